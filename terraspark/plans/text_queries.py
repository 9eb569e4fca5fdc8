"""Queries of the text, parsing and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CATEGORIES, CATEGORY_ALIASES, SEARCH_GROUPS
from ..functions import text
from ..operators import textindex
from .registry import query, table
from .views import PLACES, places

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("txt_01_tokens", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("txt_02_analysed", rf"SELECT doc_id, md5(array_to_string(CASE WHEN lang = 'fr' THEN list_transform(t, lambda x: regexp_replace(x, '^[ldsnLDSN]''', '')) ELSE t END, ' ')) AS digest FROM (SELECT doc_id, lang, {_TOK} AS t FROM documents)")
def analysed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(text.analysed("text", "lang"), " ")).alias("digest"))


@query("txt_03_ascii_tokens", f"SELECT doc_id, md5(array_to_string(list_transform({_TOK}, lambda x: strip_accents(x)), ' ')) AS digest FROM documents WHERE lang <> 'de' OR lang = 'de'")
def ascii_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array_join(text.tokens("text"), " ").alias("t"))
    return t.select("doc_id", F.md5(text.strip_diacritics("t")).alias("digest"))


@query("txt_04_strip_diacritics", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def strip_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_diacritics("text")).alias("digest"))


_AR = ["مُحَمَّد", "أحمد", "إسلام", "آمنة", "ٱلسوق", "السوق الكبير", "مسجد"]


@query("txt_05_arabic", "SELECT n_nationkey, regexp_replace(translate(x, 'أإآٱ', 'اااا'), '[ً-ٟؐ-ؚٰ]', '', 'g') AS plain FROM (SELECT n_nationkey, [" + ", ".join(repr(x) for x in _AR) + f"][n_nationkey % {len(_AR)} + 1] AS x FROM nation)")
def arabic(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in _AR]), (F.col("n_nationkey") % len(_AR) + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", text.arabic(word).alias("plain"))


@query("txt_06_french_elision", "SELECT c_custkey, regexp_replace(x, '^[ldsnLDSN]''', '') AS word FROM (SELECT c_custkey, ['l''', 'd''', 'S''', 'qu''', ''][c_custkey % 5 + 1] || c_mktsegment AS x FROM customer)")
def french_elision(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in ("l'", "d'", "S'", "qu'", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", text.french_elision(F.concat(head, "c_mktsegment")).alias("word"))


@query("txt_07_language")
def language(spark, d):
    """Languages that script and common words tell, beside the labelled one."""
    t = table(spark, d, "documents").select(F.col("lang"), text.language("text").alias("found"))
    return t.groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


@query("txt_08_phonetic")
def phonetic(spark, d):
    return table(spark, d, "part").select("p_partkey", text.phonetic("p_name").alias("code"))


_DOCS = f"WITH {PLACES}, docs AS (SELECT source || ':' || key AS doc_id, name, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t, lat, lon, n_name AS country, [{', '.join(repr(c) for c in CATEGORIES)}][category_ord + 1] AS category, 1 + category_ord % 5 AS popularity FROM places JOIN nation ON n_nationkey = nation_key), post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY doc_id, term)"


def _docs(spark, d):
    p = places(spark, d).join(F.broadcast(table(spark, d, "nation")), F.col("nation_key") == F.col("n_nationkey"))
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("category_ord") + 1).cast("int"))
    return p.select(F.concat("source", F.lit(":"), "key").alias("doc_id"), "name", "lat", "lon", F.col("n_name").alias("country"), cat.alias("category"), (1 + F.col("category_ord") % 5).alias("popularity"))


@query("txt_09_postings", f"{_DOCS} SELECT 'name' AS field, term, doc_id, tf, dl FROM post UNION ALL SELECT 'name_ascii', term, doc_id, tf, dl FROM post")
def index_postings(spark, d):
    docs = _docs(spark, d)
    fields = {k: v for k, v in textindex.place_fields(docs).items() if k != "name_phonetic"}
    return textindex.postings(docs, fields)


@query("txt_10_term_stats", f"{_DOCS} SELECT 'name' AS field, term, count(*) AS df, (SELECT count(*) FROM docs) AS n, round((SELECT avg(len(t)) FROM docs), 9) AS avgdl FROM post GROUP BY term")
def index_stats(spark, d):
    docs = _docs(spark, d)
    found = textindex.postings(docs, {"name": text.tokens("name")})
    return textindex.term_stats(found, docs.count()).select("field", "term", "df", "n", F.round("avgdl", 9).alias("avgdl"))


#: Every place asks for its own name within its own country.
_MATCH = f"""{_DOCS}, q AS (SELECT doc_id AS request, name AS q, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS words FROM docs),
f AS (SELECT term, count(*) AS df FROM post GROUP BY term), a AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
rare AS (SELECT request, arg_min(q.term, (df, q.term)) AS term, any_value(words) AS words FROM q JOIN f USING (term) GROUP BY request),
cand AS (SELECT request, words, doc_id FROM rare JOIN post USING (term)),
m AS (SELECT c.request, c.doc_id, sum(2 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25, count(*) AS matched, any_value(c.words) AS words
      FROM cand c JOIN q ON q.request = c.request JOIN post p ON p.doc_id = c.doc_id AND p.term = q.term JOIN f ON f.term = p.term, a GROUP BY c.request, c.doc_id),
hits AS (SELECT request, doc_id, bm25 FROM m WHERE matched = words)"""


def _requests(docs):
    return docs.select(F.col("doc_id").alias("request"), F.col("name").alias("q"), "country", "category", "lat", "lon", F.lit(50.0).alias("radius_km"))


@query("txt_11_all_words", f"{_MATCH} SELECT request, doc_id FROM hits")
def all_words(spark, d):
    docs = _docs(spark, d)
    return textindex.search_all(_requests(docs), docs, ["name", "name_ascii"], []).select("request", "doc_id")


@query("txt_12_bm25", f"{_MATCH} SELECT request, doc_id, round(bm25, 6) AS bm25 FROM hits")
def bm25(spark, d):
    docs = _docs(spark, d)
    return textindex.search_all(_requests(docs), docs, ["name", "name_ascii"], []).select("request", "doc_id", F.round("bm25", 6).alias("bm25"))


_COUNTRY = f"""{_MATCH}, cf AS (SELECT country, count(*) AS cdf FROM docs GROUP BY country),
h2 AS (SELECT h.request, h.doc_id, bm25 + ln(1 + (n - cdf + 0.5) / (cdf + 0.5)) AS bm25, o.name, lower(o.name) = lower(w.name) AS same FROM hits h JOIN docs o ON o.doc_id = h.doc_id JOIN docs w ON w.doc_id = h.request AND w.country = o.country JOIN cf ON cf.country = o.country, a)"""


@query("txt_13_geocode", f"""{_COUNTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM h2)
SELECT request, rank, doc_id, name, round(least(1.0, bm25 / max(bm25) OVER (PARTITION BY request) + 0.1 + CASE WHEN same THEN 0.15 ELSE 0.0 END), 6) AS confidence FROM r WHERE rank <= 5""")
def geocode(spark, d):
    docs = _docs(spark, d)
    req = _requests(docs)
    scored = textindex.search_all(req, docs, ["name", "name_ascii"], ["country"])
    return textindex.rank_geocode(scored, docs, req).withColumn("confidence", F.round("confidence", 6))


_BLEND = """w AS (SELECT h.request, h.doc_id, o.name, bm25 / max(bm25) OVER (PARTITION BY h.request) AS share, o.popularity, o.category = u.category AS same,
 6371.0::DOUBLE * 2 * atan2(sqrt(pow(sin(radians(o.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - u.lon) / 2), 2)), sqrt(1 - (pow(sin(radians(o.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - u.lon) / 2), 2)))) AS km
 FROM r h JOIN docs o ON o.doc_id = h.doc_id JOIN docs u ON u.doc_id = h.request WHERE rank0 <= 30),
s AS (SELECT request, doc_id, name, km, 0.4 * share + 0.4 / (1 + km) + 0.1 * greatest(log2(popularity), 0) / 20 + 0.1 * CASE WHEN same THEN 0.1 ELSE 0 END AS score FROM w WHERE km <= 50),
z AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT request, rank, doc_id, name, round(km, 6) AS distance_km, round(score, 6) AS score FROM z WHERE rank <= 10"""


def _rounded(df):
    return df.withColumns({"distance_km": F.round("distance_km", 6), "score": F.round("score", 6)})


@query("txt_14_place_search", f"{_MATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(bm25, 9) DESC, doc_id) AS rank0 FROM hits), {_BLEND}")
def place_search(spark, d):
    docs = _docs(spark, d)
    req = _requests(docs)
    return _rounded(textindex.rank_places(textindex.search_all(req, docs, ["name", "name_ascii"], []), docs, req))


@query("txt_14_category_browse", f"{_DOCS}, a AS (SELECT count(*) AS n FROM docs) SELECT category, doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS bm25 FROM docs JOIN (SELECT category, count(*) AS df FROM docs GROUP BY category) USING (category), a")
def category_browse(spark, d):
    docs = _docs(spark, d)
    req = docs.select(F.col("category").alias("request"), F.lit("").alias("q"), "category").distinct()
    return textindex.browse(req, docs).select(F.col("request").alias("category"), "doc_id", F.round("bm25", 6).alias("bm25"))


@query("txt_15_starts_with", f"{_DOCS}, q AS (SELECT 'r' || n_nationkey AS request, lower(substr(n_name, 1, 3)) AS prefix FROM nation UNION ALL SELECT 's', 'suppl' UNION ALL SELECT 'z', '00000001'), h AS (SELECT DISTINCT request, doc_id, name FROM (SELECT doc_id, name, unnest(t) AS word FROM docs) JOIN q ON starts_with(word, prefix)) SELECT request, row_number() OVER (PARTITION BY request ORDER BY name, doc_id) AS rank, doc_id, name FROM h QUALIFY rank <= 10")
def completion(spark, d):
    docs = _docs(spark, d)
    req = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("request"), F.substring("n_name", 1, 3).alias("q"))
    return textindex.starts_with(docs, req.unionByName(spark.createDataFrame([("s", "suppl"), ("z", "00000001")], "request string, q string")))


_GROUPS = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in SEARCH_GROUPS.items()) + " ELSE [] END"


@query("txt_16_search_groups", f"SELECT p_partkey, array_to_string({_GROUPS}, ',') AS covers FROM (SELECT p_partkey, {[*SEARCH_GROUPS, 'Hotel', 'garage']}[p_partkey % {len(SEARCH_GROUPS) + 2} + 1] AS x FROM part)")
def search_groups(spark, d):
    names = [*SEARCH_GROUPS, "Hotel", "garage"]
    x = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.search_group(x), ",").alias("covers"))


_ALIASES = [a for v in CATEGORY_ALIASES.values() for a in v] + ["garage"]


@query("str_08_category_alias", f"SELECT p_partkey, x AS alias, CASE {' '.join(f'WHEN x IN {v!r} THEN {k!r}' if len(v) > 1 else f'WHEN x = {v[0]!r} THEN {k!r}' for k, v in CATEGORY_ALIASES.items())} END AS category FROM (SELECT p_partkey, {_ALIASES}[p_partkey % {len(_ALIASES)} + 1] AS x FROM part)")
def category_alias(spark, d):
    x = F.element_at(F.array(*[F.lit(n) for n in _ALIASES]), (F.col("p_partkey") % len(_ALIASES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", x.alias("alias")).withColumn("category", text.category_of("alias"))


@query("str_07_similarity", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 9) AS similarity FROM nation a, nation b")
def similarity(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))))
    return pairs.select("a", "b", F.round(text.levenshtein_similarity("x", "y"), 9).alias("similarity"))


@query("str_05_full_address", "SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'X' END, NULL, 'Ghana') AS address FROM customer")
def full_address(spark, d):
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    return table(spark, d, "customer").select("c_custkey", text.full_address(F.when(k % 2 == 0, F.col("c_name")), "c_mktsegment", F.when(k % 3 == 0, "X"), null, F.lit("Ghana")).alias("address"))


@query("str_06_primary_name", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS name FROM customer")
def primary_name(spark, d):
    n = lambda lang, c: F.struct(F.lit(lang).alias("lang"), F.col(c).alias("name"))
    none = F.array().cast("array<struct<lang:string,name:string>>")
    names = F.when(F.col("c_custkey") % 3 == 0, none).when(F.col("c_custkey") % 3 == 1, F.array(n("en", "c_name"))).otherwise(F.array(n("en", "c_name"), n("fr", "c_mktsegment")))
    return table(spark, d, "customer").withColumn("names", names).select("c_custkey", text.primary_name("names", "fr").alias("name"))


_ASK = "SELECT event_id, ['Makola Market, Accra', 'shop near Big Tower, Osu, Accra', 'Oxford Street, Osu', 'Accra Mall', '', 'behind the school', 'Ring Road', 'a, b, c, d', 'opposite'][event_id % 9 + 1] || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' x' END AS q FROM events"


def _asked(spark, d):
    texts = ("Makola Market, Accra", "shop near Big Tower, Osu, Accra", "Oxford Street, Osu", "Accra Mall", "", "behind the school", "Ring Road", "a, b, c, d", "opposite")
    q = F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 9 + 1).cast("int")), F.when(F.col("event_id") % 2 == 0, "").otherwise(" x"))
    return table(spark, d, "events").select("event_id", q.alias("q"), F.lit("en").alias("lang")).withColumn("p", text.parse_query("q", "lang"))


_PARSE = f"""WITH a AS ({_ASK}), s AS (SELECT event_id, string_split(q, ',') AS s FROM a), t AS (SELECT event_id, s, CASE WHEN len(s) >= 3 THEN 2 WHEN len(s) = 2 THEN 1 ELSE 0 END AS k FROM s),
r AS (SELECT event_id, s, k, trim(array_to_string(s[1:len(s) - k], ',')) AS rest FROM t),
w AS (SELECT *, CASE WHEN contains(lower(rest), 'near') THEN 'near' WHEN contains(lower(rest), 'behind') THEN 'behind' WHEN contains(lower(rest), 'past') THEN 'past' WHEN contains(lower(rest), 'beside') THEN 'beside' WHEN contains(lower(rest), 'opposite') THEN 'opposite' END AS rel FROM r),
m AS (SELECT *, CASE WHEN rel IS NOT NULL THEN nullif(trim(substr(rest, instr(lower(rest), rel) + length(rel))), '') END AS mark FROM w)"""


@query("qry_02_locality", f"{_PARSE} SELECT event_id, CASE WHEN k = 2 THEN trim(s[len(s) - 1]) END AS neighborhood, CASE WHEN k > 0 THEN trim(s[len(s)]) END AS city FROM m")
def locality(spark, d):
    return _asked(spark, d).select("event_id", "p.neighborhood", "p.city")


@query("qry_03_relation", f"{_PARSE} SELECT event_id, CASE WHEN mark IS NOT NULL THEN rel END AS relation, mark AS landmark FROM m")
def relation(spark, d):
    return _asked(spark, d).select("event_id", "p.relation", "p.landmark")


@query("qry_04_street", f"{_PARSE} SELECT event_id, CASE WHEN rel IS NULL AND regexp_matches(rest, '(Street|Road|Avenue|Blvd|Lane)$') THEN rest END AS street FROM m")
def street(spark, d):
    return _asked(spark, d).select("event_id", "p.street")


@query("qry_05_words", f"{_PARSE} SELECT event_id, CASE WHEN rel IS NULL AND NOT regexp_matches(rest, '(Street|Road|Avenue|Blvd|Lane)$') THEN array_to_string(list_filter(regexp_split_to_array(rest, '\\s+'), lambda x: x <> ''), '|') ELSE '' END AS words FROM m")
def words(spark, d):
    return _asked(spark, d).select("event_id", F.array_join("p.tokens", "|").alias("words"))


@query("qry_01_parse", f"{_PARSE} SELECT CASE WHEN mark IS NOT NULL THEN 'landmark' WHEN rel IS NOT NULL THEN 'nothing' WHEN regexp_matches(rest, '(Street|Road|Avenue|Blvd|Lane)$') THEN 'street' WHEN rest <> '' THEN 'words' ELSE 'nothing' END AS kind, count(*) AS n FROM m GROUP BY 1")
def parse(spark, d):
    p = _asked(spark, d)
    kind = F.when(F.col("p.landmark").isNotNull(), "landmark").when(F.col("p.street").isNotNull(), "street").when(F.size("p.tokens") > 0, "words").otherwise("nothing")
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("qry_06_resolve")
def resolve(spark, d):
    """Requests by name, by street and by landmark, one for every place."""
    docs = _docs(spark, d)
    k = F.crc32("doc_id") % 3
    q = F.when(k == 0, F.col("name")).when(k == 1, F.concat("name", F.lit(", "), "country")).otherwise(F.concat(F.lit("near "), F.col("name")))
    req = docs.select(F.col("doc_id").alias("request"), q.alias("q"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("country"))
    return textindex.resolve(req, docs, docs.where(F.col("category").isin("hospital", "market", "mosque")))
