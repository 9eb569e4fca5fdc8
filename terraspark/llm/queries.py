"""The registered queries opN_<name>: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, packing, pii, quality, search, sharding, simhash, substring, toxicity
from .shared import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(df: DataFrame, held, at: float) -> list:
    return [F.col("doc_id"), held.alias("held_out"), F.col("score"), (F.col("score") >= at).cast("int").alias("predicted")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select(*_scored(scored, fold(F.col("doc_id"), 4) == 2, 0.3), F.col("toxic").alias("over_language_threshold"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (SELECT rowid_ AS r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS t FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.top IS NOT NULL AND coalesce(k.doc_id < c.top, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(docs, docs.where(F.col("doc_id") % 50 == 0)).withColumn("score", F.round("score", 6))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT r, doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY r, doc_id, term),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM p WHERE doc_id % 50 = 0),
s AS (SELECT query_id, r, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, r, doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)),
d AS (SELECT r, doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
h AS (SELECT d.r, d.i, d.k, b.item_id FROM d JOIN b ON d.k = b.k AND d.g = b.g),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
c AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN c USING (g)),
kept AS (SELECT w.r, count(*) FILTER (hit.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (hit.p IS NULL) AS t
         FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) w LEFT JOIN hit ON w.r = hit.r AND w.p = hit.p GROUP BY w.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


#: For tables without a secret of their own; a deployment sets spark.terraspark.pii.key.
SAMPLE_KEY = "not-a-secret"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.terraspark.pii.key", SAMPLE_KEY)
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode())
    return out.select("doc_id", "n_found", F.to_json("kinds").alias("kinds"), "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, net)
    return scored.select(*_scored(scored, fold(F.col("doc_id"), 3) == 1, 0.5))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_packing, op4_search, op5_decontaminate, op6_simhash, op7_sharding, op8_substring_dedup, op9_pii, op10_quality)}
ORACLES = {"op2_line_dedup": OP2_SQL, "op4_search": OP4_SQL, "op5_decontaminate": OP5_SQL, "op8_substring_dedup": OP8_SQL}
