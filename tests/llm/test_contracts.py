"""Operators against brute force, on documents in which everything odd occurs."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from terraspark.llm import decontaminate, linededup, search, simhash, substring

key = lambda rows: sorted(rows, key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents of a small vocabulary, in which lines, passages and whole texts recur in every way."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        t = rng.choice(["\n", " ", "\n "]).join(parts)
        if rng.random() < 0.3:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        rows.append((i, t if rng.random() < 0.9 else rows[rng.randrange(len(rows))][1] if rows else t))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


def run_lines(df, **more):
    out = linededup.dedup_lines(df, **more)
    return key(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(mixed, odd, batches, fanout):
    assert run_lines(mixed, batches=batches, fanout=fanout) == key(brute.line_dedup(pairs(mixed)))
    assert run_lines(odd, batches=batches, fanout=fanout) == key(brute.line_dedup(pairs(odd)))


def test_line_dedup_by_merge_join(mixed, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL_ROWS", 0)
    assert run_lines(mixed) == key(brute.line_dedup(pairs(mixed)))


def test_line_dedup_is_native(odd):
    plan = linededup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def run_hits(df, items, **more):
    out = decontaminate.scan(df, items, **more).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
    return key(tuple(r) for r in out.collect())


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_decontamination(odd, benchmark, most):
    want = key(brute.decontaminate(pairs(odd), [tuple(r) for r in benchmark.collect()]))
    assert run_hits(odd, benchmark, max_windows=most) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_decontamination_of_mixed(mixed, spark):
    rows = pairs(mixed)
    items = [(i, " ".join(t.split()[3:40])) for i, t in rows[:20]]
    assert run_hits(mixed, spark.createDataFrame(items, "item_id long, text string")) == key(brute.decontaminate(rows, items))


def test_decontamination_removes(odd, benchmark):
    clean = sum(not r[-1] for r in brute.decontaminate(pairs(odd), [tuple(r) for r in benchmark.collect()]))
    docs = decontaminate.decontaminate(odd, benchmark)
    assert docs.columns == odd.columns and docs.count() == clean < odd.count()
    spans = decontaminate.decontaminate(odd, benchmark, remove="spans")
    assert spans.columns == odd.columns and spans.count() == odd.count()
    again = decontaminate.scan(spans, benchmark).agg(F.sum(F.col("contaminated").cast("int"))).first()[0]
    assert again <= 1


def run_simhash(df):
    return key(tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())


def test_simhash(mixed, odd, monkeypatch):
    assert run_simhash(odd) == key(brute.simhash(pairs(odd)))
    want = key(brute.simhash(pairs(mixed)))
    assert run_simhash(mixed) == want
    monkeypatch.setattr(simhash, "CROWD", 3)
    assert run_simhash(mixed) == want


def test_simhash_links_within_crowds(spark):
    """Many fingerprints in few entries, with and without blocks."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(25):
            q = p
            for _ in range(rng.randint(0, 6)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {}
    for i, s in enumerate(signed):
        want.setdefault(find(i), set()).add(s)
    for crowd in (4096, 5):
        found = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd))
        got = {}
        for r in found.collect():
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_keep_one(odd, mixed):
    for df in (odd.where("doc_id IS NULL OR doc_id <> 120"), mixed):  # 120 is the id of two different texts, which both stay
        groups = {}
        for i, _, c in brute.simhash(pairs(df)):
            groups.setdefault(c, set()).add(i)
        out = simhash.keep_one(df)
        ids = [r.doc_id for r in out.collect()]
        assert out.columns == df.columns and len(ids) == len(set(ids))
        assert set(ids) >= {c for c in groups if c is not None} and set(ids) <= set(groups)


def run_passages(df, **more):
    out = substring.dedup_passages(df, **more)
    return key(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect())


def test_passages(mixed, odd):
    assert run_passages(odd) == key(brute.substring(pairs(odd)))
    assert run_passages(mixed) == key(brute.substring(pairs(mixed)))
    assert run_passages(mixed, window=12) == key(brute.substring(pairs(mixed), 12))


def test_passages_with_crowded_anchors(mixed, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 3)
    monkeypatch.setattr(substring, "HELD", 20)
    assert run_passages(mixed) == key(brute.substring(pairs(mixed)))


def test_search(mixed, odd):
    for df in (mixed, odd):
        got = [tuple(r) for r in search.search(df, df.where("doc_id % 50 = 0")).collect()]
        want = brute.bm25(pairs(df))
        if df is odd:  # of rows with one id, any text may be the query
            got, want = ([x for x in v if x[0] not in (120,)] for v in (got, want))
        assert key((q, r, d, round(s, 6)) for q, r, d, s in got) == key((q, r, d, round(s, 6)) for q, r, d, s in want)


def test_search_in_many_shards_and_blocks(mixed, monkeypatch):
    for name, value in (("SHARD_DOCS", 20), ("MOST_DOCS", 25), ("QUERY_TERMS", 60), ("LONG", 3), ("BLOCK", 2)):
        monkeypatch.setattr(search, name, value)
    got = [tuple(r) for r in search.search(mixed, mixed.where("doc_id % 50 = 0")).collect()]
    assert key((q, r, d, round(s, 6)) for q, r, d, s in got) == key((q, r, d, round(s, 6)) for q, r, d, s in brute.bm25(pairs(mixed)))


def test_empty_tables(none, benchmark):
    assert linededup.dedup_lines(none).count() == 0
    assert decontaminate.scan(none, benchmark).count() == 0
    assert decontaminate.scan(none, benchmark.limit(0)).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert substring.dedup_passages(none).count() == 0
    assert search.search(none, none).count() == 0


def test_other_columns_stay(odd, benchmark):
    for out in (linededup.dedup_lines(odd), decontaminate.scan(odd, benchmark), substring.dedup_passages(odd)):
        assert set(odd.columns) <= set(out.columns)
        assert out.where("source = 'src0'").count() == odd.where("source = 'src0'").count()
    clash = odd.withColumnsRenamed({"n_chars": "n_words", "lang": "N_LINES", "source": "component_id", "score": "fingerprint"})
    assert linededup.dedup_lines(clash).select("n_lines").dtypes == [("n_lines", "bigint")]
    assert decontaminate.scan(clash, benchmark).select("n_words").dtypes == [("n_words", "bigint")]
    assert simhash.near_duplicates(clash).select("component_id").dtypes == [("component_id", "bigint")]
    assert substring.dedup_passages(clash).select("n_words").dtypes == [("n_words", "bigint")]
