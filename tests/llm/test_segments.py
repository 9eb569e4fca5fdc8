"""What changes with the number of rows gives the same results: SimHash segments, blocks of queries, tasks of shards."""

import random

import pytest

from terraspark.llm import search, simhash


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_segments_lose_no_link(spark, few):
    rng = random.Random(few)
    fps = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(6):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
    for word in (0, 32):
        # All four bits in one half, spread in every way over both, and in the highest bits.
        at = rng.getrandbits(64)
        fps |= {at, at ^ 0b1111 << word, at ^ 0b11 << 62 ^ 0b11 << word, at ^ 0b111 << 29, at ^ (1 << 63 | 1 << 31 | 1 << 21 | 1 << 42)}
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for f in fps:
        for g in fps:
            if f < g and (f ^ g).bit_count() <= 4:
                root[top(g)] = top(f)
    want = {}
    for f in fps:
        want.setdefault(top(f), set()).add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), few=few)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_blocks_and_tasks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    ask = docs.where("doc_id % 50 = 0")
    pick = lambda: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.search(docs, ask, k=5).collect())
    whole = pick()
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "MOST_DOCS", 60)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    monkeypatch.setattr(search, "TASK_SHARDS", 1)
    assert pick() == whole and len(whole) == 40
