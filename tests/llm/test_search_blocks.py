"""Queries of a search in several blocks, and several queries of a shard together."""

import random

import brute
import numpy as np

from terraspark.llm import search


def test_blocks_share_one_pass_over_the_index(spark, monkeypatch):
    """The index goes to the searchers once, however many blocks of queries there are."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{i}" for i in range(200)], k=rng.randint(3, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    passes, made = [], search._searcher
    monkeypatch.setattr(search, "_searcher", lambda blocks, *rest: passes.append(blocks) or made(blocks, *rest))
    for name, value in (("SHARD_DOCS", 40), ("MOST_DOCS", 60), ("QUERY_TERMS", 30), ("TASK_SHARDS", 2)):
        monkeypatch.setattr(search, name, value)
    got = sorted((q, r, d, round(s, 6)) for q, r, d, s in search.search(docs, docs.where("doc_id % 25 = 0")).collect())
    assert len(passes) == 1 and len(passes[0]) > 2
    monkeypatch.undo()
    assert got == sorted((q, r, d, round(s, 6)) for q, r, d, s in search.search(docs, docs.where("doc_id % 25 = 0")).collect())
    assert [x for x in got if x[0] % 50 == 0] == sorted((q, r, d, round(s, 6)) for q, r, d, s in brute.bm25(rows))


def test_queries_together_find_what_each_finds_alone():
    """With and without thresholds, with long lists and short ones, over more queries than go together."""
    rng = np.random.default_rng(3)
    n, words, k = 700, 900, 10
    terms = np.arange(words, dtype=np.int64) * 7 - 3000
    lists = [np.sort(rng.choice(n, max(1, int(n * 0.7 / (1 + t / 12))), replace=False)).astype(np.int32) for t in range(words)]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    docs, freqs = np.concatenate(lists), rng.integers(1, 5, edge[-1]).astype(np.int32)
    norm = 1.2 * (0.25 + 0.75 * rng.integers(20, 300, n) / 120)
    idf = np.log(1 + (n - np.diff(edge) + 0.5) / (np.diff(edge) + 0.5))
    impact = freqs * 2.2 / (freqs + norm[docs])
    asked = [np.unique(rng.integers(0, words, rng.integers(1, 60))) for _ in range(150)]
    shard = search.Shard(list(range(n)), terms, edge, docs, freqs.copy(), norm)
    at = shard.weigh(terms, idf)
    assert (at == np.arange(words)).all() and len(shard.by_doc) > 20
    starts = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
    for part in (0.0, 0.6, 1.0):
        want, floor = [], np.zeros(len(asked))
        for q, t in enumerate(asked):
            score = np.zeros(n)
            for x in t:
                score[docs[edge[x] : edge[x + 1]]] += idf[x] * impact[edge[x] : edge[x + 1]]
            score = np.round(score, 9)
            last = np.sort(score)[-k]
            floor[q] = round(part * last, 6)
            want.append({(d, score[d].round(6)) for d in np.flatnonzero((score >= max(last, floor[q])) & (score > 0))})
        got = [set() for _ in asked]
        for q, found, score in shard.answer(at[np.concatenate(asked)], starts, floor, k):
            got[q] = set(zip(found.tolist(), score.round(6).tolist()))
        assert got == want
