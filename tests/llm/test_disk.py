"""What is left on disk while operators go on."""

import os
import time

import brute
import numpy as np

from terraspark.llm import linededup, shared, similar, substring


def shuffle_files(spark):
    """Names of the shuffle files that are there."""
    top = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def documents(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 80)) + (f" {passage}" if i % 3 == 0 else "") + f"\n{passage}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()


def gone_soon(spark, before):
    """Files are removed by the executors, a moment after they are told."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_with_the_write(spark):
    docs = documents(spark)
    before = shuffle_files(spark)
    kept = shared.materialise(docs.repartition(4, "text"), "disk")
    assert gone_soon(spark, before) and kept.count() == docs.count()


def test_passages_go_without_their_pieces(spark, monkeypatch):
    made, gone = [], []
    monkeypatch.setattr(substring, "new_path", lambda s, n, new=shared.new_path: made.append(new(s, n)) or made[-1])
    remove = shared.remove
    monkeypatch.setattr(shared, "remove", lambda s, p: gone.append(p) or remove(s, p))
    docs = documents(spark)
    out = substring.dedup_passages(docs)
    (pieces,) = [p for p in made if "/pieces-" in p]
    assert not os.path.exists(f"{pieces}/need=false") and os.path.exists(f"{pieces}/need=true")
    assert any("/anchors-" in p for p in gone)
    got = sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.text)) for r in out.collect())
    assert got == sorted(brute.substring([tuple(r) for r in docs.collect()]))


def _joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_texts_are_joined_by_one_plan_at_every_size(spark):
    """A small table isn't joined by a broadcast that a large one has no room for."""
    docs = documents(spark)
    assert _joins(linededup.dedup_lines(docs)) == (1, 0)
    rows = docs.selectExpr("doc_id AS key", "text")
    pairs = spark.createDataFrame([(0, 3), (1, 2)], "a long, b long")
    assert _joins(similar._verified(pairs, rows, 5)) == (2, 0)
