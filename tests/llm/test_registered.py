"""The registered queries and the pipeline."""

import brute
import pytest
from compare import DATA, same

from pyspark.sql import functions as F

import corpus_pipeline
from terraspark.llm import queries, toxicity
from terraspark.llm.shared import fold

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLES:
        same(df, duck.sql(queries.ORACLES[name]))
    else:
        n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
        assert df.count() >= n and df.select("doc_id").distinct().count() == n


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_simhash(spark, SMALL).collect())) == sorted(brute.simhash(rows))


def test_pipeline_stages(spark):
    """Each stage against what it should do with what came before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)
    bad = {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}
    step = {n: f for n, f in corpus_pipeline.STAGES}
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    a = step["toxicity"](spark, docs, SMALL).cache()
    assert pairs(a) == [p for p in pairs(docs) if p[0] not in bad]
    b = step["line dedup"](spark, a, SMALL).cache()
    assert b.columns == docs.columns
    assert sorted((r.doc_id, brute.sha(r.text)) for r in b.collect()) == sorted((i, s) for i, _, _, s in brute.line_dedup(pairs(a)))
    c = step["simhash near-dedup"](spark, b, SMALL).cache()
    assert sorted(r.doc_id for r in c.collect()) == sorted({g for *_, g in brute.simhash(pairs(b))})
    d = step["benchmark decontamination"](spark, c, SMALL).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r.doc_id for r in d.collect()) == sorted(i for i, *_, hit in brute.decontaminate(pairs(c), items) if not hit)
    e = step["best-fit packing"](spark, d, SMALL)
    assert e.select("doc_id").distinct().count() == d.count()
    assert e.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("c")).where("n > c").count() == 0


def test_pipeline_on_odd_documents(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    assert {"doc_id", "text", "bin_id"} <= set(out.columns)
