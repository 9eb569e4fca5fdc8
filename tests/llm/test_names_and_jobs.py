"""Cases that went wrong once."""

import pyspark.sql.readwriter as readwriter

from terraspark.llm import linededup, sharding


def test_keys_may_have_the_outputs_names(odd):
    df = odd.withColumnsRenamed({"lang": "shard", "source": "slot"})
    plain = {r.doc_id: r.shard for r in sharding.place(odd, ["lang", "source"], ["a", "b", "c"], 101).where("lang IS NOT NULL").select("doc_id", "shard").collect()}
    out = sharding.place(df, ["shard", "slot"], ["a", "b", "c"], 101)
    assert out.count() == odd.count() and out.columns.count("shard") == out.columns.count("slot") == 1
    # 120 is the id of a row without keys, too.
    named = {r.doc_id: r.shard for r in out.select("doc_id", "shard").collect() if r.doc_id not in (None, 120)}
    plain = {k: v for k, v in plain.items() if k in named}
    assert len(plain) > 10 and all(named[k] == v for k, v in plain.items())


def test_no_job_of_line_dedup_leaves_the_jvm(odd, monkeypatch):
    """Plans of everything that is written on the way, and of the result."""
    plans, init = [], readwriter.DataFrameWriter.__init__

    def spy(self, df):
        plans.append(df._jdf.queryExecution().toString())
        init(self, df)

    monkeypatch.setattr(readwriter.DataFrameWriter, "__init__", spy)
    out = linededup.dedup_lines(odd)
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 5
    assert not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow", "MapInArrow"))
    # Runs are read in their buckets, without a shuffle of theirs.
    joins = [p for p in plans if "line_run" in p and "SortMergeJoin" in p]
    assert joins and all("Bucketed: true" in p for p in joins)
