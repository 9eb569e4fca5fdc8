"""Toxicity learns from every labelled text, however many and however long they are."""

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terraspark.llm import textkernel as tk
from terraspark.llm import toxicity


def corpus():
    """Texts of which a third has one of 40 words that three toxic texts each have; a last word is in texts of over 256 KiB alone."""
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(30)]
    prose = lambda n: [rng.choice(plain) for _ in range(n)]
    texts = [(" ".join([*prose(20), f"bad{m}", *prose(10)]), 1) for m in range(40) for _ in range(3)]
    texts += [(" ".join([*prose(90_000), "longbad"]), 1) for _ in range(3)] + [(" ".join(prose(90_000)), 0)]
    texts += [(" ".join(prose(30)), 0) for _ in range(240)]
    new = [(" ".join([*prose(15), f"bad{m}", *prose(15)]), 1) for m in range(40)] + [(" ".join([*prose(15), "longbad", *prose(5)]), 1)] + [(" ".join(prose(30)), 0) for _ in range(80)]
    return texts, new


def test_every_labelled_text_is_learnt(spark):
    texts, new = corpus()
    docs = spark.createDataFrame([(i, t, ["en", "fr", None][i % 3]) for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    fit = lambda d: toxicity.fit(d, labels, F.lit(True), max_rows=20, max_bytes=1 << 20)
    model = fit(docs.repartition(3))
    score = model.scores(*tk.buffers(pa.array([t for t, _ in new], pa.string())))
    y = np.array([y for _, y in new])
    assert (score[y == 1] > np.quantile(score[y == 0], 0.95)).mean() > 0.95 and score[40] > score[41:].max()
    again = fit(docs.repartition(5, "text")).scores(*tk.buffers(pa.array([t for t, _ in new], pa.string())))
    assert np.allclose(score, again, atol=1e-6)


def test_maxima_by_pieces(monkeypatch):
    texts, _ = corpus()
    some = [t[:4000] for t, _ in texts[:130:5]] + ["", "one"]
    b, first = toxicity.features(*tk.buffers(pa.array(some, pa.large_string())))
    y = (np.arange(len(some)) % 2).astype(np.float32)
    rows = np.arange(len(some))
    model = toxicity.begun(toxicity.counted(b, first, rows, y), int(y.sum()), len(y))
    whole = model.maxima(b, first, rows)
    assert np.allclose(whole[0], model.pooled(model.vectors(b), first), atol=1e-5)
    for words in (3, 17, 100):
        monkeypatch.setattr(toxicity, "WORDS", words)
        p, _ = model.maxima(b, first, rows)
        assert np.allclose(p, whole[0], atol=1e-5)


def test_calibration_by_numbers_of_rows():
    rng = np.random.default_rng(4)
    score = rng.integers(1, 20, 400) / 20
    y = (rng.random(400) < score).astype(float)
    at, back = np.unique(score, return_inverse=True)
    n, pos = np.bincount(back), np.bincount(back, y)
    assert np.allclose(toxicity.platt(score, y), toxicity.platt(at, pos, n))
    best = toxicity.calibrate(at, pos, ["en"] * len(at), n=n)
    assert set(best) == {"", "en"} and best[""] == best["en"]
    f1 = [2 * y[score >= t].sum() / ((score >= t).sum() + y.sum()) for t in at]
    assert 2 * y[score >= best[""]].sum() / ((score >= best[""]).sum() + y.sum()) >= max(f1) - 1e-12


def test_only_the_last_model_comes_to_the_driver(spark, monkeypatch):
    """What parts learn is added up elsewhere: the driver holds a model or two at a time, and gets one."""
    rng, size, got = random.Random(8), 3 * toxicity.BUCKETS * toxicity.WIDTH * 4, []
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + (" bad" if i % 3 == 0 else ""), "en") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    arrow, broadcast = type(docs).toArrow, spark.sparkContext.broadcast
    monkeypatch.setattr(type(docs), "toArrow", lambda self: got.append(arrow(self)) or got[-1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: got.append(pa.py_buffer(pickle.dumps(value))) or broadcast(value))
    tracemalloc.start()
    model = toxicity.fit(docs, labels, F.lit(True), max_rows=20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = model.scores(*tk.buffers(pa.array([t for _, t, _ in rows], pa.string())))
    assert score[::3].min() > max(score[1::3].max(), score[2::3].max())
    assert sum(x.nbytes if isinstance(x, pa.Table) else x.size for x in got) < 1.2 * size
    assert most < 4 * size


def test_model_of_its_numbers():
    model = toxicity.train(["bad one", "good two", "bad three", "good four"], np.array([1, 0, 1, 0], np.float32))
    sums = toxicity.fresh(model)
    v = toxicity._flat(model, sums)
    again, acc = toxicity._unflat(v)
    assert np.array_equal(toxicity._flat(again, acc), v) and toxicity._unflat(v[: toxicity.MODEL])[1] is None
    assert len(v) < toxicity.BIG
