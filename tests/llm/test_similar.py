"""Near copies by word shingles against all pairs."""

import random

import brute

import corpus_pipeline
from compare import DATA
from terraspark.llm import similar


def alike(rows):
    """All pairs at or above similarity 0.8 over five-word shingles."""
    sets = []
    for i, t in rows:
        w = brute.WORD.findall((t or "").translate(brute.FOLD))
        sets.append((i, {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()))
    return {(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y))}


def edited(rng, vocab):
    rows = []
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 30, 120, 400]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_links_are_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = edited(rng, [f"w{i}" for i in range(300)]) + [(900, None), (901, " "), (902, "")]
    df = spark.createDataFrame(rows, "key long, text string").repartition(4)
    want = {(min(p), max(p)) for p in alike(rows)}
    assert len(want) > 20
    for repeated in (500_000, 50):
        monkeypatch.setattr(similar, "REPEATED", repeated)
        got = [tuple(r) for r in similar.links(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, f"{DATA}/sf0.01")
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    simhash = {g for *_, g in brute.simhash([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    of = alike([r for r in rows if r[0] in simhash])
    assert of and not alike(list(kept.items()))
    # What goes beyond SimHash is linked to another, and the least id of its group stays.
    up = {i: i for p in of for i in p}
    for _ in up:
        for a, b in of:
            up[a] = up[b] = min(up[a], up[b])
    assert set(kept) == {i for i in simhash if up.get(i, i) == i}


def groups(pairs):
    up = {i: i for p in pairs for i in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_connections_join_what_links_join(spark, monkeypatch):
    rng = random.Random(9)
    rows = edited(rng, [f"w{i}" for i in range(300)]) + [(900, None), (901, " "), (902, "")]
    # A dense group, and documents that share most entries with it but are not all alike.
    base = [f"d{i}" for i in range(100)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 4])):
            w[rng.randrange(100)] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "key long, text string").repartition(4)
    pairs = alike(rows)
    want = groups(pairs)
    dense = sum(min(p) >= 1000 for p in pairs)
    for crowd, small in ((4096, 32), (20, 4)):
        monkeypatch.setattr(similar, "CROWD", crowd)
        monkeypatch.setattr(similar, "SMALL", small)
        got = [tuple(r) for r in similar.connections(df).distinct().collect()]
        assert {(max(p), min(p)) for p in got} <= {(max(p), min(p)) for p in pairs}
        assert groups(got) == want
        assert sum(min(p) >= 1000 for p in got) < dense


def test_only_what_is_read_later_stays(spark, monkeypatch):
    from terraspark.llm import shared

    made, gone = [], []
    new, remove = shared.new_path, shared.remove
    monkeypatch.setattr(shared, "new_path", lambda s, n: made.append(new(s, n)) or made[-1])
    monkeypatch.setattr(shared, "remove", lambda s, p: gone.append(p) or remove(s, p))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "other words"), (3, "other words")], "doc_id long, text string")
    out = similar.keep_one(docs)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(made) - set(gone)}
    assert left == {"similar-documents", "similar-gone"} and len(gone) > 5


def test_texts_that_share_a_shingle_by_chance_are_not_joined(spark, monkeypatch):
    """Such pairs grow with the square of the documents; only pairs that may be similar get their texts."""
    rng = random.Random(9)
    rows = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(40)] + [f"p{i % 3}{k}" for k in range(12)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    texts, real = [], similar.materialise

    def spy(df, name, **kw):
        out = real(df, name, **kw)
        if name == "similar-texts":
            texts.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialise", spy)
    monkeypatch.setattr(similar, "REPEATED", 1)  # as of more documents, whose sample knows few of the repeated shingles
    df = spark.createDataFrame(rows, "key long, text string").repartition(4)
    assert {tuple(r) for r in similar.links(df).collect()} == {(min(p), max(p)) for p in alike(rows)}
    assert sum(texts) == 10


def test_signatures_never_tell_similar_texts_apart(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(10)
    rows = [(k, " ".join(w)) for k, w in enumerate(ws for n in (3, 60, 500, 520, 1000, 1040, 3000) for base in [[f"w{rng.randrange(9000)}" for _ in range(n)]] for ws in (base, base[: n - n // 12], [*base, *[f"x{i}" for i in range(n // 8)]]))]
    made = similar._signatures(spark.createDataFrame(rows, "key long, text string"), 5).orderBy("key").collect()
    i, j = np.triu_indices(len(made), 1)
    n, bits = np.array([r.n for r in made]), [r.bits for r in made]
    got = similar._may_be_similar(n[i], pa.array([bits[k] for k in i], pa.binary()), n[j], pa.array([bits[k] for k in j], pa.binary()))
    found = {(a, b) for a, b, g in zip(i.tolist(), j.tolist(), got.tolist(), strict=True) if g}
    want = {(min(p), max(p)) for p in alike(rows)}
    assert want and want <= found and len(found) < 2 * len(want)
