"""Passages located by their automaton, and by it alone."""

import random

import brute
import pytest

from terraspark.llm import substring


def texts(seed):
    rng = random.Random(seed)
    stock = [[f"s{k}w{i}" for i in range(rng.randint(8, 40))] for k in range(4)]
    out = []
    for _ in range(12):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(stock) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
        out.append(" ".join(w))
    return [*out, "", "same " * 900, "same " * 40]


@pytest.mark.parametrize("part", [1 << 20, 60])
def test_occurrences_are_all_found_and_only_by_passages(part, monkeypatch):
    monkeypatch.setattr(substring, "PART", part)
    window = 10
    for seed in range(6):
        rows = list(enumerate(texts(seed)))
        found = substring.recurring([t.encode() for _, t in rows], [1] * len(rows), window)
        every = sorted({p for mine in found for p in mine})
        assert every and all(window <= len(p.split()) <= max(substring.LONGEST, 2 * window) for p in every)

        def run(known):
            locator = substring.Locator()
            for p in known:
                locator.add(p)
            out = []
            for i, t in rows:
                n, spans = locator.spans(t.encode())
                mask = substring.tk.cover(n, spans[:, 0], spans[:, 1]) if len(spans) else None
                out.append((i, n, 0 if mask is None else int(mask.sum()), brute.sha(substring._without(t.encode(), mask))))
            return out

        want = brute.substring(rows, window)
        assert run(every) == want
        assert all(r[2] == 0 for r in run([]))
        # Without the passages that hold a word, no occurrence of that word goes.
        word = max(every, key=len).split()[0]
        fewer = run([p for p in every if word not in p.split()])
        assert sum(r[2] for r in fewer) <= sum(r[2] for r in want) - sum(t.encode().split().count(word) for _, t in rows if word.decode() in t.split() and any(word in p.split() for p in found[_]))
