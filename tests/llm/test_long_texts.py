"""Texts far longer than what is worked on at once."""

import random
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from terraspark.llm import quality, toxicity
from terraspark.llm import textkernel as tk


def corpus(seed=4):
    rng = random.Random(seed)
    good, bad = ([f"{c}{i}" for i in range(60)] for c in "gb")
    texts, y = [], []
    for i in range(120):
        w = [rng.choice(good) for _ in range(rng.randint(1, 400))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(rng.choice([" ", "\n", ", "]).join(w))
        y.append(i % 3 == 0)
    return [*texts, "", "x" * 3000, " " * 2000, "é" * 900], np.array([*y, 0, 0, 0, 0], np.float32)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_parts_give_the_score_of_the_whole(module, monkeypatch):
    texts, y = corpus()
    net = module.train(texts, y)
    column = pa.array(texts, pa.string())
    monkeypatch.setattr(module, "PART", 1 << 30)
    whole = net.scores(*tk.buffers(column))
    for part in (200, 777, 1 << 12):
        monkeypatch.setattr(module, "PART", part)
        assert np.allclose(net.scores(*tk.buffers(column)), whole, atol=1e-5)
    assert len(set(np.round(whole, 4))) > 10


def test_a_word_longer_than_a_slice_has_a_hash_of_its_own():
    long = "ab" * (1 << 18)
    texts = [long, long[:-1] + "c", "c" + long[1:], long, "ab"]
    h = tk.word_hashes(tk.words(*tk.buffers(pa.array(texts)), tk.NOT_SPACE))
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4


CODE = """
import sys, random, resource
import numpy as np, pyarrow as pa
from terraspark.llm import textkernel as tk, {module} as m
sys.path.insert(0, "tests/llm")
from test_long_texts import corpus
net = m.train(*corpus())
rng = random.Random(1)
piece = " ".join("w%d" % rng.randrange(5000) for _ in range(1 << 17)) + "\\n"
text = {text}
column = pa.array([text], pa.large_string())
del text
assert 0 <= net.scores(*tk.buffers(column))[0] <= 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("module", ["toxicity", "quality"])
@pytest.mark.parametrize("text", ["piece * ((64 << 20) // len(piece) + 1)", "'a' * (64 << 20)"])
def test_64_mb_stay_under_a_gb(module, text):
    out = subprocess.run([sys.executable, "-c", CODE.format(module=module, text=text)], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 1024 and resource is not None
