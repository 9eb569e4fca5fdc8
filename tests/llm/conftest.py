import datetime as dt
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kinds string, `when` timestamp"


def odd_documents():
    """Documents with what may go wrong: nulls in every column, empty, blank and very long texts, repeated rows, ids and texts, odd characters."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "è", "ß", "tu", "Re", "X9"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), "this licence line is shared by very many documents of ours"
    texts = [None, "", " \n\t ", "one", "two words", prose(9), prose(10), "naïve café ÀÉ", "\x0b\x0cA\r\nB\n\n", "a" * 5000, "same " * 400]
    texts += [prose(120) + " " + passage + " " + prose(30) for _ in range(4)] + [f"{line}\n{prose(20)}\n  {line.upper()}\t\n{prose(15)}" for _ in range(7)]
    base = prose(200)
    texts += [base, base, base.replace(" ", "\n", 3), base + " end", prose(4000)]
    t = dt.datetime(2026, 1, 1)
    rows = [(i * 10, x, ["en", "de", None][i % 3], "src0", None if x is None else len(x), 0.5, "k", t) for i, x in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[13], None, None, None, None, None, None), (None, line, None, None, None, None, None, None), (120, "another text with an id that is there already", None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i * 10, i % 2, (i // 2) % 2) for i in range(25)] + [(None, 1, 1), (30, None, None), (40, 1, 1), (99999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    text = odd_documents()[11][1].split()
    rows = [(1, " ".join(text[100:125]).upper()), (2, "two words"), (3, None), (4, ""), (None, " ".join(text[130:145])), (5, " ".join(text[105:120])), (5, "another text with"), (6, "words that occur nowhere at all in any of these documents here")]
    return spark.createDataFrame(rows, "item_id long, text string")
