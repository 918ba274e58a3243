import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts of random words with exact and near copies, junk, a long text, nulls, blanks, and rows that repeat."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(n // 4)).capitalize() + "." for _ in range(4))
    rows = []
    for k in range(120):
        t = text(rng.choice([8, 60, 60, 200]))
        if k % 10 == 3 and rows:
            t = rows[-3][1]
        if k % 10 == 5 and rows:
            parts = rows[-2][1].split(" ")
            parts[len(parts) // 2] = "changed"
            t = " ".join(parts)
        if k % 15 == 7:
            t = " ".join(f"{w}{rng.choice(['###', '$$$'])}" for w in t.split())
        rows.append((k, t, rng.choice(["en", "de"]), f"src{k % 7}", len(t)))
    rows += [(200, None, None, None, None), (201, "", "en", "src1", 0), (202, " \n\t ", "en", "src1", 4), (203, "one", "de", "odd", 3), (None, "no id here", "en", "src1", 10), (204, text(40000), "en", "src0", 1), (204, "same id", "en", "src0", 1)]
    rows += [rows[0], rows[0]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
