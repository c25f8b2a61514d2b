import os
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def texts(seed=3, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "漢字", "x1", "token"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(25)]
    out = ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(n)]
    return [*out, out[0], out[1] + "!", "", None, "=" * 300, out[0]]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[2], (None, "no id", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
