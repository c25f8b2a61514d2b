"""Removal of repeated byte strings against a plain pass over all windows."""

import hashlib
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from claimgraph.llm import common, substrings


def brute(texts):
    """{doc_id: (n_removed, n_spans, hash of what is left)} of texts in the order of their ids."""
    seen, out = set(), {}
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = hashlib.blake2b(raw[p : p + 100], digest_size=16).digest()
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def results(df, *bounds):
    return {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substrings.dedup_substrings(df, *bounds).filter("doc_id is not null").collect()}


@pytest.mark.parametrize("bounds", [(256, 16384), (2, 4), (1, 1)])
def test_bounds_change_nothing(docs, empty, bounds):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    assert results(docs, *bounds) == brute([(r.doc_id, r.text) for r in rows])
    assert substrings.dedup_substrings(empty, *bounds).count() == 0


def test_repeats_across_slices(spark):
    """A text over two slices long that repeats itself and another one across their borders."""
    rng = random.Random(4)
    part = "".join(rng.choices("abcdefgh é", k=90_000))
    rest = "".join(rng.choices("ijklmnop", k=substrings._SLICE - 50))
    texts = [(1, part[:500]), (2, rest + part + "=" * 3000 + rest[-700:] + "y" + part), (3, part[-30_000:] + "z")]
    assert len(texts[1][1].encode()) > 2 * substrings._SLICE - 400_000
    assert results(spark.createDataFrame(texts, "doc_id long, text string")) == brute(texts)


def test_finished_steps_leave_only_spans(spark, docs):
    """Before the result is asked for, no table but the spans is left."""
    common.shared_dir(spark)
    tables = Path(common.shared_dir(spark).removeprefix("file:")) / "claimgraph"
    old = set(tables.glob("*"))
    found = substrings.dedup_substrings(docs)
    assert [p.name.rsplit("-", 1)[0] for p in set(tables.glob("*")) - old] == ["spans"]
    assert found.count() == docs.count()


#: A session of its own, as in it only the step itself can delete shuffle files.
SHUFFLES = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from claimgraph.llm import substrings
local = sys.argv[1]
conf = {"spark.cleaner.referenceTracking": "false", "spark.local.dir": local, "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
line = "the same line of over a hundred bytes that several documents hold, so that it is found again and again. "
docs = spark.createDataFrame([(i, f"{i} {line * (i % 3)}{i * 7}") for i in range(12)], "doc_id long, text string")
before = spark.conf.get(key, None)
found = substrings.dedup_substrings(docs)
until = time.time() + 10  # they are deleted in the background
files = lambda: len([*Path(local).rglob("shuffle_*.data")])
while files() and time.time() < until:
    time.sleep(0.2)
print("left", files(), "same", spark.conf.get(key, None) == before, "removed", found.filter("n_removed > 0").count(), "then", files() > 0)
"""


def test_shuffles_end_with_their_step(tmp_path):
    root = str(Path(__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", SHUFFLES, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    # document 1 holds the line first and once: it loses nothing
    assert done.stdout.split("\n")[0] == "left 0 same True removed 7 then True", done.stdout + done.stderr
