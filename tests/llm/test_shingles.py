"""The near-duplicates stage's groups, against brute force."""

import random

import numpy as np
import pytest
from claimgraph.llm import shingles, simhash


def jaccard(x, y):
    sets = []
    for t in (x, y):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_first_links_by_shingles(spark):
    """Copies with a few words changed go, though their SimHash differs in over three bits."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=120)
        for changes in (0, 1, 2, 4):
            own = list(base)
            for at in rng.sample(range(120), changes):
                own[at] = "other"
            texts.append(" ".join(own))
    up = list(range(len(texts)))
    far = 0
    for _ in texts:
        for i, x in enumerate(texts):
            for j in range(i // 4 * 4, i):
                if jaccard(x, texts[j]) >= 0.8:
                    up[i] = up[j] = min(up[i], up[j])
                    far += (simhash.fingerprint(x) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.RADIUS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert far and {r.doc_id for r in shingles.keep_first(docs).collect()} == set(up)
    assert shingles.keep_first(docs.limit(0)).count() == 0
    assert shingles.similar(np.arange(8), np.arange(10), 0.8) and not shingles.similar(np.arange(7), np.arange(9), 0.8)


def test_keep_first_rows_without_ids(spark):
    """Unlike texts stay whether they have no id or share one; copies go."""
    one, two = "a text about one thing and nothing else at all", "words on quite another matter for the second document"
    rows = [(None, one, "x"), (None, two, "x"), (7, "seven " + two[::-1], "x"), (7, "again " + one[::-1], "x"), (7, "again " + one[::-1], "y"), (8, two, "z"), (None, one, "x"), (None, "", None), (9, None, "")]
    out = shingles.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(0, one), (8, two), (7, rows[2][1]), (7, rows[3][1]), (9, "")])


def _families(rng, n_families, siblings, twins, words=150, own=24):
    """Texts of boiler-plate with a middle of their own: siblings below 0.8; twins above it."""
    texts = []
    for f in range(n_families):
        plate = [f"p{f}_{k}" for k in range(words)]
        for s in range(siblings):
            texts.append(" ".join(plate[: words // 2] + [f"o{f}_{s}_{k}" for k in range(own)] + plate[words // 2 :]))
        for t in range(twins):
            middle = [f"t{f}_{k}" for k in range(own)]
            middle[own // 2 + t % 5] = f"t{f}_{t}_own"
            texts.append(" ".join(plate[: words // 2] + middle + plate[words // 2 :]))
    rng.shuffle(texts)
    return texts


def _groups(texts):
    """The smallest text number that each reaches, by an exact join of all pairs."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common >= 0.8 * (len(x) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("shape", [(20, 80, 2), (2, 30, 120)])
def test_no_link_is_lost_among_siblings(spark, shape):
    """Twins meet in bands of many siblings that are just below the threshold."""
    texts = _families(random.Random(12), *shape)
    want = _groups(texts)
    assert len(set(want)) == shape[0] * (shape[1] + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in shingles.keep_first(docs).collect()} == set(want)


def test_blocks_give_each_pair_that_can_be_similar(monkeypatch, spark):
    """The same with blocks of four texts, so that pairs go between blocks."""
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 4)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=40) if len(texts) % 3 == 0 else texts[-1].split()
        for at in rng.sample(range(40), rng.randint(0, 2)):
            base[at] = rng.choice(words)
        texts.append(" ".join(base))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in shingles.keep_first(docs).collect()} == set(_groups(texts))


def test_op5_s_trees_link_first(spark, monkeypatch):
    """Fingerprints near each other go through op5's trees; what their pairs connect is linked though no band is asked."""
    rng, asked = random.Random(8), []
    words = [f"w{k}" for k in range(500)]
    base = [rng.choices(words, k=300) for _ in range(10)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base]
    monkeypatch.setattr(shingles, "near_links", lambda fps: asked.append(simhash.near_links(fps)) or asked[-1])
    found = {r.doc_id: r.component for r in shingles.groups(shingles._with_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert len(set(found.values())) == 10 and all(found[k] == found[k + 10] for k in range(10))
    prints = [shingles.fingerprint(shingles.shingles(t)) for t in texts]
    near = [k for k in range(10) if 0 < ((prints[k] ^ prints[k + 10]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS]
    linked = {frozenset(p) for p in asked[0].collect()}
    assert near and len(linked) >= len(near)
