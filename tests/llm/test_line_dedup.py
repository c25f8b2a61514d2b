"""Line dedup against alignments with all earlier documents, written here anew."""

import difflib
import random

import pytest

from claimgraph.llm import line_dedup

LONG = ["the first line of thirty or more characters", "the second line of thirty or more characters", "the third line of thirty or more characters"]
FEW = ["s1", "s2", "s3"]


def places_shared(lines, other, min_chars=30):
    """Places of all blocks of min_chars or more that lines have in common with another document."""
    gone = set()
    for i in range(len(lines)):
        for j in range(len(other)):
            k = 0
            while i + k < len(lines) and j + k < len(other) and lines[i + k] == other[j + k]:
                k += 1
            gone |= set(range(i, i + k)) if sum(map(len, lines[i : i + k])) >= min_chars else set()
    return gone


def places_by_patience(lines, other, min_chars=30):
    """Places of the blocks of min_chars or more in a plain recursive patience diff."""
    pairs = []

    def align(i, i_end, j, j_end):
        mine, its = lines[i:i_end], other[j:j_end]
        once = [(k, its.index(x)) for k, x in enumerate(mine) if mine.count(x) == its.count(x) == 1]
        chain = []  # longest rising chain, by trying each end
        best = [[]]
        for n, (k, at) in enumerate(once):
            best.append(max((c for c in best if not c or c[-1][1] < at), key=len) + [(k, at)])
        chain = max(best, key=len)
        if not chain:
            for a, b, n in difflib.SequenceMatcher(None, mine, its, False).get_matching_blocks():
                pairs.extend((i + a + x, j + b + x) for x in range(n))
            return
        at = (i, j)
        for k, m in [*chain, (i_end - i, j_end - j)]:
            align(at[0], i + k, at[1], j + m)
            if (k, m) != (i_end - i, j_end - j):
                pairs.append((i + k, j + m))
            at = (i + k + 1, j + m + 1)

    align(0, len(lines), 0, len(other))
    gone, block = set(), []
    for p in [*sorted(pairs), None]:
        if block and (p is None or p != (block[-1][0] + 1, block[-1][1] + 1)):
            if sum(len(lines[x]) for x, _ in block) >= min_chars:
                gone |= {x for x, _ in block}
            block = []
        block.append(p)
    return gone


def check(spark, own):
    """Results for texts by id, against all earlier documents; gives each document's row."""
    d = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in own.items()}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    for i, t in own.items():
        gone, plain = set(), set()
        for j in lines:
            if j < i:
                gone |= places_shared(lines[i], lines[j])
                plain |= places_by_patience(lines[i], lines[j])
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), i
        assert got[i].n_removed == len(gone) and plain <= gone, i
    return got


def test_orders_and_partners(spark):
    """Blocks that moved, that repeat, and that only a second holder has whole."""
    own = dict(enumerate("\n".join(x) for x in ([LONG[0]], [LONG[0], *FEW], [LONG[0], *FEW], FEW[::-1] + LONG[:2], LONG[1::-1], ["x", *LONG[:2], "y", *LONG[:2], *FEW[::-1], *LONG[:2]])))
    got = check(spark, own)
    assert got[2].text == "" and got[4].n_removed == 2


def test_second_copy_with_a_first_holder_of_one_line(spark):
    own = {1: LONG[0], 2: "short a\n" + LONG[0] + "\nshort b", 3: "short a\n" + LONG[0] + "\nshort b"}
    assert check(spark, own)[3].text == ""


def test_copies_of_short_lines(spark):
    text = "\n".join(f"row {k}" for k in range(40))
    assert check(spark, {1: text, 2: text})[2].text == ""


@pytest.mark.parametrize("holders", [64, 65, 500])
def test_the_number_of_holders_changes_nothing(spark, holders):
    rows = {i: f"own {i}\n{LONG[i % 2]}\n{LONG[1 - i % 2]}\nshort\n\nend\nlast {i}" for i in range(holders)}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[0].text == rows[0] and got[1].text == "own 1\nshort\n\nend\nlast 1"
    assert all(got[i].text == f"own {i}\nlast {i}" and got[i].n_removed == 5 for i in range(2, holders))


def test_random_documents(spark, docs, empty):
    check(spark, {r.doc_id: r.text for r in docs.filter("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).collect()})
    rng = random.Random(8)
    lines = LONG + FEW + ["a line of twenty characters", "another of such lines", ""]
    check(spark, {i: "\n".join(rng.choices(lines, k=rng.randint(1, 9))) for i in range(40)})
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(docs).filter("doc_id is null or text is null").collect()
    assert len(out) == 2 and all(r.n_removed == r.n_moved == 0 for r in out)


def test_moved_blocks_stay_if_asked(spark):
    d = spark.createDataFrame([(1, "\n".join(LONG)), (2, "\n".join(["x", LONG[1], LONG[2], "y", LONG[0], LONG[1]]))], "doc_id long, text string")
    assert [(r.n_removed, r.n_moved) for r in line_dedup.dedup_lines(d).orderBy("doc_id").collect()] == [(0, 0), (4, 2)]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(d, moved=False).collect()}
    assert kept[2] in ("\n".join(["x", "y", LONG[0], LONG[1]]), "\n".join(["x", LONG[1], LONG[2], "y"]))


def test_patience():
    assert line_dedup.patience(list("abcxd"), list("bacd")) in ([(1, 0), (2, 2), (4, 3)], [(0, 1), (2, 2), (4, 3)])


def test_columns_of_any_name_pass(spark):
    line = "a line that is long enough to be held by two documents"
    rows = [(1, line, 5, 6, 7), (2, "own\n" + line, 5, 6, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, r_doc_id int, r_version int, h int")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(d).select("doc_id", "text", "r_doc_id", "r_version", "h", "n_removed").collect())
    assert got == [(1, line, 5, 6, 7, 0), (2, "own", 5, 6, 7, 1)]
