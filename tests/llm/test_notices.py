"""License scan by further notices, full texts and runs of lines."""

import textwrap

from claimgraph.llm import licenses, notices


def test_notices_texts_and_runs(spark):
    wrapped = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES["Apache-2.0-header"], 70))
    head = " ".join(f"name{k}" for k in range(99)) + "\n"
    tail = "\nclass Reader: reads the file and gives its rows back"
    rows = [
        (1, head + wrapped + tail),
        (2, "Copyright (c) 2020 Some One\n\n" + notices.FULL["MIT-text"]),
        (3, notices.FULL["Apache-2.0-text"]),
        (4, head + "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (5, None),
        (6, ""),
        (7, head + "\n".join(textwrap.wrap(licenses.TEMPLATES["ISC"], 60)) + tail),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    old = {(r.doc_id, r.license) for r in licenses.scan(d).collect()}
    assert not old & {(1, "Apache-2.0-header"), (7, "ISC")} and 4 not in {i for i, _ in old}
    got = {(r.doc_id, r.first, r.last, r.license) for r in notices.scan(d).collect()}
    n = wrapped.count("\n") + 1  # the last line, License., adds no bigram
    assert {(1, 2, n, "Apache-2.0-header"), (2, 0, 0, "MIT-text"), (3, 0, 0, "Apache-2.0-text"), (4, 2, 2, "GPL-3.0-line"), (4, 3, 3, "CC-BY-NC-4.0-line")} <= got
    assert {x for x in got if x[0] == 4} == {(4, 2, 2, "GPL-3.0-line"), (4, 3, 3, "CC-BY-NC-4.0-line")}
    assert {x[3] for x in got if x[0] == 7} == {"ISC"} and not {x for x in got if x[0] in (5, 6)}
    assert notices.scan(d.limit(0)).count() == 0
