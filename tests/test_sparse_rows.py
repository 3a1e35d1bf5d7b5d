"""Dense rows of long sparse lines."""

import time

import pytest

from noisefold.sources import text


def test_long_lines_are_dense_in_one_pass(spark):
    """Work is the tokens plus the width, not their product: 700 rows of 400 tokens at a width of 1,024."""
    lines = [(r, "2;0.5 " + " ".join(f"{(r * 7 + 3 * t) % 1024 + 1}:{r + t / 4}" for t in range(400)) + " 9:1 9:2.5") for r in range(700)]
    rows = spark.createDataFrame(lines, "r long, value string").coalesce(1).cache()
    text.sparse_rows(rows.limit(2), 1024).collect()
    began = time.time()
    got = {x["r"]: x["features"] for x in text.sparse_rows(rows, 1024).collect()}
    took = time.time() - began
    rows.unpersist()
    for r in (0, 5, 699):
        want = [0.0] * 1024
        for t in range(400):
            want[(r * 7 + 3 * t) % 1024] = r + t / 4
        want[8] = 2.5
        assert list(got[r]) == want
    assert len(got) == 700 and took < 8


def test_odd_lines(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    got = text.sparse_rows(rows("1;2", "", "3;4 junk 2:1 2:5", None, " 5;2  1:7 "), 3).collect()
    assert [(x["label"], list(x["features"])) for x in got] == [(0, [0.0] * 3), (2, [0.0, 5.0, 0.0]), (4, [7.0, 0.0, 0.0])]
    for bad, what in (("1 1:2", "no class;concentration"), ("1;2 4:1", "index out of range"), ("1;2 0:1", "index out of range")):
        with pytest.raises(Exception, match=what):
            text.sparse_rows(rows(bad), 3).collect()
