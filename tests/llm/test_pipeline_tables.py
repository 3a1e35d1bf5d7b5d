"""The pipeline's stages on odd tables: repeated ids, nulls, empty and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import noise

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, th long, spans string, times int, text_hash long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", 1, 2, "s", 3, 4) for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def table(spark):
    a, b, c = (" ".join(noise(x, 60)) for x in "abc")
    return odd(spark, [(3, a, "x"), (7, a, "y"), (7, b, "z"), (7, b, "z"), (None, c, "n"), (None, a, "n"), (8, None, "e"), (9, "", "e")])


def test_near_copies_go_by_id_and_text(spark, tiny, table):
    out = STAGES["SimHash near-dedup"](spark, table, tiny)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["source"]) for r in out.collect()))
    assert got == [(False, 3, "x"), (False, 7, "z"), (False, 8, "e"), (True, 0, "n")] and out.columns == table.columns
    assert out.where("doc_id is null").first()["text"] == " ".join(noise("c", 60))


def test_passages_are_cut_by_id_and_text(spark, tiny, table):
    a = " ".join(noise("a", 60))
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in STAGES["substring dedup"](spark, table.unionByName(odd(spark, [(7, a + " and more of it", "w")])), tiny).collect()]
    assert sorted(x[0] for x in got if x[0] and x[1]) == [3, 7, 7, 7]  # (7, a) is empty without the passage and goes
    assert (7, "and more of it", 14) in got and sum(x[1] == " ".join(noise("b", 60)) for x in got) == 2
    assert {x[0] for x in got if not x[1]} == {8, 9} and [x[1] for x in got if x[0] is None] == [" ".join(noise("c", 60))]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_and_empty_tables(spark, tiny, table, name):
    out = STAGES[name](spark, table, tiny)
    n = out.count()
    if name == "quality classifier":
        assert n == 6 and out.where("text is null or text = ''").count() == 0  # no trusted document of theirs: all stay but those without text
    if name == "toxicity":
        assert n == 8
    if name == "packing":
        assert out.groupBy("doc_id").agg(F.count("*")).count() == 5
    assert STAGES[name](spark, table.limit(0), tiny).count() == 0
