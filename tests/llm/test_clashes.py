"""Near duplicates where texts share an identifier."""

from bookloom.llm import near_dedup
from tests.llm.test_llm import BASE, prose


def test_texts_that_share_an_identifier(spark):
    far, near = prose(77, 180), BASE + " z"
    rows = [(1, BASE, "a"), (2, near, "b"), (2, far, "c"), (3, BASE + " q", "d"), (3, BASE, "e"), (4, far + " y", "f"), (None, far, "g"), (5, prose(78, 90), "h"), (5, prose(79, 90), "i"), (5, prose(79, 90), "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d0 string").repartition(3)
    got = sorted((r.doc_id or 0, r.class_id, r.kept) for r in near_dedup.classes(docs).collect())
    assert got == [(0, 2, False), (1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (3, 1, False), (4, 2, False), (5, 5, True), (5, 5, True), (5, 5, True)]
    assert sorted(r.d0 for r in near_dedup.keep(docs).collect()) == ["a", "c", "g", "h", "i", "j"]


def test_a_class_under_one_identifier(spark):
    """Two near texts with the same identifier: one of them stays."""
    docs = spark.createDataFrame([(1, BASE, "x"), (1, BASE + " z", "y")], "doc_id long, text string, other string")
    assert sorted(r.kept for r in near_dedup.classes(docs).collect()) == [False, True] and near_dedup.keep(docs).count() == 1
