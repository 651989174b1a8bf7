"""The near-duplicate stage decides row by row."""

from collections import Counter

import pytest

import corpus_pipeline
from redress.llm import simhash

A = "the quick brown fox jumps over the lazy dog and runs far away from here"
B = "one morning a small grey bird sat down on the old wall beside our garden gate"
C = "nobody in this town remembers who built the bridge across the narrow river"
NEAR_B = B.upper()  # the same words after lower-casing: distance 0

SCHEMA = "doc_id long, text string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_an_id_on_two_texts_goes_only_where_it_is_a_copy(spark):
    # 5 stands for the copies of A and is itself a copy of 3 on B
    got = kept(spark, [(3, B, "a"), (5, NEAR_B, "a"), (5, A, "a"), (7, A, "b"), (8, C, "a")])
    assert got == Counter([(3, B), (5, A), (8, C)])


def test_an_id_on_two_texts_does_not_link_them(spark):
    # 1 is the smallest id of both groups: each keeps its row of 1
    got = kept(spark, [(1, A, "a"), (1, B, "a"), (2, A, "a"), (3, NEAR_B, "a")])
    assert got == Counter([(1, A), (1, B)])


@pytest.mark.parametrize("sources", [("a", "a", "a"), ("a", "b", None)])
def test_repeated_rows_and_null_ids_leave_one_row(spark, sources):
    rows = [(i, t, s) for i, t in ((1, A), (None, B), (None, C)) for s in sources]
    got = kept(spark, [*rows, (None, NEAR_B, "z"), (9, C, "a")])
    assert got[(1, A)] == 1 and got[(9, C)] == 1 and sum(got.values()) == 3
    assert got[(None, B)] + got[(None, NEAR_B)] == 1


def test_a_repeated_row_over_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr("redress.llm.common.HOT_ROWS", 5)
    got = kept(spark, [(None, A, "a")] * 40 + [(4, B, "a")] * 3 + [(i, C, "a") for i in range(5, 30)] + [(2, None, "a")])
    assert got == Counter([(None, A), (4, B), (5, C), (2, None)])


def test_first_rows_do_not_depend_on_the_layout(spark):
    rows = [(1, A, s) for s in "abcdef"] + [(None, B, s) for s in "abcdef"]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], SCHEMA)
    got = {tuple(sorted(map(str, simhash.keep_first(docs.repartition(n)).collect()))) for n in (1, 4)}
    assert len(got) == 1 and len(next(iter(got))) == 2
