"""Trees, references and chunks are found where a document lies: its text is shuffled once, and nothing is written in between."""

import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions import staging
from lexmill.operators import chunks, parse
from lexmill.plans import laws, trees

SF = os.environ.get("LEXMILL_TEST_SF", "/root/testdata/sf0.001")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def nodes(spark):
    docs = spark.createDataFrame([("x", "Điều 1. Phạm vi\n1. Theo khoản 2 Điều 1\na) điểm a\n2. Trừ trường hợp quy định tại Điều 1"), ("none", None)], "doc_id string, text string")
    return parse.finish_nodes(parse.build_nodes(docs))


def test_nodes_and_references_shuffle_texts_once(spark):
    found = nodes(spark)
    assert shuffles(found) == 1
    refs = parse.find_references(found.withColumn("text", F.concat_ws(" ", "content", "lead_in")))
    assert shuffles(refs) == 1 and {r.target_id for r in refs.collect()} == {"doc_x_dieu_1_khoan_2", "doc_x_dieu_1"}


def test_chunks_shuffle_only_what_they_are_given(spark):
    docs = spark.createDataFrame([("x", "1/2025/QH15")], "doc_id string, document_number string")
    made = chunks.node_chunks(nodes(spark), docs)
    assert shuffles(made) <= 2  # texts and document numbers
    assert shuffles(chunks.with_references(made)) <= 2
    refs = {r.chunk_id: r.refs for r in chunks.chunk_references(made).collect()}
    second = ["doc_x_dieu_1_khoan_2_chunk"]  # the point repeats what leads into its clause
    assert refs == {"doc_x_dieu_1_khoan_1_chunk": second, "doc_x_dieu_1_khoan_1_diem_a_chunk": second}
    assert shuffles(chunks.full_text_chunks(nodes(spark), True)) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_nothing_is_written_in_between(spark, monkeypatch):
    def no(df):
        raise AssertionError("a table is written that is read once")

    for module in (staging, parse):
        monkeypatch.setattr(module, "staged", no)
    for query in (laws.law_nodes, laws.law_references, laws.law_index, laws.law_exceptions, laws.law_places, laws.law_full_texts, laws.law_texts_of, trees.chunk_index, trees.exception_index):
        query(spark, SF)


def test_patches_are_replayed_by_batches_of_documents(spark, monkeypatch):
    """One call of Python serves many documents; each still sees its own patches only."""
    plans = []
    monkeypatch.setattr(parse, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    rows = [(d, f"{d}_{n}", float(n), "t", "c", "") for d in range(1500) for n in (1, 2)]
    found = spark.createDataFrame(rows, "doc_id long, node_id string, seq double, title string, content string, lead_in string")
    patches = spark.createDataFrame([(d, 1, "set_field", f"{d}_1", "title", f"new {d}") for d in range(1500)] + [(7, 2, "remove_node", "7_2", None, None)], "doc_id long, op_seq int, op string, node_id string, field string, value string")
    got = {(r.doc_id, r.node_id): r.title for r in parse.apply_patches(found, patches).collect()}
    assert got == {(d, f"{d}_{n}"): f"new {d}" if n == 1 else "t" for d in range(1500) for n in (1, 2) if (d, n) != (7, 2)}
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroupsInArrow" in p for p in plans)
