"""The pipeline on tables that are empty or have columns of clashing names."""

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, rows, schema, benchmark):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], COLUMNS, [])).collect() == []


@pytest.mark.parametrize("labelled", [True, False])
def test_clashing_columns_nulls_and_repeats(spark, tmp_path, labelled):
    """Columns named like those that the stages make, rows that repeat, null and empty texts, a table without a learnt language."""
    say = ["the quick brown fox jumps over the lazy dog and runs away from number", "der schnelle braune Fuchs springt über den faulen Hund und läuft weg von"]
    rows = [(i, f"{say[i % 2]} {i} " * 12 + f"w{i} " * 30, ["en", "de"][i % 2] if labelled else None, ["a", "b", None][i % 3], 1, 7, "p", "x", 3, "g") for i in range(60)]
    rows += [rows[0], rows[0], (100, None, "en", "a", 0, 7, "p", "x", 3, "g"), (101, "", None, None, 0, 7, "p", "x", 3, "g"), (None, None, None, None, None, None, None, None, None, None)]
    schema = COLUMNS + ", shard int, pattern string, print string, size long, g_part string"
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, schema, [(1, "no such words in any of the texts here at all")])).collect()
    assert all(r.doc_id is not None and r.doc_id < 100 for r in got)
    assert bool(got) is labelled
