"""The near-dedup stage chooses rows, not ids."""

from pyspark.sql import functions as F

A = "one two three four five six seven eight nine ten eleven twelve"
B = "quite another text about rivers, hills and the long road between them all"


def kept(spark, rows):
    import corpus_pipeline as p

    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, row int").withColumns({"key": F.lit("k"), "n": F.lit(1), "c0": F.lit(2)})
    out = p.simhash_near_dedup(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text, r.row) for r in out.collect()), key=str)


def test_unlike_texts_under_one_id_both_stay(spark):
    assert [r[:2] for r in kept(spark, [(5, A), (5, B)])] == [(5, A), (5, B)]


def test_a_copy_under_an_id_that_is_chosen_for_another_text_goes(spark):
    assert [r[:2] for r in kept(spark, [(5, A), (7, A), (7, B)])] == [(5, A), (7, B)]


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(None, A), (None, A), (3, A), (None, B), (None, B), (4, None), (4, None), (None, "")]
    got = kept(spark, rows)
    assert sorted([r[:2] for r in got], key=str) == sorted([(3, A), (None, B), (4, None)], key=str)
    assert got == kept(spark, rows)  # the same rows each time
