"""Filters on what the stage of personal data returns."""

from pyspark.sql import functions as F

import corpus_pipeline as P


def test_columns_that_stay_are_apart_from_the_text(spark):
    """Columns other than text and n_chars come from the input as they are; a filter on them doesn't hold what makes the text."""
    rows = [(1, "write to a.b@mail.example", "en", "s", 25), (2, None, "en", "s", 7), (3, "", "de", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("more", F.lit("x"))
    out = P.personal_data(spark, docs, "")
    assert out.columns == docs.columns
    assert "update_fields" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, out.where("lang = 'en' and source = 's' and more = 'x'").collect())) == [(1, "write to [EMAIL]", "en", "s", 16, "x"), (2, None, "en", "s", 7, "x")]
