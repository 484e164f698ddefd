"""Blank lines are told by their first word character, without walking through the line."""

from pyspark.sql import functions as F

from wardlight.llm import quality_lines


def test_blank_lines(spark):
    rows = ["", " ", "\t \x0b\x0c\r", " x", "x ", " ", "  ", " é ", "\x1c", "  |"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", quality_lines._blank(F.col("x")).alias("blank")).collect()
    assert {r["x"]: r["blank"] for r in got} == {x: not x.strip("\x20\x09\x0a\x0b\x0c\x0d") for x in rows}


def test_lines_are_not_translated_to_find_blank_ones(spark):
    docs = spark.createDataFrame([("a\n\n b.",)], "text string")
    plan = quality_lines.line_quality(docs).select("n_dup_lines")
    assert "translate" not in plan._jdf.queryExecution().optimizedPlan().toString()
