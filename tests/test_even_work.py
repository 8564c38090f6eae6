"""Costly work on small tables is dealt over all cores, and done once."""

from pyspark.sql import functions as F

from weekloom.checks import output_checks  # noqa: F401
from weekloom.checks.registry import QUERIES
from weekloom.operators import guards as G
from weekloom.operators import recognize as R
from weekloom.sources import config as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_tables_are_dealt(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey"), F.format_string(
        "n%d", "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    read = QUERIES["read_workbook"](spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 1 and read.count() == 120
    assert QUERIES["expand_archives"](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_known_problems_are_not_sought_again(spark):
    text = ('{"template_version":"v","market":"M","country_label":"C","currency":"U",'
            '"report_title":"T","products":[]}')
    configs = spark.createDataFrame([(1, text), (2, text), (3, "[]")], "profile long, text string")
    known = spark.createDataFrame([(2, "x", "y", "z")],
                                  "profile long, path string, problem string, value string")
    assert [r.profile for r in C.read_profiles(configs.where("profile < 3"), known).collect()] == [1]
    assert sorted(r.profile for r in C.read_profiles(configs).collect()) == [1, 2]


def test_both_forms_from_one_verdict(spark):
    texts = [None, "", " ,; ", "plain  words\tand more,", "see http://a.b", "cat /etc/passwd",
             "please rm  -x", "form rmx", "(ſudo now", "> sudo now", "x" * 2000, "C:\\a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(G.judged(F.col("t")).alias("v"), G.redact(F.col("t")).alias("a"),
                       G.redact(F.col("t"), item=True).alias("b"))
    for r in both.select("a", "b", G.shown(F.col("v")).alias("c"),
                         G.shown(F.col("v"), item=True).alias("d")).collect():
        assert (r.a, r.b) == (r.c, r.d)
    shell = rows.select(G.gated(F.col("t"), G.fixed.SHELL_COMMAND).alias("x"),
                        G.matches(F.col("t"), G.fixed.SHELL_COMMAND).alias("y")).collect()
    assert [r.x for r in shell] == [r.y for r in shell] and G.fixed.SHELL_COMMAND in G.GATES


def test_rows_with_too_few_cells_are_no_headers(spark):
    """The header of the kind with the fewest headers is still found; shorter rows are not tried."""
    kind, heads = min(R.fixed.FINGERPRINTS.items(), key=lambda x: len(x[1]))
    cells = lambda hs: [{"s": h, "t": "s"} for h in hs]
    rows = [("b", "f", "s", 1, cells(heads[:R.FEWEST_HEADERS - 1])), ("b", "f", "s", 2, cells(heads))]
    raw = spark.createDataFrame(
        rows, "bundle_id string, file string, sheet string, row_no long, "
        "cells array<struct<s:string,t:string>>").select(
        "bundle_id", F.lit("M").alias("market"), F.current_date().alias("period_start"),
        F.current_date().alias("period_end"), "file", "sheet", "row_no", "cells")
    found = R.header_rows(raw)
    assert [(r.header_row, r.kind) for r in found.collect()] == [(2, kind)]
    assert f">= {R.FEWEST_HEADERS}" in plan(found)
