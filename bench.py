"""Time the headline queries into a noop sink: one warm-up, then the median of three runs.

Slow queries run once after the warm-up; the weekly job is timed cold.

BENCH_SF_DIR names the folder of Parquet tables, BENCH_CPUS the local cores. Prints one JSON line.
"""

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.checks import guard_checks, load_all, registry
from weekloom.functions.text import normalize_text
from weekloom.operators import facts as A
from weekloom.operators import wow as X
from weekloom.session import build_session


#: runs after one warm-up whose median counts; a warm-up above SLOW_S is followed by one run
RUNS, SLOW_S = 3, 12
ONCE = {"weekly_report_end_to_end"}


def panel(spark, sf):
    """Multi-year weekly panel: market-weeks by product and campaign from lineitem and part."""
    dec = lambda c, t: F.col(c).cast(t)
    lines = registry.table(spark, sf, "lineitem").groupBy(
        "l_partkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(
            F.sum(dec("l_extendedprice", "decimal(12,2)")).alias("value"),
            F.sum(dec("l_quantity", "decimal(12,2)")).alias("units"), F.count("*").alias("n"))
    part = registry.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("market"), F.col("p_type").alias("product_id"), "week")
            .agg(F.sum("value").cast("double").alias("purchase_value"),
                 F.sum("units").cast("double").alias("purchases"),
                 F.sum("n").cast("double").alias("link_clicks")))


def panel_changes(spark, sf):
    """Change fields of every metric of the panel against the week before."""
    rows = panel(spark, sf)
    metrics = ["purchase_value", "purchases", "link_clicks"]
    long = rows.unpivot(["market", "product_id", "week"], metrics, "metric", "current")
    before = long.select("market", "product_id", F.date_add("week", 7).alias("week"), "metric",
                         F.col("current").alias("previous"))
    return X.with_change(long.join(before, ["market", "product_id", "week", "metric"]))


def panel_rank(spark, sf):
    """The five largest changes of every market and week of the panel."""
    rows = panel_changes(spark, sf).where("percent_change is not null")
    order = W.partitionBy("market", "week").orderBy(
        F.abs("percent_change").desc(), "product_id", "metric")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 5")


def alias_scan(spark, sf):
    docs = registry.table(spark, sf, "documents").withColumn("t", normalize_text(F.col("text")))
    products = F.array(*[F.struct(F.lit(f"P{i}").alias("id"), F.array(F.lit(a)).alias(
        "norm_aliases")) for i, a in enumerate(["tion the", "que des", "und die", "la e"])])
    return docs.select("doc_id", A.alias_match(F.col("t"), products).alias("hit"))


def text_guards(spark, sf):
    return registry.QUERIES["unsafe_prose"](spark, sf)


def fresh(name):
    """Run a named query without the stages earlier queries left behind."""
    def run(spark, sf):
        registry.forget()
        return registry.QUERIES[name](spark, sf)
    return run


def main():
    load_all()
    assert guard_checks
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {
        "weekly_panel": panel, "panel_changes": panel_changes,
        "panel_rank": panel_rank,
        "keyword_topn": registry.QUERIES["keyword_topn"],
        "numeric_fingerprint": registry.QUERIES["numeric_fingerprint"],
        "alias_match": alias_scan, "text_guards": text_guards,
        "catalog_integrity": registry.QUERIES["catalog_integrity"],
        "pair_candidates": registry.QUERIES["pair_candidates"],
        "history_upsert": registry.QUERIES["history_upsert"],
        "kpi_rollup": registry.QUERIES["kpi_rollup"],
        "weekly_report_end_to_end": fresh("weekly_report")}
    times = {}
    began = time.time()
    for name, query in queries.items():
        runs = []
        while len(runs) < (1 if name in ONCE else 2 if runs and runs[0] > SLOW_S else 1 + RUNS):
            start = time.time()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, [round(r, 2) for r in runs], round(time.time() - began), file=sys.stderr,
              flush=True)
    n_docs = registry.table(spark, sf, "documents").count()
    rates = {f"{n}_docs_per_s": round(n_docs / times[n]) for n in ("alias_match", "text_guards")}
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, **rates, "cpus": int(cpus),
                      "sf": float(scale.group(1)) if scale else sf}))


if __name__ == "__main__":
    main()
