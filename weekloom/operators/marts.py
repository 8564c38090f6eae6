"""Series behind the charts and tables of the report, and the nested report itself."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import KEY, fixed

# chart slot suffix -> metric
DAILY_CHARTS = {"atc_chart": "adds_to_cart", "purchases_chart": "purchases",
                "roas_chart": "purchase_roas", "spend_chart": "amount_spent"}
PRODUCT_CHARTS = {"atc_chart": "adds_to_cart", "purchases_chart": "purchases",
                  "roas_chart": "purchase_roas", "atv_chart": "average_purchase_value"}
AUDIENCE_CHARTS = {"atc_chart": "adds_to_cart", "purchases_chart": "purchases",
                   "roas_chart": "purchase_roas"}
KEYWORD_CHARTS = {"cost_chart": "cost", "conversions_chart": "conversions",
                  "value_cost_chart": "conversion_value_per_cost"}


def tall(df: DataFrame, slide, category, items: list[tuple]) -> DataFrame:
    """Unpivot (slot, series, column) items of a fact table into mart rows."""
    as_col = lambda v: F.lit(v) if isinstance(v, (str, int)) else v
    values = F.array(*[F.struct(as_col(slot).alias("slot"), as_col(series).alias("series"),
                                as_col(column).cast("double").alias("value"))
                       for slot, series, column in items])
    return df.select(*KEY, as_col(slide).cast("int").alias("slide"),
                     category.cast("string").alias("category"), F.explode(values).alias("v")
                     ).select(*KEY, "slide", "v.slot", "category", "v.series", "v.value")


def report_mart(facts: dict[str, DataFrame], reports: DataFrame) -> DataFrame:
    """(key, slide, slot, category, series, value) of every chart and numeric table cell."""
    c = F.col
    chart = lambda head, charts: [(f"{head}.{slot}", m, c(m))
                                  for slot, m in charts.items()]
    product_slide = c("idx") + 3
    product_slot = lambda tail: F.concat(F.lit("slot.product."), "product_id",
                                         F.lit(tail))
    numbers = lambda s: [f for f, (_, kind) in fixed.SECTION_FIELDS[s].items()
                         if kind not in ("text", "keyword", "date")]
    table = lambda slot, names: [(slot, m, c(m)) for m in names]
    comparison = "slot.overall.comparison_table"
    parts = [
        tall(reports, 2, F.lit("current"), table(comparison, fixed.OVERALL_METRICS)),
        tall(reports.where("previous is not null"), 2, F.lit("previous"),
             [(comparison, m, c(f"previous.{m}")) for m in fixed.OVERALL_METRICS]),
        tall(facts["daily"], 2, c("day"), chart("slot.overall.daily", DAILY_CHARTS)),
        tall(facts["summary"], 2, c("display_name"),
             chart("slot.overall.product", PRODUCT_CHARTS)),
        tall(facts["campaign"], product_slide, c("product_id"),
             table(product_slot(".campaign_table"), numbers("campaign"))),
        tall(facts["creative"], product_slide, c("product_id"),
             table(product_slot(".creative_table"), numbers("creative"))),
        tall(facts["traffic"], 6, c("campaign_name"),
             table("slot.traffic.table", numbers("traffic"))),
        tall(facts["audience"], 7, c("ad_set_name"), chart("slot.audience", AUDIENCE_CHARTS)),
        tall(facts["audience"], 7, c("ad_set_name"),
             table("slot.audience.table", numbers("audience"))),
        tall(facts["keywords"], 8, c("keyword"), chart("slot.keywords", KEYWORD_CHARTS)),
        tall(facts["keywords"], 8, c("keyword"),
             table("slot.keywords.table", numbers("keywords")))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def canonical_report(facts: dict[str, DataFrame], reports: DataFrame) -> DataFrame:
    """The nested report of each bundle, children in order.

    Pass facts of publishable bundles: their rules bound every list by the configured products,
    the days of the period and the keyword limit.
    """
    def children(section, order, extra):
        names = [*extra, *fixed.SECTION_FIELDS[section]]
        item = F.struct(F.col(order).alias("idx"), *names)
        return facts[section].groupBy(*KEY).agg(F.transform(
            F.sort_array(F.collect_list(item)),
            lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(section))

    result = reports
    for section, order, extra in (
            ("daily", "idx", []), ("summary", "idx", ["product_id", "display_name"]),
            ("campaign", "idx", ["product_id"]), ("creative", "idx", ["product_id"]),
            ("traffic", "idx", ["product_id"]), ("audience", "idx", ["product_id"]),
            ("keywords", "rank", ["rank"])):
        result = result.join(children(section, order, extra), KEY, "left")
    current = F.struct("market", "period_start", "period_end", *fixed.OVERALL_METRICS)
    config = ["schema_version", "template_version", "country_label", "currency", "report_title"]
    analyses = F.zip_with(F.arrays_zip("summary", "campaign"), "creative", lambda a, creative:
                          F.struct(a["summary"]["product_id"].alias("product_id"),
                                   a["summary"].alias("summary"), a["campaign"].alias("campaign"),
                                   creative.alias("creative")))
    return result.select(*KEY, *config, current.alias("current_overall"),
                         F.col("previous").alias("previous_overall"), "daily",
                         F.col("summary").alias("product_summaries"),
                         analyses.alias("product_analyses"), "traffic", "audience", "keywords")


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON reports by market and period, with the stem as a column.

    A period is a start and an end, so a report never replaces one of another length.
    """
    from weekloom.functions.text import report_stem

    named = reports.withColumn("file_stem", report_stem(
        F.col("market"), F.col("period_start"), F.col("period_end")))
    (named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("market", "period_start", "period_end").json(path))
