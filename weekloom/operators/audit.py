"""Numeric fingerprints, lineage samples and entity names."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import KEY, fixed


def numeric_fingerprint(values: DataFrame, by: list[str]) -> DataFrame:
    """Digest of all (path, value) pairs of a report, and how many there are.

    Each pair is hashed on its own and four 60-bit slices are summed, so groups of any size
    combine before the shuffle and no list of pairs is ever built. Equal digests mean equal
    multisets of pairs. A value counts as the text of its exact double; both zeros are one value.
    """
    exact = F.col("value").cast("double") + F.lit(0.0)
    pair = F.sha2(F.concat("path", F.lit("="), exact.cast("string")), 256)
    rows = values.where("value is not null").select(*by, pair.alias("h"))
    slices = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
              .cast("string").alias(f"s{i}") for i in range(4)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("numeric_path_count"), *slices)
    return sums.select(*by, F.sha2(F.concat_ws("|", "s0", "s1", "s2", "s3"), 256)
                       .alias("fingerprint"), "numeric_path_count")


def mapping_sample(lineage: DataFrame) -> DataFrame:
    """At most four mappings per report section and forty per report, in a fixed order."""
    source = F.explode("sources").alias("s")
    rows = lineage.select(*KEY, "target", "transform", source).select(
        *KEY, "target", "transform", "s.source_kind", "s.header").distinct()
    group = F.regexp_extract("target", r"\A[^.\[]*", 0)
    order = ["target", "source_kind", "header", "transform"]
    inside = F.row_number().over(W.partitionBy(*KEY, "section").orderBy(*order))
    overall = F.row_number().over(W.partitionBy(*KEY).orderBy("section", "n"))
    return (rows.withColumn("section", group).withColumn("n", inside)
            .where(F.col("n") <= fixed.MAPPINGS_PER_GROUP)
            .withColumn("place", overall.cast("bigint")).where(F.col("place") <= fixed.MAPPINGS_TOTAL)
            .drop("n"))


def lineage_counts(lineage: DataFrame) -> DataFrame:
    """(key, what, name, n): entries per transform and sources per kind."""
    per = lineage.groupBy(*KEY, F.lit("transform").alias("what"),
                          F.col("transform").alias("name")).agg(F.count("*").alias("n"))
    kinds = lineage.select(*KEY, F.explode("sources.source_kind").alias("name"))
    return per.unionByName(kinds.groupBy(*KEY, F.lit("source_kind").alias("what"), "name").agg(
        F.count("*").alias("n")).select(per.columns))


def entity_names(facts: dict[str, DataFrame]) -> DataFrame:
    """(key, entity, product_id, field, name): the names a reviewer sees, once each."""
    def names(section, entity, fields):
        rows = facts[section]
        product = "product_id" if "product_id" in rows.columns else None
        items = F.array(*[F.struct(F.lit(label).alias("field"), F.col(col).alias("name"))
                          for col, label in fields])
        return rows.select(*KEY, F.lit(entity).alias("entity"),
                           (F.col(product) if product else F.lit("")).alias("product_id"),
                           F.explode(items).alias("i")).select(
            *KEY, "entity", "product_id", "i.field", "i.name").where("name <> ''").distinct()

    parts = [
        names("summary", "product", [("display_name", "display_name"),
                                     ("campaign_name", "summary_campaign_name")]),
        names("campaign", "product", [("campaign_name", "conversion_campaign_name")]),
        names("creative", "product", [("ad_name", "creative_ad_name"),
                                      ("campaign_name", "creative_campaign_name")]),
        names("traffic", "traffic_campaign", [("campaign_name", "campaign_name")]),
        names("audience", "audience", [("ad_set_name", "ad_set_name")]),
        names("keywords", "keyword", [("keyword", "keyword")])]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
