"""Reconciliation rules. Every rule adds rows to the issues table and stops nothing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.functions.text import casefold, strip
from weekloom.issues import FIELDS, emit, issue, issue_struct

CREATIVE_METRICS = ["amount_spent", "cpm", "cpc", "ctr", "cost_per_add_to_cart",
                    "cost_per_purchase", "purchase_roas", "average_purchase_value"]
SETTINGS = ["money_tolerance", "ratio_tolerance", "required_for_comparison",
            "require_all_three_products", "fail_on_missing_creative_metric",
            "fail_on_period_mismatch", "keyword_top_n", "n_products"]


def settings(profiles: DataFrame) -> DataFrame:
    return profiles.select("market", F.size("products").alias("n_products"),
                           *[c for c in SETTINGS if c != "n_products"])


def error(code, path, **more) -> Column:
    return issue_struct("ERROR", code, path, **more)


def apart(actual: Column, expected: Column, tolerance: Column, code: str, path
          ) -> tuple[Column, Column]:
    """Rule for two amounts that must agree up to a tolerance."""
    far = F.abs(actual - expected) > tolerance + F.lit(1e-9)
    return far, error(code, path, actual=actual, expected=expected, tolerance=tolerance)


def differ(actual: Column, expected: Column, code: str, path) -> tuple[Column, Column]:
    return ~actual.eqNullSafe(expected), error(code, path, actual=actual, expected=expected)


def profile_rules(bundles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every bundle needs exactly one profile of its market, with a keyword limit in range."""
    found = profiles.groupBy("market").agg(
        F.count("*").alias("n"), F.min("keyword_top_n").alias("low"),
        F.max("keyword_top_n").alias("high"))
    c = F.col
    limit = fixed.KEYWORD_LIMIT
    joined = bundles.select(*KEY).distinct().join(found, "market", "left")
    return emit(
        joined,
        (c("n").isNull(), error("NO_PROFILE", "profile", actual=F.lit(0), expected=F.lit(1))),
        (c("n") > 1, error("AMBIGUOUS_PROFILE", "profile", actual=c("n"), expected=F.lit(1))),
        (c("n").isNotNull() & F.coalesce((c("low") < 1) | (c("high") > limit), F.lit(True)),
         error("KEYWORD_LIMIT", "profile.keyword_top_n", actual=c("high"),
               expected=F.lit(limit))))


def single_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of the markets that have one; the others produce no facts."""
    one = profiles.groupBy("market").agg(F.count("*").alias("n")).where("n = 1")
    return profiles.join(one.select("market"), "market", "left_semi")


def report_rules(bundles: DataFrame, reports: DataFrame) -> DataFrame:
    """A bundle without a report row cannot pass."""
    return issue(bundles.select(*KEY).distinct().join(reports.select(*KEY), KEY, "left_anti"),
                 "ERROR", "NO_REPORT", "report")


# --- one row per bundle -----------------------------------------------------------------

def metadata_rules(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """Versions, market and period against the configuration the report was made with."""
    config = profiles.select(F.col("market").alias("config_market"),
                             F.col("schema_version").alias("config_schema"),
                             F.col("template_version").alias("config_template"))
    c = F.col
    return emit(
        reports.join(config, "config_market"),
        differ(c("schema_version"), c("config_schema"), "SCHEMA_VERSION_MISMATCH",
               "schema_version"),
        differ(c("template_version"), c("config_template"), "TEMPLATE_VERSION_MISMATCH",
               "template_version"),
        differ(c("market"), c("config_market"), "MARKET_MISMATCH", "market"),
        (c("period_end") < c("period_start"), error("INVALID_PERIOD", "period_end")),
        (~(c("overall_start").eqNullSafe(c("period_start"))
           & c("overall_end").eqNullSafe(c("period_end"))),
         error("OVERALL_PERIOD_MISMATCH", "current_overall")),
        differ(c("overall_market"), c("market"), "OVERALL_MARKET_MISMATCH",
               "current_overall.market"))


def source_rules(reports: DataFrame, sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """The eight kinds and nothing else, all dated like the report. Keywords carry no dates."""
    known = F.col("kind").isin(fixed.KINDS)
    # one row per kind first: a bundle may list one kind any number of times
    kinds = sources.select(*KEY, "kind").distinct().groupBy(*KEY).agg(
        F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"))
    bundles = reports.select(*KEY).join(kinds, KEY, "left")
    short = F.coalesce("known", F.lit(0)) < len(fixed.KINDS)
    sets = issue(bundles.where(short | (F.coalesce("unknown", F.lit(0)) > 0)), "ERROR",
                 "SOURCE_SET_MISMATCH", "source_files", actual=F.coalesce("known", F.lit(0)),
                 expected=F.lit(len(fixed.KINDS)))
    dated = sources.where("kind <> 'keyword'").join(
        profiles.select("market", "fail_on_period_mismatch"), "market")
    wrong = dated.where(~(F.col("source_start").eqNullSafe(F.col("period_start"))
                          & F.col("source_end").eqNullSafe(F.col("period_end"))))
    periods = issue(
        wrong, F.when(F.col("fail_on_period_mismatch"), "ERROR").otherwise("WARNING"),
        "SOURCE_PERIOD_MISMATCH", F.concat(F.lit("source_periods."), F.col("kind")),
        actual=F.concat_ws("..", F.col("source_start").cast("string"),
                           F.col("source_end").cast("string")))
    return sets.unionByName(periods)


def history_rules(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """``reports`` carry ``previous``, the record found by the as-of join, or null."""
    c = F.col
    joined = reports.join(profiles.select("market", "required_for_comparison"), "market")
    day_before = F.date_sub("period_start", 1)
    present = c("previous").isNotNull()
    return emit(
        joined,
        (~present & c("required_for_comparison"),
         error("MISSING_PREVIOUS_OVERALL", "previous_overall")),
        (present & ~c("previous_market").eqNullSafe(c("market")),
         error("PREVIOUS_MARKET_MISMATCH", "previous_overall.market")),
        (present & ~c("previous.period_end").eqNullSafe(day_before),
         error("HISTORY_NOT_ADJACENT", "previous_overall.period_end",
               actual=c("previous.period_end"), expected=day_before)))


# --- one wide row per bundle ------------------------------------------------------------

MEASURES = ["amount_spent", "purchase_value", "purchases", "adds_to_cart", "link_clicks",
            "impressions"]
MONEY = {"amount_spent", "purchase_value"}


def measures(facts: dict[str, DataFrame]) -> DataFrame:
    """Sections stacked and summed per (key, section, product, day), duplicates counted."""
    parts = []
    for section in ("daily", "summary", "campaign", "traffic", "audience"):
        df = facts[section]
        kind = {m: "decimal(18,4)" if m in MONEY else "bigint" for m in MEASURES}
        cols = [F.col(m).try_cast(kind[m]).alias(m) if m in df.columns else
                F.lit(None).cast(kind[m]).alias(m) for m in MEASURES]
        lost = F.lit(False)
        for m in MEASURES:
            if m in df.columns:
                lost = lost | (F.col(m).isNotNull() & F.col(m).try_cast(kind[m]).isNull())
        parts.append(df.select(
            *KEY, F.lit(section).alias("section"),
            (F.col("product_id") if "product_id" in df.columns
             else F.lit(None).cast("string")).alias("product_id"),
            (F.col("day") if "day" in df.columns else F.lit(None).cast("date")).alias("day"),
            *cols, lost.alias("lost")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long.groupBy(*KEY, "section", "product_id", "day").agg(
        F.count("*").alias("n"), *[F.try_sum(m).alias(m) for m in MEASURES],
        (F.max("lost") | reduced_to_null()).alias("lost"))


def reduced_to_null() -> Column:
    """Whether a sum ran over although it had values."""
    over = F.lit(False)
    for m in MEASURES:
        over = over | ((F.count(m) > 0) & F.try_sum(m).isNull())
    return over


def amount_rules(sums: DataFrame) -> DataFrame:
    """Amounts too large to be summed exactly; their sections cannot be reconciled."""
    return issue(sums.where("lost"), "ERROR", "AMOUNT_OUT_OF_RANGE", F.concat_ws(
        ".", "section", "product_id", F.col("day").cast("string")))


def wide(sums: DataFrame, reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """All section totals of a bundle in one row, next to its overall row and settings."""
    at = lambda section, col: F.when(F.col("section") == section, F.col(col))
    total = lambda s, m: F.coalesce(F.try_sum(at(s, m)), F.lit(0)).alias(f"{s}_{m}")
    aggs = [total(s, m) for s in ("daily", "summary") for m in MEASURES[:4]]
    aggs += [total(s, m) for s in ("campaign", "traffic")
             for m in ("amount_spent", "link_clicks", "impressions")]
    aggs += [F.count(at("daily", "n")).alias("days"), F.max(at("daily", "n")).alias("day_rows"),
             F.min(at("daily", "day")).alias("first_day"),
             F.max(at("daily", "day")).alias("last_day"),
             F.count_if((F.col("section") == "daily") & F.col("day").isNull()).alias("undated")]
    for s in ("summary", "campaign", "traffic", "audience"):
        aggs += [F.count(F.when(F.col("section") == s, F.col("product_id"))).alias(f"{s}_products"),
                 F.coalesce(F.sum(at(s, "n")), F.lit(0)).alias(f"{s}_rows")]
    totals = sums.groupBy(*KEY).agg(*aggs)
    filled = reports.join(totals, KEY, "left").join(settings(profiles), "market")
    zero = [c for c in totals.columns if c not in (*KEY, "first_day", "last_day")]
    return filled.fillna(0, zero)


def coverage_rules(w: DataFrame) -> DataFrame:
    """Days must be the whole period, once each; a calendar of dates is never built."""
    c = F.col
    length = F.datediff("period_end", "period_start") + 1
    exact = ((c("days") == length) & (c("day_rows") == 1) & (c("undated") == 0)
             & (c("first_day") == c("period_start")) & (c("last_day") == c("period_end")))
    empty = (length <= 0) & (c("days") == 0) & (c("undated") == 0)
    return emit(w, (~F.coalesce(exact | empty, F.lit(False)),
                    error("DAILY_DATE_COVERAGE", "daily", actual=c("days"), expected=length)))


def _sums(w: DataFrame, section: str, label: str, path: str) -> DataFrame:
    c = F.col
    money = c("money_tolerance")
    return emit(
        w,
        apart(c(f"{section}_amount_spent").cast("double"), c("amount_spent"), money,
              f"{label}_SPEND_RECONCILIATION", path),
        apart(c(f"{section}_purchase_value").cast("double"), c("purchase_value"), money,
              f"{label}_VALUE_RECONCILIATION", path),
        differ(c(f"{section}_purchases"), c("purchases"), f"{label}_PURCHASE_RECONCILIATION",
               path),
        differ(c(f"{section}_adds_to_cart"), c("adds_to_cart"), f"{label}_ATC_RECONCILIATION",
               path))


def daily_sum_rules(w: DataFrame) -> DataFrame:
    return _sums(w, "daily", "DAILY", "daily")


def product_sum_rules(w: DataFrame) -> DataFrame:
    return _sums(w, "summary", "PRODUCT", "product_summaries")


def cart_rate_rules(w: DataFrame) -> DataFrame:
    c = F.col
    clicks = c("link_clicks")
    far, row = apart(c("add_to_cart_rate"),
                     F.try_divide(c("adds_to_cart").cast("double"), clicks.cast("double")) * 100.0,
                     c("ratio_tolerance"), "ATC_RATE_FORMULA",
                     "current_overall.add_to_cart_rate")
    return emit(w, (clicks <= 0, error("INVALID_LINK_CLICKS", "current_overall.link_clicks",
                                       actual=clicks)),
                ((clicks > 0) & far, row))


def product_set_rules(w: DataFrame, facts: dict[str, DataFrame], products: DataFrame
                      ) -> DataFrame:
    """Summaries and analyses follow the configured order; traffic and audience cover it."""
    n = F.col("n_products")
    config = products.select("market", F.col("product_id"), F.col("idx").alias("config_idx"))

    def in_place(section):
        placed = facts[section].select(*KEY, "product_id", "idx").join(
            config, ["market", "product_id"], "left")
        return placed.groupBy(*KEY).agg(
            F.count_if(F.col("idx") == F.col("config_idx")).alias(f"{section}_placed"))

    both = (w.join(in_place("summary"), KEY, "left").join(in_place("campaign"), KEY, "left")
            .fillna(0, ["summary_placed", "campaign_placed"]))
    in_order = lambda s: ((F.col(f"{s}_placed") == n) & (F.col(f"{s}_rows") == n)
                          & (F.col(f"{s}_products") == n))
    covers = lambda s: F.col(f"{s}_products") == n
    return emit(
        both,
        (F.col("require_all_three_products") & (n != 3),
         error("CONFIG_PRODUCT_COUNT", "products", actual=n, expected=F.lit(3))),
        (~in_order("summary"), error("PRODUCT_SUMMARY_SET", "product_summaries")),
        (~in_order("campaign"), error("PRODUCT_ANALYSIS_SET", "product_analyses")),
        (~covers("traffic"), error("TRAFFIC_PRODUCT_SET", "traffic")),
        (~covers("audience"), error("AUDIENCE_PRODUCT_SET", "audience")))


def total_rules(w: DataFrame) -> DataFrame:
    """Conversion campaigns plus traffic against the overall row."""
    c = F.col
    plus = lambda m: F.try_add(f"campaign_{m}", f"traffic_{m}")
    spend = plus("amount_spent").cast("double")
    clicks, shown = plus("link_clicks"), plus("impressions")
    far, row = apart(c("ctr"),
                     F.try_divide(clicks.cast("double"), shown.cast("double")) * 100.0,
                     c("ratio_tolerance"), "CTR_RECONCILIATION", "current_overall.ctr")
    return emit(
        w,
        apart(spend, c("amount_spent"), c("money_tolerance"),
              "CAMPAIGN_TRAFFIC_SPEND_RECONCILIATION", "product_analyses"),
        differ(clicks, c("link_clicks"), "CLICK_RECONCILIATION", "current_overall.link_clicks"),
        ((shown > 0) & far, row))


# --- one row per bundle and product -----------------------------------------------------

def cross_view_rules(sums: DataFrame, bundles: DataFrame, profiles: DataFrame,
                     products: DataFrame) -> DataFrame:
    """Summary, campaign, traffic and audience of one product against each other."""
    at = lambda section, col: F.when(F.col("section") == section, F.col(col))
    names = MEASURES[:4]
    per = sums.where("product_id is not null and section <> 'daily'") \
        .groupBy(*KEY, "product_id").agg(
            *[F.try_sum(at(s, m)).alias(f"{s}_{m}") for s in
              ("summary", "campaign", "traffic", "audience") for m in names],
            *[F.count(at(s, "n")).alias(f"has_{s}") for s in
              ("summary", "campaign", "traffic", "audience")])
    per = (per.join(products.select("market", "product_id"), ["market", "product_id"])
           .join(profiles.select("market", "money_tolerance"), "market")
           .where("has_summary > 0 and has_campaign > 0"))
    c, tol = F.col, F.col("money_tolerance")
    path = lambda head, tail: F.concat(F.lit(head), c("product_id"), F.lit(tail))
    dbl = lambda name: c(name).cast("double")
    traffic, audience = c("has_traffic") > 0, c("has_audience") > 0
    guard = lambda cond, rule: (cond & rule[0], rule[1])
    uneven = lambda s: ((c(f"{s}_purchases") != c("campaign_purchases"))
                        | (c(f"{s}_adds_to_cart") != c("campaign_adds_to_cart")))
    summary_path = "product_analyses."
    return emit(
        per,
        guard(traffic, apart(
            dbl("summary_amount_spent"),
            F.try_add("campaign_amount_spent", "traffic_amount_spent").cast("double"), tol,
            "PRODUCT_SPEND_COMPONENTS", path(summary_path, ".summary.amount_spent"))),
        guard(audience, apart(dbl("audience_amount_spent"), dbl("campaign_amount_spent"), tol,
                              "AUDIENCE_CAMPAIGN_SPEND", path("audience.", ".amount_spent"))),
        guard(audience, apart(dbl("audience_purchase_value"), dbl("campaign_purchase_value"),
                              tol, "AUDIENCE_CAMPAIGN_VALUE",
                              path("audience.", ".purchase_value"))),
        (audience & uneven("audience"),
         error("AUDIENCE_CAMPAIGN_COUNTS", path("audience.", ""))),
        (uneven("summary"), error("SUMMARY_CAMPAIGN_COUNTS", path(summary_path, ".summary"))),
        apart(dbl("summary_purchase_value"), dbl("campaign_purchase_value"), tol,
              "SUMMARY_CAMPAIGN_VALUE", path(summary_path, ".summary.purchase_value")))


def creative_rules(creatives: DataFrame, profiles: DataFrame, products: DataFrame) -> DataFrame:
    c = F.col
    joined = creatives.join(
        products.select("market", "product_id", F.col("creative_pin")), ["market", "product_id"]
    ).join(profiles.select("market", "fail_on_missing_creative_metric"), "market")
    plain = lambda col: strip(casefold(col))
    path = lambda tail: F.concat(F.lit("product_analyses."), c("product_id"),
                                 F.lit(tail))
    joined = joined.withColumn("_pinned", plain(c("ad_name")) == plain(c("creative_pin")))
    return emit(
        joined,
        (~c("_pinned"), error("CREATIVE_PIN_MISMATCH", path(".creative.ad_name"),
                              actual=c("ad_name"), expected=c("creative_pin"))),
        (~c("campaign_product").eqNullSafe(c("product_id")),
         error("PRODUCT_ID_MISMATCH", path(""))),
        *[(c("fail_on_missing_creative_metric") & (c(m) < 0),
           error("INVALID_CREATIVE_METRIC", path(f".creative.{m}"), actual=c(m)))
          for m in CREATIVE_METRICS])


# --- keywords, lineage ------------------------------------------------------------------

def keyword_rules(keywords: DataFrame, reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """Count, order and ranks of the published keywords."""
    order = W.partitionBy(*KEY).orderBy("rank")
    seen = keywords.select(
        *KEY, "rank", (F.lag("conversions").over(order) < F.col("conversions")).alias("rising"),
        (F.row_number().over(order) != F.col("rank")).alias("shifted"))
    per = seen.groupBy(*KEY).agg(F.count("*").alias("n"), F.bool_or("rising").alias("rising"),
                                 F.bool_or("shifted").alias("shifted"))
    joined = (reports.select(*KEY).join(per, KEY, "left")
              .join(profiles.select("market", "keyword_top_n"), "market").fillna(0, ["n"]))
    return emit(
        joined,
        (F.col("n") != F.col("keyword_top_n"),
         error("KEYWORD_COUNT", "keywords", actual=F.col("n"),
               expected=F.col("keyword_top_n"))),
        (F.coalesce("rising", F.lit(False)), error("KEYWORD_ORDER", "keywords")),
        (F.coalesce("shifted", F.lit(False)), error("KEYWORD_RANK", "keywords")))


def lineage_rules(expected: DataFrame, lineage: DataFrame) -> DataFrame:
    """``expected(key, target)`` without an entry, and targets with several entries."""
    counts = lineage.groupBy(*KEY, "target").agg(F.count("*").alias("n"))
    lost = expected.join(counts, [*KEY, "target"], "left_anti")
    missing = issue(lost.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("target").alias("t")),
                    "ERROR", "MISSING_LINEAGE", "lineage", actual=F.col("n"),
                    message=F.col("t"))
    doubled = counts.where("n > 1").groupBy(*KEY).agg(F.count("*").alias("n"),
                                                      F.min("target").alias("t"))
    return missing.unionByName(issue(doubled, "WARNING", "DUPLICATE_LINEAGE_TARGET", "lineage",
                                     actual=F.col("n"), message=F.col("t")))


def union_issues(*parts: DataFrame) -> DataFrame:
    result = parts[0].select(*KEY, *FIELDS)
    for part in parts[1:]:
        result = result.unionByName(part.select(*KEY, *FIELDS))
    return result
