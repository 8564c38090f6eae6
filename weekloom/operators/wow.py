"""Week-over-week change facts, their ranking and the evidence text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.functions.numbers import number_text, round6
from weekloom.functions.text import entity_token
from weekloom.operators.guards import unsafe_prose

IDENT = ["scope", "product_id", "name"]
SECTION = {"overall": "current_overall", "product_campaign": "product_analyses",
           "audience": "audience", "traffic": "traffic"}


def gate(pairs: DataFrame) -> DataFrame:
    """Status of comparing a bundle with ``previous``, the snapshot chosen for it."""
    c = F.col
    reason = (F.when(c("previous").isNull(), "missing_previous_snapshot")
              .when(c("previous.market") != c("market"), "market_mismatch")
              .when(c("previous.currency") != c("currency"), "currency_mismatch")
              .when(F.date_add("previous.period_end", 1) != c("period_start"),
                    "non_adjacent_period"))
    return pairs.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "available").otherwise("unavailable"))


def entities(facts: dict[str, DataFrame]) -> DataFrame:
    """One row per (key, scope, identity) with its metrics as a map; the first row wins."""
    def metrics(df, scope):
        return F.map_from_arrays(
            F.array(*[F.lit(m) for m in fixed.SCOPE_METRICS[scope]]),
            F.array(*[F.col(m).cast("double") for m in fixed.SCOPE_METRICS[scope]]))

    none = F.lit("")
    parts = []
    for scope, section, name in (("overall", "overall", None),
                                 ("product_campaign", "campaign", "campaign_name"),
                                 ("audience", "audience", "ad_set_name"),
                                 ("traffic", "traffic", "campaign_name")):
        df = facts[section]
        overall = scope == "overall"
        parts.append(df.select(
            *KEY, F.lit(scope).alias("scope"),
            (F.col("market") if overall else F.col("product_id")).alias("product_id"),
            (none if name is None or scope == "product_campaign" else F.col(name)).alias("name"),
            (none if name is None else F.coalesce(F.col(name), none)).alias("row_name"),
            (F.lit(0).cast("bigint") if overall else F.col("idx")).alias("idx"),
            metrics(df, scope).alias("metrics")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    named = F.col("scope").isin("overall", "product_campaign") | (F.col("name") != "")
    rows = rows.where((F.col("product_id") != "") & named)
    return rows.groupBy(*KEY, *IDENT).agg(
        F.min_by(F.struct("idx", "row_name", "metrics"), "idx").alias("r")).select(
            *KEY, *IDENT, "r.idx", "r.row_name", "r.metrics")


def change(previous: Column, current: Column) -> dict[str, Column]:
    """Delta, direction and percent of two numbers; compute significance from the result."""
    raw = current - previous
    flat = F.abs(raw) <= 1e-12
    delta = F.when(flat, F.lit(0.0)).otherwise(raw)
    return {"delta": delta,
            "direction": F.when(flat, "flat").when(raw > 0, "up").otherwise("down"),
            "percent_change": F.when(previous != 0, round6(delta / F.abs(previous) * 100.0))}


def significance() -> Column:
    size = F.abs(F.col("percent_change"))
    return (F.when(F.col("direction") == "flat", "none")
            .when(size.isNull(), "high").when(size < 5, "none").when(size < 10, "low")
            .when(size < 25, "medium").otherwise("high"))


def metric_class(position: int) -> Column:
    """Look up unit, good direction or labels of the ``metric`` column."""
    table = F.create_map(*[F.lit(x) for m, row in fixed.METRICS.items()
                           for x in (m, row[position])])
    return F.try_element_at(table, F.col("metric"))


def with_change(df: DataFrame) -> DataFrame:
    """Add change fields to rows of (metric, previous, current)."""
    df = df.withColumns(change(F.col("previous"), F.col("current")))
    better = metric_class(1)
    signal = (F.when((F.col("direction") == "flat") | (better == "neutral"), "neutral")
              .when(F.col("direction") == better, "better").otherwise("worse"))
    return df.withColumns({
        "delta": round6(F.col("delta")), "significance": significance(),
        "performance_signal": signal, "unit": F.coalesce(metric_class(0), F.lit("number"))})


def source_path(idx: str) -> Column:
    section = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION.items() for x in kv]),
                           F.col("scope"))
    at = F.concat(F.lit("["), F.col(idx).cast("string"), F.lit("]"))
    inner = (F.when(F.col("scope") == "overall", "")
             .when(F.col("scope") == "product_campaign", F.concat(at, F.lit(".campaign")))
             .otherwise(at))
    return F.concat(F.lit("$."), section, inner, F.lit("."), F.col("metric"))


def change_facts(rows: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Facts of every entity present in both weeks.

    ``rows`` are ``entities`` of all bundles, ``pairs(key, currency, prev_bundle_id)`` the
    comparable bundles, ``names(key, product_id, display_name)`` the current display names.
    """
    current = rows.join(pairs.select(*KEY, "currency", "prev_bundle_id"), KEY)
    earlier = rows.select(F.col("bundle_id").alias("prev_bundle_id"), *IDENT,
                          F.col("idx").alias("prev_idx"), F.col("metrics").alias("prev_metrics"))
    both = current.join(earlier, ["prev_bundle_id", *IDENT])
    shown = both.where("scope = 'product_campaign'").select(*KEY, "product_id").join(
        names.select(*KEY, "product_id", "display_name"), [*KEY, "product_id"])
    both = both.join(shown, [*KEY, "product_id"], "left")
    both = both.withColumn("display_name", F.coalesce(
        F.nullif(F.col("display_name"), F.lit("")), "product_id"))
    token = F.when(F.col("scope") == "overall", "").when(
        F.col("scope") == "product_campaign",
        F.concat(F.lit("."), entity_token(F.col("product_id")))).otherwise(
        F.concat(F.lit("."), entity_token(F.col("product_id"), F.col("name"))))
    whole = F.col("scope") == "overall"
    label = F.when(whole, F.col("market")).otherwise(F.concat_ws(
        " / ", "display_name", F.nullif(F.col("row_name"), F.lit(""))))
    tag = F.when(F.col("scope") == "audience", F.to_json(F.struct(
        F.col("row_name").alias("ad_set_name"), "display_name", "product_id"))).when(
        whole, F.to_json(F.struct("market"))).otherwise(F.to_json(F.struct(
            F.col("row_name").alias("campaign_name"), "display_name", "product_id")))
    both = both.withColumns({"token": token, "entity_label": label, "entity": tag})
    facts = both.select(
        *KEY, "currency", "scope", "product_id", "display_name", "row_name", "token",
        "entity_label", "entity", "idx", "prev_idx", "prev_metrics",
        F.explode("metrics").alias("metric", "current"))
    facts = facts.withColumn("previous", F.try_element_at("prev_metrics", F.col("metric")))
    facts = facts.where("current is not null and previous is not null")
    facts = facts.withColumns({
        "fact_id": F.concat("scope", "token", F.lit("."), "metric"),
        "previous_path": source_path("prev_idx"), "current_path": source_path("idx")})
    return with_change(facts.drop("prev_metrics", "token", "idx", "prev_idx"))


def order_of(values: list[str], col: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return F.coalesce(F.try_element_at(table, col), F.lit(len(values)))


def preferred(scope: Column, metric: Column) -> Column:
    place = F.lit(0)
    for name, metrics in fixed.PREFERRED_METRICS.items():
        place = F.when(scope == name, order_of(metrics, metric)).otherwise(place)
    return place


def with_order(facts: DataFrame) -> DataFrame:
    """Sort columns: strongest significance, largest percent, preferred metric, scope, id."""
    level = order_of(["high", "medium", "low", "none"], F.col("significance"))
    size = F.when(F.col("direction") == "flat", 0.0).otherwise(
        F.coalesce(F.abs("percent_change"), F.lit(float("inf"))))
    return facts.withColumns({
        "o1": level, "o2": -size, "o3": preferred(F.col("scope"), F.col("metric")),
        "o4": order_of(fixed.SCOPES, F.col("scope")), "o5": F.col("fact_id")})


ORDER = ["o1", "o2", "o3", "o4", "o5"]


def ranked(facts: DataFrame) -> DataFrame:
    best_first = W.partitionBy(*KEY).orderBy(*ORDER)
    return with_order(facts).withColumn(
        "position", F.row_number().over(best_first).cast("bigint"))


def candidates(facts: DataFrame) -> DataFrame:
    """Up to 18 changed facts per bundle: six per scope in turn over its entities, then by rank.

    Every step keeps only the first few rows of a group, so group limits run before shuffles.
    """
    moved = with_order(facts.where("direction <> 'flat'"))
    busy = F.max(F.col("scope") != "overall").over(W.partitionBy(*KEY))
    moved = moved.withColumn("busy", busy).where(~F.col("busy") | (F.col("scope") != "overall"))
    depth = F.row_number().over(W.partitionBy(*KEY, "scope", "entity").orderBy(*ORDER))
    turn = F.row_number().over(W.partitionBy(*KEY, "scope").orderBy("depth", "entity"))
    limit = fixed.MAX_PER_SCOPE
    taken = (moved.withColumn("depth", depth).where(F.col("depth") <= limit)
             .withColumn("turn", turn).where(F.col("turn") <= limit)
             .select(*KEY, "fact_id", F.lit(0).alias("filler")))
    rest = moved.join(taken.select(*KEY, "fact_id"), [*KEY, "fact_id"], "left_anti")
    place = F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER))
    cap = fixed.MAX_CANDIDATES
    fill = (rest.withColumn("place", place).where(F.col("place") <= cap)
            .select(*KEY, "fact_id", F.lit(1).alias("filler")))
    pool = moved.join(taken.unionByName(fill), [*KEY, "fact_id"])
    # scope shares never exceed the cap; the best of the rest fill the free seats
    seat = F.row_number().over(W.partitionBy(*KEY).orderBy("filler", *ORDER))
    chosen = pool.withColumn("seat", seat).where(F.col("seat") <= cap)
    return chosen.withColumn("position", place.cast("bigint")).drop("busy", "filler", "seat")


def safe_label(facts: DataFrame) -> DataFrame:
    """``safe_label``: the entity label, else the product id, else the token of the fact id."""
    squeeze = lambda col, n: F.substring(F.trim(F.regexp_replace(
        col, r"(?U)\s+", " ")), 1, n)
    facts = facts.withColumns({
        "_label": squeeze(F.col("entity_label"), 120),
        "_product": F.when(F.col("scope") != "overall", squeeze(F.col("product_id"), 64))})
    facts = facts.withColumns({"_label_bad": unsafe_prose(F.col("_label")),
                               "_product_bad": unsafe_prose(F.col("_product"))})
    safe = (F.when((F.col("_label") != "") & F.col("_label_bad").isNull(), F.col("_label"))
            .when((F.col("_product") != "") & F.col("_product_bad").isNull(), F.col("_product"))
            .otherwise(F.split_part("fact_id", F.lit("."), F.lit(2))))
    return facts.withColumn("safe_label", safe).drop(
        "_label", "_product", "_label_bad", "_product_bad")


def masked(col: Column) -> Column:
    return F.when(unsafe_prose(col).isNotNull(), fixed.UNSAFE_LABEL).otherwise(col)


def evidence(facts: DataFrame) -> DataFrame:
    """``evidence_zh`` and ``evidence_en`` sentences from rows with ``safe_label``."""
    c = F.col
    unit, currency = c("unit"), c("currency")
    text = lambda col: number_text(col, unit, currency)
    labels = lambda i: F.element_at(F.create_map(*[
        F.lit(x) for s, names in fixed.SCOPE_LABELS.items() for x in (s, names[i])]), c("scope"))
    plain = F.regexp_replace("metric", "_", " ")
    size = F.abs("delta")
    points = unit == "percentage_points"
    signed = F.concat(F.when(c("percent_change") < 0, "-").otherwise("+"),
                      F.format_number(F.abs("percent_change"), 2), F.lit("%"))
    up, down = c("direction") == "up", c("direction") == "down"
    prefix = lambda i: F.when(c("scope") == "overall", labels(i)).otherwise(
        F.concat(labels(i), F.lit(" "), c("safe_label")))
    facts = facts.withColumns({
        "_now": text(c("current")), "_then": text(c("previous")),
        "_zh": F.when(points, F.concat(F.format_number(size, 2), F.lit(" 个百分点")))
        .otherwise(text(size)),
        "_en": F.when(points, F.concat(F.format_number(size, 2), F.lit(" pp")))
        .otherwise(text(size))})
    moved_zh = (F.when(up, F.concat(F.lit("增加 "), c("_zh")))
                .when(down, F.concat(F.lit("减少 "), c("_zh")))
                .otherwise(F.concat(F.lit("持平，变化 "), c("_zh"))))
    moved_en = (F.when(up, F.concat(F.lit("up "), c("_en")))
                .when(down, F.concat(F.lit("down "), c("_en")))
                .otherwise(F.concat(F.lit("flat, change "), c("_en"))))
    share_zh = F.when(c("percent_change").isNull(), "百分比变化不可用（上周为零）").otherwise(
        F.concat(F.lit("环比 "), signed))
    share_en = F.when(c("percent_change").isNull(),
                      "percentage change unavailable (previous value was zero)").otherwise(
        F.concat(F.lit("week over week "), signed))
    return facts.withColumns({
        "evidence_zh": F.concat(
            prefix(0), F.lit(" · "), F.coalesce(metric_class(2), plain), F.lit("：本周 "),
            c("_now"), F.lit("，上周 "), c("_then"), F.lit("，"), moved_zh, F.lit("（"),
            share_zh, F.lit("）。")),
        "evidence_en": F.concat(
            prefix(1), F.lit(" · "), F.coalesce(metric_class(3), F.initcap(plain)),
            F.lit(": current "), c("_now"), F.lit(", previous "), c("_then"), F.lit(", "),
            moved_en, F.lit(" ("), share_en, F.lit(")."))}).drop("_now", "_then", "_zh", "_en")
