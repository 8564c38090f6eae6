"""Reconciliation rules over the derived bundles."""

from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.checks import ads
from weekloom.checks.registry import check, once
from weekloom.checks.sections import found
from weekloom.issues import verdict
from weekloom.operators import facts as A
from weekloom.operators import lineage as L
from weekloom.operators import rules as U
from weekloom.plans import weekly
from weekloom.session import cut, cut_all
from weekloom.sources import history as H

METRICS_SQL = ", ".join(fixed.OVERALL_METRICS)
HISTORY = ads.BASE + f""",
history as (
  select market, period_start, period_end, true as is_db, amount_spent
  from overall_x where not (m = 1 and w = 1)
  union all
  select market, cast(period_start - interval 7 day as date),
         cast(period_end - interval 7 day as date), false, amount_spent
  from overall_x where w = 0
  union all
  select market, period_start, period_end, false, -amount_spent from overall_x where w = 2),
prev as (
  select o.bundle_id, o.market, o.period_start,
         max_by(struct_pack(s := h.period_start, e := h.period_end, d := h.is_db,
                            a := h.amount_spent),
                struct_pack(e := h.period_end, s := h.period_start, d := h.is_db)) as p
  from overall_x o join history h
    on h.market = o.market and h.period_end < o.period_start
  group by all)
"""


@once
def staged_facts(spark, sf):
    got, profiles = found(spark, sf)
    return cut_all(A.build_facts(got, profiles))


@once
def history_rows(spark, sf):
    """Earlier loads of all weeks but one, seeds before the first week, and stale seeds."""
    overall = staged_facts(spark, sf)["overall"].select(
        "market", "period_start", "period_end", *fixed.OVERALL_METRICS)
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    named = lambda df, db, file: df.withColumns({
        "is_db": F.lit(db), "source_file": F.lit(file)})
    seeds = overall.where(week == 0).withColumns({
        "period_start": F.date_sub("period_start", 7), "period_end": F.date_sub("period_end", 7)})
    stale = overall.where(week == 2).withColumn("amount_spent", -F.col("amount_spent"))
    return cut(named(overall.where(~((F.col("market") == "M1") & (week == 1))), True, "history")
               .unionByName(named(seeds, False, "seed.json"))
               .unionByName(named(stale, False, "seed.json")))


@once
def reports(spark, sf):
    return cut(weekly.report_rows(staged_facts(spark, sf)["overall"], found(spark, sf)[1],
                                  history_rows(spark, sf)))


@once
def sums(spark, sf):
    return cut(U.measures(staged_facts(spark, sf)))


@once
def wide(spark, sf):
    return cut(U.wide(sums(spark, sf), reports(spark, sf), found(spark, sf)[1]))


def shown(issues):
    return issues.select("market", "period_start", "severity", "code", "path")


def rows_sql(base, *selects):
    return base + " union all ".join(selects)


def one(code, path, source, severity="ERROR"):
    return (f" select market, period_start, '{severity}' as severity, '{code}' as code, "
            f"{path} as path from {source}")


@check("previous_period_asof", HISTORY + """
select market, period_start, p.s as previous_start, p.e as previous_end, p.d as is_db,
       p.a as amount_spent
from prev""")
def previous_period_asof(spark, sf):
    current = reports(spark, sf).drop("previous")
    got = H.previous_period(current.select("market", "period_start"), history_rows(spark, sf))
    return got.where("previous is not null").select(
        "market", "period_start", F.col("previous.period_start").alias("previous_start"),
        F.col("previous.period_end").alias("previous_end"), "previous.is_db",
        "previous.amount_spent")


@check("rule_metadata", rows_sql(
    ads.BASE, one("SCHEMA_VERSION_MISMATCH", "'schema_version'", "overall_x where w = 1"),
    one("TEMPLATE_VERSION_MISMATCH", "'template_version'", "overall_x where m = 2"),
    one("MARKET_MISMATCH", "'market'", "overall_x where m = 3 and w = 0"),
    one("OVERALL_PERIOD_MISMATCH", "'current_overall'", "overall_x where w = 3"),
    one("OVERALL_MARKET_MISMATCH", "'current_overall.market'",
        "overall_x where m = 1 and w = 2")))
def rule_metadata(spark, sf):
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    m = F.col("market")
    swap = lambda cond, value, col: F.when(cond, value).otherwise(F.col(col))
    changed = reports(spark, sf).withColumns({
        "schema_version": swap(week == 1, "0.9.0", "schema_version"),
        "template_version": swap(m == "M2", "old", "template_version"),
        "config_market": swap((m == "M3") & (week == 0), "M0", "config_market"),
        "overall_end": swap(week == 3, F.date_sub("overall_end", 1), "overall_end"),
        "overall_market": swap((m == "M1") & (week == 2), "M0", "overall_market")})
    return shown(U.metadata_rules(changed, found(spark, sf)[1]))


@check("rule_sources", rows_sql(
    ads.BASE, one("SOURCE_SET_MISMATCH", "'source_files'", "overall_x where fault in (6, 7)"),
    one("SOURCE_PERIOD_MISMATCH", "'source_periods.creative'", "overall_x where w = 2"),
    one("SOURCE_PERIOD_MISMATCH", "'source_periods.audience'",
        "overall_x where m = 1 and fault <> 6")))
def rule_sources(spark, sf):
    got, profiles = found(spark, sf)
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    late = (F.col("kind") == "creative") & (week == 2)
    undated = (F.col("kind") == "audience") & (F.col("market") == "M1")
    tables = got["tables"].withColumn("source_end", F.when(
        late, F.date_sub("source_end", 1)).when(~undated, F.col("source_end")))
    return shown(U.source_rules(reports(spark, sf), tables, profiles))


@check("rule_history", HISTORY + ",".join(["", """
w as (select o.market, o.period_start, p, o.w, o.m from overall_x o
      left join prev using (bundle_id))""", ""]).rstrip(",") + one(
    "HISTORY_NOT_ADJACENT", "'previous_overall.period_end'",
    "w where w > 0 and p.e <> period_start - interval 1 day and m <> 4") + " union all " + one(
    "MISSING_PREVIOUS_OVERALL", "'previous_overall'", "w where m = 4") + " union all " + one(
    "PREVIOUS_MARKET_MISMATCH", "'previous_overall.market'", "w where m = 3"))
def rule_history(spark, sf):
    m = F.col("market")
    changed = reports(spark, sf).withColumns({
        "previous": F.when(m != "M4", F.col("previous")),
        "previous_market": F.when(m == "M3", "M0").otherwise(F.col("previous_market"))})
    return shown(U.history_rules(changed, found(spark, sf)[1]))


@check("rule_daily_coverage", ads.BASE + """,
d as (select bundle_id, any_value(market) as market, any_value(period_start) as period_start,
             list_sort(list(day)) as days, any_value(period_end) as period_end
      from daily_x group by bundle_id)
select market, period_start, 'ERROR' as severity, 'DAILY_DATE_COVERAGE' as code, 'daily' as path
from d where days <> [cast(x as date) for x in generate_series(period_start, period_end,
                                                              interval 1 day)]""")
def rule_daily_coverage(spark, sf):
    return shown(U.coverage_rules(wide(spark, sf)))


SECTION_SUMS = """,
t as (select bundle_id, sum(cast(amount_spent as decimal(18,4))) as spend,
             sum(cast(purchase_value as decimal(18,4))) as val, sum(purchases) as purchases,
             sum(adds_to_cart) as adds from {source} group by bundle_id),
j as (select o.*, t.spend, t.val, t.purchases as n_purchases, t.adds
      from overall_x o join t using (bundle_id)) """


def sum_rules(source, label, path):
    far = "j where abs(cast({} as double) - {}) > 0.01 + 1e-9"
    path = f"'{path}'"
    return rows_sql(
        ads.BASE + SECTION_SUMS.format(source=source),
        one(f"{label}_SPEND_RECONCILIATION", path, far.format("spend", "amount_spent")),
        one(f"{label}_VALUE_RECONCILIATION", path, far.format("val", "purchase_value")),
        one(f"{label}_PURCHASE_RECONCILIATION", path, "j where n_purchases <> purchases"),
        one(f"{label}_ATC_RECONCILIATION", path, "j where adds <> adds_to_cart"))


@check("rule_daily_sums", sum_rules("daily_x", "DAILY", "daily"))
def rule_daily_sums(spark, sf):
    return shown(U.daily_sum_rules(wide(spark, sf)))


@check("rule_product_sums", sum_rules("summary_x", "PRODUCT", "product_summaries"))
def rule_product_sums(spark, sf):
    return shown(U.product_sum_rules(wide(spark, sf)))


@check("rule_atc_rate", rows_sql(
    ads.BASE, one("ATC_RATE_FORMULA", "'current_overall.add_to_cart_rate'",
                  "overall_x where m = 2 and w <> 1"),
    one("INVALID_LINK_CLICKS", "'current_overall.link_clicks'", "overall_x where w = 1")))
def rule_atc_rate(spark, sf):
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    changed = wide(spark, sf).withColumns({
        "add_to_cart_rate": F.col("add_to_cart_rate")
        + F.when(F.col("market") == "M2", 0.02).otherwise(0.005),
        "link_clicks": F.when(week == 1, F.lit(0)).otherwise(F.col("link_clicks"))})
    return shown(U.cart_rate_rules(changed))


@check("rule_product_sets", rows_sql(
    ads.BASE + """,
n as (select o.*, (select count(distinct product_id) from audience_x a
                   where a.bundle_id = o.bundle_id) as n_audience from overall_x o) """,
    one("AUDIENCE_PRODUCT_SET", "'audience'", "n where n_audience <> 3"),
    one("TRAFFIC_PRODUCT_SET", "'traffic'", "n where w = 3"),
    one("PRODUCT_SUMMARY_SET", "'product_summaries'", "n where m = 2"),
    one("PRODUCT_ANALYSIS_SET", "'product_analyses'", "n where m = 3")))
def rule_product_sets(spark, sf):
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    facts = dict(staged_facts(spark, sf))
    products = A.dim_product(found(spark, sf)[1])
    facts["traffic"] = facts["traffic"].where(~((week == 3) & (F.col("product_id") == "P1")))
    facts["summary"] = facts["summary"].withColumn("idx", F.when(
        F.col("market") == "M2", 2 - F.col("idx")).otherwise(F.col("idx")))
    again = facts["campaign"].where("market = 'M3' and product_id = 'P0'")
    facts["campaign"] = facts["campaign"].unionByName(again)
    w = U.wide(U.measures(facts), reports(spark, sf), found(spark, sf)[1])
    return shown(U.product_set_rules(w, facts, products))


@check("rule_totals", ads.BASE + """,
t as (select bundle_id, sum(cast(amount_spent as decimal(18,4))) as spend,
             sum(link_clicks) as clicks, sum(impressions) as shown
      from (select bundle_id, amount_spent, link_clicks, impressions from campaign_x
            where product_id <> 'P2' or market <> 'M2'
            union all
            select bundle_id, amount_spent, link_clicks, impressions from traffic_x)
      group by bundle_id),
j as (select o.*, spend, clicks, shown from overall_x o join t using (bundle_id))
""" + " union all ".join([
    one("CAMPAIGN_TRAFFIC_SPEND_RECONCILIATION", "'product_analyses'",
        "j where abs(cast(spend as double) - amount_spent) > 0.01 + 1e-9"),
    one("CLICK_RECONCILIATION", "'current_overall.link_clicks'", "j where clicks <> link_clicks"),
    one("CTR_RECONCILIATION", "'current_overall.ctr'",
        "j where shown > 0 and abs(ctr - clicks / shown * 100.0) > 0.01 + 1e-9")]))
def rule_totals(spark, sf):
    facts = dict(staged_facts(spark, sf))
    facts["campaign"] = facts["campaign"].where("product_id <> 'P2' or market <> 'M2'")
    w = U.wide(U.measures(facts), reports(spark, sf), found(spark, sf)[1])
    return shown(U.total_rules(w))


@check("rule_creative", ads.BASE + " union all ".join([
    one("CREATIVE_PIN_MISMATCH", "'product_analyses.' || product_id || '.creative.ad_name'",
        "creative_x where market = 'M1'"),
    one("PRODUCT_ID_MISMATCH", "'product_analyses.' || product_id",
        "creative_x where market = 'M2' and product_id = 'P1'")] + [
    one("INVALID_CREATIVE_METRIC", f"'product_analyses.' || product_id || '.creative.{m}'",
        f"creative_x where market = 'M3' and {m} > 3") for m in U.CREATIVE_METRICS]))
def rule_creative(spark, sf):
    creative, m = staged_facts(spark, sf)["creative"], F.col("market")
    wrong = creative.withColumns({
        "ad_name": F.when(m == "M1", "OTHER").otherwise(F.col("ad_name")),
        "campaign_product": F.when((m == "M2") & (F.col("product_id") == "P1"), "P0")
        .otherwise(F.col("campaign_product")),
        **{x: F.when((m == "M3") & (F.col(x) > 3), -F.col(x)).otherwise(F.col(x))
           for x in U.CREATIVE_METRICS}})
    profiles = found(spark, sf)[1]
    return shown(U.creative_rules(wrong, profiles, A.dim_product(profiles)))


CROSS = """,
c as (
  select s.market, s.period_start, s.product_id as p, s.amount_spent as s_spend,
         s.purchase_value as s_val, s.purchases as s_n, s.adds_to_cart as s_adds,
         c.amount_spent as c_spend, c.purchase_value as c_val, c.purchases as c_n,
         c.adds_to_cart as c_adds, t.amount_spent as t_spend, a.amount_spent as a_spend,
         a.purchase_value as a_val, a.purchases as a_n, a.adds_to_cart as a_adds
  from summary_x s join campaign_x c using (bundle_id, product_id)
  left join traffic_x t using (bundle_id, product_id)
  left join audience_x a using (bundle_id, product_id)) """


@check("rule_cross_view", ads.BASE + CROSS + " union all ".join([
    one("PRODUCT_SPEND_COMPONENTS", "'product_analyses.' || p || '.summary.amount_spent'",
        "c where abs(s_spend - (c_spend + t_spend)) > 0.01 + 1e-9"),
    one("AUDIENCE_CAMPAIGN_SPEND", "'audience.' || p || '.amount_spent'",
        "c where abs(a_spend - c_spend) > 0.01 + 1e-9"),
    one("AUDIENCE_CAMPAIGN_VALUE", "'audience.' || p || '.purchase_value'",
        "c where abs(a_val - c_val) > 0.01 + 1e-9"),
    one("AUDIENCE_CAMPAIGN_COUNTS", "'audience.' || p",
        "c where a_n <> c_n or a_adds <> c_adds"),
    one("SUMMARY_CAMPAIGN_COUNTS", "'product_analyses.' || p || '.summary'",
        "c where s_n <> c_n or s_adds <> c_adds"),
    one("SUMMARY_CAMPAIGN_VALUE", "'product_analyses.' || p || '.summary.purchase_value'",
        "c where abs(s_val - c_val) > 0.01 + 1e-9")]))
def rule_cross_view(spark, sf):
    profiles = found(spark, sf)[1]
    return shown(U.cross_view_rules(sums(spark, sf), reports(spark, sf), profiles,
                                    A.dim_product(profiles)))


@check("rule_keywords", ads.BASE + """,
kx as (select bundle_id, market, period_start,
              case when market = 'M2' and "rank" = 3 then 4 else "rank" end as r,
              case when market = 'M3' and "rank" = 5 then conversions + 1000
                   else conversions end as conversions
       from keyword_x where not (market = 'M1' and "rank" = 8)),
o as (select *, lag(conversions) over (partition by bundle_id order by r) as before,
             row_number() over (partition by bundle_id order by r) as place from kx)
""" + " union all ".join([
    one("KEYWORD_COUNT", "'keywords'", """overall_x x where (select count(*) from kx
        where kx.bundle_id = x.bundle_id) <> 8"""),
    one("KEYWORD_ORDER", "'keywords'",
        "(select distinct market, period_start from o where before < conversions)"),
    one("KEYWORD_RANK", "'keywords'",
        "(select distinct market, period_start from o where place <> r)")]))
def rule_keywords(spark, sf):
    m, r = F.col("market"), F.col("rank")
    words = staged_facts(spark, sf)["keywords"].where(~((m == "M1") & (r == 8)))
    words = words.withColumn("conversions", F.col("conversions") + F.when(
        (m == "M3") & (r == 5), 1000.0).otherwise(0.0))
    words = words.withColumn("rank", F.when((m == "M2") & (r == 3), 4).otherwise(r))
    return shown(U.keyword_rules(words, reports(spark, sf), found(spark, sf)[1]))


@once
def lineage(spark, sf):
    return cut(L.build_lineage(staged_facts(spark, sf), reports(spark, sf)))


@check("rule_lineage", ads.BASE + " union all ".join([
    one("MISSING_LINEAGE", "'lineage'", "overall_x where m = 1"),
    one("DUPLICATE_LINEAGE_TARGET", "'lineage'", "overall_x where w = 2", "WARNING")]))
def rule_lineage(spark, sf):
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    entries = lineage(spark, sf)
    kept = entries.where(~((F.col("market") == "M1") & F.col("target").startswith("daily.0")))
    again = kept.where((week == 2) & F.col("target").startswith("traffic.1"))
    expected = L.expected_targets(staged_facts(spark, sf), reports(spark, sf))
    return shown(U.lineage_rules(expected, kept.unionByName(again)))


def lineage_sql():
    parts = []
    places = {"daily": "daily_x", "summary": "summary_x", "campaign": "campaign_x",
              "creative": "creative_x", "traffic": "traffic_x", "audience": "audience_x"}
    heads = {"daily": ["daily.{}"], "summary": ["product_summaries.{}",
                                               "product_analyses.{}.summary"],
             "campaign": ["product_analyses.{}.campaign"],
             "creative": ["product_analyses.{}.creative"], "traffic": ["traffic.{}"],
             "audience": ["audience.{}"]}
    for section, source in places.items():
        for head in heads[section]:
            for field in fixed.SECTION_FIELDS[section]:
                how = L.TRANSFORMS.get((section, field), fixed.IDENTITY)
                target = "'" + head.replace("{}", "' || idx || '") + f".{field}'"
                parts.append(f"select market, period_start, {target} as target, "
                             f"'{how}' as transform, 1 as cells from {source}")
    for field in fixed.SECTION_FIELDS["keywords"]:
        how = L.TRANSFORMS.get(("keywords", field), fixed.IDENTITY)
        parts.append("select market, period_start, 'keywords.' || (\"rank\" - 1) || "
                     f"'.{field}', '{how}', 1 from keyword_x")
    fields = [(f, fixed.IDENTITY, 1) for f in fixed.SECTION_FIELDS["overall"]]
    fields += [("add_to_cart_rate", fixed.CART_RATE, 2), ("period_start", fixed.ISO_DATE, 1),
               ("period_end", fixed.ISO_DATE, 1)]
    for field, how, n in fields:
        parts.append(f"select market, period_start, 'current_overall.{field}', '{how}', {n} "
                     "from overall_x")
    for field in ["market", "period_start", "period_end", *fixed.OVERALL_METRICS]:
        parts.append(f"select market, period_start, 'previous_overall.{field}', "
                     f"'{fixed.FROM_HISTORY}', 1 from prev")
    return HISTORY + " union all ".join(parts)


@check("lineage_rows", lineage_sql())
def lineage_rows(spark, sf):
    return lineage(spark, sf).select("market", "period_start", "target", "transform",
                                     F.size("sources").alias("cells"))


DATES = [fixed.START_HEADER, fixed.END_HEADER]
COSTS = ["Cost per purchase", "Cost per add to cart"]
PRICES = [fixed.CTR, fixed.CPM, fixed.CPC]
#: columns of the exports, and the place of a fact's row below the first one
EXPORTS = {
    "overall": (["Starts", "Ends", fixed.SPENT, fixed.VALUE, fixed.ROAS, "Purchases",
                 "Adds to cart", *COSTS, "Link clicks", fixed.CTR, *DATES], "overall_x", "0"),
    "daily": (["Day", "Adds to cart", "Purchases", fixed.ROAS, fixed.SPENT, fixed.VALUE, *DATES],
              "daily_x", "datediff('day', day, period_end)"),
    "summary": (["Campaign name", "Name", "Adds to cart", "Purchases", fixed.ROAS,
                 "Average purchases conversion value", fixed.VALUE, fixed.SPENT, *DATES],
                "summary_x", "idx"),
    "campaign": (["Campaign name", fixed.SPENT, fixed.VALUE, fixed.ROAS, "Purchases",
                  "Adds to cart", *COSTS, "Purchases rate per landing page views",
                  "Add to cart Rate", "Impressions", "Link clicks", *PRICES, None, *DATES],
                 "campaign_x", "idx"),
    "creative": (["Ads", "Campaign name", fixed.SPENT, fixed.CPM, fixed.CPC, fixed.CTR,
                  *COSTS[::-1], fixed.ROAS, None, "Adds to cart", "Purchases", *DATES],
                 "creative_x", "idx * 7"),
    "traffic": (["Campaign name", fixed.SPENT, "Purchases", "Adds to cart", "Impressions",
                 "Link clicks", *PRICES, "Landing page views", "Cost per landing page view",
                 "Landing page views rate per link clicks", *DATES], "traffic_x", "idx"),
    "audience": (["Ad Set Name", "Adds to cart", "Purchases", fixed.ROAS, fixed.VALUE, fixed.SPENT,
                  *DATES], "audience_x", "idx"),
    "keywords": (["Keyword", "Conversions", "Conv. value / cost", "Cost", "Conv. value"],
                 "keyword_x", "cast(substr(keyword, 4) as bigint)")}
HEADS = {"overall": ["'current_overall'"], "daily": ["'daily.' || idx"],
         "summary": ["'product_summaries.' || idx", "'product_analyses.' || idx || '.summary'"],
         "campaign": ["'product_analyses.' || idx || '.campaign'"],
         "creative": ["'product_analyses.' || idx || '.creative'"],
         "traffic": ["'traffic.' || idx"], "audience": ["'audience.' || idx"],
         "keywords": ["'keywords.' || (\"rank\" - 1)"]}


def cells_sql():
    """Every cell that a published field is read from."""
    parts = []
    average = "case m % 2 when 0 then '{}' else '{}' end".format(*fixed.AVERAGE_VALUE_HEADERS[:2])

    def part(section, head, field, nth, header, amount):
        columns, source, offset = EXPORTS[section]
        letter = chr(65 + columns.index(header))
        parts.append(
            f"select market, period_start, {head} || '.{field}' as target, "
            f"cast({nth} as int) as nth, 'CSV' as sheet, m % 3 + 2 + 2 * ({offset}) as row_no, "
            f"'{letter}' || (m % 3 + 2 + 2 * ({offset})) as cell, "
            + (f"'{header}'" if header else average) + f" as header, {amount} as amount "
            f"from (select *, cast(substr(market, 2) as bigint) as m from {source})"
            if section != "overall" else
            f"select market, period_start, {head} || '.{field}', {nth}, 'CSV', m % 3 + 2, "
            f"'{letter}' || (m % 3 + 2), '{header}', {amount} from overall_x")

    for section, heads in HEADS.items():
        for field, (header, kind) in fixed.SECTION_FIELDS[section].items():
            plain = kind not in ("text", "keyword", "date") and (
                section, field) not in L.TRANSFORMS
            for head in heads:
                part(section, head, field, 0, header,
                     f"cast({field} as double)" if plain else "cast(null as double)")
    for nth, (header, field) in enumerate((("Adds to cart", "adds_to_cart"),
                                           ("Link clicks", "link_clicks"))):
        part("overall", HEADS["overall"][0], "add_to_cart_rate", nth, header,
             f"cast({field} as double)")
    for field, header in zip(("period_start", "period_end"), DATES):
        part("overall", HEADS["overall"][0], field, 0, header, "cast(null as double)")
    named = [p for p in parts if " as target" in p]
    return ads.BASE + " union all ".join(named + [p for p in parts if " as target" not in p])


@check("lineage_cells", cells_sql())
def lineage_cells(spark, sf):
    """All source cells of all targets: where they stand, under which header, and their amount."""
    from weekloom.functions.numbers import parse_number

    cells = lineage(spark, sf).select(
        "market", "period_start", "target", "transform", F.posexplode("sources").alias("nth", "c")
    ).where("c.source_kind = 'bundle'")
    read = F.col("transform").isin(fixed.IDENTITY, fixed.CART_RATE)
    return cells.select(
        "market", "period_start", "target", "nth", "c.sheet", F.col("c.row").alias("row_no"),
        "c.cell", "c.header", F.when(read, parse_number(F.col("c.raw_value"))).alias("amount"))


@once
def all_issues(spark, sf):
    got, profiles = found(spark, sf)
    return weekly.check_report(got, staged_facts(spark, sf), reports(spark, sf), profiles,
                               lineage(spark, sf))


CLEAN = """
drifted as (
  select distinct bundle_id from keyed where fault in (0, 1, 2)
  and ((spend_lo <> spend and (fault < 2 or flow = 'conversion'))
       or (flow = 'conversion'
           and (adds_lo <> adds or purch_lo <> purch or val_lo <> val)))),
clean as (select * from overall_x o where fault < 6 and not (m = 1 and w = 2)
          and bundle_id not in (select bundle_id from drifted)
          and (select count(*) from daily_x d where d.bundle_id = o.bundle_id) = 7)
"""


@check("bundle_verdict", ads.BASE + "," + CLEAN + """
select o.market, o.period_start, c.bundle_id is not null as passed
from overall_x o left join clean c using (bundle_id)""")
def bundle_verdict(spark, sf):
    v = verdict(found(spark, sf)[0]["per_kind"].select(*KEY).distinct(), all_issues(spark, sf))
    return v.select("market", "period_start", "passed")


@check("issue_counts", None)
def issue_counts(spark, sf):
    return all_issues(spark, sf).groupBy("code", "severity").agg(F.count("*").alias("n"))
