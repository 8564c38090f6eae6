"""Weekly export bundles derived from the events table, as raw text rows and as SQL.

Market = user, product and campaign kind = event id, week = Monday of the event. Some
bundles are made to disagree on purpose: ``fault = (market + week) % 8`` selects which.
"""

from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.checks.registry import once, table
from weekloom.session import cut

BASE = """
with e as (
  select user_id % 5 as m, cast(date_trunc('week', ts) as date) as period_start,
         cast(ts as date) as day, event_id % 3 as p,
         case when event_id % 5 = 0 then 'traffic' else 'conversion' end as flow,
         cast(json_extract(props, '$.k') as bigint) as k, event_type,
         cast(round(value * 100) as bigint) as cents
  from events),
base as (
  select m, cast(datediff('day', date '2024-01-01', period_start) // 7 as bigint) as w,
         period_start, day, p, flow, k,
         count(*) as impressions,
         count(*) filter (event_type = 'click') as clicks,
         count(*) filter (event_type = 'view') as views,
         count(*) filter (event_type = 'signup') as adds,
         count(*) filter (event_type = 'signup' and cents <= 10000) as adds_lo,
         count(*) filter (event_type = 'purchase') as purch,
         count(*) filter (event_type = 'purchase' and cents <= 10000) as purch_lo,
         coalesce(sum(cents) filter (event_type in ('view', 'click')), 0) as spend,
         coalesce(sum(cents) filter (event_type in ('view', 'click') and cents <= 10000), 0)
           as spend_lo,
         coalesce(sum(cents) filter (event_type = 'purchase'), 0) as val,
         coalesce(sum(cents) filter (event_type = 'purchase' and cents <= 10000), 0) as val_lo
  from e group by all),
b as (
  select *, (m + w) % 8 as fault, 'M' || m as market, period_start + interval 6 day as pe
  from base),
keyed as (
  select *, cast(pe as date) as period_end,
         sha256('M' || m || '|' || cast(period_start as varchar)) as bundle_id,
         'P' || p as product_id
  from b),
overall_x as (
  select bundle_id, market, period_start, period_end, any_value(m) as m, any_value(w) as w,
         any_value(fault) as fault,
         cast(sum(spend) as double) / 100 as amount_spent,
         cast(coalesce(sum(val) filter (flow = 'conversion'), 0) as double) / 100
           as purchase_value,
         coalesce(round(coalesce(sum(val) filter (flow = 'conversion'), 0)
                        / nullif(sum(spend), 0), 6), 0) as purchase_roas,
         cast(coalesce(sum(purch) filter (flow = 'conversion'), 0) as bigint) as purchases,
         cast(coalesce(sum(adds) filter (flow = 'conversion'), 0) as bigint) as adds_to_cart,
         coalesce(round(sum(spend)
                  / nullif(100 * sum(purch) filter (flow = 'conversion'), 0), 6), 0)
           as cost_per_purchase,
         coalesce(round(sum(spend)
                  / nullif(100 * sum(adds) filter (flow = 'conversion'), 0), 6), 0)
           as cost_per_add_to_cart,
         cast(sum(clicks) as bigint) as link_clicks,
         coalesce(round(100 * sum(clicks) / nullif(sum(impressions), 0), 6), 0) as ctr,
         cast(coalesce(sum(adds) filter (flow = 'conversion'), 0) as bigint)
           / cast(sum(clicks) as bigint) * 100.0 as add_to_cart_rate
  from keyed group by bundle_id, market, period_start, period_end),
daily_x as (
  select bundle_id, market, period_start, period_end, day,
         cast(row_number() over (partition by bundle_id order by day) - 1 as bigint) as idx,
         cast(coalesce(sum(case when fault = 0 then adds_lo else adds end)
              filter (flow = 'conversion'), 0) as bigint) as adds_to_cart,
         cast(coalesce(sum(case when fault = 0 then purch_lo else purch end)
              filter (flow = 'conversion'), 0) as bigint) as purchases,
         coalesce(round(coalesce(sum(case when fault = 0 then val_lo else val end)
                                 filter (flow = 'conversion'), 0)
              / nullif(sum(case when fault = 0 then spend_lo else spend end), 0), 6), 0)
           as purchase_roas,
         cast(sum(case when fault = 0 then spend_lo else spend end) as double) / 100
           as amount_spent,
         cast(coalesce(sum(case when fault = 0 then val_lo else val end)
              filter (flow = 'conversion'), 0) as double) / 100 as purchase_value
  from keyed group by bundle_id, market, period_start, period_end, day),
prod as (
  select bundle_id, market, period_start, period_end, p, product_id, any_value(m) as m,
         any_value(fault) as fault, flow,
         sum(impressions) as impressions, sum(clicks) as clicks, sum(views) as views,
         sum(adds) as adds, sum(adds_lo) as adds_lo, sum(purch) as purch,
         sum(purch_lo) as purch_lo, sum(spend) as spend, sum(spend_lo) as spend_lo,
         sum(val) as val, sum(val_lo) as val_lo
  from keyed
  group by bundle_id, market, period_start, period_end, p, product_id, flow),
summary_raw as (
  select bundle_id, market, period_start, period_end, p, product_id,
         coalesce(sum(case when fault = 1 then adds_lo else adds end)
              filter (flow = 'conversion'), 0) as adds,
         coalesce(sum(case when fault = 1 then purch_lo else purch end)
              filter (flow = 'conversion'), 0) as purch,
         coalesce(sum(case when fault = 1 then val_lo else val end)
              filter (flow = 'conversion'), 0) as val,
         sum(case when fault = 1 then spend_lo else spend end) as spend
  from prod group by bundle_id, market, period_start, period_end, p, product_id),
summary_x as (
  select bundle_id, market, period_start, period_end, cast(p as bigint) as idx, product_id,
         'Product ' || product_id as display_name,
         'CAMPAIGN | Robo ' || product_id || ' | Conversion' as campaign_name,
         cast(adds as bigint) as adds_to_cart, cast(purch as bigint) as purchases,
         coalesce(round(val / nullif(spend, 0), 6), 0) as purchase_roas,
         coalesce(round(val / nullif(100 * purch, 0), 6), 0) as average_purchase_value,
         cast(val as double) / 100 as purchase_value,
         cast(spend as double) / 100 as amount_spent
  from summary_raw),
campaign_x as (
  select bundle_id, market, period_start, period_end, cast(p as bigint) as idx, product_id,
         'CAMPAIGN | Robo ' || product_id || ' | Conversion' as campaign_name,
         cast(spend as double) / 100 as amount_spent,
         cast(val as double) / 100 as purchase_value,
         coalesce(round(val / nullif(spend, 0), 6), 0) as purchase_roas,
         cast(purch as bigint) as purchases, cast(adds as bigint) as adds_to_cart,
         coalesce(round(spend / nullif(100 * purch, 0), 6), 0) as cost_per_purchase,
         coalesce(round(spend / nullif(100 * adds, 0), 6), 0) as cost_per_add_to_cart,
         coalesce(round(purch / nullif(views, 0), 6), 0) * 100.0 as purchase_rate,
         coalesce(round(adds / nullif(views, 0), 6), 0) * 100.0 as add_to_cart_rate,
         cast(impressions as bigint) as impressions, cast(clicks as bigint) as link_clicks,
         coalesce(round(100 * clicks / nullif(impressions, 0), 6), 0) as ctr,
         coalesce(round(10 * spend / nullif(impressions, 0), 6), 0) as cpm,
         coalesce(round(spend / nullif(100 * clicks, 0), 6), 0) as cpc,
         coalesce(round(val / nullif(100 * purch, 0), 6), 0) as average_purchase_value
  from prod where flow = 'conversion'),
creative_rows as (
  select bundle_id, market, period_start, period_end, p, product_id, day, any_value(m) as m,
         sum(impressions) as impressions, sum(clicks) as clicks, sum(adds) as adds,
         sum(purch) as purch, sum(spend) as spend, sum(val) as val
  from keyed where flow = 'conversion'
  group by bundle_id, market, period_start, period_end, p, product_id, day),
creative_x as (
  select bundle_id, market, period_start, period_end, cast(p as bigint) as idx, product_id,
         'CREATIVE-' || product_id || '-0' as ad_name,
         'CAMPAIGN | Robo ' || product_id || ' | Conversion' as campaign_name,
         cast(spend as double) / 100 as amount_spent,
         coalesce(round(10 * spend / nullif(impressions, 0), 6), 0) as cpm,
         coalesce(round(spend / nullif(100 * clicks, 0), 6), 0) as cpc,
         coalesce(round(100 * clicks / nullif(impressions, 0), 6), 0) as ctr,
         coalesce(round(spend / nullif(100 * adds, 0), 6), 0) as cost_per_add_to_cart,
         coalesce(round(spend / nullif(100 * purch, 0), 6), 0) as cost_per_purchase,
         coalesce(round(val / nullif(spend, 0), 6), 0) as purchase_roas,
         coalesce(round(val / nullif(100 * purch, 0), 6), 0) as average_purchase_value,
         cast(adds as bigint) as adds_to_cart, cast(purch as bigint) as purchases
  from creative_rows where day = period_start),
traffic_x as (
  select bundle_id, market, period_start, period_end, cast((p + 2) % 3 as bigint) as idx,
         product_id, 'CAMPAIGN | Robo ' || product_id || ' | Traffic' as campaign_name,
         cast(spend as double) / 100 as amount_spent,
         cast(nullif(purch, 0) as bigint) as purchases,
         cast(nullif(adds, 0) as bigint) as adds_to_cart,
         cast(impressions as bigint) as impressions, cast(clicks as bigint) as link_clicks,
         coalesce(round(100 * clicks / nullif(impressions, 0), 6), 0) as ctr,
         coalesce(round(10 * spend / nullif(impressions, 0), 6), 0) as cpm,
         coalesce(round(spend / nullif(100 * clicks, 0), 6), 0) as cpc,
         cast(views as bigint) as landing_page_views,
         coalesce(round(spend / nullif(100 * views, 0), 6), 0) as cost_per_landing_page_view,
         coalesce(round(100 * views / nullif(clicks, 0), 6), 0) as landing_page_view_rate
  from prod where flow = 'traffic'),
audience_x as (
  select bundle_id, market, period_start, period_end, cast(2 - p as bigint) as idx, product_id,
         'AUDIENCE Robo ' || product_id || ' Max' as ad_set_name,
         cast(case when fault = 2 then adds_lo else adds end as bigint) as adds_to_cart,
         cast(case when fault = 2 then purch_lo else purch end as bigint) as purchases,
         coalesce(round((case when fault = 2 then val_lo else val end)
           / nullif(case when fault = 2 then spend_lo else spend end, 0), 6), 0)
           as purchase_roas,
         cast(case when fault = 2 then val_lo else val end as double) / 100 as purchase_value,
         cast(case when fault = 2 then spend_lo else spend end as double) / 100 as amount_spent
  from prod where flow = 'conversion' and fault <> 6),
keyword_raw as (
  select bundle_id, market, period_start, period_end, k, any_value(fault) as fault,
         sum(purch) as purch, sum(spend) as spend, sum(val) as val
  from keyed group by bundle_id, market, period_start, period_end, k),
keyword_x as (
  select * from (
    select bundle_id, market, period_start, period_end,
           row_number() over (partition by bundle_id order by purch desc, k) as "rank",
           'kw ' || k as keyword, cast(purch as double) as conversions,
           coalesce(round(val / nullif(spend, 0), 6), 0) as conversion_value_per_cost,
           cast(spend as double) / 100 as cost, cast(val as double) / 100 as conversion_value
    from keyword_raw where fault <> 7) where "rank" <= 8)
"""

PRODUCTS = [(f"P{p}", f"Product P{p}", aliases, f"creative-p{p}-0", f"p{p}.png")
            for p, aliases in enumerate([["Robo P0"], ["Robo", "Robo  P1"],
                                         ["ROBO P2", "P2 Max"]])]


def profiles(spark, sf):
    """One report configuration per region."""
    product = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(n).alias("display_name"),
                 F.array(*[F.lit(a) for a in al]).alias("aliases"),
                 F.lit(pin).alias("creative_pin"), F.lit(asset).alias("creative_asset"))
        for i, n, al, pin, asset in PRODUCTS])
    return table(spark, sf, "region").select(
        F.concat(F.lit("M"), "r_regionkey").alias("market"),
        F.lit("1.0.0").alias("schema_version"), F.lit("weekly-v1").alias("template_version"),
        F.col("r_name").alias("country_label"), F.lit("USD").alias("currency"),
        F.concat(F.col("r_name"), F.lit(" weekly")).alias("report_title"),
        F.lit(8).alias("keyword_top_n"), product.alias("products"),
        F.lit(0.01).alias("money_tolerance"), F.lit(0.01).alias("ratio_tolerance"),
        F.lit(True).alias("required_for_comparison"),
        F.lit(True).alias("require_all_three_products"),
        F.lit(True).alias("fail_on_missing_creative_metric"),
        F.lit(True).alias("fail_on_period_mismatch"))


@once
def base(spark, sf):
    """The one pass over events; everything else re-aggregates this small cube."""
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    low = cents <= 10000
    paid = kind.isin("view", "click")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, cents)), F.lit(0))
    start = F.to_date(F.date_trunc("week", "ts"))
    cube = (table(spark, sf, "events")
            .groupBy((F.col("user_id") % 5).alias("m"), start.alias("period_start"),
                     F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("p"),
                     F.when(F.col("event_id") % 5 == 0, "traffic")
                     .otherwise("conversion").alias("flow"),
                     F.get_json_object("props", "$.k").cast("bigint").alias("k"))
            .agg(F.count("*").alias("impressions"),
                 F.count_if(kind == "click").alias("clicks"),
                 F.count_if(kind == "view").alias("views"),
                 F.count_if(kind == "signup").alias("adds"),
                 F.count_if((kind == "signup") & low).alias("adds_lo"),
                 F.count_if(kind == "purchase").alias("purch"),
                 F.count_if((kind == "purchase") & low).alias("purch_lo"),
                 total(paid).alias("spend"), total(paid & low).alias("spend_lo"),
                 total(kind == "purchase").alias("val"),
                 total((kind == "purchase") & low).alias("val_lo")))
    market = F.concat(F.lit("M"), F.col("m"))
    return cut(cube.withColumns({
        "market": market, "period_end": F.date_add("period_start", 6),
        "bundle_id": F.sha2(F.concat(market, F.lit("|"), F.col("period_start").cast("string")),
                            256),
        "fault": (F.col("m") + F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)) % 8,
        "product_id": F.concat(F.lit("P"), F.col("p"))}))


def _rate(part, whole):
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(value, F.lit(0.0)).cast("decimal(18,6)").cast("string")


def _money(cents):
    return (cents / 100).cast("decimal(18,2)").cast("string")


def _sums(df, *by):
    names = ["impressions", "clicks", "views", "adds", "adds_lo", "purch", "purch_lo", "spend",
             "spend_lo", "val", "val_lo"]
    both = [F.sum(n).alias(n) for n in names]
    conv = [F.coalesce(F.sum(F.when(F.col("flow") == "conversion", F.col(n))), F.lit(0))
            .alias(f"c_{n}") for n in names]
    return df.groupBy(*KEY, "m", "fault", *by).agg(*both, *conv)


def _low(fault, name):
    return F.when(F.col("fault") == fault, F.col(f"{name}_lo")).otherwise(F.col(name))


def average_header():
    return F.element_at(F.array(*[F.lit(h) for h in fixed.AVERAGE_VALUE_HEADERS]),
                        (F.col("m") % 2 + 1).cast("int"))


def export_rows(spark, sf):
    """(key, m, file, offset, headers, texts): one row per data row of every export."""
    cube = base(spark, sf)
    c, text = F.col, lambda s: F.lit(s)
    start, end = c("period_start").cast("string"), c("period_end").cast("string")
    dates = {fixed.START_HEADER: start, fixed.END_HEADER: end}

    def export(df, kind, offset, values, file=None):
        names, cells = list(values), list(values.values())
        return df.select(
            *KEY, "m", F.lit(file or f"{kind}.csv").alias("file"), offset.alias("offset"),
            F.array(*[average_header() if n is None else F.lit(n) for n in names]).alias("headers"),
            F.array(*[v.cast("string") for v in cells]).alias("texts"))

    whole = _sums(cube)
    overall = export(whole, "overall", F.lit(0), {
        "Starts": start, "Ends": end,
        fixed.SPENT: F.concat(text("$"), F.format_number((c("spend") / 100).cast("decimal(18,2)"),
                                                         2)),
        fixed.VALUE: _money(c("c_val")), fixed.ROAS: _rate(c("c_val"), c("spend")),
        "Purchases": F.format_number(c("c_purch"), 0), "Adds to cart": c("c_adds"),
        "Cost per purchase": _rate(c("spend"), c("c_purch") * 100),
        "Cost per add to cart": _rate(c("spend"), c("c_adds") * 100),
        "Link clicks": c("clicks"),
        fixed.CTR: F.concat(_rate(c("clicks") * 100, c("impressions")), text("%")), **dates})
    daily = _sums(cube, "day")
    by_day = export(daily, "by_day", F.datediff("period_end", "day"), {
        "Day": c("day"), "Adds to cart": _low(0, "c_adds"), "Purchases": _low(0, "c_purch"),
        fixed.ROAS: _rate(_low(0, "c_val"), _low(0, "spend")),
        fixed.SPENT: _money(_low(0, "spend")), fixed.VALUE: _money(_low(0, "c_val")), **dates})
    product = _sums(cube, "p", "product_id")
    name = F.concat(text("CAMPAIGN | Robo "), c("product_id"))
    by_product = export(product, "by_product", c("p"), {
        "Campaign name": F.concat(name, text(" | Conversion")),
        "Name": F.concat(text("robo  "), F.lower("product_id")),
        "Adds to cart": _low(1, "c_adds"), "Purchases": _low(1, "c_purch"),
        fixed.ROAS: _rate(_low(1, "c_val"), _low(1, "spend")),
        "Average purchases conversion value": _rate(_low(1, "c_val"), _low(1, "c_purch") * 100),
        fixed.VALUE: _money(_low(1, "c_val")), fixed.SPENT: _money(_low(1, "spend")), **dates})
    flow = _sums(cube, "p", "product_id", "flow")
    conversion = flow.where("flow = 'conversion'")
    campaign = export(conversion, "campaign", c("p"), {
        "Campaign name": F.concat(name, text(" | Conversion")), fixed.SPENT: _money(c("spend")),
        fixed.VALUE: _money(c("val")), fixed.ROAS: _rate(c("val"), c("spend")),
        "Purchases": c("purch"), "Adds to cart": c("adds"),
        "Cost per purchase": _rate(c("spend"), c("purch") * 100),
        "Cost per add to cart": _rate(c("spend"), c("adds") * 100),
        "Purchases rate per landing page views": _rate(c("purch"), c("views")),
        "Add to cart Rate": _rate(c("adds"), c("views")), "Impressions": c("impressions"),
        "Link clicks": c("clicks"), fixed.CTR: _rate(c("clicks") * 100, c("impressions")),
        fixed.CPM: _rate(c("spend") * 10, c("impressions")),
        fixed.CPC: _rate(c("spend"), c("clicks") * 100),
        None: _rate(c("val"), c("purch") * 100), **dates})
    # the campaign export also lists a row without ROAS, which must be ignored
    other = export(whole, "campaign", F.lit(9), {
        "Campaign name": text("CAMPAIGN | Robo P0 | Brand"), **{h: text(None) for h in (
            fixed.SPENT, fixed.VALUE, fixed.ROAS, "Purchases", "Adds to cart",
            "Cost per purchase", "Cost per add to cart",
            "Purchases rate per landing page views", "Add to cart Rate", "Impressions",
            "Link clicks", fixed.CTR, fixed.CPM, fixed.CPC)},
        None: text(" "), **dates})
    ads = _sums(cube.where("flow = 'conversion'"), "p", "product_id", "day")
    slot = F.datediff("day", "period_start")
    creative = export(ads, "creative", c("p") * 7 + slot, {
        "Ads": F.concat(text(" CREATIVE-"), c("product_id"), text("-"), slot.cast("string")),
        "Campaign name": F.concat(name, text(" | Conversion")), fixed.SPENT: _money(c("spend")),
        fixed.CPM: _rate(c("spend") * 10, c("impressions")),
        fixed.CPC: _rate(c("spend"), c("clicks") * 100),
        fixed.CTR: _rate(c("clicks") * 100, c("impressions")),
        "Cost per add to cart": _rate(c("spend"), c("adds") * 100),
        "Cost per purchase": _rate(c("spend"), c("purch") * 100),
        fixed.ROAS: _rate(c("val"), c("spend")), None: _rate(c("val"), c("purch") * 100),
        "Adds to cart": c("adds"), "Purchases": c("purch"), **dates})
    traffic = export(flow.where("flow = 'traffic'"), "traffic_campaign", (c("p") + 2) % 3, {
        "Campaign name": F.concat(name, text(" | Traffic")), fixed.SPENT: _money(c("spend")),
        "Purchases": F.nullif(c("purch"), F.lit(0)), "Adds to cart": F.nullif(c("adds"), F.lit(0)),
        "Impressions": c("impressions"), "Link clicks": c("clicks"),
        fixed.CTR: _rate(c("clicks") * 100, c("impressions")),
        fixed.CPM: _rate(c("spend") * 10, c("impressions")),
        fixed.CPC: _rate(c("spend"), c("clicks") * 100), "Landing page views": c("views"),
        "Cost per landing page view": _rate(c("spend"), c("views") * 100),
        "Landing page views rate per link clicks": _rate(c("views") * 100, c("clicks")),
        **dates})
    audience = export(conversion.where("fault <> 6"), "audience", 2 - c("p"), {
        "Ad Set Name": F.concat(text("AUDIENCE Robo "), c("product_id"), text(" Max")),
        "Adds to cart": _low(2, "adds"), "Purchases": _low(2, "purch"),
        fixed.ROAS: _rate(_low(2, "val"), _low(2, "spend")),
        fixed.VALUE: _money(_low(2, "val")), fixed.SPENT: _money(_low(2, "spend")), **dates})
    word = _sums(cube, "k")
    words = {
        "Keyword": F.when(c("k") % 2 == 1, F.concat(text('"kw '), c("k").cast("string"),
                                                    text('"')))
        .otherwise(F.concat(text("kw "), c("k").cast("string"))),
        "Conversions": c("purch"), "Conv. value / cost": _rate(c("val"), c("spend")),
        "Cost": _money(c("spend")), "Conv. value": _money(c("val"))}
    keyword = export(word, "keyword", c("k"), words)
    copy = export(word.where("fault = 7"), "keyword", c("k"), words, file="keyword copy.csv")
    frames = [overall, by_day, by_product, campaign, other, creative, traffic, audience,
              keyword, copy]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


@once
def raw_rows(spark, sf):
    """(key, file, sheet, row_no, cells): title rows, header row, data rows, blank rows."""
    rows = cut(export_rows(spark, sf))
    title = F.col("m") % 3
    cells = lambda texts: F.transform(
        texts, lambda s: F.struct(s.alias("s"), F.when(s.isNull(), "null").otherwise("s")
                                  .alias("t")))
    data = rows.select(*KEY, "file", (title + 2 + F.col("offset") * 2).alias("row_no"),
                       cells(F.col("texts")).alias("cells"))
    files = rows.groupBy(*KEY, "m", "file").agg(F.first("headers").alias("headers"))
    # a title row above the header where the market has one, and blank rows between data rows
    heads = files.select(*KEY, "file", F.explode(F.concat(
        F.array(F.struct((title + 1).alias("row_no"), cells(F.col("headers")).alias("cells"))),
        F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), title), lambda i: i > 0),
                    lambda i: F.struct(i.alias("row_no"), cells(F.array(
                        F.lit("Weekly export"), F.lit(" "))).alias("cells"))))).alias("h")) \
        .select(*KEY, "file", F.col("h.row_no").alias("row_no"), F.col("h.cells").alias("cells"))
    blank = data.select(*KEY, "file", (F.col("row_no") + 1).alias("row_no"),
                        cells(F.array(F.lit(None).cast("string"), F.lit("  "))).alias("cells"))
    return cut(heads.unionByName(data).unionByName(blank)
               .select(*KEY, "file", F.lit("CSV").alias("sheet"),
                       F.col("row_no").cast("bigint").alias("row_no"), "cells"))
