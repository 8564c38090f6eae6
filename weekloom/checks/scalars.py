"""Scalar functions over text and numbers built from the driver tables."""

from pyspark.sql import functions as F

from weekloom.checks.registry import check, table
from weekloom.functions import numbers as N
from weekloom.functions import text as T


@check("parse_number", """
with t as (select l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 14 as v,
                  cast(l_extendedprice as decimal(12,2)) as x from lineitem)
select l_orderkey, l_linenumber,
       case when v in (2, 3) then -cast(x as double)
            when v in (4, 9, 10, 11, 12) then null
            when v = 13 then cast('10' || cast(x as varchar) as double)
            else cast(x as double) end as parsed
from t""")
def parse_number(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    variant = (F.col("l_orderkey") + F.col("l_linenumber")) % 14
    forms = [price, F.concat(F.lit("$"), price), F.concat(F.lit("("), price, F.lit(")")),
             F.concat(F.lit("($"), price, F.lit(")")), F.concat(F.lit("-$"), price),
             F.concat(price, F.lit("%")), F.concat(F.lit("€ "), price),
             F.concat(F.lit(" "), price, F.lit(" ")),
             F.regexp_replace(price, r"^(\d+)(\d{3}\.)", "$1,$2"),
             F.lit("n/a"), F.lit(""), F.lit("nan"), F.concat(price, F.lit("f")),
             F.concat(F.lit("1_0"), price)]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(variant == i, form).otherwise(text)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("text")).select(
        "l_orderkey", "l_linenumber", N.parse_number(F.col("text")).alias("parsed"))


@check("parse_integer", """
select l_orderkey, l_linenumber,
       case when (l_orderkey + l_linenumber) % 5 in (2, 4) then null
            else cast(l_quantity as bigint) end as parsed
from lineitem""")
def parse_integer(spark, sf):
    whole = F.col("l_quantity").cast("bigint").cast("string")
    variant = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    text = (F.when(variant == 0, whole)
            .when(variant == 1, F.concat(whole, F.lit(".0")))
            .when(variant == 2, F.concat(whole, F.lit(".5")))
            .when(variant == 3, F.concat(whole, F.lit(".0000000001")))
            .otherwise(F.concat(whole, F.lit(".000001"))))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("text")).select(
        "l_orderkey", "l_linenumber", N.parse_number(F.col("text")).alias("value")).select(
        "l_orderkey", "l_linenumber", N.to_integer(F.col("value")).alias("parsed"))


@check("parse_date", """
select o_orderkey,
       case when year(o_orderdate) < 2000 or o_orderkey % 5 in (2, 3) then null
            else cast(o_orderdate as date) end as parsed
from orders""")
def parse_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    variant = F.col("o_orderkey") % 5
    text = (F.when(variant == 0, day)
            .when(variant == 1, F.concat(F.lit("Report "), day, F.lit(" end")))
            .when(variant == 2, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .when(variant == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
            .otherwise(F.concat(day, F.lit("T00:00:00"))))
    return table(spark, sf, "orders").select("o_orderkey", N.parse_date(text).alias("parsed"))


@check("clean_keyword", """
select p_partkey,
       case p_partkey % 7 when 4 then '"' || p_name when 5 then null when 6 then '"'
            else p_name end as keyword
from part""")
def clean_keyword(spark, sf):
    name, variant = F.col("p_name"), F.col("p_partkey") % 7
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    text = (F.when(variant == 0, F.concat(F.lit(" "), name))
            .when(variant == 1, quoted)
            .when(variant == 2, F.concat(F.lit('"'), quoted, F.lit('"')))
            .when(variant == 3, F.concat(F.lit('"  '), quoted, F.lit('\t"')))
            .when(variant == 4, F.concat(F.lit('"'), name))
            .when(variant == 5, F.lit('"" '))
            .otherwise(F.lit('"""')))
    return table(spark, sf, "part").select("p_partkey", T.clean_keyword(text).alias("keyword"))


@check("cell_reference", """
with t as (select distinct l_partkey % 18278 + 1 as c, l_orderkey as r from lineitem)
select c, r,
       case when c > 702 then chr(cast(65 + (c - 703) // 676 as int)) else '' end
       || case when c > 26 then chr(cast(65 + ((c - 27) // 26) % 26 as int)) else '' end
       || chr(cast(65 + (c - 1) % 26 as int)) || cast(r as varchar) as cell
from t""")
def cell_reference(spark, sf):
    cells = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 18278 + 1).alias("c"), F.col("l_orderkey").alias("r")).distinct()
    return cells.select("c", "r", N.cell_reference(F.col("c"), F.col("r")).alias("cell"))


@check("normalize_headers", r"""
select doc_id,
       sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')))
         as folded
from documents""")
def normalize_headers(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(T.normalize_header(F.col("text")), 256).alias("folded"))


@check("entity_token", r"""
with t as (select conv_id, turn, role || chr(31) || text as joined from conversations),
s as (select *, regexp_replace(regexp_replace(replace(lower(joined), 'ß', 'ss'),
                '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from t)
select conv_id, turn, substr(slug, 1, 36) || '-' || substr(sha256(joined), 1, 10) as token
from s""")
def entity_token(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.entity_token(F.col("role"), F.col("text")).alias("token"))


@check("report_stem", r"""
select o_orderkey,
       regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9_-]+', '_', 'g'),
                      '_+', '_', 'g')
       || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_'
       || strftime(o_orderdate + interval 6 day, '%Y-%m-%d') || '_weekly_report' as stem
from orders""")
def report_stem(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        T.report_stem(F.col("o_orderpriority"), day, F.date_add(day, 6)).alias("stem"))


EVENT_GRAIN = """
with e as (
  select 'M' || (user_id % 5) as market, cast(date_trunc('week', ts) as date) as week_start,
         'P' || (event_id % 3) as product_id, event_type,
         cast(round(value * 100) as bigint) as cents
  from events),
g as (
  select market, week_start, product_id, count(*) as impressions,
         count(*) filter (event_type = 'click') as clicks,
         count(*) filter (event_type = 'signup') as adds,
         count(*) filter (event_type = 'purchase') as purchases,
         count(*) filter (event_type = 'view') as views,
         cast(coalesce(sum(cents) filter (event_type in ('view', 'click')), 0) as bigint) as cost,
         cast(coalesce(sum(cents) filter (event_type = 'purchase'), 0) as bigint) as val
  from e group by all)
"""


def event_grain(spark, sf):
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (table(spark, sf, "events")
            .groupBy(F.concat(F.lit("M"), F.col("user_id") % 5).alias("market"),
                     F.to_date(F.date_trunc("week", "ts")).alias("week_start"),
                     F.concat(F.lit("P"), F.col("event_id") % 3).alias("product_id"))
            .agg(F.count("*").alias("impressions"),
                 F.count_if(kind == "click").alias("clicks"),
                 F.count_if(kind == "signup").alias("adds"),
                 F.count_if(kind == "purchase").alias("purchases"),
                 F.count_if(kind == "view").alias("views"),
                 F.coalesce(F.sum(F.when(kind.isin("view", "click"), cents)),
                            F.lit(0)).alias("cost"),
                 F.coalesce(F.sum(F.when(kind == "purchase", cents)), F.lit(0)).alias("val")))


@check("derived_rates", EVENT_GRAIN + """
select market, week_start, product_id,
       case when clicks > 0 then adds / clicks * 100.0 end as add_to_cart_rate,
       case when views > 0 then purchases / views * 100.0 end as purchase_rate,
       case when clicks > 0 then views / clicks end as landing_page_view_rate
from g""")
def derived_rates(spark, sf):
    return event_grain(spark, sf).select(
        "market", "week_start", "product_id",
        N.percent_of(F.col("adds"), F.col("clicks")).alias("add_to_cart_rate"),
        N.percent_of(F.col("purchases"), F.col("views")).alias("purchase_rate"),
        N.ratio(F.col("views"), F.col("clicks")).alias("landing_page_view_rate"))


@check("kpi_rollup", EVENT_GRAIN + """
select market, product_id,
       round(sum(val) / nullif(sum(cost), 0), 6) as roas,
       round(sum(cost) / 100 / nullif(sum(purchases), 0), 6) as cpa,
       round(sum(cost) / 100 / nullif(sum(adds), 0), 6) as cost_per_add_to_cart,
       round(sum(clicks) / sum(impressions) * 100, 6) as ctr,
       round(sum(cost) / 100 / sum(impressions) * 1000, 6) as cpm,
       round(sum(cost) / 100 / nullif(sum(clicks), 0), 6) as cpc,
       round(sum(val) / 100 / nullif(sum(purchases), 0), 6) as aov
from g group by market, product_id""")
def kpi_rollup(spark, sf):
    total = event_grain(spark, sf).groupBy("market", "product_id").agg(
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "adds", "purchases",
                                      "cost", "val")])
    money, value = F.col("cost") / 100, F.col("val") / 100
    six = lambda part, whole, name: F.round(N.ratio(part, F.col(whole)), 6).alias(name)
    return total.select(
        "market", "product_id", six(F.col("val"), "cost", "roas"), six(money, "purchases", "cpa"),
        six(money, "adds", "cost_per_add_to_cart"),
        F.round(N.percent_of(F.col("clicks"), F.col("impressions")), 6).alias("ctr"),
        F.round(N.ratio(money, F.col("impressions")) * 1000, 6).alias("cpm"),
        six(money, "clicks", "cpc"), six(value, "purchases", "aov"))
