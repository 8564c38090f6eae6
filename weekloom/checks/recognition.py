"""Header detection, classification, table building and completeness."""

from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.checks import ads
from weekloom.checks.registry import check, once, table
from weekloom.functions.text import normalize_text
from weekloom.operators import facts as A
from weekloom.operators import recognize as R


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def export_files(spark, sf):
    return ads.raw_rows(spark, sf)


@once
def recognized(spark, sf):
    return R.recognize(ads.raw_rows(spark, sf))


EXPECTED_FILES = ads.BASE + """,
files as (
  select bundle_id, market, period_start, period_end, m, fault, kind,
         kind || '.csv' as file, m % 3 + 1 as header_row
  from overall_x, (select unnest(['overall', 'by_day', 'by_product', 'campaign', 'creative',
                                  'traffic_campaign', 'audience', 'keyword']) as kind)
  where not (kind = 'audience' and fault = 6)
  union all
  select bundle_id, market, period_start, period_end, m, fault, 'keyword', 'keyword copy.csv',
         m % 3 + 1
  from overall_x where fault = 7)
"""


@check("header_row", EXPECTED_FILES + """
select market, period_start, file, cast(header_row as bigint) as header_row, kind from files""")
def header_row(spark, sf):
    return R.header_rows(export_files(spark, sf)).select(
        "market", "period_start", "file", "header_row", "kind")


KIND_LIST = sql_list(fixed.KINDS)
PRINTS = " union all ".join(
    f"select {i} as ord, '{k}' as kind, {sql_list([h.lower() for h in hs])} as required"
    for i, (k, hs) in enumerate(fixed.FINGERPRINTS.items()))


@check("classify_headers", f"""
with fp as ({PRINTS}),
h as (
  select row_number() over () as id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         list_concat(
           case when l_suppkey % 5 = 0 then a.required[2:] else a.required end,
           case when l_orderkey % 3 = 0 then b.required else ['spare'] end) as headers
  from lineitem join fp a on a.ord = l_partkey % 8 join fp b on b.ord = (l_partkey + 1) % 8),
m as (
  select id, string_agg(kind, ',' order by ord) as kinds, count(*) as n
  from h join fp on list_has_all(h.headers, fp.required) group by id)
select l_orderkey, l_linenumber, l_partkey, coalesce(kinds, '') as kinds,
       case when n is null then 'unknown' when n > 1 then 'ambiguous' else 'classified' end
         as status
from h left join m using (id)""")
def classify_headers(spark, sf):
    prints = F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in fixed.FINGERPRINTS.values()])
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                "l_suppkey")
    at = lambda i: F.element_at(prints, (i % 8 + 1).cast("int"))
    first, second = at(F.col("l_partkey")), at(F.col("l_partkey") + 1)
    lines = lines.withColumn("headers", F.concat(
        F.when(F.col("l_suppkey") % 5 == 0, F.slice(first, F.lit(2), F.size(first)))
        .otherwise(first),
        F.when(F.col("l_orderkey") % 3 == 0, second).otherwise(F.array(F.lit("Spare")))))
    lines = lines.withColumn("line", R.header_line(F.col("headers")))
    lines = lines.withColumn("kinds", R.matched_kinds(F.col("line")))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(",", "kinds").alias("kinds"),
        F.when(F.size("kinds") == 0, "unknown").when(F.size("kinds") > 1, "ambiguous")
        .otherwise("classified").alias("status"))


def key_columns(bundle):
    day = F.lit("2024-01-01").cast("date")
    return [bundle.cast("string").alias("bundle_id"), F.lit("M").alias("market"),
            day.alias("period_start"), day.alias("period_end")]


def text_cells(texts):
    return F.transform(texts, lambda s: F.struct(
        s.alias("s"), F.when(s.isNull(), "null").otherwise("s").alias("t")))


@check("blank_tail", """
with filled as (select distinct l_suppkey, l_partkey * 9 + 1 as row_no from lineitem
                where l_quantity > 5),
g as (select l_suppkey, row_no,
             coalesce(lag(row_no) over (partition by l_suppkey order by row_no), 0) as prev
      from filled)
select l_suppkey, cast(min(prev) + 100 as bigint) as cutoff
from g where row_no - prev > 100 group by l_suppkey""")
def blank_tail(spark, sf):
    lines = table(spark, sf, "lineitem")
    filled = F.when(F.col("l_quantity") > 5, F.lit("x")).otherwise(F.lit(" "))
    raw = lines.select(*key_columns(F.col("l_suppkey")), F.lit("f").alias("file"),
                       F.lit("s").alias("sheet"), (F.col("l_partkey") * 9 + 1).alias("row_no"),
                       text_cells(F.array(F.lit(None).cast("string"), filled)).alias("cells"))
    return R.blank_tail(raw).select(F.col("bundle_id").cast("bigint").alias("l_suppkey"),
                                    "cutoff")


@check("table_build", """
with t as (
  select l_orderkey, cast(l_linenumber + 1 as bigint) as row_no, l_linenumber - 1 as n,
         cast(l_partkey as varchar) as a, cast(l_suppkey as varchar) as b,
         cast(cast(l_quantity as bigint) as varchar) as c
  from lineitem where l_orderkey % 7 <> 0 and l_linenumber > 1)
select l_orderkey, row_no, case when n >= 1 then a end as keyword,
       case when n >= 2 then b end as conversions, case when n >= 3 then c end as blank,
       case when n >= 4 then a end as per_cost, case when n >= 5 then b end as cost,
       case when n >= 6 then c end as val
from t""")
def table_build(spark, sf):
    lines = table(spark, sf, "lineitem")
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    c = F.col("l_quantity").cast("bigint").cast("string")
    data = lines.select(
        *key_columns(F.col("l_orderkey")), F.lit("f").alias("file"), F.lit("s").alias("sheet"),
        (F.col("l_linenumber") + 1).cast("bigint").alias("row_no"),
        text_cells(F.slice(F.array(a, b, c, a, b, c, a, b), F.lit(1),
                           F.col("l_linenumber") - 1)).alias("cells"))
    inner = F.when(F.col("l_orderkey") % 7 == 0, F.lit("COST ")).otherwise(F.lit(" "))
    heads = lines.select("l_orderkey").distinct().select(
        *key_columns(F.col("l_orderkey")), F.lit("f").alias("file"), F.lit("s").alias("sheet"),
        F.lit(1).cast("bigint").alias("row_no"),
        text_cells(F.array(F.lit(" Keyword"), F.lit("conversions"), inner,
                           F.lit("Conv. value /  cost"), F.lit("Cost"), F.lit("Conv. value"),
                           F.lit(""), F.lit(None))).alias("cells"))
    raw = heads.unionByName(data)
    rows = R.table_rows(raw, R.table_headers(R.header_rows(raw)))
    names = {"keyword": "Keyword", "conversions": "Conversions", "per_cost": "Conv. value / cost",
             "cost": "Cost", "val": "Conv. value", "blank": "__blank_3"}
    return rows.select(F.col("bundle_id").cast("bigint").alias("l_orderkey"), "row_no",
                       *[R.value(h)["s"].alias(n) for n, h in names.items()])


@check("declared_period", EXPECTED_FILES + """
select market, period_start, kind,
       case when kind <> 'keyword' then period_start end as source_start,
       case when kind <> 'keyword' then period_end end as source_end
from files where not (kind = 'keyword' and fault = 7)""")
def declared_period(spark, sf):
    tables = recognized(spark, sf)["tables"]
    return tables.select("market", "period_start", "kind", "source_start", "source_end")


@check("bundle_completeness", EXPECTED_FILES + """
select market, period_start,
       case when any_value(fault) = 6 then 'audience' else '' end as missing,
       case when any_value(fault) = 7 then 'keyword' else '' end as duplicates,
       count(distinct kind) - max(case when fault = 7 then 1 else 0 end) as selected,
       any_value(fault) not in (6, 7) as complete
from files group by market, period_start""")
def bundle_completeness(spark, sf):
    per_kind = recognized(spark, sf)["per_kind"]
    return R.bundle_summary(per_kind).select("market", "period_start", "missing", "duplicates",
                                             "selected", "complete")


@check("header_alias_priority", EXPECTED_FILES + f"""
select market, period_start, kind,
       {sql_list(fixed.AVERAGE_VALUE_HEADERS)}[m % 2 + 1] as header
from files where kind in ('campaign', 'creative')""")
def header_alias_priority(spark, sf):
    rows = recognized(spark, sf)["rows"]
    used = rows.where("kind in ('campaign', 'creative')").select(
        "market", "period_start", "kind", R.average_value_cell()["header"].alias("header"))
    return used.groupBy("market", "period_start", "kind").agg(F.min("header").alias("header"))


@check("bundle_period_agree", EXPECTED_FILES + """
select distinct market, period_start, cast(0 as bigint) as undated, cast(1 as bigint) as periods,
       true as agreed
from files""")
def bundle_period_agree(spark, sf):
    tables = recognized(spark, sf)["tables"]
    return R.bundle_period(tables).select("market", "period_start", "undated", "periods",
                                          "agreed")


@check("profile_match", ads.BASE + """
select o.market, o.period_start, v.variant as profile,
       case v.variant when 'main' then true when 'short' then false else false end as matched
from overall_x o, (select unnest(['main', 'short', 'other pin']) as variant) v""")
def profile_match(spark, sf):
    rows = recognized(spark, sf)["rows"]
    main = A.prepare_profiles(ads.profiles(spark, sf)).select("market", "products")
    other = F.transform("products", lambda p: p.withField("creative_pin", F.lit("nobody")))
    variants = (main.withColumn("profile", F.lit("main"))
                .unionByName(main.select("market", F.slice("products", 1, 2).alias("products"),
                                         F.lit("short").alias("profile")))
                .unionByName(main.select("market", other.alias("products"),
                                         F.lit("other pin").alias("profile"))))
    variants = variants.withColumn("profile", F.concat("market", F.lit("/"), "profile"))
    paired = rows.join(variants.select("market", "profile"), "market")
    text = lambda kind, head: paired.where(F.col("kind") == kind).select(
        *KEY, "profile", normalize_text(R.value(head)["s"]).alias("normalized")) \
        .where("normalized <> ''")
    matched = R.match_profiles(text("by_product", "Name"), text("creative", "Ads"), variants)
    return matched.select("market", "period_start",
                          F.split_part("profile", F.lit("/"), F.lit(2)).alias("profile"),
                          "matched")
