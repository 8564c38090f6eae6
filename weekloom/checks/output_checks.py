"""Readers, audit and report outputs."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from weekloom import fixed
from weekloom.checks import ads
from weekloom.checks.registry import check, spread, table
from weekloom.checks.rule_checks import (CLEAN, all_issues, lineage, lineage_sql, reports,
                                         staged_facts)
from weekloom.checks.catalog_check_queries import text
from weekloom.issues import publishable
from weekloom.operators import audit as Q
from weekloom.operators import marts as M
from weekloom.sources import readers as R


@check("read_delimited", """
with o as (select o_orderkey as k, cast(cast(o_totalprice as decimal(18,2)) as varchar) as price
           from orders)
select k, cast(1 as bigint) as row_no, 'Keyword|Conversions' as cells, false as failed from o where k % 50 <> 7
union all
select k, 2, 'a, "k' || k || '"' || chr(10) || 'b|' || price, false from o where k % 50 <> 7
union all
select k, 3, '', false from o where k % 50 <> 7
union all
select k, 4, 'end', false from o where k % 50 <> 7
union all
select k, null, null, true from o where k % 50 = 7""")
def read_delimited(spark, sf):
    k = F.col("o_orderkey")
    mark = F.when(k % 2 == 0, ",").otherwise("\t")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    body = F.concat(F.lit("Keyword"), mark, F.lit('Conversions\n"a, ""k'), text(k),
                    F.lit('""\nb"'), mark, price, F.lit("\n\nend\n"))
    utf8 = F.encode(body, "UTF-8")
    content = (F.when(k % 50 == 7, F.unhex(F.lit("C328")))
               .when(k % 3 == 0, F.encode(body, "UTF-16"))
               .when(k % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8))
    files = table(spark, sf, "orders").select(k.alias("k"), content.alias("content"))
    return R.read_delimited(files, ["k"]).select(
        "k", "row_no", F.when(F.col("row_no").isNotNull(), F.concat_ws("|", "cells.s"))
        .alias("cells"), F.col("error").isNotNull().alias("failed"))


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(sheets: dict, shared: list, formats=("0", "14")) -> bytes:
    """A minimal workbook: sheets of {row number: xml of its cells}."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names))
            + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>'
            for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(
            f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><cellXfs>" + "".join(
            f'<xf numFmtId="{n}"/>' for n in formats) + "</cellXfs></styleSheet>")
        for i, name in enumerate(names):
            rows = "".join(f'<row r="{r}">{cells}</row>' for r, cells in sheets[name].items())
            z.writestr(f"xl/worksheets/s{i}.xml",
                       f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@F.pandas_udf(BinaryType())
def pack_workbook(names: pd.Series, amounts: pd.Series, days: pd.Series) -> pd.Series:
    def pack(name, amount, serial):
        first = {1: '<c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Total</t></is></c>',
                 3: f'<c r="B3"><v>{amount}</v></c><c r="C3" t="b"><v>1</v></c>'
                    f'<c r="D3" s="1"><v>{serial}</v></c>',
                 200: '<c r="A200"><v>9</v></c>'}
        return workbook_bytes({"Data": first, "More": {2: '<c r="A2" t="s"><v>1</v></c>'}},
                              [name, "second"])

    return pd.Series([pack(*x) for x in zip(names, amounts, days)])


@check("read_workbook", """
select c_custkey as k, unnest(['Data', 'Data', 'More']) as sheet,
       unnest([cast(1 as bigint), 3, 2]) as row_no,
       unnest([c_name || ':s,null,Total:s',
               'null,' || c_custkey || '.5:n,True:b,2024-01-' || lpad(cast(1 + c_custkey % 28
               as varchar), 2, '0') || 'T00:00:00:d', 'second:s']) as cells
from customer""")
def read_workbook(spark, sf):
    k = F.col("c_custkey")
    files = spread(table(spark, sf, "customer").select("c_custkey", "c_name")).select(
        k.alias("k"), pack_workbook(
        F.col("c_name"), F.concat(text(k), F.lit(".5")), 45292 + k % 28).alias("content"))
    cells = F.transform("cells", lambda c: F.concat_ws(":", c["s"], c["t"]))
    return R.read_workbooks(files, ["k"]).select("k", "sheet", "row_no",
                                                 F.array_join(cells, ",").alias("cells"))


@F.pandas_udf(BinaryType())
def pack_archive(keys: pd.Series) -> pd.Series:
    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    def pack(key):
        inner = zipped([("in/b.TSV", f"b{key}"), ("note.txt", "x"), ("deep.zip", "y")])
        members = [("a.csv", f"a{key}"), ("__MACOSX/a.csv", "m"), ("d/._b.csv", "m"),
                   ("d/", ""), ("d/pack.zip", inner)]
        return b"broken" if key % 10 == 3 else zipped(members)

    return keys.map(pack)


@check("expand_archives", """
select c_custkey as k, unnest([null, 'd/pack.zip']) as nested, unnest(['a.csv', 'in/b.TSV'])
         as member, unnest(['a', 'b']) || c_custkey as body, false as failed
from customer where c_custkey % 10 <> 3
union all
select c_custkey, null, null, null, true from customer where c_custkey % 10 = 3""")
def expand_archives(spark, sf):
    files = spread(table(spark, sf, "customer").select("c_custkey")).select(
        F.col("c_custkey").alias("k"), pack_archive(F.col("c_custkey")).alias("content"))
    return R.expand_archives(files, ["k"]).select(
        "k", "nested", "member", F.decode("content", "UTF-8").alias("body"),
        F.col("error").isNotNull().alias("failed"))


@check("choose_bundle", """
with s as (select l_orderkey as k, case when l_linenumber = 1 then null
                    else l_linenumber || '.zip' end as nested, l_quantity > 40 as complete
           from lineitem),
g as (select k, coalesce(bool_or(complete and nested is null), false) as direct,
             count(*) filter (complete and nested is not null) as n,
             min(nested) filter (complete and nested is not null) as nested
      from s group by k)
select k, direct or n = 1 as resolved, case when not direct and n = 1 then nested end as nested,
       case when direct or n = 1 then null when n = 0 then 'no_bundle' else 'several_bundles' end
         as problem
from g""")
def choose_bundle(spark, sf):
    status = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") > 1, F.concat(
            text("l_linenumber"), F.lit(".zip"))).alias("nested"),
        (F.col("l_quantity") > 40).alias("complete"))
    return R.choose_bundle(status, ["k"])


@check("numeric_fingerprint", """
with h as (
  select l_partkey as k, sha256(l_orderkey || '.' || l_linenumber || '='
           || cast(cast(l_extendedprice as double) as varchar)) as h
  from lineitem),
s as (
  select k, count(*) as numeric_path_count,
         array_to_string([
           cast(sum(cast(('0x' || substr(h, 1, 15)) as bigint)) as varchar),
           cast(sum(cast(('0x' || substr(h, 16, 15)) as bigint)) as varchar),
           cast(sum(cast(('0x' || substr(h, 31, 15)) as bigint)) as varchar),
           cast(sum(cast(('0x' || substr(h, 46, 15)) as bigint)) as varchar)], '|') as t
  from h group by k)
select k, sha256(t) as fingerprint, numeric_path_count from s""")
def numeric_fingerprint(spark, sf):
    values = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), F.concat(text("l_orderkey"), F.lit("."),
                                                text("l_linenumber")).alias("path"),
        F.col("l_extendedprice").alias("value"))
    return Q.numeric_fingerprint(values, ["k"])


@check("lineage_sample", (
    "select market, period_start, target, place from (select *, row_number() over "
    "(partition by market, period_start order by section, n) as place from ("
    "select *, row_number() over (partition by market, period_start, section "
    "order by target, i) as n from (select market, period_start, target, "
    "regexp_extract(target, '^[^.]*') as section, unnest(range(cells)) as i from ("
    + lineage_sql() + ") l) x) y where n <= 4) z where place <= 40"))
def lineage_sample(spark, sf):
    return Q.mapping_sample(lineage(spark, sf)).select("market", "period_start", "target",
                                                       "place")


def names_sql():
    rows = [("summary_x", "product", "product_id", "display_name", "display_name"),
            ("summary_x", "product", "product_id", "summary_campaign_name", "campaign_name"),
            ("campaign_x", "product", "product_id", "conversion_campaign_name", "campaign_name"),
            ("creative_x", "product", "product_id", "creative_ad_name", "ad_name"),
            ("creative_x", "product", "product_id", "creative_campaign_name", "campaign_name"),
            ("traffic_x", "traffic_campaign", "product_id", "campaign_name", "campaign_name"),
            ("audience_x", "audience", "product_id", "ad_set_name", "ad_set_name"),
            ("keyword_x", "keyword", "''", "keyword", "keyword")]
    return ads.BASE + " union ".join(
        f"select market, period_start, '{e}' as entity, {p} as product_id, '{f}' as field, "
        f"{c} as name from {s}" for s, e, p, f, c in rows)


@check("entity_names", names_sql())
def entity_names(spark, sf):
    return Q.entity_names(staged_facts(spark, sf)).drop("bundle_id", "period_end")


def mart_sql():
    def part(source, slide, slot, category, series, value):
        return (f"select market, period_start, cast({slide} as int) as slide, {slot} as slot, "
                f"cast({category} as varchar) as category, '{series}' as series, "
                f"cast({value} as double) as value from {source}")

    numbers = lambda s: [f for f, (_, k) in fixed.SECTION_FIELDS[s].items()
                         if k not in ("text", "keyword", "date")]
    table = "'slot.overall.comparison_table'"
    parts = [part("overall_x", 2, table, "'current'", m, m) for m in fixed.OVERALL_METRICS]
    parts += [part("earlier", 2, table, "'previous'", m, f"p.{m}")
              for m in fixed.OVERALL_METRICS]
    for source, slide, head, category, charts in (
            ("daily_x", 2, "slot.overall.daily", "day", M.DAILY_CHARTS),
            ("summary_x", 2, "slot.overall.product", "display_name", M.PRODUCT_CHARTS),
            ("audience_x", 7, "slot.audience", "ad_set_name", M.AUDIENCE_CHARTS),
            ("keyword_x", 8, "slot.keywords", "keyword", M.KEYWORD_CHARTS)):
        parts += [part(source, slide, f"'{head}.{slot}'", category, m, m)
                  for slot, m in charts.items()]
    for section, slide, slot, category in (
            ("campaign", "idx + 3", "'slot.product.' || product_id || '.campaign_table'",
             "product_id"),
            ("creative", "idx + 3", "'slot.product.' || product_id || '.creative_table'",
             "product_id"),
            ("traffic", 6, "'slot.traffic.table'", "campaign_name"),
            ("audience", 7, "'slot.audience.table'", "ad_set_name"),
            ("keywords", 8, "'slot.keywords.table'", "keyword")):
        source = "keyword_x" if section == "keywords" else f"{section}_x"
        parts += [part(source, slide, slot, category, m, m) for m in numbers(section)]
    return EARLIER + " union all ".join(parts)


METRICS = ", ".join(fixed.OVERALL_METRICS)
#: the record before each bundle, with all its metrics
EARLIER = ads.BASE + f""",
loads as (
  select market, period_start, period_end, true as is_db, {METRICS}
  from overall_x where not (m = 1 and w = 1)
  union all
  select market, cast(period_start - interval 7 day as date),
         cast(period_end - interval 7 day as date), false, {METRICS} from overall_x where w = 0
  union all
  select market, period_start, period_end, false,
         {METRICS.replace("amount_spent", "-amount_spent", 1)} from overall_x where w = 2),
earlier as (
  select o.market, o.period_start,
         max_by(struct_pack({", ".join(f"{m} := h.{m}" for m in fixed.OVERALL_METRICS)}),
                struct_pack(e := h.period_end, s := h.period_start, d := h.is_db)) as p
  from overall_x o join loads h on h.market = o.market and h.period_end < o.period_start
  group by all)
"""


@check("report_mart", mart_sql())
def report_mart(spark, sf):
    return M.report_mart(staged_facts(spark, sf), reports(spark, sf)).drop(
        "bundle_id", "period_end")


@check("canonical_report", ads.BASE + "," + CLEAN + """
select c.market, c.period_start, c.amount_spent,
       (select count(*) from daily_x d where d.bundle_id = c.bundle_id) as days,
       (select string_agg(product_id, ',' order by idx) from traffic_x t
        where t.bundle_id = c.bundle_id) as traffic_order,
       (select string_agg(keyword, ',' order by "rank") from keyword_x k
        where k.bundle_id = c.bundle_id) as keyword_order,
       'P0,P1,P2' as products
from clean c""")
def canonical_report(spark, sf):
    issues = all_issues(spark, sf)
    facts = {n: publishable(f, issues) for n, f in staged_facts(spark, sf).items()}
    nested = M.canonical_report(facts, publishable(reports(spark, sf), issues))
    return nested.select(
        "market", "period_start", "current_overall.amount_spent",
        F.size("daily").cast("bigint").alias("days"),
        F.concat_ws(",", "traffic.product_id").alias("traffic_order"),
        F.concat_ws(",", "keywords.keyword").alias("keyword_order"),
        F.concat_ws(",", F.transform("product_analyses", lambda p: p["creative"]["product_id"]))
        .alias("products"))

