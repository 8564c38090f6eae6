"""Discovery, archives, unchanged bundles and the report sink over files derived from the tables."""

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from weekloom import KEY, fixed
from weekloom.checks import ads
from weekloom.checks.catalog_check_queries import text
from weekloom.checks.registry import check, spread, table
from weekloom.checks.rule_checks import CLEAN, all_issues, history_rows, reports, staged_facts
from weekloom.checks.sections import found
from weekloom.checks.wow_checks import WEEKLY_SQL
from weekloom.issues import publishable
from weekloom.operators import marts
from weekloom.operators import wow as X
from weekloom.plans import discovery as D
from weekloom.plans import publish, replay, weekly
from weekloom.session import cut
from weekloom.sources import config as C
from weekloom.sources import inventory as I

WORDS = "Keyword,Conversions,Conv. value / cost,Cost,Conv. value\n"
#: what a file is, by its number modulo 12: name, and whether it is a link and a plain file
FORMS = ["{}.csv", ".{}.csv", "~${}.xlsx", "{}.tmp", "{}.pdf", "{}_link.csv", "{}_pipe.csv",
         ".git/{}.csv", "{}_bad.csv", "{}_large.csv", "{}_empty.csv", "deep/{}_plain.csv"]


def order_files(spark, sf):
    """(k, form, bundle_id, file, path): each order is a file; one bundle has far too many."""
    k = F.col("o_orderkey")
    form = (k % 12).cast("int")
    name = F.element_at(F.array(*[F.lit(f) for f in FORMS]), form + 1)
    crowd = F.col("o_custkey") % 4 == 0
    rows = table(spark, sf, "orders").select(
        k.alias("k"), form.alias("form"),
        F.when(crowd, "crowd").otherwise(text("o_custkey")).alias("bundle_id"),
        F.replace(name, F.lit("{}"), text("o_orderkey")).alias("file"))
    return rows.withColumn("path", F.concat_ws("/", "bundle_id", "file"))


@check("discovery", """
with f as (
  select o_orderkey % 12 as form, o_orderkey as k,
         case when o_custkey % 4 = 0 then 'crowd' else cast(o_custkey as varchar) end as bundle_id,
         replace(['{}.csv', '.{}.csv', '~${}.xlsx', '{}.tmp', '{}.pdf', '{}_link.csv',
                  '{}_pipe.csv', '.git/{}.csv', '{}_bad.csv', '{}_large.csv', '{}_empty.csv',
                  'deep/{}_plain.csv'][(o_orderkey % 12 + 1)::int], '{}',
                 o_orderkey::varchar) as file
  from orders),
n as (select bundle_id, count(*) filter (form in (0, 8, 9, 10, 11)) > 256 as crowded
      from f group by bundle_id)
select bundle_id, file,
       case when form in (1, 7) then 'hidden_or_system' when form in (2, 3) then 'temporary'
            when form = 4 then 'unsupported_extension' when form = 5 then 'symbolic_link'
            when form = 6 then 'not_regular_file' when crowded then 'too_many_candidates'
            when form in (8, 9, 10, 11) then 'unrecognized_source' end as reason,
       case when form = 0 and not crowded then 'keyword' end as kind
from f join n using (bundle_id)""")
def discovery(spark, sf):
    """One row per listed file with what became of it: all reasons, and the kind of the others."""
    files, form = order_files(spark, sf), F.col("form")
    listing = files.select(
        "bundle_id", "file", "path",
        F.when(form == 9, fixed.MAX_SOURCE_BYTES + 1).otherwise(100).cast("bigint").alias("length"),
        (form == 5).alias("is_symlink"), (form != 6).alias("is_file"))
    row = F.concat(F.lit(WORDS), F.lit("w"), text("k"), F.lit(",1,2,3,4\n"))
    body = (F.when(form == 8, F.unhex(F.lit("C328"))).when(form == 10, F.encode(F.lit(WORDS), "UTF-8"))
            .when(form == 11, F.encode(F.lit("a,b\n1,2\n"), "UTF-8")).otherwise(F.encode(row, "UTF-8")))
    found = D.decoded(cut(D.triaged(listing)), files.select("path", body.alias("content")))
    return found["files"].select("bundle_id", "file", "reason", "kind")


@check("changed_bundles", """
with d as (select source || '/' || (doc_id % 61) as bundle_id, doc_id || '.csv' as file, doc_id,
                  coalesce(text, '') as t from documents),
then_ as (select bundle_id, string_agg(file || ' ' || sha256(t), chr(10) order by file) as s,
                 count(*) as n from d group by bundle_id),
now_ as (select bundle_id, string_agg(file || ' ' || sha256(
           case when doc_id % 97 = 0 then t || '!' else t end), chr(10) order by file) as s
         from d where doc_id % 89 <> 0 group by bundle_id)
select now_.bundle_id, sha256('v1' || chr(10) || now_.s) as files_sha256
from now_ join then_ using (bundle_id) where now_.s <> then_.s""")
def changed_bundles(spark, sf):
    """Bundles with an edited, or a vanished, file since the outcomes of an earlier run."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", text(i % 61)).alias("bundle_id"),
        F.concat(text("doc_id"), F.lit(".csv")).alias("file"),
        F.coalesce("text", F.lit("")).alias("t"))

    def prints(rows):
        named = rows.withColumn("path", F.concat_ws("/", "bundle_id", "file"))
        listing = named.select("bundle_id", "file", "path", F.length("t").cast("bigint").alias(
            "length"), F.lit(False).alias("is_symlink"), F.lit(True).alias("is_file"))
        content = named.select("path", F.encode("t", "UTF-8").alias("content"))
        return D.fingerprints(D.triaged(listing), content, "v1")

    edited = F.when(i % 97 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))
    return D.changed_bundles(prints(rows.where(i % 89 != 0).withColumn("t", edited)),
                             cut(prints(rows))).select("bundle_id", "files_sha256")


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def pack_bundle(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of a bundle's exports: flat, inside an archive, or beside an incomplete one.
    A bundle is one market-week."""
    members = {}
    for file, part in rows.sort_values("row_no").groupby("file"):
        out = io.StringIO()
        writer, at = csv.writer(out), 0
        for number, cells in zip(part["row_no"], part["cells"]):
            # rows that the table leaves out are blank lines of the file
            writer.writerows([[]] * (number - at - 1))
            writer.writerow([c["s"] or "" for c in cells])
            at = number
        members[f"week/{file}"] = out.getvalue().encode()
    form = rows["form"].iloc[0]
    if form > 0:
        inner = {"exports.zip": zipped(members), "__MACOSX/exports.zip": b"x", "notes.txt": b"x"}
        if form > 1:
            inner["half.zip"] = zipped(dict(list(members.items())[:3]))
        members = inner
    return pd.DataFrame({"bundle_id": [rows["bundle_id"].iloc[0]], "content": [zipped(members)]})


def report_from(spark, sf, decoded):
    """The weekly job over decoded rows of bundles whose keys are known."""
    keys = ads.base(spark, sf).select(*KEY).distinct()
    raw = decoded["rows"].withColumn("bundle_id", F.regexp_extract(
        "bundle_id", r"([^/]*)\.zip\z", 1)).join(keys, "bundle_id").select(
        *KEY, "file", "sheet", "row_no", "cells")
    result = weekly.weekly_report(cut(raw), found(spark, sf)[1], history_rows(spark, sf))
    facts = cut(weekly.change_report(result))
    place = X.candidates(facts).select(*KEY, "fact_id", "position")
    return facts.join(place, [*KEY, "fact_id"], "left")


@check("archive_to_report", WEEKLY_SQL)
def archive_to_report(spark, sf):
    """The weekly report of exports that come in archives, flat or nested, among others."""
    form = F.pmod(F.xxhash64("bundle_id"), F.lit(3))
    packed = ads.raw_rows(spark, sf).select("bundle_id", "file", "row_no", "cells",
                                            form.alias("form"))
    archives = cut(packed.groupBy("bundle_id").applyInPandas(
        pack_bundle, "bundle_id string, content binary").select(
        F.concat("bundle_id", F.lit(".zip")).alias("path"), "content"))
    listing = archives.select(
        F.col("path").alias("bundle_id"), F.col("path").alias("file"), "path",
        F.length("content").cast("bigint").alias("length"), F.lit(False).alias("is_symlink"),
        F.lit(True).alias("is_file"))
    decoded = D.decoded(cut(D.triaged(listing)), archives)
    return report_from(spark, sf, decoded).select(
        "market", "period_start", "fact_id", "current", "previous", "percent_change",
        "significance", "performance_signal", "position")


@check("report_sink", ads.BASE + "," + CLEAN + """
select market, period_start,
       market || '_' || period_start || '_' || period_end || '_weekly_report' as file_stem,
       amount_spent, link_clicks,
       (select count(*) from daily_x d where d.bundle_id = c.bundle_id) as days,
       (select sum(k.cost) from keyword_x k where k.bundle_id = c.bundle_id) as cost
from clean c""")
def report_sink(spark, sf):
    """Published reports as JSON text under the stem of their file, read back from the text."""
    issues = all_issues(spark, sf)
    facts = {n: publishable(f, issues) for n, f in staged_facts(spark, sf).items()}
    rows = publish.report_rows(marts.canonical_report(facts, publishable(
        reports(spark, sf), issues)))
    back = F.from_json("report_json", "current_overall struct<amount_spent:double,"
                       "link_clicks:bigint>, daily array<struct<day:date>>, "
                       "keywords array<struct<cost:double>>")
    cost = F.aggregate("r.keywords", F.lit(0.0).cast("decimal(38,6)"), lambda a, k: (
        a + k["cost"].cast("decimal(18,6)")).cast("decimal(38,6)"))
    return rows.withColumn("r", back).select(
        "market", "period_start", "file_stem", "r.current_overall.amount_spent",
        "r.current_overall.link_clicks", F.size("r.daily").cast("bigint").alias("days"),
        cost.cast("double").alias("cost"))


#: what is wrong with a configuration, by its number modulo 14: path, problem, value
CONFIG_FAULTS = {
    1: [("extra", "unknown_key", None)], 2: [("market", "missing_key", None)],
    3: [("history.extra", "unknown_key", None)], 4: [("quality.money_tolerance", "wrong_type", "text")],
    5: [("keyword_top_n", "out_of_range", "101")], 6: [("keyword_top_n", "wrong_type", "number")],
    7: [("products", "duplicate_product_id", "p0")],
    8: [("products", "duplicate_creative_pin", "pin 0")],
    9: [("products.1.extra", "unknown_key", None), ("products.1.display_name", "missing_key", None)],
    10: [("", "no_object", None)], 11: [("products", "wrong_type", "object")],
    12: [("products.0.aliases", "wrong_type", "integer"), ("currency", "wrong_type", "integer")]}
DEFAULTS = [("schema_version", "1.0.0"), ("keyword_top_n", "8"), ("money_tolerance", "0.01"),
            ("require_all_three_products", "true"), ("required_for_comparison", "true"),
            ("database", "history/report_history.sqlite3")]
GIVEN = [("schema_version", "2.0.0"), ("keyword_top_n", "9"), ("money_tolerance", "0.5"),
         ("require_all_three_products", "false"), ("required_for_comparison", "false"),
         ("database", "h.db")]


def config_sql():
    quote = lambda v: "null" if v is None else f"'{v}'"
    rows = [f"({form}, '{path}', '{problem}', {quote(value)})"
            for form, found in CONFIG_FAULTS.items() for path, problem, value in found]
    for form, values in ((0, DEFAULTS), (13, GIVEN)):
        rows += [f"({form}, '{path}', 'value', '{value}')" for path, value in values]
    return ("select p_partkey as k, path, problem, value from part join (values "
            + ", ".join(rows) + ") f(form, path, problem, value) on p_partkey % 14 = form")


@check("config_strict", config_sql())
def config_strict(spark, sf):
    """Configurations with one fault each, and what sound ones come to with their defaults."""
    form = F.col("form")
    pick = lambda *cases, other: (
        lambda c: c.otherwise(other))(_chain(form, cases))
    product = lambda n, more="": (
        f'{{"id":"p{n}","display_name":"P","aliases":["a{n}"],"creative_pin":" Pin {n}"{more}}}')
    both = f"[{product(0)},{product(1, ',\"creative_asset\":null')}]"
    items = pick((7, f"[{product(0)},{product(1).replace('p1', 'p0')}]"),
                 (8, f"[{product(0)},{product(1).replace(' Pin 1', 'PIN 0')}]"),
                 (9, f'[{product(0)},{{"id":"p1","aliases":[],"creative_pin":"x","extra":1}}]'),
                 (11, "{}"), (12, f"[{product(0).replace('[\"a0\"]', '[1]')}]"), other=both)
    head = pick((2, '"template_version":"v1"'), other='"template_version":"v1","market":"M"')
    more = pick(
        (1, ',"extra":1'), (3, ',"history":{"extra":1}'), (4, ',"quality":{"money_tolerance":"x"}'),
        (5, ',"keyword_top_n":101'), (6, ',"keyword_top_n":8.5'),
        (13, ',"schema_version":"2.0.0","keyword_top_n":"9","history":{"database":"h.db",'
             '"required_for_comparison":0},"quality":{"money_tolerance":"0.5",'
             '"require_all_three_products":"No"}'), other="")
    currency = pick((12, "1"), other='"USD"')
    whole = F.concat(F.lit("{"), head, F.lit(',"country_label":"C","report_title":"T","currency":'),
                     currency, F.lit(',"products":'), items, more, F.lit("}"))
    configs = cut(spread(table(spark, sf, "part").select("p_partkey")).select(
        F.col("p_partkey").alias("profile"), (F.col("p_partkey") % 14).alias("form")).select(
        "profile", F.when(form == 10, "[1]").otherwise(whole).alias("text")))
    problems = cut(C.config_problems(configs))
    flat = C.read_profiles(configs, problems)
    shown = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.lit("value").alias("problem"),
                                         F.col(n).cast("string").alias("value"))
                                for n, _ in DEFAULTS])).alias("x")
    return problems.unionByName(flat.select("profile", shown).select(
        "profile", "x.*")).withColumnRenamed("profile", "k")


def _chain(form, cases):
    chain = F.when(form == cases[0][0], cases[0][1])
    for n, value in cases[1:]:
        chain = chain.when(form == n, value)
    return chain


@F.pandas_udf(BinaryType())
def pack_two(keys: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([zipped({"a.csv": f"a{k}".encode(), "b/c.csv": f"b{k}{m}".encode()})
                      for k, m in zip(keys, marks)])


@check("inventory_delta", """
with c as (select c_custkey as k, 'f' || c_custkey || case when c_custkey % 3 = 0 then '.zip'
                  else '.csv' end as path, c_custkey % 3 = 0 as packed from customer),
s as (select *, case when k % 7 = 1 then 'removed' when k % 7 = 2 then 'added'
                     when k % 7 = 3 then 'changed' else 'same' end as status from c)
select path, null as member, status, null as sha256 from s where status <> 'same'
union all
select path, 'a.csv', status, null from s where packed and status in ('added', 'removed')
union all
select path, 'b/c.csv', status, null from s where packed and status <> 'same'
union all
select path, null, 'now', case when packed then null else sha256('x' || k || case
       when k % 7 = 3 then '!' else '' end) end from s where status <> 'removed'
union all
select path, 'a.csv', 'now', sha256('a' || k) from s where packed and status <> 'removed'
union all
select path, 'b/c.csv', 'now', sha256('b' || k || case when k % 7 = 3 then '!' else '' end)
from s where packed and status <> 'removed'""")
def inventory_delta(spark, sf):
    """An inventory brought up to date: what changed, and all digests as they are then. The bytes
    given for unchanged files are others, which must not be seen."""
    k = F.col("c_custkey")
    turn, packed = k % 7, k % 3 == 0
    rows = spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", F.concat(
        F.lit("f"), text(k), F.when(packed, ".zip").otherwise(".csv")).alias("path"))

    def files(rows, now):
        mark = F.when(F.lit(now) & (turn == 3), "!").when(
            F.lit(now) & (turn > 3), "unseen").otherwise("")
        body = F.when(packed, pack_two(text(k), mark)).otherwise(F.encode(
            F.concat(F.lit("x"), text(k), mark), "UTF-8"))
        moment = F.when(F.lit(now) & (turn == 3), "2024-02-02").otherwise("2024-01-01")
        return cut(rows.select("path", F.lit(9).cast("bigint").alias("length"),
                               moment.cast("timestamp").alias("modified"), body.alias("content")))

    before = cut(I.scanned(files(rows.where(turn != 2), False)))
    listed = files(rows.where(turn != 1), True)
    after = cut(I.updated(listed.select(*I.STAMP), listed.select("path", "content"), before))
    whole = F.col("member").isNull() & F.col("path").endswith(".zip")
    now = after.select("path", "member", F.lit("now").alias("status"),
                       F.when(~whole, F.col("sha256")).alias("sha256"))
    return I.delta(before, after).withColumn("sha256", F.lit(None).cast("string")).unionByName(now)


@check("replay_run", "with recursive" + (ads.BASE + "," + CLEAN.rsplit("clean as", 1)[0]).lstrip()[4:] + """
s as (
  select o.market, o.period_start, o.m, o.w, (o.m + o.w) % 3 = 0 or o.w = 0 as seeded,
         o.m = 4 and o.w = 3 as broken, o.m = 0 and o.w = 1 as idle,
         o.fault < 6 and o.bundle_id not in (select bundle_id from drifted)
           and (select count(*) from daily_x d where d.bundle_id = o.bundle_id) = 7
           and not (o.m = 3 and o.w = 1) as own
  from overall_x o),
r as (
  select *, own and not broken and not idle as ok from s where w = 0
  union all
  select s.*, s.own and not s.broken and not s.idle and (s.seeded or r.ok) as ok
  from s join r on s.m = r.m and s.w = r.w + 1)
select market, period_start, own as own_ok, case when broken then 'FAIL' when idle then 'SKIP'
       when ok then 'PASS' else 'FAIL' end as status
from r""")
def replay_run(spark, sf):
    """Every market-week as a catalog sample: weeks run against the record their link names, some
    frozen reports altered, chains over several weeks."""
    got, profiles = found(spark, sf)
    facts = staged_facts(spark, sf)
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    m = F.substring("market", 2, 9).cast("int")
    name = lambda day: F.concat_ws("/", "market", day.cast("string"))
    seeded = ((m + week) % 3 == 0) | (week == 0)
    samples = cut(ads.base(spark, sf).select(*KEY).distinct().select(
        *KEY, name(F.col("period_start")).alias("sample_id"),
        F.when((m == 0) & (week == 1), "reference_only").otherwise("runnable")
        .alias("workflow_status"), (~((m == 4) & (week == 3))).alias("integrity_ok"),
        F.lit(True).alias("source_ok"), F.when(seeded, "seed_file").otherwise("catalog_sample")
        .alias("previous_kind"), F.when(seeded, F.concat(F.lit("seed "), name(F.col(
            "period_start")))).otherwise(name(F.date_sub("period_start", 7))).alias("previous_id")))
    heads = cut(weekly.report_heads(facts["overall"], profiles))
    seeds = cut(heads.select(
        F.concat(F.lit("seed "), name(F.col("period_start"))).alias("previous_id"), "market",
        F.date_sub("period_start", 7).alias("period_start"),
        F.date_sub("period_end", 7).alias("period_end"), *fixed.OVERALL_METRICS,
        F.lit(False).alias("is_db"), F.lit("seed.json").alias("source_file")))
    # frozen reports are what the weeks gave, from another folder, and one is altered
    linked = heads.join(replay.linked_previous(samples, heads, seeds), "bundle_id", "left")
    frozen = replay.canonical_values(facts, linked).where(week < 3).withColumn("value", F.when(
        F.col("is_history_file"), F.concat(F.lit("/else/"), "value")).when(
        (m == 3) & (week == 1) & (F.col("path") == "report.currency"), "EUR").otherwise(
        F.col("value")))
    goldens = cut(frozen.join(samples.select("bundle_id", "sample_id"), "bundle_id").select(
        "sample_id", "path", "value", "is_history_file"))
    return replay.replay_run(samples, got, facts, profiles, seeds, goldens).select(
        "market", "period_start", "own_ok", "status")
