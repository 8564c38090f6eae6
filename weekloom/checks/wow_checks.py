"""Week-over-week facts, ranking, candidates and evidence over the derived bundles."""

from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.checks import ads
from weekloom.checks.registry import check, once
from weekloom.checks.rule_checks import (CLEAN, all_issues, lineage, reports, staged_facts)
from weekloom.operators import wow as X
from weekloom.plans import weekly
from weekloom.session import cut


def metric_rows_sql():
    sources = {"overall": ("overall_x", "market", "''", "''", "0"),
               "product_campaign": ("campaign_x", "product_id", "''", "campaign_name", "idx"),
               "audience": ("audience_x", "product_id", "ad_set_name", "ad_set_name", "idx"),
               "traffic": ("traffic_x", "product_id", "campaign_name", "campaign_name", "idx")}
    # each view once, and only bundles that take part in a pair
    views = "".join(
        f",\n{source}_m as materialized (select * from {source} where bundle_id in "
        "(select bundle_id from pairs union all select prev_bundle_id from pairs))"
        for source, *_ in sources.values())
    parts = []
    for scope, (source, pid, name, row_name, idx) in sources.items():
        for i, metric in enumerate(fixed.SCOPE_METRICS[scope]):
            parts.append(
                f"select bundle_id, market, period_start, '{scope}' as scope, {pid} as pid, "
                f"{name} as name, {row_name} as row_name, {idx} as idx, '{metric}' as metric, "
                f"cast({metric} as double) as v from {source}_m")
    return views + ",\nlong as materialized (" + " union all ".join(parts) + ")"


def class_sql(position, col="metric"):
    arms = " ".join(f"when '{m}' then '{row[position]}'" for m, row in fixed.METRICS.items())
    return f"case {col} {arms} end"


SECTION = "case scope " + " ".join(
    f"when '{s}' then '{p}'" for s, p in X.SECTION.items()) + " end"
PREFERRED = "case scope " + " ".join(
    f"when '{s}' then case metric " + " ".join(
        f"when '{m}' then {i}" for i, m in enumerate(ms)) + f" else {len(ms)} end"
    for s, ms in fixed.PREFERRED_METRICS.items()) + " else 0 end"
TOKEN = ("regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
ID = "case when scope = 'overall' then '' else '.' || substr(" + TOKEN.format("joined") + \
     ", 1, 36) || '-' || substr(sha256(joined), 1, 10) end"
PATH = ("'$.' || " + SECTION + " || case when scope = 'overall' then '' else '[' || {0} || ']' end "
        "|| case when scope = 'product_campaign' then '.campaign' else '' end || '.' || metric")

FACTS = metric_rows_sql() + f""",
paired as materialized (
  select c.*, p.v as previous, p.idx as prev_idx,
         case when c.name = '' then c.pid else c.pid || chr(31) || c.name end as joined
  from long c join pairs on pairs.bundle_id = c.bundle_id
  join long p on p.bundle_id = pairs.prev_bundle_id and p.scope = c.scope and p.pid = c.pid
   and p.name = c.name and p.metric = c.metric
  where c.v is not null and p.v is not null),
d as (
  select *, v as current, v - previous as raw, abs(v - previous) <= 1e-12 as flat,
         scope || {ID} || '.' || metric as fact_id from paired),
p as (
  select *, case when flat then 0 else raw end as dd,
         case when flat then 'flat' when raw > 0 then 'up' else 'down' end as direction,
         case when previous <> 0 then
           round((case when flat then 0 else raw end) / abs(previous) * 100, 6) end
           as percent_change from d),
facts as (
  select *, round(dd, 6) as delta, {class_sql(0)} as unit,
         case when direction = 'flat' then 'none' when percent_change is null then 'high'
              when abs(percent_change) < 5 then 'none' when abs(percent_change) < 10 then 'low'
              when abs(percent_change) < 25 then 'medium' else 'high' end as significance,
         case when direction = 'flat' or {class_sql(1)} = 'neutral' then 'neutral'
              when direction = {class_sql(1)} then 'better' else 'worse' end
           as performance_signal,
         {PATH.format('idx')} as current_path, {PATH.format('prev_idx')} as previous_path,
         case when scope = 'overall' then market
              else 'Product ' || pid || ' / ' || row_name end as entity_label
  from p),
o as (
  select *, case significance when 'high' then 0 when 'medium' then 1 when 'low' then 2
            else 3 end as o1,
         case when direction = 'flat' then 0.0
              else -coalesce(abs(percent_change), cast('infinity' as double)) end as o2,
         {PREFERRED} as o3,
         case scope when 'overall' then 0 when 'product_campaign' then 1 when 'audience' then 2
              else 3 end as o4
  from facts)
"""
WEEKS = ads.BASE + """,
pairs as materialized (
  select c.bundle_id, p.bundle_id as prev_bundle_id
  from overall_x c join overall_x p on p.market = c.market and p.w = c.w - 1)
"""


@once
def entity_rows(spark, sf):
    return cut(X.entities(staged_facts(spark, sf)))


@once
def week_facts(spark, sf):
    """Facts of every bundle against the week before, whatever their verdicts."""
    r = reports(spark, sf)
    earlier = r.select("market", F.date_add("period_end", 1).alias("period_start"),
                       F.col("bundle_id").alias("prev_bundle_id"))
    pairs = r.join(earlier, ["market", "period_start"])
    names = staged_facts(spark, sf)["summary"].select(*KEY, "product_id", "display_name")
    return cut(X.change_facts(entity_rows(spark, sf), pairs, names))


@check("wow_gate", ads.BASE + """
select market, period_start, case when reason is null then 'available' else 'unavailable' end
         as status, reason
from (select *, case when w = 0 then 'missing_previous_snapshot'
             when m = 3 and w = 1 then 'market_mismatch'
             when m = 2 and w = 1 then 'currency_mismatch'
             when m = 1 and w = 3 then 'non_adjacent_period' end as reason from overall_x)""")
def wow_gate(spark, sf):
    week = F.floor(F.datediff("period_start", F.lit("2024-01-01")) / 7)
    r, m = reports(spark, sf), F.col("market")
    skip = F.when((m == "M1") & (week == 3), 7).otherwise(0)
    previous = F.struct(
        F.when((m == "M3") & (week == 1), "M0").otherwise(m).alias("market"),
        F.when((m == "M2") & (week == 1), "EUR").otherwise(F.col("currency")).alias("currency"),
        F.date_sub("period_start", skip + 1).alias("period_end"))
    pairs = r.withColumn("previous", F.when(week > 0, previous))
    return X.gate(pairs).select("market", "period_start", "status", "reason")


@check("wow_facts", WEEKS + FACTS + """
select market, period_start, scope, fact_id, entity_label, metric, unit, current, previous,
       current_path, previous_path from facts""")
def wow_facts(spark, sf):
    return week_facts(spark, sf).select(
        "market", "period_start", "scope", "fact_id", "entity_label", "metric", "unit",
        "current", "previous", "current_path", "previous_path")


@check("wow_change", WEEKS + FACTS + """
select market, period_start, fact_id, delta, percent_change, direction, significance,
       performance_signal from facts""")
def wow_change(spark, sf):
    return week_facts(spark, sf).select(
        "market", "period_start", "fact_id", "delta", "percent_change", "direction",
        "significance", "performance_signal")


@check("wow_rank", WEEKS + FACTS + """
select market, period_start, fact_id,
       row_number() over (partition by bundle_id order by o1, o2, o3, o4, fact_id) as position
from o""")
def wow_rank(spark, sf):
    return X.ranked(week_facts(spark, sf)).select("market", "period_start", "fact_id",
                                                  "position")


CANDIDATES = """,
moved as (select * from o where direction <> 'flat'
          qualify scope <> 'overall'
                  or not bool_or(scope <> 'overall') over (partition by bundle_id)),
dd as (select *, row_number() over (partition by bundle_id, scope, pid, row_name
                                    order by o1, o2, o3, o4, fact_id) as depth from moved),
tt as (select *, row_number() over (partition by bundle_id, scope
                                    order by depth, row_name, pid) as turn from dd),
ff as (select *, row_number() over (partition by bundle_id
                                    order by case when turn <= 6 then 0 else 1 end,
                                             o1, o2, o3, o4, fact_id) as seat from tt),
cand as (select *, row_number() over (partition by bundle_id
                                      order by o1, o2, o3, o4, fact_id) as position
         from ff where seat <= 18)
"""


@check("wow_candidates", WEEKS + FACTS + CANDIDATES + """
select market, period_start, fact_id, position from cand""")
def wow_candidates(spark, sf):
    return X.candidates(week_facts(spark, sf)).select("market", "period_start", "fact_id",
                                                      "position")


NUM = ("case unit when 'currency' then 'USD ' || format('{{:,.2f}}', {0}) "
       "when 'count' then format('{{:,.0f}}', {0}) "
       "when 'percentage_points' then format('{{:,.2f}}', {0}) || '%' "
       "when 'ratio' then format('{{:,.2f}}', {0}) || 'x' end")
SCOPE_EN = "case scope " + " ".join(f"when '{s}' then '{n[1]}'"
                                    for s, n in fixed.SCOPE_LABELS.items()) + " end"


@check("wow_evidence", WEEKS + FACTS + f"""
select market, period_start, fact_id,
       {SCOPE_EN} || case when scope = 'overall' then '' else ' ' || entity_label end
       || ' · ' || {class_sql(3)} || ': current ' || {NUM.format('current')} || ', previous '
       || {NUM.format('previous')} || ', '
       || case direction when 'flat' then 'flat, change' else direction end || ' '
       || case when unit = 'percentage_points'
               then format('{{:,.2f}}', abs(delta)) || ' pp' else {NUM.format('abs(delta)')} end
       || ' (' || case when percent_change is null
            then 'percentage change unavailable (previous value was zero)'
            else 'week over week ' || case when percent_change < 0 then '-' else '+' end
                 || format('{{:,.2f}}', abs(percent_change)) || '%' end || ').' as evidence_en
from facts""")
def wow_evidence(spark, sf):
    return X.evidence(X.safe_label(week_facts(spark, sf))).select(
        "market", "period_start", "fact_id", "evidence_en")


@check("safe_labels", WEEKS + FACTS + """
select market, period_start, fact_id,
       case when market = 'M0' and scope <> 'overall' then pid
            when market = 'M1' and scope <> 'overall' then split_part(fact_id, '.', 2)
            else entity_label end as safe_label
from facts""")
def safe_labels(spark, sf):
    m, inner = F.col("market"), F.col("scope") != "overall"
    spoiled = week_facts(spark, sf).withColumns({
        "entity_label": F.when(m.isin("M0", "M1") & inner,
                               F.concat("entity_label", F.lit(" see www.example.com")))
        .otherwise(F.col("entity_label")),
        "product_id": F.when((m == "M1") & inner, F.concat(F.lit("~/"), "product_id"))
        .otherwise(F.col("product_id"))})
    return X.safe_label(spoiled).select("market", "period_start", "fact_id", "safe_label")


PUBLISHED = ads.BASE + "," + CLEAN + """,
pairs as materialized (
  select c.bundle_id, p.bundle_id as prev_bundle_id
  from clean c join clean p on p.market = c.market and p.w = c.w - 1)
"""


def report_result(spark, sf):
    return {"facts": staged_facts(spark, sf), "reports": reports(spark, sf),
            "issues": all_issues(spark, sf), "lineage": lineage(spark, sf)}


WEEKLY_SQL = PUBLISHED + FACTS + CANDIDATES + """
select f.market, f.period_start, f.fact_id, f.current, f.previous, f.percent_change,
       f.significance, f.performance_signal, c.position
from facts f left join cand c using (bundle_id, fact_id)"""


@check("weekly_report", WEEKLY_SQL)
def weekly_report(spark, sf):
    facts = cut(weekly.change_report(report_result(spark, sf)))
    place = X.candidates(facts).select(*KEY, "fact_id", "position")
    return facts.join(place, [*KEY, "fact_id"], "left").select(
        "market", "period_start", "fact_id", "current", "previous", "percent_change",
        "significance", "performance_signal", "position")
