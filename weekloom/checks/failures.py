"""What must not pass: bundles without one profile, amounts off any range, links in circles,
golden reports and decks of another scope; and lineage counts."""

from pyspark.sql import functions as F

from weekloom.checks import ads
from weekloom.checks.registry import check, table
from weekloom.checks.rule_checks import HISTORY, lineage, lineage_sql, staged_facts
from weekloom.checks.sections import found
from weekloom.functions.numbers import period_token
from weekloom.operators import audit as Q
from weekloom.operators import catalog_checks as C
from weekloom.operators import rules as U
from weekloom.sources import catalog as K


@check("profile_coverage", ads.BASE + """
select market, period_start,
       case m when 0 then 'NO_PROFILE' when 1 then 'AMBIGUOUS_PROFILE' else 'KEYWORD_LIMIT' end
         as code
from overall_x where m in (0, 1, 2)""")
def profile_coverage(spark, sf):
    """One market without a profile, one with two, one with a keyword count off limits."""
    got, profiles = found(spark, sf)
    spoiled = (profiles.where("market <> 'M0'").unionByName(profiles.where("market = 'M1'"))
               .withColumn("keyword_top_n", F.when(F.col("market") == "M2", 101)
                           .otherwise(F.col("keyword_top_n"))))
    return U.profile_rules(got["per_kind"], spoiled).select("market", "period_start", "code")


@check("oversized_amounts", ads.BASE + """
select market, period_start, count(*) as n from daily_x where market = 'M2' group by all""")
def oversized_amounts(spark, sf):
    """Spend of 1e20 in every day of one market is an error there and stops nothing else."""
    facts = dict(staged_facts(spark, sf))
    facts["daily"] = facts["daily"].withColumn("amount_spent", F.when(
        F.col("market") == "M2", F.lit(1e20)).otherwise(F.col("amount_spent")))
    return (U.amount_rules(U.measures(facts)).where("code = 'AMOUNT_OUT_OF_RANGE'")
            .groupBy("market", "period_start").agg(F.count("*").alias("n")))


@check("replay_cycles", """
select c_custkey as k, case when (c_custkey // 8) % 4 = 0 then 'PASS' else 'FAIL' end as status
from customer""")
def replay_cycles(spark, sf):
    """Chains of eight: sound, closed to a circle, on a self link, and on a link ahead."""
    k = F.col("c_custkey")
    kind, first = F.floor(k / 8) % 4, k % 8 == 0
    start = (F.when(kind == 1, k + 7).when(kind == 2, k).when(kind == 3, k + 4))
    samples = table(spark, sf, "customer").select(
        k.alias("k"), k.cast("string").alias("sample_id"), F.lit("runnable").alias("workflow_status"),
        F.lit(True).alias("integrity_ok"), F.lit(True).alias("source_ok"),
        F.lit(True).alias("own_ok"),
        F.when(first & (kind == 0), "seed_file").otherwise("catalog_sample").alias("previous_kind"),
        F.when(first, start).otherwise(k - 1).cast("string").alias("previous_id"))
    return C.replay(samples).select("k", "status")


@check("registration_batch", """
with b as (select o_orderkey as k, o_custkey as market,
                  cast(date_trunc('month', o_orderdate) as date) as a, o_orderkey // 2 as src
           from orders),
f as (select *, min(lpad(cast(k as varchar), 12, '0')) over (partition by market, a) as first_p,
             min(lpad(cast(k as varchar), 12, '0')) over (partition by src) as first_s,
             lpad(cast(k as varchar), 12, '0') as id from b)
select id as sample_id, case when first_p < id then 'duplicate_market_period'
                             when first_s < id then 'duplicate_source' end as problem
from f""")
def registration_batch(spark, sf):
    """New samples are held against each other when the catalog is empty."""
    k, month = F.col("o_orderkey"), F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = table(spark, sf, "orders").select(
        F.lpad(k.cast("string"), 12, "0").alias("sample_id"), F.col("o_custkey").alias("market"),
        month.alias("period_start"), F.last_day(month).alias("period_end"),
        F.floor(k / 2).cast("string").alias("source_sha256"),
        F.col("o_orderpriority").alias("content"))
    return K.registration_problems(rows, rows.where("false")).select("sample_id", "problem")


@check("lineage_counts", HISTORY + ", l as (" + lineage_sql()[len(HISTORY):] + """)
select market, period_start, 'transform' as what, transform as name, count(*) as n
from l group by all
union all
select market, period_start, 'source', 'all', cast(sum(cells) as bigint) from l group by all""")
def lineage_counts(spark, sf):
    """Entries per transform, and sources of all kinds together."""
    counts = Q.lineage_counts(lineage(spark, sf))
    whole = counts.where("what = 'source_kind'").groupBy("market", "period_start").agg(
        F.sum("n").alias("n")).select("market", "period_start", F.lit("source").alias("what"),
                                      F.lit("all").alias("name"), "n")
    return counts.where("what = 'transform'").select(
        "market", "period_start", "what", "name", "n").unionByName(whole)


@check("golden_scope", """
select o_orderkey as k from orders where o_orderkey % 5 in (1, 2, 3)""")
def golden_scope(spark, sf):
    """Golden reports of another market, start or end; lower-case markets are the same."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(k.alias("k"), day.alias("day"))
    path = F.concat(F.lit("g/"), F.col("k").cast("string"))
    samples = rows.select(F.col("k").alias("sample_id"), F.lit("IT").alias("market"),
                          F.col("day").alias("period_start"),
                          F.date_add("day", 6).alias("period_end"),
                          F.struct(path.alias("path")).alias("golden_json"))
    v = F.col("k") % 5
    goldens = rows.select(
        path.alias("path"), F.when(v == 1, "FR").when(v == 4, "it").otherwise("IT").alias("market"),
        F.date_add("day", F.when(v == 2, 1).otherwise(0)).alias("start"),
        F.date_add("day", F.when(v == 3, 7).otherwise(6)).alias("end"))
    return C.golden_issues(samples, goldens).select(F.col("sample_id").alias("k"))


@check("deck_scope", """
select o_orderkey as k from orders
where o_orderkey % 3 <> 0 and o_orderkey % 5 in (1, 2, 3)""")
def deck_scope(spark, sf):
    """Approved decks without the period as primary, without the market, or missing."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(k.alias("k"), day.alias("day"))
    name, packed = F.concat(F.lit("d"), F.col("k").cast("string")), F.col("k") % 2 == 0
    text = lambda c: F.lit(c).cast("string")
    samples = rows.select(
        F.col("k").alias("sample_id"), F.lit("IT").alias("market"),
        F.when(F.col("k") % 3 == 0, "candidate").otherwise("approved").alias("review_status"),
        F.col("day").alias("period_start"), F.date_add("day", 6).alias("period_end"),
        F.struct(F.when(packed, "archive_member").otherwise("file").alias("kind"),
                 F.when(~packed, name).alias("path"), F.when(packed, text("a.zip"))
                 .alias("archive_path"), F.when(packed, name).alias("member_name")).alias("deck"))
    v = F.col("k") % 5
    token = lambda shift: period_token(F.date_add("day", shift), F.date_add("day", 6))
    decks = rows.where(v != 3).select(
        F.when(packed, F.concat(F.lit("a.zip!"), name)).otherwise(name).alias("path"),
        F.array(F.when(v == 1, token(1)).otherwise(token(0))).alias("primary"),
        F.array(F.when(v == 2, "FR").otherwise("IT")).alias("markets"))
    return C.deck_scope_issues(samples, decks).select(F.col("sample_id").alias("k"))
