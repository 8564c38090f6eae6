"""The eight fact sections, read back from exported text cells."""

from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.checks import ads
from weekloom.checks.recognition import recognized
from weekloom.checks.registry import check, once, table
from weekloom.functions.text import normalize_text
from weekloom.operators import facts as A
from weekloom.operators import recognize as R
from weekloom.session import cut


@once
def found(spark, sf):
    """Recognised rows of every export and the prepared profiles."""
    return (recognized(spark, sf), cut(A.prepare_profiles(ads.profiles(spark, sf))))


def fields(section):
    return list(fixed.SECTION_FIELDS[section])


def select_sql(section, source, more=()):
    names = ["market", "period_start", *more, *fields(section)]
    return ads.BASE + f"select {', '.join(names)} from {source}"


def shown(facts, section, more=()):
    return facts.select("market", "period_start", *more, *fields(section))


@check("overall_fact", select_sql("overall", "overall_x", ["period_end", "add_to_cart_rate"]))
def overall_fact(spark, sf):
    got, _ = found(spark, sf)
    return shown(A.overall(got["rows"], got["tables"]), "overall",
                 ["period_end", "add_to_cart_rate"])


@check("daily_fact", select_sql("daily", "daily_x", ["idx"]))
def daily_fact(spark, sf):
    got, _ = found(spark, sf)
    return shown(A.daily(got["rows"]), "daily", ["idx"])


@check("product_summary", select_sql("summary", "summary_x",
                                     ["idx", "product_id", "display_name"]))
def product_summary(spark, sf):
    got, profiles = found(spark, sf)
    facts = A.summary(got["rows"], profiles, A.dim_product(profiles))
    return shown(facts, "summary", ["idx", "product_id", "display_name"])


@check("campaign_fact", select_sql("campaign", "campaign_x", ["idx", "product_id"]))
def campaign_fact(spark, sf):
    got, profiles = found(spark, sf)
    facts = A.campaign(got["rows"], profiles, A.dim_product(profiles))
    return shown(facts, "campaign", ["idx", "product_id"])


@check("pinned_creative", select_sql("creative", "creative_x", ["idx", "product_id"]))
def pinned_creative(spark, sf):
    got, profiles = found(spark, sf)
    facts = A.creative(got["rows"], profiles, A.dim_product(profiles))
    return shown(facts.where("campaign_product = product_id"), "creative",
                 ["idx", "product_id"])


@check("traffic_fact", select_sql("traffic", "traffic_x", ["idx", "product_id"]))
def traffic_fact(spark, sf):
    got, profiles = found(spark, sf)
    return shown(A.traffic(got["rows"], profiles), "traffic", ["idx", "product_id"])


@check("audience_fact", select_sql("audience", "audience_x", ["idx", "product_id"]))
def audience_fact(spark, sf):
    got, profiles = found(spark, sf)
    return shown(A.audience(got["rows"], profiles), "audience", ["idx", "product_id"])


@check("bundle_keywords", ads.BASE + """
select market, period_start, "rank", keyword, conversions, conversion_value_per_cost, cost,
       conversion_value
from keyword_x""")
def bundle_keywords(spark, sf):
    got, profiles = found(spark, sf)
    return shown(A.keywords(got["rows"], profiles), "keywords", ["rank"])


@check("keyword_topn", """
with w as (
  select p_brand as market, p_partkey, p_name || '#' || p_partkey as keyword,
         cast(sum(cast(l_quantity as decimal(12,2))) as double) as conversions,
         cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))))
              as double) as conversion_value,
         cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)))
              as double) as cost
  from lineitem join part on l_partkey = p_partkey group by p_brand, p_partkey, p_name),
r as (select *, row_number() over (partition by market order by conversions desc, p_partkey)
                as "rank" from w)
select market, "rank", keyword, conversions, conversion_value, cost from r where "rank" <= 8""")
def keyword_topn(spark, sf):
    dec = lambda c, t: F.col(c).cast(t)
    price = dec("l_extendedprice", "decimal(12,2)")
    # lines shrink to one row per part before they meet the part table
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum(dec("l_quantity", "decimal(12,2)")).cast("double").alias("conversions"),
        F.sum(price * (1 - dec("l_discount", "decimal(4,2)"))).cast("double")
        .alias("conversion_value"),
        F.sum(price * dec("l_tax", "decimal(4,2)")).cast("double").alias("cost"))
    words = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("market"), "p_partkey",
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("keyword"),
        "conversions", "conversion_value", "cost")
    top = A.top_keywords(words, F.lit(8), ["market"], "conversions", "p_partkey")
    return top.select("market", F.col("rank").cast("bigint").alias("rank"), "keyword",
                      "conversions", "conversion_value", "cost")


@check("alias_longest_match", """
with aliases as (
  select * from (values ('P0', 'the'), ('P0', 'ation'), ('P1', 'tion the'), ('P1', 'que des'),
                        ('P2', 'und die'), ('P2', 'straße'), ('P3', 'la e'),
                        ('P4', 'la e')) as t(product_id, a)),
texts as (select doc_id, replace(regexp_replace(replace(lower(text), 'ß', 'ss'),
                 '\\s+', ' ', 'g'), 'ß', 'ss') as t from documents),
hits as (select doc_id, product_id, length(replace(a, 'ß', 'ss')) as n
         from texts join aliases on contains(t, replace(a, 'ß', 'ss'))),
best as (select distinct doc_id, product_id from (
           select *, max(n) over (partition by doc_id) as top from hits) where n = top),
w as (select doc_id, count(distinct product_id) as n, min(product_id) as product_id
      from best group by doc_id)
select d.doc_id, case when n = 1 then product_id end as product_id,
       case when n is null then 'unmatched' when n > 1 then 'ambiguous' else 'matched' end
         as status
from documents d left join w using (doc_id)""")
def alias_longest_match(spark, sf):
    names = {"P0": ["the", "ation"], "P1": ["tion the", "que des"], "P2": ["und die", "straße"],
             "P3": ["la e"], "P4": ["la e"]}
    products = F.array(*[F.struct(
        F.lit(p).alias("id"),
        F.array(*[F.lit(R.header_key(a)) for a in al]).alias("norm_aliases"))
        for p, al in names.items()])
    docs = table(spark, sf, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("text"))
    hit = docs.select("doc_id", A.alias_match(F.col("text"), products).alias("hit"))
    return hit.select("doc_id", "hit.product_id", "hit.status")


@check("product_row_cover", ads.BASE + """,
expected as (
  select bundle_id, market, period_start, 'P' || unnest([0, 1, 2]) as product_id
  from overall_x where fault <> 6)
select e.market, e.period_start, e.product_id, count(a.product_id) as n
from expected e left join audience_x a using (bundle_id, product_id) group by all
union all
select market, period_start, 'P' || unnest([0, 1, 2]), 0 from overall_x where fault = 6""")
def product_row_cover(spark, sf):
    got, profiles = found(spark, sf)
    mapped = A.audience(got["rows"], profiles)
    counts = mapped.groupBy(*KEY, "product_id").agg(F.count("*").alias("n"))
    expected = got["per_kind"].select(*KEY).distinct().join(
        A.dim_product(profiles).select("market", "product_id"), "market")
    return expected.join(counts, [*KEY, "product_id"], "left").select(
        "market", "period_start", "product_id", F.coalesce("n", F.lit(0)).alias("n"))
