"""Catalog, history-file and registration queries over orders, parts and lineitems."""

from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.checks.recognition import sql_list
from weekloom.checks.registry import check, table
from weekloom.functions.numbers import period_token
from weekloom.operators import catalog_checks as C
from weekloom.sources import catalog as K
from weekloom.sources import history as H
from weekloom.sources import listing as S


def text(col):
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def raw_samples(spark, sf):
    """Catalog entries as JSON text, some in the old layout and some broken."""
    k = F.col("o_orderkey")
    day = F.to_date(F.date_trunc("week", "o_orderdate"))
    start = F.when(k % 29 == 0, "2000-13-01").otherwise(day.cast("string"))
    end = F.when(k % 31 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 6)).cast("string")
    old = k % 2 == 1
    when = lambda cond, v: F.when(cond, v)
    file = F.struct(F.lit("file").alias("kind"), F.concat(F.lit("d/"), text("o_orderkey"))
                    .alias("path"))
    sample = F.struct(
        F.when(k % 17 == 0, " ").when(k % 23 == 0, F.concat(F.lit("dup"), text(k % 5)))
        .otherwise(F.concat(F.lit(" o"), text(k))).alias("sample_id"),
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("c"), text("o_custkey"), F.lit(" ")))
        .alias("market"),
        when(~old, start).alias("period_start"), when(~old, end).alias("period_end"),
        when(k % 3 > 0, F.when(k % 37 == 0, "bogus").otherwise(F.element_at(
            F.array(*[F.lit(s) for s in fixed.REVIEW_STATUSES]), (k % 5 + 1).cast("int"))))
        .alias("review_status"),
        when(k % 4 > 0, F.element_at(F.array(*[F.lit(s) for s in fixed.WORKFLOW_STATUSES]),
                                     (k % 3 + 1).cast("int"))).alias("workflow_status"),
        when(~old & (k % 41 > 0), F.struct(F.lit("archive").alias("kind"))).alias("source"),
        when(old, F.struct(F.concat(F.lit("b/"), text(k)).alias("path"), start.alias("period_start"),
                           end.alias("period_end"))).alias("bundle"),
        when(~old & (k % 6 == 0), file).alias("deck"),
        when(old & (k % 7 == 0), F.struct(F.lit("d").alias("path"))).alias("reviewed_deck"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_json(sample).alias("json"))
    return rows.select("o_orderkey", K.parse(F.col("json")).alias("s")).select("o_orderkey", "s.*")


NORMAL = f"""
with o as (select o_orderkey as k, o_custkey,
                  cast(date_trunc('week', o_orderdate) as date) as day from orders),
n as (
  select k, case when k % 17 = 0 then '' when k % 23 = 0 then 'dup' || k % 5
                 else 'o' || k end as sample_id,
         case when k % 19 = 0 then '' else 'C' || o_custkey end as market,
         case when k % 29 > 0 then day end as period_start,
         case when k % 31 = 0 then cast(day - interval 1 day as date)
              else cast(day + interval 6 day as date) end as period_end,
         case when k % 2 = 0 and k % 6 = 0 then 'file' when k % 2 = 1 and k % 7 = 0 then 'file' end
           as deck_kind,
         case when k % 2 = 1 then 'zip_bundle' when k % 41 > 0 then 'archive' end as source_kind,
         case when k % 4 = 0 then 'reference_only'
              else {sql_list(fixed.WORKFLOW_STATUSES)}[k % 3 + 1] end as workflow_status
  from o),
r as (
  select *, case when k % 3 = 0 then
              case when deck_kind is null then 'candidate' else 'historical_reference' end
            when k % 37 = 0 then 'bogus' else {sql_list(fixed.REVIEW_STATUSES)}[k % 5 + 1] end
              as review_status,
         count(*) over (partition by sample_id) as n_id,
         count(*) over (partition by market, period_start, period_end) as n_period
  from n)
"""


@check("catalog_normalize", NORMAL + """
select k as o_orderkey, sample_id, market, period_start, period_end, review_status,
       workflow_status, source_kind, deck_kind, array_to_string(list_filter([
         case when sample_id = '' then 'missing_sample_id' end,
         case when sample_id <> '' and n_id > 1 then 'duplicate_sample_id' end,
         case when market = '' then 'missing_market' end,
         case when period_start is null then 'invalid_period' end,
         case when period_end < period_start then 'inverted_period' end,
         case when period_start is not null and n_period > 1 then 'duplicate_market_period' end,
         case when review_status = 'bogus' then 'review_status' end,
         case when source_kind is null then 'missing_source' end],
         lambda x: x is not null), ',') as problems
from r""")
def catalog_normalize(spark, sf):
    return K.normalize(raw_samples(spark, sf)).select(
        "o_orderkey", "sample_id", "market", "period_start", "period_end", "review_status",
        "workflow_status", F.col("source.kind").alias("source_kind"),
        F.col("deck.kind").alias("deck_kind"), F.concat_ws(",", "problems").alias("problems"))


@check("catalog_counts", NORMAL + """
select count(*) as inventory_count,
       count(*) filter (review_status = 'approved') as approved_count,
       count(*) filter (workflow_status = 'runnable') as runnable_count,
       count(*) filter (workflow_status = 'needs_adapter') as needs_adapter_count,
       count(*) filter (workflow_status = 'reference_only') as reference_only_count,
       count(*) filter (review_status = 'candidate') as candidate_count,
       count(*) filter (review_status = 'historical_reference') as historical_reference_count,
       count(*) filter (review_status = 'known_bad_reference') as known_bad_reference_count,
       count(*) filter (review_status = 'expected_fail') as expected_fail_count,
       greatest(0, 10 - count(*)) as remaining_inventory_to_minimum,
       greatest(0, 20 - count(*)) as remaining_inventory_to_target,
       count(*) >= 10 as inventory_minimum_met,
       greatest(0, 10 - count(*) filter (review_status = 'approved'))
         as remaining_approved_to_minimum,
       count(*) filter (review_status = 'approved') >= 10 as approved_minimum_met
from r""")
def catalog_counts(spark, sf):
    return K.status_counts(K.normalize(raw_samples(spark, sf)))


@check("period_gaps", """
with s as (select 'M' || o_custkey % 40 as market, o_orderkey,
                  cast(o_orderdate as date) as a, cast(o_orderdate as date) + 6 as b from orders),
l as (select *, lag(o_orderkey) over w as prev, lag(b) over w as prev_b
      from s window w as (partition by market order by a, o_orderkey))
select market, prev as previous_sample_id, o_orderkey as next_sample_id,
       cast(datediff('day', prev_b, a) - 1 as int) as gap_days
from l where prev is not null and datediff('day', prev_b, a) - 1 <> 0""")
def period_gaps(spark, sf):
    day = F.to_date("o_orderdate")
    samples = table(spark, sf, "orders").select(
        F.concat(F.lit("M"), F.col("o_custkey") % 40).alias("market"),
        F.col("o_orderkey").alias("sample_id"), day.alias("period_start"),
        F.date_add(day, 6).alias("period_end"))
    return C.period_gaps(samples)


def sha(col):
    return F.sha2(col, 256)


def linked_samples(spark, sf):
    """One sample per order; links, seeds and approvals vary with the order key."""
    k = F.col("o_orderkey")
    day = F.to_date(F.date_trunc("week", "o_orderdate"))
    seed = F.concat(F.lit("seed/"), text(k % 10))
    none = F.lit(None).cast("string")
    link = F.when(k % 6 == 0, F.struct(
        F.lit("catalog_sample").alias("kind"), text(k - 1).alias("sample_id"),
        none.alias("path"), none.alias("sha256"))).when(k % 6 == 1, F.struct(
            F.lit("seed_file").alias("kind"), none.alias("sample_id"), seed.alias("path"),
            F.when(k % 5 == 0, "short").when(k % 5 == 1, sha(F.lit("x"))).otherwise(sha(seed))
            .alias("sha256"))).when(k % 6 == 2, F.struct(
                F.lit("guess").alias("kind"), none.alias("sample_id"), none.alias("path"),
                none.alias("sha256")))
    return table(spark, sf, "orders").select(
        text(k).alias("sample_id"), F.concat(F.lit("M"), text(F.col("o_custkey") % 3))
        .alias("market"), day.alias("period_start"), F.date_add(day, 6).alias("period_end"),
        F.when(k % 4 == 0, "approved").otherwise("candidate").alias("review_status"),
        F.when(k % 3 == 0, "runnable").otherwise("reference_only").alias("workflow_status"),
        link.alias("previous_source"),
        F.struct(F.when(k % 8 == 0, " ").otherwise("reviewer").alias("reviewer"),
                 F.element_at(F.array(F.lit("2025-01-02T03:04:05Z"), F.lit("2025-01-02T03:04:05"),
                                      F.lit("2025-01-02 03:04+02:00"), F.lit("yesterday")),
                              (F.floor(k / 4) % 4 + 1).cast("int")).alias("approved_at"))
        .alias("review"))


LINKED = """
with s as (select o_orderkey as k, 'M' || o_custkey % 3 as market,
                  cast(date_trunc('week', o_orderdate) as date) as a,
                  o_orderkey % 4 = 0 as approved, o_orderkey % 3 = 0 as runnable from orders),
j as (select s.*, p.market as p_market, p.a + 6 as p_end, p.k as p_k
      from s left join s p on s.k % 6 = 0 and p.k = s.k - 1)
"""


@check("previous_links", LINKED + """,
codes as (
  select k, unnest(list_filter([
    case when k % 6 = 0 and p_k is null then 'PREVIOUS_SAMPLE_MISSING' end,
    case when k % 6 = 0 and p_k is not null and (p_market <> market or a - p_end <> 1)
         then 'PREVIOUS_SAMPLE_NOT_ADJACENT' end,
    case when k % 6 = 1 and k % 10 > 7 then 'PREVIOUS_SEED_MISSING' end,
    case when k % 6 = 1 and k % 10 <= 7 and k % 5 = 0 then 'INVALID_PREVIOUS_SEED_SHA256' end,
    case when k % 6 = 1 and k % 10 <= 7 and k % 5 = 1 then 'PREVIOUS_SEED_HASH_MISMATCH' end,
    case when k % 6 = 2 and (approved or runnable) then 'UNSUPPORTED_PREVIOUS_SOURCE' end,
    case when k % 6 > 2 and (approved or runnable) then 'MISSING_PREVIOUS_SOURCE' end,
    case when approved and k % 8 = 0 then 'MISSING_APPROVED_REVIEWER' end,
    case when approved and (k // 4) % 4 in (1, 3) then 'INVALID_APPROVED_AT' end,
    case when approved and k % 6 > 1 then 'INVALID_APPROVED_PREVIOUS_SOURCE' end],
    lambda x: x is not null)) as code from j)
select cast(k as varchar) as sample_id, code from codes""")
def previous_links(spark, sf):
    samples = linked_samples(spark, sf)
    # every order names its seed; the last two of ten seeds do not exist
    seeds = table(spark, sf, "orders").select(
        F.concat(F.lit("seed/"), text(F.col("o_orderkey") % 10)).alias("path")).distinct()
    seeds = seeds.where(~F.col("path").isin("seed/8", "seed/9")).select(
        "path", sha(F.col("path")).alias("sha256"))
    return C.previous_issues(samples, seeds).unionByName(C.approval_issues(samples))


def reference_samples(spark, sf):
    """Samples whose three references point to files, archive members and member sets."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("f/"), text(k))
    none, many = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def ref(kind, **values):
        names = ["path", "sha256", "archive_path", "archive_sha256", "member_name",
                 "member_sha256"]
        return F.struct(F.lit(kind).alias("kind"),
                        *[values.get(n, none).alias(n) for n in names],
                        values.get("selectors", many).alias("selectors"),
                        values.get("shas", many).alias("member_sha256s"))

    expected = F.when(k % 7 == 0, "zz").when(k % 7 == 1, sha(F.lit("other"))).when(
        k % 7 == 2, none).otherwise(sha(path))
    source = F.when(k % 13 > 0, ref("file", path=F.when(k % 17 > 0, path), sha256=expected))
    deck = F.when(k % 5 == 0, ref(
        "archive_member", archive_path=path, archive_sha256=sha(path),
        member_name=F.when(k % 3 == 0, "a.pptx").when(k % 3 == 1, "gone.pptx"),
        member_sha256=F.when(k % 4 == 0, sha(F.concat(path, F.lit("a")))).when(
            k % 4 == 1, "1").otherwise(sha(F.lit("q")))))
    golden = F.when(k % 5 == 1, ref(
        "archive_member_set", archive_path=path, archive_sha256=sha(path),
        selectors=F.when(k % 3 == 0, F.array(F.lit("*.pptx"), F.lit("?.csv")))
        .when(k % 3 == 1, F.array(F.lit("x[!a].csv"))).otherwise(F.array().cast("array<string>")),
        shas=F.when(k % 2 == 0, F.array(sha(F.concat(path, F.lit("a"))),
                                        sha(F.concat(path, F.lit("b"))))).otherwise(
            F.array(sha(F.concat(path, F.lit("b")))))))
    samples = table(spark, sf, "orders").select(
        text(k).alias("sample_id"),
        F.when(k % 4 == 0, "approved").otherwise("candidate").alias("review_status"),
        source.alias("source"), deck.alias("deck"), golden.alias("golden_json"))
    here = table(spark, sf, "orders").where(k % 11 > 0)
    inventory = here.select(path.alias("path"), sha(path).alias("sha256"))
    members = here.select(path.alias("path"), F.explode(F.array(
        F.struct(F.lit("a.pptx").alias("name"), sha(F.concat(path, F.lit("a"))).alias("digest")),
        F.struct(F.lit("b.csv").alias("name"), sha(F.concat(path, F.lit("b"))).alias("digest")),
        F.struct(F.lit("xa.csv").alias("name"), sha(F.lit("c")).alias("digest")))).alias("m")) \
        .select("path", "m.name", "m.digest", F.when(
            F.col("m.digest").isNull(), "no digest of the member").alias("problem"))
    return samples, inventory, members


@check("catalog_integrity", """
with s as (select o_orderkey as k, o_orderkey % 4 = 0 as approved, o_orderkey % 11 > 0 as here
           from orders),
codes as (
  select k, unnest(list_filter([
    case when k % 13 = 0 then 'MISSING_SOURCE_REF' end,
    case when approved and k % 5 <> 0 then 'MISSING_APPROVED_DECK' end,
    case when approved and k % 5 <> 1 then 'MISSING_APPROVED_GOLDEN' end,
    case when k % 13 > 0 and k % 17 = 0 then 'INVALID_SOURCE_REF' end,
    case when k % 13 > 0 and k % 17 > 0 and not here then 'MISSING_SOURCE' end,
    case when k % 5 = 0 and not here then 'MISSING_DECK' end,
    case when k % 5 = 1 and not here then 'MISSING_GOLDEN_JSON' end,
    case when k % 13 > 0 and k % 17 > 0 and here and k % 7 in (0, 2) and approved
         then 'INVALID_APPROVED_SOURCE_SHA256' end,
    case when k % 13 > 0 and k % 17 > 0 and here and k % 7 = 0 and not approved
         then 'INVALID_SOURCE_SHA256' end,
    case when k % 13 > 0 and k % 17 > 0 and here and k % 7 in (0, 1)
         then 'SOURCE_HASH_MISMATCH' end,
    case when k % 5 = 0 and k % 3 = 2 then 'MISSING_DECK_MEMBER_NAME' end,
    case when k % 5 = 0 and (k % 3 = 1 or (k % 3 = 0 and not here))
         then 'DECK_MEMBER_NAME_MISSING' end,
    case when k % 5 = 0 and k % 4 = 1 then 'INVALID_DECK_MEMBER_SHA256' end,
    case when k % 5 = 0 and k % 3 = 0 and here and k % 4 in (2, 3)
         then 'DECK_MEMBER_HASH_MISMATCH' end,
    case when k % 5 = 1 and k % 3 = 2 then 'MISSING_GOLDEN_JSON_SELECTORS' end,
    case when k % 5 = 1 and not (here and k % 3 = 0 and k % 2 = 0)
         then 'GOLDEN_JSON_MEMBER_SET_MISMATCH' end],
    lambda x: x is not null)) as code from s
  union all
  select k, 'GOLDEN_JSON_SELECTOR_EMPTY' from s where k % 5 = 1 and k % 3 = 1
  union all
  select k, 'GOLDEN_JSON_SELECTOR_EMPTY'
  from s, (select unnest([1, 2])) where k % 5 = 1 and k % 3 = 0 and not here)
select cast(k as varchar) as sample_id, code from codes""")
def catalog_integrity(spark, sf):
    samples, inventory, members = reference_samples(spark, sf)
    refs, broken = C.references(samples), C.unreadable(members)
    packed = C.readable(refs, broken)
    return (C.asset_issues(refs, inventory, broken)
            .unionByName(C.member_issues(packed, members))
            .unionByName(C.member_set_issues(packed, members)))


@check("pair_candidates", """
with o as (select *, 'm' || o_custkey % 3 as market,
                  cast(date_trunc('week', o_orderdate) as date) as a from orders),
t as (select *, month(a) || '.' || day(a) || '–' || month(a + 6) || '.' || day(a + 6) as token,
             month(a - 7) || '.' || day(a - 7) || '–' || month(a - 1) || '.' || day(a - 1)
               as token0 from o),
p as (
  select b.market, b.o_orderkey as bundle_id, d.o_orderkey as deck_id,
         case when b.token = d.token then 100 when b.token = d.token0 then 40 else 0 end
         + case when b.o_orderpriority = d.o_orderpriority then 20 else 0 end
         + case when d.o_orderkey % 3 = 0 then 10 else 0 end as score
  from t b join t d on b.market = d.market
  where b.o_orderkey % 2 = 0 and d.o_orderkey % 2 = 1),
r as (select *, row_number() over w as place, lead(score) over w as runner from p
      window w as (partition by bundle_id order by score desc, deck_id))
select market, bundle_id, deck_id, score, place,
       place = 1 and score >= 100 and (runner is null or score > runner) as auto_pair
from r where place <= 5""")
def pair_candidates(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").withColumns({
        "market": F.concat(F.lit("m"), text(F.col("o_custkey") % 3)),
        "a": F.to_date(F.date_trunc("week", "o_orderdate"))})
    token = period_token(F.col("a"), F.date_add("a", 6))
    before = period_token(F.date_sub("a", 7), F.date_sub("a", 1))
    bundles = orders.where(k % 2 == 0).select("market", k.alias("bundle_id"),
                                              F.col("o_orderpriority").alias("folder"),
                                              token.alias("token"))
    decks = orders.where(k % 2 == 1).select(
        "market", k.alias("deck_id"), F.col("o_orderpriority").alias("folder"),
        F.when(k % 3 == 0, F.concat(F.upper("market"), F.lit(" deck.pptx")))
        .otherwise("deck.pptx").alias("file_name"), F.array(token).alias("primary"),
        F.array(token, before).alias("visible"))
    return C.pair_candidates(bundles, decks)


@check("slide_text_profile", """
with s as (select o_custkey % 100 as deck, o_orderkey as slide,
                  cast(date_trunc('month', o_orderdate) as date) as a from orders),
t as (select deck, slide, unnest([
        month(a) || '.' || day(a) || '–' || month(a + 6) || '.' || day(a + 6),
        month(a - 7) || '.' || day(a - 7) || '–' || month(a - 1) || '.' || day(a - 1)]) as token
      from s),
n as (select deck, token, count(distinct slide) as slides from t group by all)
select deck, token, slides, slides = max(slides) over (partition by deck) as is_primary from n
""")
def slide_text_profile(spark, sf):
    a = F.to_date(F.date_trunc("month", "o_orderdate"))
    pair = lambda x, y: F.concat(F.date_format(x, "MM.dd"), F.lit(" - "),
                                 F.date_format(y, "M/d"))
    slides = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("deck"), F.col("o_orderkey").alias("slide_no"),
        F.concat(F.lit("Duration: "), pair(a, F.date_add(a, 6)), F.lit(" against "),
                 pair(F.date_sub(a, 7), F.date_sub(a, 1)), F.lit(", again "),
                 pair(a, F.date_add(a, 6)), F.lit(", not 11.1-2.3456")).alias("text"))
    return C.slide_tokens(slides)


@check("slide_marks", r"""
select source as deck, 'unresolved' as kind, '{{' as value from documents
where contains(text, '{{') group by source
union
select source, 'date', unnest(regexp_extract_all(text, '20\d{2}-\d{2}-\d{2}')) from documents
union
select source, 'market', m from documents, (select unnest(['FR', 'IT', 'UK', 'AU']) as m)
where regexp_matches(text, '(^|[^A-Za-z])' || m || '($|[^A-Za-z])')""")
def slide_marks(spark, sf):
    slides = table(spark, sf, "documents").select(
        F.col("source").alias("deck"), F.col("doc_id").alias("slide_no"), "text")
    return C.slide_marks(slides)


@check("registration_guard", """
with i as (select o_orderkey as k, o_custkey % 50 as market,
                  cast(date_trunc('week', o_orderdate) as date) as a, o_orderpriority as content
           from orders where o_orderkey % 3 = 0),
e as (select case when o_orderkey % 3 = 1 then o_orderkey + 2 else o_orderkey end as k,
             o_custkey % 50 as market, cast(date_trunc('week', o_orderdate) as date) as a,
             o_orderpriority as content, o_orderkey // 4 as src
      from orders where o_orderkey % 3 <> 0),
x as (select i.*, i.k // 4 as src, (select min(content) from e where e.k = i.k) as old,
             exists (select 1 from e where e.market = i.market and e.a = i.a and e.k <> i.k)
               as taken,
             exists (select 1 from e where e.src = i.k // 4 and e.k <> i.k) as again from i)
select cast(k as varchar) as sample_id, coalesce(old = content, false) as unchanged,
       case when old = content then null when old is not null then 'different_metadata'
            when taken then 'duplicate_market_period' when again then 'duplicate_source' end
         as problem
from x""")
def registration_guard(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    shape = lambda df, key: df.select(
        text(key).alias("sample_id"), (F.col("o_custkey") % 50).alias("market"),
        week.alias("period_start"), F.date_add(week, 6).alias("period_end"),
        text(F.floor(k / 4)).alias("source_sha256"), F.col("o_orderpriority").alias("content"))
    existing = shape(orders.where(k % 3 != 0), F.when(k % 3 == 1, k + 2).otherwise(k))
    return K.registration_problems(shape(orders.where(k % 3 == 0), k), existing)


@check("golden_diff", """
with a as (select l_orderkey as k, l_partkey || '.' || l_suppkey as path,
                  max(l_quantity) as v, max(l_linenumber) as n from lineitem group by all)
select k, path, case when n <> 2 then cast(cast(v as bigint) as varchar) end as actual,
       case when n <> 3 then cast(cast(case when n = 4 then v + 1 else v end as bigint)
                                  as varchar) end as golden
from a where n in (2, 3, 4)""")
def golden_diff(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("k"),
        F.concat(text("l_partkey"), F.lit("."), text("l_suppkey")).alias("path")).agg(
            F.max("l_quantity").alias("v"), F.max("l_linenumber").alias("n"))
    tall = lambda df, v: df.select(
        "k", "path", F.concat(F.when(F.col("n") == 5, F.concat(F.lit("at/"), text("k"), F.lit("/")))
                              .otherwise(""), v.cast("bigint").cast("string")).alias("value"),
        (F.col("n") == 5).alias("is_history_file"))
    golden = tall(rows.where("n <> 3"), F.when(F.col("n") == 4, F.col("v") + 1)
                  .otherwise(F.col("v")))
    moved = golden.withColumn("value", F.when(F.col("is_history_file"), F.concat(
        F.lit("else"), "value")).otherwise(F.col("value")))
    return C.golden_diff(tall(rows.where("n <> 2"), F.col("v")), moved, ["k"])


def chain_samples(spark, sf):
    """A sample per market and week that links to the week before where there is one."""
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    s = table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 10).alias("m"), week.alias("a")).agg(F.max("o_orderkey").alias("k"))
    name = lambda day: F.concat(F.lit("M"), text("m"), F.lit("/"), day.cast("string"))
    ids = s.select(name(F.col("a")).alias("previous_id"))
    k = F.col("k")
    s = s.withColumns({"sample_id": name(F.col("a")), "wanted": name(F.date_sub("a", 7))})
    s = s.join(ids, F.col("wanted") == F.col("previous_id"), "left")
    return s.select(
        "sample_id", F.when(k % 4 == 0, "approved").otherwise("candidate").alias("review_status"),
        F.when(k % 97 == 0, "reference_only").otherwise("runnable").alias("workflow_status"),
        (k % 89 > 0).alias("integrity_ok"), (k % 83 > 0).alias("source_ok"),
        (k % 79 > 0).alias("own_ok"), "previous_id",
        F.when(k % 73 == 0, "guess").when(F.col("previous_id").isNull() | (k % 50 == 7),
                                          "seed_file")
        .otherwise("catalog_sample").alias("previous_kind"))


REPLAY = """
with recursive s as (
  select o_custkey % 10 as m, cast(date_trunc('week', o_orderdate) as date) as a,
         max(o_orderkey) as k from orders group by all),
j as (select s.*, p.k is not null as has_prev, dense_rank() over (order by s.a) as w,
             s.k % 97 > 0 and s.k % 89 > 0 and s.k % 83 > 0 and s.k % 79 > 0 and s.k % 73 > 0
               as good,
             p.k is null or s.k % 50 = 7 as seed
      from s left join s p on p.m = s.m and p.a = cast(s.a - interval 7 day as date)),
ok as (
  select m, a from j where good and seed
  union
  select j.m, j.a from ok join j on j.m = ok.m and j.a = cast(ok.a + interval 7 day as date)
  where j.good and not j.seed),
r as (select j.*, 'M' || j.m || '/' || cast(j.a as varchar) as sample_id,
             case when k % 89 = 0 then 'FAIL' when k % 97 = 0 then 'SKIP'
                  when ok.m is not null then 'PASS' else 'FAIL' end as status
      from j left join ok on ok.m = j.m and ok.a = j.a)
"""


@check("replay_status", REPLAY + "select sample_id, status from r")
def replay_status(spark, sf):
    return C.replay(chain_samples(spark, sf)).select("sample_id", "status")


@check("replay_summary", REPLAY + """
select count(*) as total, count(*) filter (status = 'PASS') as pass,
       count(*) filter (status = 'FAIL') as fail, count(*) filter (status = 'SKIP') as skip,
       count(*) filter (status <> 'SKIP') as executed,
       count(*) filter (k % 4 = 0 and status <> 'PASS') as approved_failures,
       count(*) filter (status = 'FAIL') = 0 and count(*) filter (status = 'PASS') > 0
         and count(*) filter (k % 4 = 0 and status <> 'PASS') = 0 as passed
from r""")
def replay_summary(spark, sf):
    return C.replay_summary(C.replay(chain_samples(spark, sf)))


# --- listings, digests, configuration, history files ------------------------------------

@check("source_triage", """
with l as (
  select source as root, doc_id % 16 as v, doc_id, n_chars from documents),
c as (
  select root, case when v in (0, 1) then '.cache' || doc_id % 3
                    when v = 2 then '__MACOSX' else null end as pruned, v, doc_id from l),
r as (
  select root, 'hidden_or_system' as reason, count(distinct pruned) as n from c
  where pruned is not null group by root
  union all
  select root, case when v = 3 then 'hidden_or_system' when v in (4, 5) then 'temporary'
                    when v = 6 then 'symbolic_link' when v in (7, 8) then 'unsupported_extension'
                    else 'candidate' end, count(*) from c where pruned is null group by all)
select root, reason, cast(sum(n) as bigint) as n from r group by root, reason""")
def source_triage(spark, sf):
    v, d = F.col("doc_id") % 16, text("doc_id")
    name = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p)
                                     for p in parts])
    path = F.lit(None).cast("string")
    forms = [name("in/.cache", text(F.col("doc_id") % 3), "/", d, ".csv"),
             name("in/.cache", text(F.col("doc_id") % 3), "/deep/.x/", d, ".csv"),
             name("__MACOSX/", d, ".xlsx"), name("a/.", d, ".csv"), name("a/~$", d, ".xlsx"),
             name("a/", d, ".TMP"), name("a/", d, ".csv"), name("a/", d, ".docx"), name(d)]
    for i, form in enumerate(forms):
        path = F.when(v == i, form).otherwise(path)
    path = F.coalesce(path, name("b/c d/", d, F.when(v % 2 == 0, ".CSV").otherwise(".xlsx")))
    listing = table(spark, sf, "documents").select(
        F.col("source").alias("root"), path.alias("path"), (v == 6).alias("is_symlink"),
        F.lit(True).alias("is_file"))
    return S.triage_counts(S.triage(listing))


@check("source_set_digest", f"""
with f as (
  select o_orderkey as b, 'f' || i || '.csv' as path, {sql_list(fixed.KINDS)}[i + 1] as kind, i,
         sha256(o_orderkey || '/' || i) as sha
  from orders, (select unnest([0, 1, 2, 3, 4, 5, 6, 7]) as i)),
s as (select b, string_agg(hex(encode(kind)) || '00' || hex(encode(path)) || '00' || upper(sha), ''
                           order by i) as h from f group by b)
select b, sha256(unhex(h)) as digest from s""")
def source_set_digest(spark, sf):
    i = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("b"), i).select(
        "b", F.element_at(F.array(*[F.lit(k) for k in fixed.KINDS]), F.col("i") + 1).alias("kind"),
        F.concat(F.lit("f"), text("i"), F.lit(".csv")).alias("path"),
        F.encode(F.concat(text("b"), F.lit("/"), text("i")), "UTF-8").alias("content"))
    return S.source_set_digest(S.file_digests(files), ["b"]).select("b", "digest")


@check("config_uniqueness", """
with p as (select p_brand as profile, p_name as id, upper(p_type) || p_size % 5 as pin,
                  p_size from part),
a as (select profile, 'duplicate_product_id' as problem, id as value from p
      group by profile, id having count(*) > 1),
b as (select profile, 'duplicate_creative_pin', lower(pin) from p
      group by profile, pin having count(*) > 1),
c as (select distinct profile, 'keyword_top_n', cast(n as varchar) from (
        select profile, count(*) as n from p group by profile) where n > 100)
select * from a union all select * from b union all select * from c""")
def config_uniqueness(spark, sf):
    part = table(spark, sf, "part")
    pin = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(
        F.col("p_type")), text(F.col("p_size") % 5), F.when(F.col("p_partkey") % 3 == 0, " ")
        .otherwise(""))
    products = part.select(F.col("p_brand").alias("profile"), F.col("p_name").alias("id"),
                           pin.alias("creative_pin"))
    settings = part.groupBy(F.col("p_brand").alias("profile")).agg(
        F.count("*").alias("keyword_top_n"))
    return S.config_problems(products, settings)


def seed_files(spark, sf):
    """One seed array per order, with one good record and one that may lack fields."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    record = lambda drop: F.struct(
        F.lit("IT").alias("market"), day.cast("string").alias("period_start"),
        F.date_add(day, 6).cast("string").alias("period_end"),
        *[F.when(~drop | (F.lit(i) != k % 10), F.lit(i + 1)).alias(m)
          for i, m in enumerate(fixed.OVERALL_METRICS)], F.lit("kept out").alias("source"))
    return table(spark, sf, "orders").select(
        text(k).alias("file"),
        F.to_json(F.array(record(F.lit(False)), record(k % 3 == 0))).alias("text"))


@check("seed_required_fields", f"""
select cast(o_orderkey as varchar) as file, 0 as position, '' as missing from orders
union all
select cast(o_orderkey as varchar), 1,
       case when o_orderkey % 3 = 0
            then {sql_list(fixed.OVERALL_METRICS)}[o_orderkey % 10 + 1] else '' end from orders""")
def seed_required_fields(spark, sf):
    good, bad = H.seed_records(seed_files(spark, sf))
    return good.select("file", "position", F.lit("").alias("missing")).unionByName(
        bad.select("file", "position", F.concat_ws(",", "missing").alias("missing")))


@check("history_upsert", """
with o as (select 'M' || o_custkey % 20 as market, cast(date_trunc('week', o_orderdate) as date)
                    as period_start, o_orderkey as load_ts, o_totalprice as amount_spent
           from orders)
select market, period_start, cast(period_start + interval 6 day as date) as period_end,
       max(load_ts) as load_ts, max_by(amount_spent, load_ts) as amount_spent
from o group by market, period_start""")
def history_upsert(spark, sf):
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("M"), text(F.col("o_custkey") % 20)).alias("market"),
        week.alias("period_start"), F.date_add(week, 6).alias("period_end"),
        F.col("o_orderkey").alias("load_ts"), F.col("o_totalprice").alias("amount_spent"))
    early = F.col("load_ts") % 2 == 0
    return H.upsert(rows.where(early), rows.where(~early))


@check("snapshot_identity", """
select cast(o_orderkey as varchar) as bundle_id,
       case when o_orderkey % 7 = 0 then 'SNAPSHOT_INVALID' else 'SNAPSHOT_IDENTITY_MISMATCH' end
         as code
from orders where o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 11 = 0""")
def snapshot_identity(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    payload = F.when(k % 7 == 0, "not json").otherwise(F.to_json(F.struct(
        F.when(k % 5 == 0, "XX").otherwise("IT").alias("market"),
        day.cast("string").alias("period_start"),
        F.date_add(day, F.when(k % 11 == 0, 7).otherwise(6)).cast("string")
        .alias("period_end"))))
    rows = table(spark, sf, "orders").select(
        text(k).alias("bundle_id"), F.lit("IT").alias("market"), day.alias("period_start"),
        F.date_add(day, 6).alias("period_end"), payload.alias("json"))
    rows = rows.withColumn("report", F.from_json(
        "json", "market string, period_start date, period_end date"))
    return H.snapshot_issues(rows).select("bundle_id", "code")
