"""Integrity of catalog samples, period gaps, links, golden differences and replay."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.numbers import period_token
from weekloom.functions.text import is_blank, is_sha256, zoned_timestamp
from weekloom.session import cut

ROLES = ["source", "deck", "golden_json"]
FILE_KINDS = ["file", "zip_bundle"]
ARCHIVE_KINDS = ["archive", "archive_member", "archive_member_set"]
OPENED_KINDS = ["archive_member", "archive_member_set"]


def references(samples: DataFrame) -> DataFrame:
    """(sample_id, review_status, role, ref, path, expected): three roles of every sample."""
    roles = F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("ref")) for r in ROLES])).alias("x")
    df = samples.select("sample_id", "review_status", roles).select(
        "sample_id", "review_status", "x.role", "x.ref")
    plain, packed = F.col("ref.kind").isin(FILE_KINDS), F.col("ref.kind").isin(ARCHIVE_KINDS)
    return df.withColumns({
        "path": F.when(plain, F.col("ref.path")).when(packed, F.col("ref.archive_path")),
        "expected": F.when(plain, F.col("ref.sha256")).when(packed, F.col("ref.archive_sha256"))})


def _code(head: str, tail: str = "") -> Column:
    return F.concat(F.lit(head), F.upper("role"), F.lit(tail))


def _spread(df: DataFrame, *codes: Column) -> DataFrame:
    return df.select("sample_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def looked_up(df: DataFrame, by: list[str], *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """``df`` left-joined with each of ``tables`` (frame, columns joined on).

    Rows that lack one of the columns ``by`` find nothing: they go past the joins, whose shuffle
    would bring them into one task. Both sides grow with the catalog, so neither is broadcast;
    their estimates from compressed files are far too low.
    """
    lacking = F.lit(False)
    for column in by:
        lacking = lacking | F.col(column).isNull()
    found = df.where(~lacking)
    for right, on in tables:
        found = found.join(right.hint("merge"), on, "left")
    return found.unionByName(df.where(lacking), allowMissingColumns=True)


def unreadable(members: DataFrame) -> DataFrame:
    """(path): archives that cannot be opened, or of which a member cannot be read.

    ``members(path, problem)`` has a row per member, and one of an archive that does not open.
    """
    return members.where("path is not null and problem is not null").select("path").distinct()


def readable(refs: DataFrame, broken: DataFrame) -> DataFrame:
    """The references into archives, but for those into ``broken(path)``."""
    opened = refs.where(F.col("ref.kind").isin(OPENED_KINDS))
    marked = looked_up(opened, ["path"], (broken.withColumn("broken", F.lit(True)), ["path"]))
    return marked.where("broken is null").drop("broken")


def asset_issues(refs: DataFrame, inventory: DataFrame,
                 broken: DataFrame | None = None) -> DataFrame:
    """Missing references, missing files, wrong file hashes and archives that cannot be read.

    ``inventory(path, sha256)``; ``broken(path)`` as ``unreadable`` gives it, none if left out.
    Members of these archives are not looked at (``readable``).
    """
    c = F.col
    if broken is None:
        broken = inventory.select("path").where("false")
    df = looked_up(refs, ["path"], (inventory.select("path", c("sha256").alias("actual")), ["path"]),
                   (broken.withColumn("broken", F.lit(True)), ["path"]))
    approved, given = c("review_status") == "approved", c("ref").isNotNull()
    here = given & c("actual").isNotNull()
    bad_sha = ~is_sha256(c("expected"))
    return _spread(
        df,
        F.when(~given & (c("role") == "source"), "MISSING_SOURCE_REF"),
        F.when(~given & approved & (c("role") == "deck"), "MISSING_APPROVED_DECK"),
        F.when(~given & approved & (c("role") == "golden_json"), "MISSING_APPROVED_GOLDEN"),
        F.when(given & c("path").isNull(), _code("INVALID_", "_REF")),
        F.when(given & c("path").isNotNull() & c("actual").isNull(), _code("MISSING_")),
        F.when(here & approved & bad_sha, _code("INVALID_APPROVED_", "_SHA256")),
        F.when(here & ~approved & (c("expected") != "") & bad_sha, _code("INVALID_", "_SHA256")),
        F.when(here & (c("expected") != "") & (c("expected") != c("actual")),
               _code("", "_HASH_MISMATCH")),
        F.when(here & c("ref.kind").isin(OPENED_KINDS) & c("broken"),
               _code("INVALID_", "_ARCHIVE")))


def member_issues(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Single archive members by name and hash (``members(path, name, digest)``)."""
    c = F.col
    df = refs.where("ref.kind = 'archive_member'").withColumns({
        "name": c("ref.member_name"), "digest": c("ref.member_sha256")})
    named = members.groupBy("path", "name").agg(F.count("*").alias("n_named"))
    exact = members.select("path", "name", "digest").distinct().withColumn("exact", F.lit(True))
    df = looked_up(df, ["path", "name"], (named, ["path", "name"]),
                   (exact, ["path", "name", "digest"]))
    known = is_sha256(c("digest"))
    no_name = c("name").isNull() | (c("name") == "")
    return _spread(
        df,
        F.when(no_name, _code("MISSING_", "_MEMBER_NAME")),
        F.when(~no_name & c("n_named").isNull(), _code("", "_MEMBER_NAME_MISSING")),
        F.when(~known, _code("INVALID_", "_MEMBER_SHA256")),
        F.when(known & c("n_named").isNotNull() & c("exact").isNull(),
               _code("", "_MEMBER_HASH_MISMATCH")))


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a shell pattern: ``*``, ``?`` and ``[...]`` (``[!`` negates)."""
    text = F.regexp_replace(glob, r"([\\.+^$(){}|])", r"\\$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(text, r"\[!", "[^"), F.lit(r"\z"))


def member_set_issues(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Members chosen by selectors must equal the expected hashes, counted."""
    c, ident = F.col, ["sample_id", "role"]
    df = refs.where("ref.kind = 'archive_member_set'").select(
        *ident, "path", c("ref.selectors").alias("selectors"),
        c("ref.member_sha256s").alias("shas"))
    none = F.array().cast("array<string>")
    df = df.withColumns({"selectors": F.coalesce("selectors", none),
                         "shas": F.coalesce("shas", none)})
    globs = df.select(*ident, "path", F.explode(F.array_distinct("selectors")).alias("glob"))
    globs = globs.withColumn("pattern", glob_pattern(c("glob")))
    copies = members.groupBy("path", "name", "digest").agg(F.count("*").alias("copies"))
    hits = globs.join(copies.hint("merge"), "path").where(F.expr("name rlike pattern"))
    empty = globs.join(hits.select(*ident, "glob").hint("merge"), [*ident, "glob"], "left_anti")
    picked = hits.select(*ident, "name", "digest", "copies").distinct().groupBy(
        *ident, "digest").agg(F.sum("copies").alias("n"))
    wanted = df.select(*ident, F.explode("shas").alias("digest")).groupBy(*ident, "digest").agg(
        F.count("*").alias("m"))
    valid = (F.size("shas") > 0) & F.forall("shas", is_sha256)
    uneven = picked.join(wanted.hint("merge"), [*ident, "digest"], "full").where("not (n <=> m)") \
        .select(*ident).distinct().withColumn("uneven", F.lit(True))
    flagged = df.join(uneven.hint("merge"), ident, "left")
    return _spread(
        flagged,
        F.when(F.size("selectors") == 0, _code("MISSING_", "_SELECTORS")),
        F.when(~valid, _code("INVALID_", "_MEMBER_SET_SHA256")),
        F.when(valid & c("uneven"), _code("", "_MEMBER_SET_MISMATCH"))).unionByName(
            empty.select("sample_id", _code("", "_SELECTOR_EMPTY").alias("code")))


def golden_issues(samples: DataFrame, goldens: DataFrame) -> DataFrame:
    """Golden reports of another market or period (``goldens(path, market, start, end)``)."""
    c = F.col
    df = samples.where("golden_json.path is not null").join(goldens.select(
        "path", c("market").alias("g_market"), "start", "end"),
        c("golden_json.path") == c("path"))
    same = (F.upper("g_market").eqNullSafe(c("market"))
            & c("start").eqNullSafe(c("period_start")) & c("end").eqNullSafe(c("period_end")))
    return df.where(~same).select("sample_id", F.lit("INVALID_GOLDEN_REPORT").alias("code"))


def deck_scope_issues(samples: DataFrame, decks: DataFrame) -> DataFrame:
    """Approved decks must show the period as primary and name the market.

    ``decks(path, primary array<string>, markets array<string>)``, keyed by the asset path.
    """
    c = F.col
    path = F.when(c("deck.kind") == "file", c("deck.path")).when(
        c("deck.kind") == "archive_member",
        F.concat("deck.archive_path", F.lit("!"), "deck.member_name"))
    df = samples.where("review_status = 'approved' and deck is not null").withColumn("at", path)
    df = df.join(decks, c("at") == c("path"), "left")
    fits = (F.array_contains("primary", period_token(c("period_start"), c("period_end")))
            & F.array_contains("markets", c("market")))
    return df.where(~F.coalesce(fits, F.lit(False))).select(
        "sample_id", F.lit("INVALID_APPROVED_DECK_SCOPE").alias("code"))


def previous_issues(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """The link to the previous week: a catalog sample one day earlier, or a seed file."""
    c = F.col
    linked = samples.select(c("sample_id").alias("p_id"), c("market").alias("p_market"),
                            c("period_end").alias("p_end"))
    seeds = inventory.select(c("path").alias("seed_path"), c("sha256").alias("seed_sha"))
    rows = samples.select("sample_id", "market", "period_start", "review_status",
                          "workflow_status", "previous_source").withColumns({
        "sample_key": F.when(c("previous_source.kind") == "catalog_sample",
                             c("previous_source.sample_id")),
        "seed_key": F.when(c("previous_source.kind") == "seed_file", c("previous_source.path"))})
    # a link is of one kind, so its rows take part in one join and the rest in none
    to_sample, to_seed = c("sample_key").isNotNull(), c("seed_key").isNotNull()
    df = (rows.where(to_sample).join(linked.hint("merge"), c("sample_key") == c("p_id"), "left")
          .unionByName(rows.where(to_seed).join(
              seeds.hint("merge"), c("seed_key") == c("seed_path"), "left"),
              allowMissingColumns=True)
          .unionByName(rows.where(~to_sample & ~to_seed), allowMissingColumns=True))
    needed = (c("review_status") == "approved") | (c("workflow_status") == "runnable")
    given, kind = c("previous_source").isNotNull(), c("previous_source.kind")
    sample, seed = given & (kind == "catalog_sample"), given & (kind == "seed_file")
    want = c("previous_source.sha256")
    return _spread(
        df,
        F.when(sample & c("p_id").isNull(), "PREVIOUS_SAMPLE_MISSING"),
        F.when(sample & c("p_id").isNotNull() & (
            (c("p_market") != c("market")) | (F.datediff("period_start", "p_end") != 1)),
            "PREVIOUS_SAMPLE_NOT_ADJACENT"),
        F.when(seed & c("seed_sha").isNull(), "PREVIOUS_SEED_MISSING"),
        F.when(seed & c("seed_sha").isNotNull() & ~is_sha256(want),
               "INVALID_PREVIOUS_SEED_SHA256"),
        F.when(seed & is_sha256(want) & (want != c("seed_sha")), "PREVIOUS_SEED_HASH_MISMATCH"),
        F.when(given & ~F.coalesce(kind.isin(fixed.PREVIOUS_KINDS), F.lit(False)) & needed,
               "UNSUPPORTED_PREVIOUS_SOURCE"),
        F.when(~given & needed, "MISSING_PREVIOUS_SOURCE"))


def approval_issues(samples: DataFrame) -> DataFrame:
    c = F.col
    kind = c("previous_source.kind")
    return _spread(
        samples.where("review_status = 'approved'"),
        F.when(c("review.reviewer").isNull() | is_blank(c("review.reviewer")),
               "MISSING_APPROVED_REVIEWER"),
        F.when(zoned_timestamp(c("review.approved_at")).isNull(), "INVALID_APPROVED_AT"),
        F.when(~F.coalesce(kind.isin(fixed.PREVIOUS_KINDS), F.lit(False)),
               "INVALID_APPROVED_PREVIOUS_SOURCE"))


def period_gaps(samples: DataFrame) -> DataFrame:
    """Days between neighbouring samples of a market, where not zero; overlaps are negative.

    Rows are compared inside (market, month); the first row of a month looks at the last row of
    the latest earlier month, so one market never has to fit one task.
    """
    df = samples.select("market", "sample_id", "period_start", "period_end",
                        F.trunc("period_start", "month").alias("month"))
    last = F.struct("period_start", "sample_id", "period_end")
    tails = df.groupBy("market", "month").agg(F.max(last).alias("tail"))
    tails = tails.withColumn("carried", F.lag("tail").over(
        W.partitionBy("market").orderBy("month"))).drop("tail")
    inside = F.lag(last).over(
        W.partitionBy("market", "month").orderBy("period_start", "sample_id"))
    df = df.withColumn("p", inside).join(tails, ["market", "month"]).withColumn(
        "p", F.coalesce("p", "carried")).where("p is not null")
    gap = F.datediff("period_start", "p.period_end") - 1
    return df.select("market", F.col("p.sample_id").alias("previous_sample_id"),
                     F.col("sample_id").alias("next_sample_id"),
                     gap.alias("gap_days")).where("gap_days <> 0")


def golden_diff(actual: DataFrame, golden: DataFrame, by: list[str]) -> DataFrame:
    """Paths whose values differ between two tall reports ``(by, path, value)``.

    History file paths count by their base name only.
    """
    base = lambda df, name: df.select(*by, "path", F.when(
        F.coalesce("is_history_file", F.lit(False)),
        F.substring_index("value", "/", -1)).otherwise(F.col("value")).alias(name),
        F.lit(True).alias(f"has_{name}"))
    both = base(actual, "actual").join(base(golden, "golden"), [*by, "path"], "full")
    return both.where("not (actual <=> golden) or not (has_actual <=> has_golden)").select(
        *by, "path", "actual", "golden")


def replay(samples: DataFrame) -> DataFrame:
    """PASS, FAIL or SKIP of every sample; a linked sample needs its predecessor to pass.

    Rows carry ``sample_id, workflow_status, integrity_ok, source_ok, own_ok, previous_kind,
    previous_id``. Chains are walked by doubling: each round every sample learns the state of
    the chain twice as far back, so a chain of n weeks takes log2(n) joins on the sample id.
    A link that does not lead to an earlier start of the same market (where the rows carry both)
    fails; so does what is still linked when every acyclic chain has ended.
    """
    c = F.col
    if {"market", "period_start"} <= set(samples.columns):
        before = samples.select(c("sample_id").alias("previous_id"),
                                c("market").alias("_market"), c("period_start").alias("_start"))
        samples = looked_up(samples, ["previous_id"], (before, ["previous_id"]))
        back = (c("_market") == c("market")) & (c("_start") < c("period_start"))
        samples = samples.withColumn(
            "previous_id", F.when(F.coalesce(back, F.lit(False)), c("previous_id"))
        ).drop("_market", "_start")
    runnable = c("workflow_status") == "runnable"
    known = F.coalesce(c("previous_kind").isin(fixed.PREVIOUS_KINDS), F.lit(False))
    good = c("integrity_ok") & runnable & c("source_ok") & known & c("own_ok")
    linked = good & (c("previous_kind") == "catalog_sample")
    state = cut(samples.select("sample_id", good.alias("ok"),
                               F.when(linked, F.coalesce("previous_id", F.lit(""))).alias("next")))
    rounds = max(1, state.count()).bit_length() + 1
    while rounds and not state.where("next is not null").isEmpty():
        rounds -= 1
        ahead = state.select(c("sample_id").alias("next"), c("ok").alias("next_ok"),
                             c("next").alias("next_next"))
        state = cut(looked_up(state, ["next"], (ahead, ["next"])).select(
            "sample_id",
            F.when(c("next").isNull(), c("ok")).otherwise(
                c("ok") & F.coalesce("next_ok", F.lit(False))).alias("ok"),
            F.when(c("next_ok"), c("next_next")).alias("next")))
    state = state.withColumn("ok", c("ok") & c("next").isNull())
    status = (F.when(~c("integrity_ok"), "FAIL").when(~runnable, "SKIP")
              .when(c("ok"), "PASS").otherwise("FAIL"))
    reason = (F.when(~c("integrity_ok"), "asset integrity failed")
              .when(~runnable, F.concat(F.lit("workflow_status="), "workflow_status"))
              .when(~c("source_ok"), "runnable sample has unsupported source reference")
              .when(~known, "unsupported previous_source for replay")
              .when(~c("own_ok"), "own run failed")
              .when(~c("ok"), "previous_source chain is not runnable"))
    return samples.join(state.select("sample_id", "ok").hint("merge"), "sample_id").withColumns(
        {"status": status, "reason": reason}).drop("ok")


def replay_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    failures = F.count_if((F.col("review_status") == "approved") & (F.col("status") != "PASS"))
    return results.agg(
        F.count("*").alias("total"), n("PASS").alias("pass"), n("FAIL").alias("fail"),
        n("SKIP").alias("skip"), (n("PASS") + n("FAIL")).alias("executed"),
        failures.alias("approved_failures"),
        ((n("PASS") > 0) & (n("FAIL") == 0) & (failures == 0)).alias("passed"))


# --- decks ------------------------------------------------------------------------------

PERIOD = r"(?<!\d)(\d{1,2})[./](\d{1,2})\s*[–—-]\s*(\d{1,2})[./](\d{1,2})(?!\d)"


def period_tokens(text: Column) -> Column:
    """Distinct ``m.d–m.d`` tokens of a text, without leading zeros."""
    part = lambda i: F.regexp_extract_all(text, F.lit(PERIOD), F.lit(i))
    number = lambda s: s.cast("int").cast("string")
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"),
                          part(4).alias("d"))
    return F.array_distinct(F.transform(zipped, lambda z: F.concat(
        number(z["a"]), F.lit("."), number(z["b"]), F.lit("–"), number(z["c"]), F.lit("."),
        number(z["d"]))))


def slide_tokens(slides: DataFrame) -> DataFrame:
    """(deck, token, slides, is_primary): on how many slides each period token appears.

    Slides count once each; counting combines before the shuffle, so a huge deck is no problem.
    """
    seen = slides.select("deck", "slide_no", F.explode(period_tokens(F.col("text")))
                         .alias("token")).distinct()
    counts = seen.groupBy("deck", "token").agg(F.count("*").alias("slides"))
    most = counts.groupBy("deck").agg(F.max("slides").alias("most"))
    return counts.join(most, "deck").select("deck", "token", "slides",
                                            (F.col("slides") == F.col("most")).alias("is_primary"))


def slide_marks(slides: DataFrame) -> DataFrame:
    """(deck, kind, value): ISO dates, market tokens and unresolved template marks."""
    markets = "|".join(fixed.DECK_MARKETS)
    dates = F.regexp_extract_all("text", F.lit(r"20\d{2}-\d{2}-\d{2}"), F.lit(0))
    found = F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z])(?:{markets})(?![A-Za-z])"),
                                 F.lit(0))
    tag = lambda kind, xs: F.transform(xs, lambda v: F.struct(
        F.lit(kind).alias("kind"), v.alias("value")))
    marks = F.concat(tag("date", dates), tag("market", found), F.when(
        F.col("text").contains("{{"), tag("unresolved", F.array(F.lit("{{"))))
        .otherwise(tag("unresolved", F.array().cast("array<string>"))))
    return slides.select("deck", F.explode(marks).alias("m")).select(
        "deck", "m.kind", "m.value").distinct()


TOP_DECKS = 5


def pair_candidates(bundles: DataFrame, decks: DataFrame) -> DataFrame:
    """The five best decks of every bundle, exactly, without forming all pairs.

    ``bundles(market, bundle_id, folder, token)``; ``decks(market, deck_id, folder, file_name,
    primary, visible)`` with ``deck_id`` in listing order. A deck scores 100 when it shows the
    period as primary or else 40 when it shows it at all, 20 in the same folder and 10 when its
    name holds the market. Decks that share one of these with a bundle rank among themselves
    the same way for every such bundle, so the first five per token, folder, both, and market
    contain the five best of any bundle. Bundles of one market, token and folder have the same
    five, which are found once; bundles then meet them in one join.
    """
    c = F.col
    decks = decks.withColumn("named", F.when(
        F.lower("file_name").contains(F.lower("market")), 10).otherwise(0))

    def first(df, by, *order):
        w = W.partitionBy(*by).orderBy(*order, c("named").desc(), "deck_id")
        ranked = df.withColumn("r", F.row_number().over(w)).where(c("r") <= TOP_DECKS)
        return ranked.drop("r")

    shown = decks.select("market", "deck_id", "folder", "named", F.explode(F.concat(
        F.transform("primary", lambda t: F.struct(t.alias("token"), F.lit(100).alias("hit"))),
        F.transform(F.array_except("visible", "primary"),
                    lambda t: F.struct(t.alias("token"), F.lit(40).alias("hit"))))).alias("t"))
    shown = shown.select("market", "deck_id", "folder", "named", "t.token", "t.hit")
    plain = decks.select("market", "deck_id", "folder", "named", F.lit(0).alias("hit"))
    bundles = bundles.select("market", "bundle_id", "token", c("folder").alias("own_folder"))
    keys = bundles.select("market", "token", "own_folder").distinct()
    kept = ["market", "token", "own_folder", "deck_id", "folder", "named", "hit"]
    at_folder = lambda df: df.withColumn("own_folder", c("folder"))
    pool = keys.join(first(shown, ["market", "token"], c("hit").desc()),
                     ["market", "token"]).select(kept)
    for more, by in ((at_folder(first(shown, ["market", "token", "folder"], c("hit").desc())),
                      ["market", "token", "own_folder"]),
                     (at_folder(first(plain, ["market", "folder"])), ["market", "own_folder"]),
                     (first(plain, ["market"]), ["market"])):
        pool = pool.unionByName(keys.join(more, by).select(kept))
    # a deck reached twice keeps its higher token score
    scored = pool.groupBy("market", "token", "own_folder", "deck_id").agg(F.max(
        c("hit") + c("named") + F.when(c("folder") == c("own_folder"), 20).otherwise(0))
        .alias("score"))
    own = W.partitionBy("market", "token", "own_folder").orderBy(c("score").desc(), "deck_id")
    tops = scored.withColumn("r", F.row_number().over(own)).where(c("r") <= TOP_DECKS).select(
        c("market").alias("t_market"), c("token").alias("t_token"),
        c("own_folder").alias("t_folder"), F.struct("deck_id", "score").alias("top"))
    # few rows of one key, so that bundles are matched by lists of five
    tops = tops.groupBy("t_market", "t_token", "t_folder").agg(
        F.collect_list("top").alias("tops"))
    reached = bundles.join(tops, (c("market") == c("t_market"))
                           & c("token").eqNullSafe(c("t_token"))
                           & c("own_folder").eqNullSafe(c("t_folder"))).select(
        "market", "bundle_id", F.explode("tops").alias("top"))
    # a bundle may stand in several rows
    scored = reached.groupBy("market", "bundle_id", "top.deck_id").agg(
        F.max("top.score").alias("score"))
    best = W.partitionBy("market", "bundle_id").orderBy(c("score").desc(), "deck_id")
    ranked = scored.withColumns({"place": F.row_number().over(best).cast("bigint"),
                                 "runner_up": F.lead("score").over(best)})
    auto = ((c("place") == 1) & (c("score") >= 100)
            & (c("runner_up").isNull() | (c("score") > c("runner_up"))))
    return ranked.where(c("place") <= TOP_DECKS).select(
        "market", "bundle_id", "deck_id", "score", "place", auto.alias("auto_pair"))
