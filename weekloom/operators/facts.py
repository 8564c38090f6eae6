"""Typed facts from classified source rows, and the problems met on the way."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.functions.numbers import parse_date, parse_number, percent_of, to_integer
from weekloom.functions.text import clean_keyword, is_blank, normalize_text, strip
from weekloom.issues import FIELDS, issue
from weekloom.operators.ordering import positions
from weekloom.operators.recognize import average_value_cell, value

ROW = [*KEY, "file", "sheet", "row_no"]


def cell_of(header: str | None, vendor: str | None = None) -> Column:
    return average_value_cell(vendor) if header is None else value(header)


def section_headers(section: str) -> list[str | None]:
    """The headers whose cells a fact of the section carries: those of its fields, and for the
    overall row those of its period."""
    more = [fixed.START_HEADER, fixed.END_HEADER] if section == "overall" else []
    return [header for header, _ in fixed.SECTION_FIELDS[section].values()] + more


def typed(rows: DataFrame, section: str, keep: list[str] | None = None,
          vendor: str | None = None) -> DataFrame:
    """Parse the section's fields; ``bad_fields`` names those that do not parse.

    The cells a fact is read from travel with it as ``cells``, in the order of
    ``section_headers``, so that its lineage needs no look back at the rows. Each cell is looked
    up once; numbers are parsed over one array and rounded to integers in a second step.
    """
    keep = keep or []
    fields = fixed.SECTION_FIELDS[section]
    place = {name: at for at, name in enumerate(fields)}
    numeric = [n for n, (_, kind) in fields.items()
               if kind not in ("text", "keyword", "date")]
    cells = F.array(*[cell_of(h, vendor) for h in section_headers(section)])
    df = rows.select(*ROW, *keep, cells.alias("cells"))
    first = []
    for name, (_, kind) in fields.items():
        text = F.col("cells")[place[name]]["s"]
        if kind == "text":
            first.append(strip(text).alias(name))
        elif kind == "keyword":
            first.append(clean_keyword(text).alias(name))
        elif kind == "date":
            first.append(parse_date(text).alias(name))
    picked = F.array(*[F.col("cells")[place[n]] for n in numeric])
    df = df.select(*ROW, *keep, *first, "cells", picked.alias("_cells"))
    df = df.withColumn("_numbers", F.transform("_cells", lambda c: parse_number(c["s"], c["t"])))
    second, bad = [], []
    for name, (_, kind) in fields.items():
        missing = F.col(name).isNull()
        if name in numeric:
            at = numeric.index(name)
            col = F.col("_numbers")[at]
            if kind in ("integer", "optional_integer"):
                col = to_integer(col)
            elif kind == "hundredfold":
                col = col * 100.0
            if kind == "optional_integer":
                cell = F.col("_cells")[at]
                missing = missing & ~(cell.isNotNull() & is_blank(cell["s"]))
            second.append(col.alias(name))
        else:
            second.append(F.col(name))
        bad.append(F.when(missing, F.lit(name)))
    df = df.select(*ROW, *keep, *second, "cells", "_cells")
    return df.withColumn("bad_fields", F.array_compact(F.array(*bad))).drop("_cells")


def bad_values(facts: DataFrame, section: str) -> DataFrame:
    """One error per required field that did not parse."""
    broken = facts.select(*KEY, "row_no", F.explode("bad_fields").alias("field"))
    return issue(broken, "ERROR", "UNREADABLE_VALUE",
                 F.concat(F.lit(f"{section}.row_"), F.col("row_no").cast("string"), F.lit("."),
                          F.col("field")))


def alias_match(normalized: Column, products: Column) -> Column:
    """Product of the longest alias contained in a text, as ``struct<product_id, status>``.

    ``products`` is the configured array, small by nature and read with the profile row, so a
    text meets only its own profile's aliases and no pairs are formed. Status is ``matched``,
    ``ambiguous`` (longest aliases of different products) or ``unmatched``.
    """
    aliases = F.flatten(F.transform(products, lambda p: F.transform(
        p["norm_aliases"], lambda a: F.struct(F.length(a).alias("n"), p["id"].alias("id"),
                                              a.alias("a")))))
    hits = F.filter(aliases, lambda x: (x["n"] > 0) & normalized.contains(x["a"]))
    best = F.array_max(F.transform(hits, lambda x: x["n"]))
    winners = F.array_distinct(F.transform(
        F.filter(hits, lambda x: x["n"] == best), lambda x: x["id"]))
    return F.struct(
        F.when(F.size(winners) == 1, winners[0]).alias("product_id"),
        F.when(F.size(winners) == 1, "matched").when(F.size(winners) > 1, "ambiguous")
        .otherwise("unmatched").alias("status"))


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Add normalised aliases and pins to the products of each profile."""
    exploded = profiles.select("market", F.posexplode("products").alias("idx", "p"))
    alias = exploded.select("market", "idx", "p.id", F.posexplode("p.aliases").alias("j", "a"))
    alias = alias.groupBy("market", "idx").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("j", normalize_text(F.col("a")).alias("a")))), lambda s: s["a"])
        .alias("norm_aliases"))
    shaped = exploded.join(alias, ["market", "idx"], "left").select(
        "market", "idx", F.struct(
            F.col("p.id").alias("id"), F.col("p.display_name").alias("display_name"),
            F.coalesce("norm_aliases", F.array().cast("array<string>")).alias("norm_aliases"),
            F.col("p.creative_pin").alias("creative_pin"),
            normalize_text(F.col("p.creative_pin")).alias("norm_pin"),
            F.col("p.creative_asset").alias("creative_asset")).alias("product"))
    nested = shaped.groupBy("market").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("idx", "product"))), lambda s: s["product"]).alias("products"))
    return profiles.drop("products").join(nested, "market")


def dim_product(profiles: DataFrame) -> DataFrame:
    return profiles.select("market", F.posexplode("products").alias("idx", "p")).select(
        "market", F.col("idx").cast("bigint").alias("idx"), F.col("p.id").alias("product_id"),
        "p.display_name", "p.creative_pin", "p.norm_pin", "p.creative_asset")


def with_product(rows: DataFrame, profiles: DataFrame, text: Column) -> DataFrame:
    """Attach the matched product of a text; profiles join on market."""
    small = profiles.select("market", "products")
    named = rows.withColumn("_text", normalize_text(text))
    return (named.join(small, "market")
            .withColumn("_hit", alias_match(F.col("_text"), F.col("products")))
            .withColumn("product_id", F.col("_hit.product_id"))
            .withColumn("match_status", F.col("_hit.status"))
            .drop("_hit", "_text", "products"))


def cover_issues(mapped: DataFrame, bundles: DataFrame, products: DataFrame,
                 section: str) -> DataFrame:
    """Rows without one product, products with several rows, and products without any."""
    path = F.concat(F.lit(f"{section}.row_"), F.col("row_no").cast("string"))
    unmatched = issue(mapped.where("match_status <> 'matched'"), "ERROR",
                      F.when(F.col("match_status") == "ambiguous", "AMBIGUOUS_PRODUCT")
                      .otherwise("UNMATCHED_PRODUCT"), path)
    counts = mapped.where("product_id is not null").groupBy(*KEY, "product_id").agg(
        F.count("*").alias("n"))
    expected = bundles.select(*KEY).join(products.select("market", "product_id"), "market")
    both = expected.join(counts, [*KEY, "product_id"], "left")
    wrong = issue(both.where("n is null or n > 1"), "ERROR",
                  F.when(F.col("n").isNull(), "MISSING_PRODUCT").otherwise("DUPLICATE_PRODUCT"),
                  F.concat(F.lit(f"{section}."), F.col("product_id")),
                  actual=F.coalesce("n", F.lit(0)), expected=F.lit(1))
    return unmatched.unionByName(wrong)


def overall(rows: DataFrame, tables: DataFrame) -> DataFrame:
    facts = typed(rows.where("kind = 'overall'"), "overall")
    spans = tables.where("kind = 'overall'").select(*KEY, "source_start", "source_end")
    return (facts.join(spans, KEY).withColumn(
        "add_to_cart_rate", percent_of(F.col("adds_to_cart"), F.col("link_clicks"))))


def overall_issues(facts: DataFrame, bundles: DataFrame) -> DataFrame:
    n = facts.groupBy(*KEY).agg(F.count("*").alias("n"))
    wrong = bundles.select(*KEY).join(n, KEY, "left").where("n is null or n <> 1")
    undated = facts.where("source_start is null or source_end is null")
    idle = facts.where("link_clicks <= 0")
    return (bad_values(facts, "overall")
            .unionByName(issue(wrong, "ERROR", "OVERALL_ROW_COUNT", "overall",
                               actual=F.coalesce("n", F.lit(0)), expected=F.lit(1)))
            .unionByName(issue(undated, "ERROR", "OVERALL_PERIOD_MISSING", "overall"))
            .unionByName(issue(idle, "ERROR", "INVALID_LINK_CLICKS", "overall.link_clicks",
                               actual=F.col("link_clicks"))))


def daily(rows: DataFrame) -> DataFrame:
    """Days in order. Rows of one day keep file order."""
    facts = typed(rows.where("kind = 'by_day'"), "daily")
    return positions(facts.where("day is not null"), KEY, F.col("day"), ["row_no"]).unionByName(
        facts.where("day is null"), allowMissingColumns=True)


def summary(rows: DataFrame, profiles: DataFrame, products: DataFrame) -> DataFrame:
    named = rows.where("kind = 'by_product'").where(~is_blank(value("Name")["s"]))
    mapped = with_product(named, profiles, value("Name")["s"])
    facts = typed(mapped, "summary", ["product_id", "match_status"])
    return facts.join(products.select("market", "product_id", "idx", "display_name"),
                      ["market", "product_id"], "left")


def campaign(rows: DataFrame, profiles: DataFrame, products: DataFrame,
             vendor: str | None = None) -> DataFrame:
    """Conversion campaigns; rows with a blank ROAS or a blank name are not campaigns."""
    filled = rows.where("kind = 'campaign'").where(
        ~is_blank(value(fixed.ROAS)["s"]) & ~is_blank(value("Campaign name")["s"]))
    mapped = with_product(filled, profiles, value("Campaign name")["s"])
    facts = typed(mapped, "campaign", ["product_id", "match_status"], vendor)
    return facts.join(products.select("market", "product_id", "idx"),
                      ["market", "product_id"], "left")


def creative(rows: DataFrame, profiles: DataFrame, products: DataFrame,
             vendor: str | None = None) -> DataFrame:
    """The pinned creative of each product; ``campaign_product`` is where it really belongs."""
    ads = rows.where("kind = 'creative'").withColumn("norm_pin",
                                                     normalize_text(value("Ads")["s"]))
    pinned = ads.join(products.select("market", "norm_pin", F.col("product_id").alias("pin_for"),
                                      "idx"), ["market", "norm_pin"])
    mapped = with_product(pinned, profiles, value("Campaign name")["s"]) \
        .withColumnRenamed("product_id", "campaign_product") \
        .withColumnRenamed("pin_for", "product_id")
    return typed(mapped, "creative", ["product_id", "campaign_product", "match_status", "idx"],
                 vendor)


def creative_issues(facts: DataFrame, bundles: DataFrame, products: DataFrame) -> DataFrame:
    counts = facts.groupBy(*KEY, "product_id").agg(F.count("*").alias("n"))
    expected = bundles.select(*KEY).join(products.select("market", "product_id"), "market")
    wrong = expected.join(counts, [*KEY, "product_id"], "left").where("n is null or n <> 1")
    path = F.concat(F.lit("creative."), F.col("product_id"))
    astray = facts.where("not (campaign_product <=> product_id)")
    return (bad_values(facts, "creative")
            .unionByName(issue(wrong, "ERROR", "CREATIVE_PIN_COUNT", path,
                               actual=F.coalesce("n", F.lit(0)), expected=F.lit(1)))
            .unionByName(issue(astray, "ERROR", "CREATIVE_PIN_PRODUCT", path,
                               actual=F.col("campaign_product"), expected=F.col("product_id"))))


def _by_name(rows, profiles, kind, section, header):
    mapped = with_product(rows.where(F.col("kind") == kind), profiles, value(header)["s"])
    facts = typed(mapped, section, ["product_id", "match_status"])
    return positions(facts, KEY, F.floor(F.col("row_no") / 4096), ["row_no"])


def traffic(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Traffic campaigns in file order; purchases and adds to cart may be blank."""
    return _by_name(rows, profiles, "traffic_campaign", "traffic", "Campaign name")


def audience(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    return _by_name(rows, profiles, "audience", "audience", "Ad Set Name")


def top_keywords(rows: DataFrame, n: Column, by: list[str], score: str, order: str) -> DataFrame:
    """The first ``n`` rows of each group by score, ties in row order, with their rank.

    The rank filter becomes a group limit ahead of the shuffle, so a huge group sends at most
    ``limit`` rows per task.
    """
    window = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(order))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def keywords(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Top keywords of each bundle. Limits lie between 1 and
    ``fixed.KEYWORD_LIMIT``; a profile off that range is an error of its bundles."""
    words = rows.where("kind = 'keyword'").select(
        *ROW, "values", parse_number(value("Conversions")["s"], value("Conversions")["t"])
        .alias("_conversions"))
    window = W.partitionBy(*KEY).orderBy(F.col("_conversions").desc(), "row_no")
    best = words.withColumn("rank", F.row_number().over(window).cast("bigint")).where(
        f"rank <= {fixed.KEYWORD_LIMIT}")
    best = best.join(profiles.select("market", "keyword_top_n"), "market").where(
        "rank <= keyword_top_n")
    return typed(best, "keywords", ["rank"])


def keyword_issues(rows: DataFrame, top: DataFrame, bundles: DataFrame,
                   profiles: DataFrame) -> DataFrame:
    """Conversions must be readable in every row, and enough rows must exist."""
    words = rows.where("kind = 'keyword'")
    unread = words.where(parse_number(value("Conversions")["s"],
                                      value("Conversions")["t"]).isNull())
    n = words.groupBy(*KEY).agg(F.count("*").alias("n"))
    short = bundles.select(*KEY).join(profiles.select("market", "keyword_top_n"), "market") \
        .join(n, KEY, "left").where("coalesce(n, 0) < keyword_top_n")
    return (bad_values(top.where("not array_contains(bad_fields, 'conversions')"), "keyword")
            .unionByName(issue(unread, "ERROR", "UNREADABLE_VALUE",
                               F.concat(F.lit("keyword.row_"), F.col("row_no").cast("string"),
                                        F.lit(".conversions"))))
            .unionByName(issue(short, "ERROR", "TOO_FEW_KEYWORDS", "keyword",
                               actual=F.coalesce("n", F.lit(0)),
                               expected=F.col("keyword_top_n"))))


def build_facts(found: dict[str, DataFrame], profiles: DataFrame, vendor: str | None = None
                ) -> dict[str, DataFrame]:
    """All eight sections from recognised rows; ``vendor`` names one more accepted header."""
    rows, products = found["rows"], dim_product(profiles)
    return {"overall": overall(rows, found["tables"]), "daily": daily(rows),
            "summary": summary(rows, profiles, products),
            "campaign": campaign(rows, profiles, products, vendor),
            "creative": creative(rows, profiles, products, vendor),
            "traffic": traffic(rows, profiles), "audience": audience(rows, profiles),
            "keywords": keywords(rows, profiles)}


def reading_issues(found: dict[str, DataFrame], facts: dict[str, DataFrame],
                   profiles: DataFrame) -> DataFrame:
    """What went wrong between raw rows and facts. Pass facts that are already written."""
    bundles = found["per_kind"].select(*KEY).distinct()
    products = dim_product(profiles)
    parts = [found["issues"], overall_issues(facts["overall"], bundles),
             bad_values(facts["daily"], "by_day"),
             creative_issues(facts["creative"], bundles, products),
             keyword_issues(found["rows"], facts["keywords"], bundles, profiles)]
    for section in ("summary", "campaign", "traffic", "audience"):
        parts.append(bad_values(facts[section], section))
        parts.append(cover_issues(facts[section], bundles, products, section))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues.select(*KEY, *FIELDS)
