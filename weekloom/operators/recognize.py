"""From raw rows to classified source tables.

Raw rows carry ``(key, file, sheet, row_no, cells array<struct<s,t>>)``; ``s`` is the text of
the cell and ``t`` its origin (s text, n number, b boolean, d date, null).
"""

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.functions.numbers import parse_date
from weekloom.functions.text import (SPACE, nfkc_casefold, normalize_header, squeeze,
                                     strip)
from weekloom.issues import issue
from weekloom.session import cut

SHEET = [*KEY, "file", "sheet"]
MARK = "\x02"


def header_key(text: str) -> str:
    """The normalised form of a header known in advance."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def header_line(headers: Column) -> Column:
    """All headers of a row, normalised and joined into one text with a mark around each."""
    safe = F.transform(headers, lambda h: F.translate(F.coalesce(h, F.lit("")), MARK, "?"))
    line = squeeze(F.regexp_replace(nfkc_casefold(F.concat_ws(MARK, safe)), r"\x{feff}", ""))
    bare = F.regexp_replace(F.concat(F.lit(MARK), line, F.lit(MARK)), f" ?{MARK} ?", MARK)
    return bare


def header_array(line: Column) -> Column:
    return F.split(line.substr(F.lit(2), F.length(line) - 2), MARK)


def blank_cell(cell: Column) -> Column:
    return cell["s"].isNull() | ~cell["s"].rlike(f"[^{SPACE}]")


#: headers that the kind with the fewest requires; each needs a cell of its own
FEWEST_HEADERS = min(len({header_key(h) for h in hs}) for hs in fixed.FINGERPRINTS.values())


def matched_kinds(line: Column) -> Column:
    """Kinds whose required headers all occur in a header line (a column, not an expression:
    it is searched once per required header)."""
    def has_all(headers):
        tests = [line.contains(f"{MARK}{header_key(h)}{MARK}") for h in headers]
        both = tests[0]
        for test in tests[1:]:
            both = both & test
        return both

    return F.array_compact(F.array(*[
        F.when(has_all(headers), kind) for kind, headers in fixed.FINGERPRINTS.items()]))


def trim_blank_tail(raw: DataFrame) -> DataFrame:
    """Drop everything after the first run of 100 blank rows in a workbook sheet.

    A run never fits between two filled rows of the same block of 100, so one row per block
    is enough to find it; blocks are pre-aggregated before the window.
    """
    return raw.join(blank_tail(raw), SHEET, "left").where(
        F.col("cutoff").isNull() | (F.col("row_no") <= F.col("cutoff"))).drop("cutoff")


def blank_tail(raw: DataFrame) -> DataFrame:
    """(sheet, cutoff): last row read of each sheet that has a long blank run."""
    from pyspark.sql import Window as W

    size = fixed.BLANK_TAIL_ROWS
    filled = raw.where(F.exists("cells", lambda c: ~blank_cell(c)))
    blocks = (filled.groupBy(*SHEET, F.floor((F.col("row_no") - 1) / size).alias("block"))
              .agg(F.min("row_no").alias("low"), F.max("row_no").alias("high")))
    before = F.lag("high", 1, 0).over(W.partitionBy(*SHEET).orderBy("block"))
    runs = blocks.withColumn("before", before).where(F.col("low") - F.col("before") > size)
    return runs.groupBy(*SHEET).agg((F.min("before") + size).alias("cutoff"))


def header_rows(raw: DataFrame) -> DataFrame:
    """The first row of each sheet, within the scan limit, that classifies as one kind."""
    probe = raw.where((F.col("row_no") <= fixed.HEADER_SCAN_ROWS)
                      & (F.size(F.filter("cells", lambda c: ~blank_cell(c))) >= FEWEST_HEADERS))
    probe = probe.withColumn("line", header_line(F.transform("cells", lambda c: c["s"])))
    probe = probe.withColumn("kinds", matched_kinds(F.col("line")))
    # chosen inside the aggregate: a filter here would be pushed below and search each row twice
    found = probe.groupBy(*SHEET).agg(F.min_by(
        F.struct("row_no", "kinds", "cells", "line"),
        F.when(F.size("kinds") == 1, F.col("row_no"))).alias("h")).where("h is not null")
    return found.select(*SHEET, F.col("h.row_no").alias("header_row"),
                        F.col("h.kinds")[0].alias("kind"),
                        F.col("h.cells").alias("header_cells"),
                        header_array(F.col("h.line")).alias("normalized"))


def table_headers(heads: DataFrame) -> DataFrame:
    """Cut trailing blank headers, name inner blank ones, and flag duplicates."""
    filled = F.transform(F.col("header_cells"), lambda c: ~blank_cell(c))
    width = F.size(filled) - F.array_position(F.reverse(filled), True).cast("int") + 1
    heads = heads.withColumn("width", width)
    cells = F.slice("header_cells", F.lit(1), F.col("width"))
    headers = F.transform(cells, lambda c, i: F.when(
        blank_cell(c), F.concat(F.lit("__blank_"), (i + 1).cast("string")))
        .otherwise(strip(c["s"])))
    heads = heads.withColumn("headers", headers)
    keys = F.transform(F.slice("normalized", F.lit(1), F.col("width")), lambda n, i: F.when(
        n == "", F.concat(F.lit("__blank_"), (i + 1).cast("string"))).otherwise(n))
    heads = heads.withColumn("header_keys", keys)
    return heads.withColumn(
        "duplicate_headers", F.size(F.array_distinct("header_keys")) < F.col("width")) \
        .drop("header_cells", "normalized")


def table_rows(raw: DataFrame, heads: DataFrame) -> DataFrame:
    """Data rows below the header as ``values map<header key, struct<s,t,col,header>>``."""
    heads = heads.where(~F.col("duplicate_headers"))
    rows = raw.join(heads, SHEET).where(F.col("row_no") > F.col("header_row"))
    absent = F.lit(None).cast("struct<s:string,t:string>")
    padded = F.slice(F.concat("cells", F.array_repeat(absent, F.col("width"))),
                     F.lit(1), F.col("width"))
    rows = rows.withColumn("cells", padded).where(
        F.exists("cells", lambda c: ~F.coalesce(blank_cell(c), F.lit(True))))
    cells = F.transform("cells", lambda c, i: F.struct(
        c["s"].alias("s"), c["t"].alias("t"), (i + 1).alias("col"),
        F.element_at("headers", i + 1).alias("header")))
    return rows.select(*SHEET, "kind", "row_no",
                       F.map_from_arrays("header_keys", cells).alias("values"))


def value(header: str | None) -> Column:
    """The cell under a header, found by its normalised text; null when absent."""
    return F.try_element_at("values", F.lit(header_key(header)))


def average_value_cell(vendor: str | None = None) -> Column:
    """The cell under the first accepted average-value header that the row's table has."""
    names = list(fixed.AVERAGE_VALUE_HEADERS)
    if vendor:
        names.append(fixed.VENDOR_AVERAGE_VALUE_HEADER.format(vendor=vendor))
    return F.coalesce(*[value(n) for n in names])


def source_tables(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per classified sheet with row count and declared period."""
    start, end = value(fixed.START_HEADER), value(fixed.END_HEADER)
    both = start.isNotNull() & end.isNotNull()
    spans = rows.groupBy(*SHEET).agg(
        F.count("*").alias("n_rows"),
        F.min(F.when(both, parse_date(start["s"]))).alias("source_start"),
        F.max(F.when(both, parse_date(end["s"]))).alias("source_end"))
    return heads.join(spans, SHEET, "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0)))


def file_status(raw_files: DataFrame, tables: DataFrame) -> DataFrame:
    """Each file with the number of usable sheets; a usable file has exactly one."""
    per_file = tables.groupBy(*KEY, "file").agg(
        F.count("*").alias("n_tables"),
        F.count_if(F.col("duplicate_headers")).alias("n_duplicate"),
        F.min("kind").alias("kind"), F.sum("n_rows").alias("n_rows"))
    return raw_files.join(per_file, [*KEY, "file"], "left").withColumn(
        "recognized", F.coalesce((F.col("n_tables") == 1) & (F.col("n_duplicate") == 0)
                                 & (F.col("n_rows") > 0), F.lit(False)))


def completeness(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """(key, kind, n_files): every bundle against all eight kinds, zero where missing."""
    counted = files.groupBy(*KEY, "kind").agg(
        F.count("*").alias("n_files"), F.min("file").alias("file"))
    kinds = F.posexplode(F.array(*[F.lit(k) for k in fixed.KINDS])).alias("ord", "kind")
    return (bundles.select(*KEY, kinds).join(counted, [*KEY, "kind"], "left")
            .withColumn("n_files", F.coalesce("n_files", F.lit(0))))


def bundle_summary(per_kind: DataFrame) -> DataFrame:
    """Missing and duplicate kinds of each bundle, in fingerprint order."""
    names = lambda cond: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(
        F.when(cond, F.struct("ord", "kind")))), lambda s: s["kind"]))
    return per_kind.groupBy(*KEY).agg(
        names(F.col("n_files") == 0).alias("missing"),
        names(F.col("n_files") > 1).alias("duplicates"),
        F.count_if(F.col("n_files") == 1).alias("selected"),
        (F.count_if(F.col("n_files") == 1) == len(fixed.KINDS)).alias("complete"))


def completeness_issues(per_kind: DataFrame) -> DataFrame:
    return issue(per_kind.where("n_files <> 1"), "ERROR",
                 F.when(F.col("n_files") == 0, "MISSING_SOURCE").otherwise("DUPLICATE_SOURCE"),
                 F.concat(F.lit("sources."), F.col("kind")),
                 actual=F.col("n_files"), expected=F.lit(1))


def recognize(raw: DataFrame) -> dict[str, DataFrame]:
    """Classify every file, keep the one table of each kind, and list what is wrong."""
    # each stage is read by several later ones, so it is written once
    heads = cut(table_headers(header_rows(raw)))
    rows = table_rows(raw, heads)
    tables = cut(source_tables(heads, rows))
    files = file_status(raw.select(*KEY, "file").distinct(), tables)
    good = files.where("recognized").select(*KEY, "file", "kind")
    per_kind = cut(completeness(raw.select(*KEY).distinct(), good))
    chosen = per_kind.where("n_files = 1").select(*KEY, "kind", "file")
    pick = lambda df: df.join(chosen, [*KEY, "kind", "file"], "left_semi")
    # only rows that count are written, apart by kind: a section reads its own kind and no other
    return {"heads": heads, "tables": cut(pick(tables)), "rows": cut(pick(rows), by="kind"),
            "files": files, "per_kind": per_kind, "issues": completeness_issues(per_kind)}


def bundle_period(tables: DataFrame) -> DataFrame:
    """Whether all dated sources of a bundle declare the same period."""
    span = F.struct("source_start", "source_end")
    lacking = F.col("source_start").isNull() | F.col("source_end").isNull()
    return tables.where("kind <> 'keyword'").groupBy(*KEY).agg(
        F.count_if(lacking).alias("undated"), F.count_distinct(span).alias("periods"),
        (F.bool_and(~lacking) & (F.min(span) == F.max(span))).alias("agreed"))


def match_profiles(names: DataFrame, ads: DataFrame, profiles: DataFrame) -> DataFrame:
    """(key, profile, matched): profiles whose products and pins a bundle carries exactly.

    ``names(key, profile, text)`` holds product names and ``ads(key, profile, text)`` creative
    names, both already paired with the profiles that might apply.
    """
    from weekloom.operators.facts import alias_match

    listed = profiles.select("profile", "products")
    named = names.join(listed, "profile").withColumn(
        "hit", alias_match(F.col("normalized"), F.col("products")))
    # one count per product first, so that no list of matched names is ever collected
    counts = named.groupBy(*KEY, "profile", "hit.product_id").agg(F.count("*").alias("n"))
    covered = counts.groupBy(*KEY, "profile").agg(
        F.bool_and(F.col("product_id").isNotNull() & (F.col("n") == 1)).alias("one_each"),
        F.count("product_id").alias("n_products"))
    pins = listed.select("profile", F.size("products").alias("size"),
                         F.explode("products").alias("product"))
    pins = pins.select("profile", "size",
                       normalize_header(F.col("product.creative_pin")).alias("pin"))
    pinned = (ads.join(pins, (ads["profile"] == pins["profile"])
                       & (ads["normalized"] == pins["pin"])).drop(pins["profile"])
              .groupBy(*KEY, "profile", "pin").agg(F.count("*").alias("n"))
              .groupBy(*KEY, "profile").agg(F.count_if(F.col("n") == 1).alias("n_pins")))
    size = listed.select("profile", F.size("products").alias("size"))
    return (covered.join(pinned, [*KEY, "profile"], "left").join(size, "profile")
            .select(*KEY, "profile",
                    (F.col("one_each") & (F.col("n_products") == F.col("size"))
                     & (F.coalesce("n_pins", F.lit(0)) == F.col("size"))).alias("matched")))


