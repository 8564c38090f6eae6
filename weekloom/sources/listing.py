"""Folder listings, file digests and configuration checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.text import casefold, strip


def triage(listing: DataFrame) -> DataFrame:
    """Why each listed file is ignored, or ``candidate``.

    ``listing(root, path, is_symlink, is_file)`` holds relative paths. A hidden or system folder
    hides all below it and counts once, so its files share the path of that folder.
    """
    c = F.col
    hidden_dir = F.regexp_extract("path", r"\A((?:[^/]+/)*?(?:\.[^/]*|__MACOSX)/)", 1)
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)\z", 1))
    reason = (F.when(c("hidden_dir") != "", "hidden_or_system")
              .when(c("name").startswith("."), "hidden_or_system")
              .when(c("name").startswith("~$") | F.lower("name").endswith(".tmp"), "temporary")
              .when(c("is_symlink"), "symbolic_link")
              .when(~c("suffix").isin(fixed.SOURCE_SUFFIXES), "unsupported_extension")
              .when(~c("is_file"), "not_regular_file").otherwise("candidate"))
    return (listing.withColumns({"hidden_dir": hidden_dir, "name": name, "suffix": suffix})
            .withColumn("reason", reason)
            .withColumn("counted_as", F.when(c("hidden_dir") != "", c("hidden_dir"))
                        .otherwise(c("path"))))


def triage_counts(triaged: DataFrame) -> DataFrame:
    once = triaged.select("root", "reason", "counted_as").distinct()
    return once.groupBy("root", "reason").agg(F.count("*").alias("n"))


def too_many_candidates(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("reason") == "candidate")
                        & (F.col("n") > fixed.MAX_CANDIDATE_FILES))


def file_digests(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def source_set_digest(files: DataFrame, by: list[str]) -> DataFrame:
    """Digest of a complete set: kind, path and raw digest of each file in kind order.

    ``files(by, kind, path, sha256)`` holds one file per kind, so eight per set.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in fixed.KINDS]), F.col("kind"))
    nul = F.lit(b"\x00")
    part = F.concat(F.encode("kind", "UTF-8"), nul, F.encode("path", "UTF-8"), nul,
                    F.unhex("sha256"))
    kinds = F.col("kind").isin(fixed.KINDS)
    flags = [F.count_if(F.col("kind") == k).alias(f"_{i}") for i, k in enumerate(fixed.KINDS)]
    # counted first, so that only sets of eight files are ever collected
    counts = files.groupBy(*by).agg(*flags, F.count_if(~kinds | F.col("kind").isNull())
                                    .alias("_more"))
    complete = counts.where(" and ".join(
        [f"_{i} = 1" for i in range(len(fixed.KINDS))] + ["_more = 0"])).select(*by)
    sets = files.join(complete, by, "left_semi").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("i"), part.alias("part")))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    return sets.select(*by, F.sha2(whole, 256).alias("digest"))


def config_problems(products: DataFrame, settings: DataFrame) -> DataFrame:
    """(profile, problem, value): repeated product ids or pins, and a keyword count off limits."""
    def twice(df, value, problem):
        return (df.groupBy("profile", value.alias("value")).agg(F.count("*").alias("n"))
                .where("n > 1").select("profile", F.lit(problem).alias("problem"), "value"))

    pin = strip(casefold(F.col("creative_pin")))
    off = settings.where(f"keyword_top_n < 1 or keyword_top_n > {fixed.KEYWORD_LIMIT}").select(
        "profile", F.lit("keyword_top_n").alias("problem"),
        F.col("keyword_top_n").cast("string").alias("value"))
    return (twice(products, F.col("id"), "duplicate_product_id")
            .unionByName(twice(products.withColumn("pin", pin), F.col("pin"),
                               "duplicate_creative_pin"))
            .unionByName(off))
