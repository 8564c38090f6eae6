"""Fail-closed discovery: every listed file ends in one row that says what became of it, and the
bundles of a job are those of the listing, whether or not anything in them could be read.

A listing has (bundle_id, file, path, length, is_symlink, is_file); ``file`` is relative to the
bundle. Frames of bytes have (path, content).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.issues import FIELDS, issue
from weekloom.operators import recognize as R
from weekloom.session import cut
from weekloom.sources import listing as L
from weekloom.sources import readers

PENDING = {"market": "", "period_start": "1970-01-01", "period_end": "1970-01-01"}
LEVEL = "\x1f"
NOT_CLASSIFIED = "unrecognized_source"


def qualified(spark: SparkSession, path: str) -> str:
    """The folder as the file system names it, so that listed paths begin with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toString().rstrip("/")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: the first folder below it is the bundle, and an archive one of its
    own. Only names and sizes are read. Spark itself leaves out names that begin with a dot or
    an underscore; a listing from elsewhere may hold them."""
    root = qualified(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = F.col("path")
    below = F.substring(full, F.lit(len(root) + 2), F.length(full))
    folder = F.when(below.contains("/"), F.concat(F.lit(root + "/"), F.substring_index(
        below, "/", 1))).otherwise(F.lit(root))
    archive = is_archive(full)
    return files.select(
        F.when(archive, full).otherwise(folder).alias("bundle_id"),
        F.when(archive, F.substring_index(full, "/", -1)).otherwise(F.substring(
            full, F.length(folder) + 2, F.length(full))).alias("file"),
        "path", "length", F.lit(False).alias("is_symlink"), F.lit(True).alias("is_file"))


def is_archive(path: Column) -> Column:
    return F.lower(path).endswith(".zip")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file up to the size limits; larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    most = F.when(is_archive(F.col("path")), fixed.MAX_ARCHIVE_BYTES).otherwise(
        fixed.MAX_SOURCE_BYTES)
    return files.where((F.col("length") <= fixed.MAX_ARCHIVE_BYTES) & (F.col("length") <= most)
                       ).select("path", "content")


def triaged(listing: DataFrame) -> DataFrame:
    """The listing with ``reason`` and ``detail``: null for what is to be decoded.

    A bundle with more candidates than the limit has none decoded. Archives are bundles of their
    own and stay out of the count.
    """
    plain = L.triage(listing.where(~is_archive(F.col("file"))).withColumnsRenamed(
        {"bundle_id": "root", "path": "full_path", "file": "path"})).withColumnsRenamed(
        {"root": "bundle_id", "path": "file", "full_path": "path"})
    crowds = plain.where("reason = 'candidate'").groupBy("bundle_id").agg(
        F.count("*").alias("n")).where(F.col("n") > fixed.MAX_CANDIDATE_FILES)
    marked = plain.join(crowds, "bundle_id", "left").withColumn("big", (
        F.col("reason") == "candidate") & (F.col("length") > fixed.MAX_SOURCE_BYTES))
    candidate = F.col("reason") == "candidate"
    left = marked.select(
        *listing.columns, "counted_as",
        F.when(candidate & F.col("n").isNotNull(), "too_many_candidates")
        .when(F.col("big"), NOT_CLASSIFIED).when(~candidate, F.col("reason")).alias("reason"),
        F.when(candidate & F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(
            f" candidates, the limit is {fixed.MAX_CANDIDATE_FILES}")))
        .when(F.col("big"), "larger than the size limit").alias("detail"))
    large = F.col("length") > fixed.MAX_ARCHIVE_BYTES
    packed = listing.where(is_archive(F.col("file"))).select(
        *listing.columns, F.col("file").alias("counted_as"),
        F.when(F.col("is_symlink"), "symbolic_link").when(large, "unreadable_archive")
        .alias("reason"), F.when(large, "larger than the size limit").alias("detail"))
    return left.unionByName(packed)


def pending(df: DataFrame) -> DataFrame:
    """Rows under a key that says only which bundle they are of."""
    key = [F.col("bundle_id"), F.lit(PENDING["market"]).alias("market"),
           *[F.lit(PENDING[c]).cast("date").alias(c) for c in ("period_start", "period_end")]]
    return df.select(*key, *[c for c in df.columns if c not in KEY])


def provisional(rows: DataFrame) -> DataFrame:
    return pending(rows.select("bundle_id", "file", "sheet", "row_no", "cells"))


def classified(stream: DataFrame) -> DataFrame:
    """(bundle_id, file, kind, recognized, error) of every file record of a staged stream.

    A file is recognised when it was read whole and exactly one of its sheets is a table.
    """
    records = stream.where("record = 'file'").select("bundle_id", "file", "error")
    raw = provisional(stream.where("record = 'row'"))
    heads = cut(R.table_headers(R.header_rows(raw)))
    tables = R.source_tables(heads, R.table_rows(raw, heads))
    status = R.file_status(pending(records.select("bundle_id", "file")), tables)
    found = status.select("bundle_id", "file", "kind", "n_tables", "n_duplicate", "n_rows",
                          F.col("recognized").alias("usable"))
    why = (F.when(F.col("error").isNotNull(), F.col("error"))
           .when(F.col("n_tables").isNull(), "no sheet with the headers of one kind")
           .when(F.col("n_tables") > 1, "several sheets with the headers of a kind")
           .when(F.col("n_duplicate") > 0, "headers that occur twice")
           .when(F.col("n_rows") == 0, "no rows below the headers"))
    good = F.col("usable") & F.col("error").isNull()
    return records.join(found, ["bundle_id", "file"]).select(
        "bundle_id", "file", F.when(good, F.col("kind")).alias("kind"), good.alias("recognized"),
        F.when(~good, why).alias("error"))


def archive_levels(probes: DataFrame) -> DataFrame:
    """(bundle_id, nested, complete) of every level of every archive, from its header probes: a
    level is complete with one file of each kind and none that is anything else."""
    key = F.concat(F.col("bundle_id"), F.lit(LEVEL), F.coalesce("nested", F.lit("")))
    opened = probes.where("member is not null").withColumns({"bundle_id": key, "file": F.col("member")})
    files = classified(opened)
    one = [F.count_if(F.col("kind") == k) == 1 for k in fixed.KINDS]
    whole = F.count("*") == len(fixed.KINDS)
    for test in one:
        whole = whole & test
    levels = files.groupBy("bundle_id").agg(whole.alias("complete"))
    parts = F.split("bundle_id", LEVEL)
    found = levels.select(parts[0].alias("bundle_id"), F.when(parts[1] != "", parts[1])
                          .alias("nested"), "complete")
    shut = probes.where("member is null").select("bundle_id", "nested", F.lit(False)
                                                 .alias("complete"))
    return found.unionByName(shut)


def chosen_levels(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, nested) to decode of each archive, and (bundle_id, problem) of the others.

    ``archives`` has (bundle_id, content). Only header probes of all levels are decoded here.
    """
    probes = cut(readers.probe_archives(archives, ["bundle_id"]))
    choice = cut(archives.select("bundle_id").join(
        readers.choose_bundle(archive_levels(probes), ["bundle_id"]), "bundle_id", "left"))
    broken = probes.where("member is null and nested is null").select(
        "bundle_id", F.col("error").alias("why"))
    lost = choice.where("not coalesce(resolved, false)").join(broken, "bundle_id", "left").select(
        "bundle_id", F.when(F.col("why").isNotNull(), "unreadable_archive").otherwise(
            F.coalesce("problem", F.lit("no_bundle"))).alias("problem"), "why")
    return choice.where("resolved").select("bundle_id", "nested"), lost


def fingerprints(asked: DataFrame, content: DataFrame, context: str = "") -> DataFrame:
    """(bundle_id, files_sha256) of the bytes of each bundle, without decoding any.

    Candidates that are too large count by name and length. ``context`` stands for all else that
    decides on a result, such as the version of the profiles. Bundles above the candidate limit
    or with nothing to read have none. ``asked`` is a triaged listing.
    """
    of_file = asked.where(F.col("reason").isNull()).join(content, "path").select(
        "bundle_id", "file", F.sha2("content", 256).alias("d"))
    large = asked.where(F.col("reason").isin(NOT_CLASSIFIED)).select(
        "bundle_id", "file", F.col("length").cast("string").alias("d"))
    # the candidate limit bounds the list
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file", "d"))), lambda x: F.concat_ws(
        " ", x["file"], x["d"]))
    return of_file.unionByName(large).groupBy("bundle_id").agg(F.sha2(F.array_join(F.concat(
        F.array(F.lit(context)), lines), "\n"), 256).alias("files_sha256"))


def changed_bundles(prints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The bundles of ``prints`` whose bytes are not those of their last outcome."""
    known = outcomes.where("files_sha256 is not null").select("bundle_id", "files_sha256")
    return prints.join(known, ["bundle_id", "files_sha256"], "left_anti")


def decoded(asked: DataFrame, content: DataFrame) -> dict[str, DataFrame]:
    """Everything that is to be decoded, once: ``rows`` of readable files, ``files`` with one row
    per listed file (of a chosen archive: per member) and why it is left out, and ``archives``
    with the digest of each archive. ``asked`` is a triaged and staged listing."""
    open_ = asked.where("reason is null")
    bytes_of = open_.select("bundle_id", "file", "path").join(content, "path")
    packed = is_archive(F.col("file"))
    digest = F.sha2("content", 256).alias("sha256")
    plain = readers.decode_files(bytes_of.where(~packed).select(
        "bundle_id", "file", digest, "content"), ["bundle_id", "file", "sha256"])
    archives = bytes_of.where(packed).select("bundle_id", "content")
    levels, lost = chosen_levels(archives)
    inner = readers.decode_archives(archives.join(levels, "bundle_id"), ["bundle_id"])
    stream = cut(plain.unionByName(inner.select(
        "bundle_id", F.col("member").alias("file"), F.lit(None).cast("string").alias("sha256"),
        "record", "sheet", "row_no", "cells", "error", "n_rows")))
    found = cut(classified(stream))
    digests = stream.where("record = 'file'").select("bundle_id", "file", "sha256")
    # a file that was listed but has no record was not there any more when it was to be read
    gone = open_.where(~packed).select("bundle_id", "file").join(
        found.select("bundle_id", "file"), ["bundle_id", "file"], "left_anti")
    missing = gone.select("bundle_id", "file", F.lit(NOT_CLASSIFIED).alias("reason"), F.lit(
        "could not be read").alias("detail"))
    done = found.join(digests, ["bundle_id", "file"], "left").select(
        "bundle_id", "file", F.when(~F.col("recognized"), NOT_CLASSIFIED).alias("reason"),
        F.col("error").alias("detail"), "kind", "sha256")
    left = asked.where("reason is not null").select("bundle_id", "file", "reason", "detail",
                                                    "counted_as")
    shut = lost.select("bundle_id", F.substring_index("bundle_id", "/", -1).alias("file"),
                       F.col("problem").alias("reason"), F.col("why").alias("detail"))
    every = done
    for part in (left, missing, shut):
        every = every.unionByName(part, allowMissingColumns=True)
    files = cut(every.withColumn("counted_as", F.coalesce("counted_as", "file")))
    bad = files.where(F.col("reason").isNotNull()).select("bundle_id", "file")
    rows = stream.where("record = 'row'").select("bundle_id", "file", "sheet", "row_no", "cells")
    return {"rows": rows.join(bad, ["bundle_id", "file"], "left_anti"), "files": files,
            "bundles": cut(asked.select("bundle_id").distinct()),
            "archives": stream.where("record = 'archive'").select(
                "bundle_id", F.col("sheet").alias("sha256"))}


def reason_counts(files: DataFrame) -> DataFrame:
    """(bundle_id, reason, n): how many files each reason leaves out, those of a hidden folder
    once, and how many are classified."""
    once = files.select("bundle_id", F.coalesce("reason", F.lit("classified")).alias("reason"),
                        "counted_as").distinct()
    return once.groupBy("bundle_id", "reason").agg(F.count("*").alias("n"))


def bundle_digests(found: dict[str, DataFrame]) -> DataFrame:
    """(bundle_id, source_sha256): of a folder the digest of its complete set of files, of an
    archive that of the level that was used."""
    sets = L.source_set_digest(found["files"].where("kind is not null and sha256 is not null")
                               .select("bundle_id", "kind", F.col("file").alias("path"), "sha256"),
                               ["bundle_id"])
    return sets.withColumnRenamed("digest", "source_sha256").unionByName(
        found["archives"].withColumnRenamed("sha256", "source_sha256"))


def discovery_issues(found: dict[str, DataFrame]) -> DataFrame:
    """What discovery says against a bundle, under its pending key.

    A file that is no source of any kind is a warning: it may lie beside a complete set. Without
    a complete set the bundle fails, for each kind that is missing or found twice; so does one
    with too many candidates or an archive in which no level or several are complete.
    """
    of_file = pending(found["files"].where("reason is not null"))
    odd = of_file.where(F.col("reason").isin(NOT_CLASSIFIED))
    fatal = of_file.where(F.col("reason").isin(
        "too_many_candidates", "unreadable_archive", "no_bundle", "several_bundles"))
    path = F.concat(F.lit("files."), F.col("file"))
    crowd = fatal.where("reason = 'too_many_candidates'").groupBy(*KEY).agg(
        F.first("detail").alias("detail"))
    kinds = F.posexplode(F.array(*[F.lit(k) for k in fixed.KINDS])).alias("ord", "kind")
    counts = found["files"].where("kind is not null").groupBy("bundle_id", "kind").agg(
        F.count("*").alias("n_files"), F.array_sort(F.collect_list("file")).alias("paths"))
    sets = pending(found["bundles"]).select(*KEY, kinds).join(counts, ["bundle_id", "kind"], "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(0)))
    incomplete = issue(sets.where("n_files <> 1"), "ERROR", F.when(
        F.col("n_files") == 0, "MISSING_SOURCE").otherwise("DUPLICATE_SOURCE"),
        F.concat(F.lit("sources."), F.col("kind")), actual=F.col("n_files"), expected=F.lit(1),
        message=F.array_join("paths", ", "))
    return (issue(odd, "WARNING", "UNRECOGNIZED_SOURCE", path, message=F.col("detail"))
            .unionByName(issue(fatal.where("reason <> 'too_many_candidates'"), "ERROR",
                               "ARCHIVE_NOT_RESOLVED", path, actual=F.col("reason"),
                               message=F.col("detail")))
            .unionByName(issue(crowd, "ERROR", "TOO_MANY_CANDIDATES", "files",
                               message=F.col("detail")))
            .unionByName(incomplete).select(*KEY, *FIELDS))
