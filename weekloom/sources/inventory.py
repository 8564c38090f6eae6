"""Digests of files and of the members of archives, kept up to date by path, length and time.

An inventory has (path, length, modified, member, sha256, problem): one row per file with a null
member, and for an archive one per member too. Only files that are new, or whose length or time
is another one, are read; the rows of all others are taken over as they are.
"""

import hashlib
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.sources import readers

STAMP = ["path", "length", "modified"]
INVENTORY = ("path string, length bigint, modified timestamp, member string, sha256 string, "
             "problem string")
MEMBERS = "member string,sha256 string,problem string"
CHUNK = 1 << 20


def _digests(payload: bytes):
    """The members of an archive with the digest of each; its bytes are read piece by piece."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(payload))
    except zipfile.BadZipFile as error:
        yield (None, None, f"not a readable archive: {error}")
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            digest = hashlib.sha256()
            try:
                with archive.open(info) as stream:
                    while piece := stream.read(CHUNK):
                        digest.update(piece)
            except Exception as error:  # an encrypted or broken member is listed, not lost
                yield (info.filename, None, f"{type(error).__name__}: {error}"[:1000])
                continue
            yield (info.filename, digest.hexdigest(), None)


def scanned(files: DataFrame) -> DataFrame:
    """The inventory of ``files(path, length, modified, content)``."""
    none = F.lit(None).cast("string")
    whole = files.select(*STAMP, none.alias("member"), F.sha2("content", 256).alias("sha256"),
                         none.alias("problem"))
    packed = files.where(F.lower("path").endswith(".zip"))
    members = readers.decode_rows(packed, STAMP, _digests, MEMBERS, ["member", "sha256", "problem"])
    return whole.unionByName(members)


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """The listed files (path, length, modified) that the inventory does not hold as they are."""
    return listing.join(known.where("member is null").select(*STAMP), STAMP, "left_anti")


def updated(listing: DataFrame, content: DataFrame, known: DataFrame) -> DataFrame:
    """The inventory of a listing: rows of unchanged files as known, the others read anew; files
    that are not listed any more have no rows. ``content`` has (path, content)."""
    fresh = changed(listing, known).join(content, "path")
    kept = known.join(listing.select(*STAMP), STAMP, "left_semi")
    return kept.unionByName(scanned(fresh.select(*STAMP, "content")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, member, status) of everything that was added, removed or has other bytes."""
    side = lambda df, name: df.select(
        "path", F.coalesce("member", F.lit("")).alias("member"),
        F.coalesce("sha256", F.concat(F.lit("!"), "problem")).alias(name))
    both = side(before, "old").join(side(after, "new"), ["path", "member"], "full")
    status = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
              .when(F.col("old") != F.col("new"), "changed"))
    return both.select("path", F.nullif("member", F.lit("")).alias("member"),
                       status.alias("status")).where("status is not null")
