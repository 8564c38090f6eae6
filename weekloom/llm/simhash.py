"""SimHash near-dedup by segment popcounts.

A fingerprint's 64 bits are cut into 32 segments; the vector of their bit counts fits one long.
Fingerprints that differ in d bits have count vectors at a Manhattan distance of d at most, so
vectors within 2 are all that can link. Two vectors within 2 have a common grid cell within 1 of
each; every fingerprint therefore enters its own cell and the cells one step away, and meets its
candidates there. Candidates are verified on the exact bits.

Equal fingerprints are one class before anything is joined. In a cell of more than ``CELL``
fingerprints, pairs are not made: its members enter one key for each fingerprint within one bit,
and all members of such a key are within 2 bits of each other, so a star of links is exact.

The pipeline's stage (``keep_one``) has another bound, five-word shingles and an exact Jaccard
likeness of 0.8. Its fingerprints have 256 bits, and the first 64 go to the same grid. At 0.8 these
differ by 10 bits with a deviation of 3, and no grid of segment counts tells 18 bits from the 32 of
unrelated texts; so what the grid cannot hold is found by shared smallest shingle hashes.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like
any other; repeated rows share their class; null ids are left out of the least id (a class of
null ids only has a null component); further columns are not looked at; an empty table gives an
empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import (
    documents,
    schema_after,
    scratch,
    stage,
    text_key,
    through_python,
)
from weekloom.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
CELL = 32
PAIRS_OF_BITS = 0x5555555555555555
BLOCK = 1 << 14
#: the pipeline's stage has values of its own
STAGE_SHINGLE = 5
SIMILAR = 0.8
LEAST = 8
STAGE_BITS = 72
BLOCK_SETS = 512
BLOCK_BYTES = 1 << 23
COLUMNS = 1 << 15
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                   0xD6E8FEB86659FD93], np.uint64)


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of a text's three-word shingles, as a signed long."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    hashed = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = hashed[k:k + BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) of every document, and further columns as they are."""
    kept = ["doc_id", *more]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(
                    [fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())],
                [*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(run, schema_after(docs, kept, "fp long"))


def segment_counts(fp: Column) -> Column:
    """Bit counts (0 to 2) of the 32 two-bit segments, two bits each."""
    mask = F.lit(PAIRS_OF_BITS)
    low, high = fp.bitwiseAND(mask), F.shiftrightunsigned(fp, 1).bitwiseAND(mask)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint at its own count vector and at those one step away."""
    place = F.greatest(2 * F.abs("k") - 2, F.lit(0))
    digit = F.call_function("shiftrightunsigned", F.col("v"), place).bitwiseAND(F.lit(3))
    spread = fps.select("fp", segment_counts(F.col("fp")).alias("v"),
                        F.explode(F.sequence(F.lit(-32), F.lit(32))).alias("k"))
    # counts stay from 0 to 2
    inside = (F.col("k") == 0) | ((F.col("k") > 0) & (digit < 2)) | ((F.col("k") < 0) & (digit > 0))
    change = digit.bitwiseXOR(digit + F.signum("k").cast("long"))
    moved = F.when(F.col("k") == 0, F.col("v")).otherwise(
        F.col("v").bitwiseXOR(F.call_function("shiftleft", change, place)))
    return spread.where(inside).select(moved.alias("cell"), "fp")


def links(fps: DataFrame, max_cell: int = CELL) -> DataFrame:
    """(a, b): links between fingerprints of at most two differing bits, enough to connect all
    that link, with a < b. ``fps`` has each fingerprint once."""
    shared = stage(cells(fps).withColumn("n", F.count("*").over(W.partitionBy("cell")))
                   .where(F.col("n") > 1), "cells")
    small = shared.where(F.col("n") <= max_cell)
    other = small.select(F.col("cell").alias("o_cell"), F.col("fp").alias("b"))
    pairs = small.join(other, (F.col("cell") == F.col("o_cell")) & (F.col("fp") < F.col("b"))
                       & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    crowded = shared.where(F.col("n") > max_cell).select("fp").distinct()
    one = F.lit(1).cast("long")
    flips = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", one, i))))
    near = crowded.select("fp", flips.alias("bit")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("middle"))
    star = near.withColumn("b", F.min("fp").over(W.partitionBy("middle")))
    return (pairs.select(F.col("fp").alias("a"), "b").unionByName(
        star.select(F.col("b").alias("a"), F.col("fp").alias("b")))
        .where(F.col("a") != F.col("b")).distinct())


def grouped(own: DataFrame) -> DataFrame:
    """(c_fp, component_id, root, n_docs) of each fingerprint of a staged (doc_id, fp) table."""
    classes = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                          F.count("*").alias("n_docs")), "classes")
    roots = components(links(classes.select("fp")))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "n_docs", F.coalesce("root", "fp").alias("root"))
    tops = joined.groupBy("root").agg(F.min("least").alias("component_id"),
                                      F.sum("n_docs").alias("n_docs"))
    return stage(joined.select("fp", "root").join(tops, "root").select(
        F.col("fp").alias("c_fp"), "component_id", "root", "n_docs"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, n_docs): every document with the least id of its group."""
    own = stage(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    return own.join(grouped(own), F.col("fp") == F.col("c_fp")).drop("c_fp", "root")


def word_shingles(text: str | None, width: int = STAGE_SHINGLE) -> set[bytes]:
    """Distinct runs of ``width`` words; a shorter text is one run, one without words has none."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k:k + width]) for k in range(len(words) - width + 1)}


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    from xxhash import xxh64_intdigest

    own = word_shingles(text)
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in own), "<u8", len(own)))


def sketch(text: str | None) -> tuple[int, int, list[int], list[int]]:
    """(hash of the shingle set, its size, its ``LEAST`` smallest hashes, fingerprint as four
    longs)."""
    from xxhash import xxh3_64_intdigest

    hashed = shingle_hashes(text)
    if not len(hashed):
        return 0, 0, [], [0] * len(MIXERS)
    whole = int(np.uint64(xxh3_64_intdigest(hashed.tobytes())).view(np.int64))
    votes = np.zeros(64 * len(MIXERS), np.int64)
    for k in range(0, len(hashed), BLOCK):
        part = hashed[k:k + BLOCK, None] * MIXERS
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(29)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1,
                             bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    fp = np.packbits(votes * 2 > len(hashed), bitorder="little").view("<i8")
    return whole, len(hashed), hashed[:LEAST].view("<i8").tolist(), fp.tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s, n, keys, fp): the sketch of every document; n counts its shingles."""
    def run(batches):
        for batch in batches:
            found = [sketch(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"),
                 *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["doc_id", "key", "s", "n", "keys", "fp"])

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    return through_python(rows, run, schema_after(
        rows, ["doc_id", "key"], "s long, n long, keys array<long>, fp array<long>"))


def bits_apart(x: str, y: str) -> Column:
    parts = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(len(MIXERS))]
    return sum(parts[1:], parts[0])


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, member) that connect what a symmetric matrix connects; at most n - 1."""
    seen, links = np.zeros(len(near), bool), []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            new = near[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(new).tolist()
            links += [(root, k) for k in front]
    return links


def near_bits(rows: list[dict]) -> np.ndarray:
    """Which fingerprints and sizes of rows allow a link."""
    fps = np.array([r["fp"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows], np.int64)
    apart = np.zeros((len(rows), len(rows)), np.int64)
    for k in range(fps.shape[1]):
        # unsigned, as signed values are counted by their size
        apart += np.bitwise_count((fps[:, None, k] ^ fps[None, :, k]).view(np.uint64))
    return (apart <= STAGE_BITS) & (np.minimum.outer(n, n) >= SIMILAR * np.maximum.outer(n, n))


def similar(rows: list[dict]) -> np.ndarray:
    """Which shingle sets of rows have a Jaccard likeness of ``SIMILAR`` or more, exactly."""
    sets = [np.frombuffer(r["h"], "<u8") for r in rows]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # only what two sets hold can be shared
    several = count > 1
    place = np.cumsum(several) - 1
    held = several[column]
    owner, column = owner[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for begin in range(0, int(several.sum()), COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        at = column[low:high] - begin
        # a bit for each set and shingle
        bits = np.zeros((len(sets), -(-min(COLUMNS, int(several.sum()) - begin) // 64)), np.uint64)
        np.bitwise_or.at(bits, (owner[low:high], at >> 6),
                         np.uint64(1) << (at & 63).astype(np.uint64))
        for k in range(len(sets)):
            shared[k, k:] += np.bitwise_count(bits[k] & bits[k:]).sum(axis=1, dtype=np.int64)
    shared = np.maximum(shared, shared.T)
    either = np.add.outer(size, size) - shared
    return shared >= SIMILAR * either


def linked_within(rows: DataFrame, by: list[str], near) -> DataFrame:
    """(a, b): links between rows of one group that ``near`` finds, enough to connect them. A
    group meets in one task, so its size must be bounded."""
    def links_of(held):
        pairs = [(held[i]["s"], held[k]["s"]) for i, k in forest(near(held))]
        return pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.int64())
                                           for n in (0, 1)], ["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = [row[c] for c in by]
                if len(held) > 1 and now != last:
                    yield links_of(held)
                if now != last:
                    held = []
                last = now
                # a row of the input may be repeated
                if not held or held[-1]["s"] != row["s"]:
                    held.append(row)
        if len(held) > 1:
            yield links_of(held)

    return through_python(rows.repartition(*by).sortWithinPartitions(*by, "s"), run,
                          "a long, b long")


def block_pairs(rows: DataFrame, width: Column, carried: list[str]) -> DataFrame:
    """Rows once for every pair (lo, hi) of blocks with their own, a group being dealt over
    ``width`` blocks; ``carried`` names the other columns."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1))
    return (rows.withColumn("width", width)
            .withColumn("own", F.pmod(F.xxhash64("s"), F.col("width"))).withColumn("other", every)
            .select(*carried, F.least("own", "other").alias("lo"),
                    F.greatest("own", "other").alias("hi")))


def candidate_links(classes: DataFrame, block: int) -> DataFrame:
    """(a, b): links that connect all classes that may be similar: those that share a key and
    are near in bits and size."""
    members = classes.select("s", "n", "fp", F.explode("keys").alias("k"))
    tops = members.groupBy("k").agg(F.count("*").alias("members"),
                                    F.min(F.struct("s", "n", "fp")).alias("top")).where("members > 1")
    shared = members.join(tops, "k").select(
        "k", "s", "n", "fp", "members", F.col("top.s").alias("top"), F.col("top.n").alias("top_n"),
        F.col("top.fp").alias("top_fp"))
    # a crowd of near copies is mostly connected through one member
    near = (bits_apart("fp", "top_fp") <= STAGE_BITS) & (
        F.least("n", "top_n") >= SIMILAR * F.greatest("n", "top_n"))
    shared = stage(shared.withColumn("near", near).drop("top_n", "top_fp"), "shared-keys")
    star = shared.where("near and s <> top").select(F.col("top").alias("a"), F.col("s").alias("b"))
    mixed = shared.groupBy("k").agg(F.bool_and("near").alias("one")).where("not one").select("k")
    dealt = block_pairs(shared.join(mixed, "k", "left_semi"),
                        F.ceil(F.col("members") / block).cast("long"), ["k", "s", "n", "fp"])
    return stage(star.unionByName(linked_within(dealt, ["k", "lo", "hi"], near_bits)).distinct(),
                 "candidates")


def grid_links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect the classes which the grid of operator 1 connects by the first
    64 bits of their fingerprints."""
    own = stage(classes.where("n > 0").select("s", F.col("fp")[0].alias("fp")), "prints")
    tops = stage(own.groupBy("fp").agg(F.min("s").alias("top")), "tops")
    equal = own.join(tops, "fp").where("s <> top").select(F.col("top").alias("a"),
                                                          F.col("s").alias("b"))
    other = tops.select(F.col("fp").alias("b"), F.col("top").alias("b_top"))
    near = links(tops.select("fp")).join(
        tops.select(F.col("fp").alias("a"), F.col("top").alias("a_top")), "a").join(other, "b")
    return equal.unionByName(near.select(F.col("a_top").alias("a"), F.col("b_top").alias("b")))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (least and other columns) with ``h``, the sorted hashes of the shingles of the
    text that ``least`` names, as often as that row stands in the table."""
    kept = [c for c in wanted.columns if c != "least"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 pa.array([shingle_hashes(t.as_py()).tobytes() for t in batch.column("text")],
                          pa.binary())], [*kept, "h"])

    w = wanted.select(*kept, F.col("least.doc_id").alias("w_id"), F.col("least.key").alias("w_key"))
    rows = docs.select("doc_id", "text").join(
        w, F.col("doc_id").eqNullSafe(F.col("w_id"))
        & text_key(F.col("text")).eqNullSafe(F.col("w_key"))).select(*kept, "text")
    return through_python(rows, run, schema_after(rows, kept, "h binary"))


def blocks_of(n_bytes: Column, block: int) -> Column:
    """The blocks that a group is dealt over, by its sets and their bytes."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(n_bytes) / BLOCK_BYTES)).cast("long")


def verified_links(dealt: DataFrame, block: int) -> DataFrame:
    """(node, root) of the sets that similarity connects, among staged sets (c, s, width, own, h)
    of candidate groups ``c``.

    Sets meet in blocks. Blocks of a group are first joined within, then through one set of each
    connected part, and only groups still in several parts compare all their blocks.
    """
    links = stage(linked_within(dealt, ["c", "own"], similar), "links")
    wide = dealt.where("width > 1")
    if wide.isEmpty():
        return components(links)

    def with_roots(links):
        return wide.join(components(links), F.col("s") == F.col("node"), "left").select(
            "c", "s", "h", "width", "own", F.coalesce("root", "s").alias("root"))

    parts = stage(with_roots(links).groupBy("c", "own", "root").agg(F.min_by(
        F.struct("s", "h"), "s").alias("x")).select("c", "x.*"), "parts")
    few = parts.groupBy("c").agg(blocks_of(F.octet_length("h"), block).alias("width"))
    between = linked_within(parts.join(few, "c").withColumn(
        "own", F.pmod(F.xxhash64("s"), F.col("width"))), ["c", "own"], similar)
    links = stage(links.unionByName(between), "links")
    rooted = stage(with_roots(links), "rooted")
    open_ = rooted.groupBy("c").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(
        "x <> y").select("c")
    pairs = block_pairs(rooted.join(open_, "c", "left_semi"), F.col("width"),
                        ["c", "s", "h"]).where("lo < hi")
    return components(links.unionByName(linked_within(pairs, ["c", "lo", "hi"], similar)))


def near_roots(docs: DataFrame, classes: DataFrame, block: int = BLOCK_SETS) -> DataFrame:
    """(node, root) of the shingle sets that link with others."""
    near = components(stage(grid_links(classes).unionByName(candidate_links(classes, block)),
                            "near"))
    # a root is no node of its own
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    groups = stage(classes.join(near, F.col("s") == F.col("node")).select(
        "s", "n", "least", F.col("root").alias("c")), "groups")
    widths = groups.groupBy("c").agg(blocks_of(8 * F.col("n"), block).alias("width"))
    wanted = groups.join(widths, "c").select(
        "c", "s", "width", F.pmod(F.xxhash64("s"), F.col("width")).alias("own"), "least")
    return verified_links(stage(shingle_sets(docs, wanted), "sets"), block)


def keep_one(docs: DataFrame, block: int = BLOCK_SETS) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the least id, then
    the least text hash; rows without an id come last, and of equal rows one stays.

    Documents link when their distinct five-word shingles have a Jaccard likeness of ``SIMILAR``
    or more; groups are what links connect. Candidates are what the SimHash grid links
    (``MAX_BITS`` of the first 64 bits), and those that share one of their ``LEAST`` smallest
    shingle hashes, which a linked pair does but for a chance of 0.2 ** 8 (3e-6), and differ in
    at most ``STAGE_BITS`` of the 256 bits of their fingerprints, where 39 with a deviation of 6
    is usual at 0.8. Every link is verified on the hashes of all shingles, inside tasks that hold
    a block of sets and send on a tree of links, never pairs. Texts without words are one group.
    """
    schema = docs.schema
    with scratch(docs.sparkSession):
        own = stage(sketches(docs), "sketches")
        classes = stage(own.groupBy("s").agg(
            F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")),
            "classes")
        roots = near_roots(docs, classes, block)
        chosen = stage(
            classes.join(roots, F.col("s") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("least").alias("first"))
            .select(F.col("first.doc_id").alias("k_id"), F.col("first.key").alias("k_key")),
            "chosen", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("k_id"))
                     & text_key(F.col("row.text")).eqNullSafe(F.col("k_key")))
    nth = F.row_number().over(W.partitionBy("k_id", "k_key").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*").to(schema)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id", "n_docs")
