"""Shards of nearly equal bytes by a k-d tree over metadata.

A node is split along its widest dimension (length, language, source, id; each scaled to the whole
table) at the distributed weighted median, until every leaf is one shard. Documents of equal text
are one point and stay together, unless the group holds more than 1/32 of a shard's bytes or (from
64 rows on) rows; there are at most 1,024 such groups for 16 shards, and they are dealt into parts
of that size by the rank of a row in its group. A larger bound would keep more groups whole and
leave the shards less equal, which is the law here.

The median is found by narrowing a 62-bit key (30 bits of the coordinate, 32 of a hash that parts
ties), 12 bits a round: each round sums bytes by node and key prefix. What reaches the driver is
one row per node. All of it is DataFrame code.

Defined cases: a null text has no bytes (size 1, crc 0); null or equal metadata values share the
least coordinate or one coordinate and are parted by the hash; repeated rows are dealt like others
and get slots of their own; further columns are not looked at; an empty table gives an empty
result; with fewer points than shards some shards stay empty.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import documents, ranked, stage, text_key

SHARDS = 16
PARTS = 32
FEW_ROWS = 64
COORD_BITS, TIE_BITS, ROUND_BITS = 30, 32, 12
KEY_BITS = COORD_BITS + TIE_BITS
TOLERANCE = 0.0005
DIMENSIONS = ["length", "language", "origin", "number"]


def text_number(value: Column) -> Column:
    """The first six bytes of a text as a number that sorts alike; 0 for null."""
    first = F.rpad(F.hex(F.substring(F.coalesce(value, F.lit("")).cast("binary"), 1, 6)), 12, "0")
    return F.conv(first, 16, 10).cast("double")


def points(docs: DataFrame) -> DataFrame:
    """One row per document: size, checksum, identity of the text, and metadata as numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"),
        F.log2(F.octet_length(text) + 1).alias("length"),
        text_number(F.col("lang")).alias("language"), text_number(F.col("source")).alias("origin"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("number"))


def parted(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``part``: groups of equal text above the bound are dealt into several."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    max_bytes = max(1, (total["bytes"] or 0) // (shards * PARTS))
    max_rows = max(FEW_ROWS, total["n"] // (shards * PARTS))
    groups = rows.groupBy("key").agg(F.sum("size").alias("g_bytes"), F.count("*").alias("g_rows"))
    large = groups.where(f"g_rows > 1 and (g_bytes > {max_bytes} or g_rows > {max_rows})").select(
        F.col("key").alias("g_key"), F.greatest(F.ceil(F.col("g_bytes") / max_bytes), F.ceil(
            F.col("g_rows") / max_rows)).cast("long").alias("parts"))
    # at most 2 * shards * PARTS groups can be above either bound
    split = rows.join(F.broadcast(large), F.col("key") == F.col("g_key"))
    whole = rows.join(F.broadcast(large.select("g_key")), F.col("key") == F.col("g_key"),
                      "left_anti")
    # by rank, as repeated rows have one id
    numbered = ranked(stage(split, "split"), "key", ["doc_id"], "rank")
    return whole.withColumn("part", F.lit(0).cast("long")).unionByName(
        numbered.withColumn("part", F.col("rank") % F.col("parts"))
        .select(*rows.columns, F.col("part").cast("long")))


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of whole numbers."""
    body = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def split_keys(units: DataFrame, ranges: dict[str, tuple[float, float]]) -> Column:
    """The keys of a unit in each dimension, in one array."""
    keys = []
    for name in DIMENSIONS:
        low, high = ranges[name]
        width = (high - low) or 1.0
        scaled = F.floor((F.col(name) - low) / width * ((1 << COORD_BITS) - 1)).cast("long")
        keys.append(F.shiftleft(scaled, TIE_BITS).bitwiseOR(F.col("tie")))
    return F.array(*keys)


def medians(units: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """The greatest key of the left side of each node.

    ``units`` has node, keys and bytes; a node has its dimension and the bytes wanted left.
    """
    spark = units.sparkSession
    state = {n: {"prefix": 0, "bits": 0, "below": 0} for n in nodes}
    cuts: dict[int, int] = {}
    while state:
        rows = [(n, nodes[n]["dimension"] + 1, s["prefix"], KEY_BITS - s["bits"],
                 max(0, KEY_BITS - s["bits"] - ROUND_BITS), s["below"], nodes[n]["wanted"])
                for n, s in state.items()]
        table = values(spark, rows, "s_node, dim, prefix, outer, inner, below, wanted")
        shift = lambda c: F.call_function(
            "shiftright", F.col("k"), F.col(c).cast("int"))
        found = (units.join(F.broadcast(table), F.col("node") == F.col("s_node"))
                 .withColumn("k", F.element_at("keys", F.col("dim").cast("int")))
                 .where(shift("outer") == F.col("prefix")).withColumn("bin", shift("inner")))
        bins = found.groupBy("node", "bin", "below", "wanted").agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        run = F.sum("bytes").over(W.partitionBy("node").orderBy("bin"))
        # at most 4,096 bins of a node meet in one window
        crossing = (bins.withColumn("upto", F.col("below") + run)
                    .where(F.col("upto") >= F.col("wanted"))
                    .groupBy("node").agg(F.min_by(F.struct("bin", "bytes", "n", "upto"), "bin")
                                         .alias("x")).select("node", "x.*").collect())
        following = {}
        for r in crossing:
            node, wanted = r["node"], nodes[r["node"]]["wanted"]
            bits = min(KEY_BITS, state[node]["bits"] + ROUND_BITS)
            before = r["upto"] - r["bytes"]
            if r["n"] > 1 and bits < KEY_BITS and r["bytes"] > TOLERANCE * wanted:
                following[node] = {"prefix": r["bin"], "bits": bits, "below": before}
            else:
                inside = r["upto"] - wanted <= wanted - before
                cuts[node] = ((r["bin"] + inside) << (KEY_BITS - bits)) - 1
        state = following
    return cuts


def tree(units: DataFrame, shards: int) -> DataFrame:
    """``units`` with ``shard``; ``units`` has bytes, tie and the dimensions."""
    spark = units.sparkSession
    span = units.agg(*[f(n).alias(f"{k}_{n}") for n in DIMENSIONS
                       for k, f in (("low", F.min), ("high", F.max))]).first()
    ranges = {n: (span[f"low_{n}"] or 0.0, span[f"high_{n}"] or 0.0) for n in DIMENSIONS}
    now = stage(units.select("key", "part", "bytes", split_keys(units, ranges).alias("keys"),
                             F.lit(0).cast("long").alias("node")), "kd-units")
    sizes = {0: shards}
    while any(k > 1 for k in sizes.values()):
        boxes = now.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[
            (F.max(F.col("keys")[d]) - F.min(F.col("keys")[d])).alias(f"w{d}")
            for d in range(len(DIMENSIONS))]).collect()
        nodes = {}
        for r in boxes:
            k = sizes[r["node"]]
            if k > 1:
                widths = [r[f"w{d}"] for d in range(len(DIMENSIONS))]
                nodes[r["node"]] = {"dimension": widths.index(max(widths)),
                                    "wanted": r["bytes"] * (k // 2) // k}
        if not nodes:
            break
        cuts = medians(now, nodes)
        rows = [(n, nodes[n]["dimension"] + 1, cut, n + sizes[n] // 2) for n, cut in cuts.items()]
        table = values(spark, rows, "s_node, dim, cut, right_node")
        side = F.when(F.element_at("keys", F.col("dim").cast("int")) > F.col("cut"),
                      F.col("right_node")).otherwise(F.col("node"))
        now = stage(now.join(F.broadcast(table), F.col("node") == F.col("s_node"), "left")
                    .select("key", "part", "bytes", "keys", side.alias("node")), "kd-units")
        sizes = {m: n for node, k in sizes.items()
                 for m, n in (((node, k // 2), (node + k // 2, k - k // 2)) if k > 1
                              else ((node, k),))}
    return now.select("key", "part", F.col("node").cast("int").alias("shard"))


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    rows = stage(parted(stage(points(docs), "points"), shards), "parts")
    units = rows.groupBy("key", "part").agg(
        F.sum("size").alias("bytes"), *[F.min(n).alias(n) for n in DIMENSIONS])
    tie = F.pmod(F.xxhash64("key", "part"), F.lit(1 << TIE_BITS))
    leaves = stage(tree(units.withColumn("tie", tie), shards), "leaves").select(
        F.col("key").alias("l_key"), F.col("part").alias("l_part"), "shard")
    placed = stage(rows.join(leaves, (F.col("key") == F.col("l_key"))
                             & (F.col("part") == F.col("l_part")))
                   .select("doc_id", "size", "text_crc32", "shard"), "placed")
    return ranked(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Leaves needed so that none is planned above the target."""
    return max(1, -(-total_bytes // target_bytes))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
