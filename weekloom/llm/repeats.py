"""Exact removal of repeated byte strings: every byte covered by a ``SPAN``-byte string that also
starts anywhere else in the corpus goes.

The corpus is narrowed to where repeats can be; what is left is compared in shards. A shard is
compared by its suffix array (``compare=repeated_in_blocks``, as in the pipeline), by external
induced suffix sorting (``compare=by_suffixes``) or by hashes of its windows, which gives the same
result; the README says why the query takes hashes.

1. Each text is cut into runs of windows (``regions``); a window's twin lies in a run of the same
   key. Keys are counted, and runs whose key is nowhere else are done.
2. Runs are grouped by key and content. Where a content occurs twice, all its windows repeat.
3. Of keys with several contents, one run of each content is looked at window by window. Contents
   of a key meet in one task in bounded portions; keys with more than ``CROWD`` contents spread
   their windows over all tasks and are counted with a combine before the shuffle. Where suffixes
   are compared, windows with a hash that is there twice are then compared byte by byte.
4. Spans are joined back to their texts.

Identities are 64-bit hashes under a 64-bit key, and 128 bits for windows and texts.

Defined cases: a null text counts as empty; texts of fewer than ``SPAN`` bytes lose nothing;
repeated rows are repeats of each other and lose all (from ``SPAN`` bytes on); further columns
are not looked at; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, schema_after, scratch, stage, through_python
from weekloom.llm.regions import runs
from weekloom.llm.suffix_sort import repeated_in_blocks, repeated_places

SPAN = 200
#: contents of one key that a task compares: about 6 MB of text and 100 MB of window hashes
CROWD = 20_000
PORTION = 4000
#: the same in bytes for suffix arrays, which take 60 bytes of memory for each
CROWD_BYTES = 6 << 20
PORTION_BYTES = 3 << 19
RUNS = "array<struct<m:long,r:long,a:int,b:int,inner:boolean>>"
RUN_TYPE = pa.list_(pa.struct([("m", pa.int64()), ("r", pa.int64()), ("a", pa.int32()),
                               ("b", pa.int32()), ("inner", pa.bool_())]))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, k1, k2, text): texts without nulls and their identity."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(text, F.lit(7)).alias("k2"), text.alias("text"))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def doc_runs(texts: DataFrame, span: int) -> DataFrame:
    """(u, doc, k1, k2, runs) of every text; u numbers the rows and holds once this is written."""
    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        u = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for text in batch.column("text"):
                data = text.as_py().encode()
                found.append([{"m": signed(m), "r": signed(xxh3_64_intdigest(data[a:b + span])),
                               "a": a, "b": b, "inner": inner} for m, a, b, inner in
                              runs(data, span)])
            ids = pa.array(range(u, u + len(found)), pa.int64())
            u += len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("k1"), batch.column("k2"), ids,
                 pa.array(found, RUN_TYPE)], ["doc", "k1", "k2", "u", "runs"])

    return through_python(
        texts.select("doc", "k1", "k2", "text"), run,
        schema_after(texts, ["doc", "k1", "k2"], f"u long, runs {RUNS}"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, k1, k2, z): texts compressed for the shuffle."""
    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("k1"), batch.column("k2"),
                 pa.array([press(t.as_py().encode()) for t in batch.column("text")], pa.binary())],
                ["doc", "k1", "k2", "z"])

    return through_python(
        docs.select("doc", "k1", "k2", "text"), run,
        schema_after(docs, ["doc", "k1", "k2"], "z binary"))


def window_hashes(data: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every ``span``-byte string."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        base, power = np.uint64(seed), seed
        level = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(seed >> 40)
        width, left, at = 1, span, 0
        total = np.zeros(len(data) - span + 1, np.uint64)
        while left:
            if left & 1:
                total = total * np.uint64(power) + level[at:at + len(total)]
                at += width
            left >>= 1
            if left:
                level = level[:-width] * np.uint64(power) + level[width:]
                level = level ^ (level >> np.uint64(31))
                power = (power * power + 2) % (1 << 64)
                width *= 2
        total ^= total >> np.uint64(29)
        out.append(total * base)
    return out[0], out[1]


def joined_ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """[(first, last)] of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def repeated_windows(contents: list[bytes], span: int) -> list[np.ndarray]:
    """For each content, which of its windows occur twice or more in all of them."""
    parts = [window_hashes(c, span) for c in contents]
    h1 = np.concatenate([p[0] for p in parts])
    h2 = np.concatenate([p[1] for p in parts])
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    flags = np.zeros(len(h1), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return np.split(flags, np.cumsum([len(p[0]) for p in parts])[:-1])


def by_suffixes(contents: list[bytes], span: int) -> list[np.ndarray]:
    """The same by suffix sorting: windows that share ``span`` bytes with a neighbour."""
    return [np.array(f, bool) for f in repeated_places(contents, span)]


CONTENT = "u long, m long, a int, single boolean, crowd boolean, content binary"


def contents(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Content of the wanted runs; ``wanted`` has doc, k1, k2, u and a list of places."""
    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, u, places in zip(*(batch.column(c) for c in ("z", "u", "places"))):
                data = unpress(z.as_py(), max_output_size=1 << 31) if len(z.as_py()) else b""
                rows += [(u.as_py(), p["m"], p["a"], p["single"], p["crowd"],
                          data[p["a"]:p["b"] + span]) for p in places.as_py()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["u", "m", "a", "single", "crowd", "content"])

    w = wanted.select("u", "places", F.col("doc").alias("w_doc"), F.col("k1").alias("w_k1"),
                      F.col("k2").alias("w_k2"))
    found = packed_texts(texts).join(w, (F.col("k1") == F.col("w_k1"))
                                     & (F.col("k2") == F.col("w_k2"))
                                     & F.col("doc").eqNullSafe(F.col("w_doc"))).select(
        "z", "u", "places")
    return through_python(found, run, CONTENT)


def near_contents(rows: DataFrame, span: int, compare=repeated_windows) -> DataFrame:
    """(u, a, e): spans of single contents that repeat under the same key; keys meet in one
    partition, sorted, and are compared in portions of whole keys."""
    def flush(held):
        out = []
        for (u, _, a, single, _), flags in zip(
                held, compare([h[4] for h in held], span)):
            if single:
                out += [(u, a + i, a + j + span) for i, j in joined_ranges(flags)]
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
             pa.array(columns[2], pa.int32())], ["u", "a", "e"])

    def run(batches):
        held, last, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if (len(held) >= PORTION or size >= PORTION_BYTES) and row["m"] != last:
                    yield flush(held)
                    held, size = [], 0
                last = row["m"]
                size += len(row["content"])
                held.append((row["u"], last, row["a"], row["single"], row["content"]))
        if held:
            yield flush(held)

    near = rows.where("not crowd").select("u", "m", "a", "single", "content")
    return through_python(near.repartition("m").sortWithinPartitions("m"), run,
                          "u long, a int, e int")


def crowd_twins(rows: DataFrame, span: int) -> DataFrame:
    """(u, a, single): windows of crowded keys whose hash occurs twice or more."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h1, h2 = (h.view(np.int64) for h in window_hashes(row["content"], span))
                n = len(h1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(np.full(n, row["u"])),
                     pa.array(np.arange(row["a"], row["a"] + n, dtype=np.int32)),
                     pa.array(np.full(n, row["single"], bool))], ["h1", "h2", "u", "a", "single"])

    windows = stage(through_python(
        rows.where("crowd").select("u", "a", "single", "content"), run,
        "h1 long, h2 long, u long, a int, single boolean"), "windows")
    twice = stage(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
                  .select("h1", "h2"), "twice")
    return windows.join(twice, ["h1", "h2"], "left_semi").select("u", "a", "single")


def crowd_suffixes(rows: DataFrame, span: int) -> DataFrame:
    """(u, a, single): windows of crowded keys whose bytes occur twice or more. Equal windows have
    equal hashes, so only those of a hash that is there twice are spread as they are."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, begin, places = row["content"], row["a"], {}
                for p in row["places"]:
                    if 0 <= p - begin <= len(data) - span:
                        places.setdefault(data[p - begin:p - begin + span], []).append(p)
                found = list(places.items())
                for k in range(0, len(found), PORTION):
                    suffixes, starts = zip(*found[k:k + PORTION])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(suffixes, pa.binary()),
                         pa.array([row["u"]] * len(starts), pa.int64()),
                         pa.array(starts, pa.list_(pa.int32())),
                         pa.array([row["single"]] * len(starts), pa.bool_())],
                        ["suffix", "u", "places", "single"])

    places = crowd_twins(rows, span).groupBy("u").agg(F.collect_list("a").alias("places"))
    found = rows.where("crowd").select("u", "a", "single", "content").join(places, "u")
    suffixes = stage(through_python(
        found, run, "suffix binary, u long, places array<int>, single boolean"), "suffixes")
    twice = suffixes.groupBy("suffix").agg(F.sum(F.size("places")).alias("n")).where("n > 1")
    return suffixes.join(twice, "suffix", "left_semi").select(
        "u", F.explode("places").alias("a"), "single")


def crowd_contents(rows: DataFrame, span: int, compare=repeated_windows) -> DataFrame:
    """(u, a, e): the same for crowded keys, one row a window."""
    twins = crowd_twins if compare is repeated_windows else crowd_suffixes
    return twins(rows, span).where("single").select("u", "a", (F.col("a") + span).alias("e"))


def repeated_spans(texts: DataFrame, span: int, compare=repeated_windows) -> DataFrame:
    """(k1, k2, spans): places of every text whose bytes repeat; spans may overlap."""
    table = stage(doc_runs(texts, span), "runs")
    every = table.select("u", F.explode("runs").alias("x")).select("u", "x.*")
    again = stage(every.groupBy("m").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
                  .where("n > 1 or inner").select("m"), "keys")
    shared = stage(every.join(again, "m", "left_semi"), "shared-runs")
    kinds = stage(shared.groupBy("m", "r").agg(
        F.count("*").alias("n"), F.max("inner").alias("inner"),
        F.min(F.struct("u", "a", "b")).alias("first")), "contents")
    crowd = F.col("kinds") > CROWD
    if compare is not repeated_windows:
        crowd = crowd | (F.col("bytes") > CROWD_BYTES)
    mixed = stage(kinds.groupBy("m").agg(
        F.count("*").alias("kinds"), F.max("inner").alias("any_inner"),
        F.sum(F.expr(f"first.b - first.a + {span}")).alias("bytes"))
                  .where("kinds > 1 or any_inner").select("m", crowd.alias("crowd")), "mixed")
    places = stage(kinds.join(mixed, "m").groupBy("first.u").agg(F.collect_list(F.struct(
        "m", "first.a", "first.b", (F.col("n") == 1).alias("single"), "crowd"))
        .alias("places")), "places")
    owners = table.select("u", "doc", "k1", "k2")
    wanted = stage(places.join(owners, "u"), "wanted")
    found = stage(contents(texts, wanted, span), "run-contents")
    whole = (shared.join(kinds.where("n > 1").select("m", "r"), ["m", "r"], "left_semi")
             .select("u", "a", (F.col("b") + span).alias("e")))
    spans = (whole.unionByName(near_contents(found, span, compare))
             .unionByName(crowd_contents(found, span, compare)))
    # one row per document before anything is joined; copies of a text have the same spans
    by_row = spans.groupBy("u").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    found = by_row.join(owners.drop("doc"), "u")
    return found.groupBy("k1", "k2").agg(F.first("spans").alias("spans"))


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


def whole_characters(data: bytes, gone: list[list[int]]) -> list[list[int]]:
    """The removed ranges without characters of which only a part is removed."""
    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    out = []
    for a, e in gone:
        while a < e and inside(a):
            a += 1
        while e > a and inside(e):
            e -= 1
        if a < e:
            out.append([a, e])
    return out


def without_repeats(docs: DataFrame, span: int = SPAN, characters: bool = False,
                    compare=repeated_windows) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): maximal removed byte ranges and the bytes
    that stay. With ``characters``, a character that would be cut stays whole."""
    texts = keyed(docs)
    with scratch(docs.sparkSession):
        spans = stage(repeated_spans(texts, span, compare), "spans", keep=True)

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, spans_of in zip(batch.column("z"), batch.column("spans")):
                data = unpress(z.as_py(), max_output_size=1 << 31)
                gone = merged((s["a"], s["e"]) for s in spans_of.as_py() or ())
                if characters:
                    gone = whole_characters(data, gone)
                kept, at = [], 0
                for a, e in gone:
                    kept.append(data[at:a])
                    at = e
                rows.append((len(data), sum(e - a for a, e in gone), gone,
                             b"".join([*kept, data[at:]])))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    packed = packed_texts(texts).join(spans, ["k1", "k2"], "left").select(
        F.col("doc").alias("doc_id"), "z", "spans")
    return through_python(packed, run, schema_after(
        packed, ["doc_id"],
        "n_bytes long, n_removed long, removed array<array<int>>, kept binary"))


def keep_new(docs: DataFrame, span: int = SPAN, compare=repeated_in_blocks) -> DataFrame:
    """The rows with repeats taken out of their texts, ``n_chars`` counted anew where there is
    one. A null text stays null. Suffixes are sorted, not hashed, if not asked otherwise."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.col("text").isNull().alias("none"), F.struct(
        *[F.col(f"`{c}`") for c in others]).alias("row")).alias("doc_id"), "text")
    text = F.when(~F.col("doc_id.none"), F.decode("kept", "UTF-8"))
    found = without_repeats(rows, span, characters=True, compare=compare).select(
        "doc_id.row.*", text.alias("text"))
    if "n_chars" in others:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(
            docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
