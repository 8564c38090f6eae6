"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams
are in the target texts than in the corpus.

Features are runs of one to three words, hashed by CRC32 into buckets. The CRCs of a block of
texts are computed together: a run is a slice of the block's normalised bytes, distinct runs are
grouped by their length in bytes into two-dimensional byte arrays, all CRCs of an array advance
column by column, and the buckets are scattered back to where the runs stand.

The corpus is read twice, once to count buckets and once to score; a pass holds a block of words
at a time, so a text may be of any length. Counts are combined per task, and the driver holds one
number per bucket. The draw ranks rows inside ranges of the score and never sorts in one task.

Defined cases: a null or empty text, or one without words, has no features and weight 0; repeated
rows count as often as they stand there, and of equal scores and ids any may come first; a null
id is hashed as an empty text and comes after the others of its score; further columns are not
looked at; an empty corpus gives an empty result, an empty target scores by the corpus alone.
"""

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import documents, schema_after, stage

WIDEST = 3
BUCKETS = 10000
DRAWN_PERCENT = 5
MIN_WORDS = 20
SEED = 42
BLOCK_WORDS = 1 << 17
#: runs longer than this take CRCs one by one, as their arrays would have few rows
LONG_RUN = 512
ARRAY_BYTES = 1 << 22
POLYNOMIAL = 0xEDB88320
#: lower case; all ASCII but letters and digits is a break
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
                for c in range(256))


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


TABLE = crc_table()


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC32 of many slices (none empty) of a byte array, those of one length at a time."""
    from zlib import crc32

    found = np.empty(len(start), np.uint32)
    by_length = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[by_length], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        n = int(length[by_length[a]])
        if n > LONG_RUN:
            for k in by_length[a:b].tolist():
                found[k] = crc32(data[start[k]:start[k] + n])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(data, n)
        rows = max(1, ARRAY_BYTES // n)
        for at in range(a, b, rows):
            which = by_length[at:min(b, at + rows)]
            # a row of the turned array is a column of bytes
            matrix = np.ascontiguousarray(windows[start[which]].T)
            crc = np.full(len(which), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            found[which] = ~crc
    return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def feature_buckets(words: list[bytes], owner: np.ndarray, own: int
                    ) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every run that starts in the first ``own`` words and stays with one
    owner. Distinct runs are hashed once."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, number, firsts, ends, inverse, owners, base = word, word, [], [], [], [], 0
    for k in range(min(WIDEST, len(words))):
        if k:
            # a run's number is that of the shorter run and of the word after it
            key = number[:len(words) - k] * len(ids) + word[k:]
        first, number = np.unique(key, return_index=True, return_inverse=True)[1:]
        firsts.append(start[first])
        ends.append(start[first + k] + size[first + k])
        whole = np.flatnonzero(owner[:len(key)] == owner[k:])
        whole = whole[:np.searchsorted(whole, own)]
        inverse.append(number[whole] + base)
        owners.append(owner[whole])
        base += len(first)
    begin = np.concatenate(firsts)
    hashed = crcs(data, begin, np.concatenate(ends) - begin) % BUCKETS
    return np.concatenate(owners), hashed[np.concatenate(inverse)].astype(np.int64)


def blocks(texts):
    """(words, owner, own) of runs of texts, ``BLOCK_WORDS`` at a time; a block also shows the
    words that runs from its end reach into."""
    words, owner = [], []
    for k, text in enumerate(texts):
        more = words_of(text)
        words += more
        owner += [k] * len(more)
        while len(words) >= BLOCK_WORDS + WIDEST:
            n = BLOCK_WORDS + WIDEST - 1
            yield words[:n], np.array(owner[:n]), BLOCK_WORDS
            words, owner = words[BLOCK_WORDS:], owner[BLOCK_WORDS:]
    yield words, np.array(owner, np.int64), len(words)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how often features of each bucket stand in all texts."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(t.as_py() for t in batch.column("text")):
                total += np.bincount(feature_buckets(*block)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])],
                                         ["bucket", "n"])

    parts = texts.select("text").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, by the counts of both sides."""
    both = bucket_counts(corpus).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")
                                        ).unionByName(bucket_counts(target).select(
                                            "bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # at most BUCKETS rows
    found = counts.toArrow()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found.column("bucket").to_numpy()
    s[at], t[at] = found.column("s").to_numpy(), found.column("t").to_numpy()
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([floor(1000 * log(r)) for r in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over a document's features."""
    def run(batches):
        for batch in batches:
            n = len(batch)
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for words, owner, own in blocks(t.as_py() for t in batch.column("text")):
                owners, bucket = feature_buckets(words, owner, own)
                n_words += np.bincount(owner[:own], minlength=n)
                n_features += np.bincount(owners, minlength=n)
                np.add.at(weight, owners, gains[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x) for x in (n_words, n_features, weight)]],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, schema_after(
        docs, ["doc_id"], "n_words long, n_features long, weight long"))


def noise(doc_id: Column) -> Column:
    """Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(
        doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = DRAWN_PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... of the highest scores among documents of at least
    ``least`` words, ``percent`` of these rounded down; null for all others.

    Rows are dealt over ranges of (score, id) and numbered inside a range; the driver holds the
    size of each range, one number per partition of the shuffle. ``scored`` is read more than
    once, so it should be a staged frame.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    able = F.col("n_words") >= least
    ranged = stage(scored.where(able).repartitionByRange(*order).withColumn(
        "block", F.spark_partition_id()), "ranges")
    sizes = sorted((r["block"], r["count"]) for r in ranged.groupBy("block").count().collect())
    drawn = sum(n for _, n in sizes) * percent // 100
    starts, before = [], 0
    for block, n in sizes:
        if before < drawn:
            starts.append((block, before))
        before += n
    known = scored.sparkSession.createDataFrame(starts, "b int, before long")
    place = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy(*order))
    reached = ranged.join(F.broadcast(known), F.col("block") == F.col("b")).select(*scored.columns, F.when(place <= drawn, place).alias("rank"))
    last = starts[-1][0] if starts else -1
    unplaced = F.lit(None).cast("long").alias("rank")
    return (reached.unionByName(ranged.where(F.col("block") > last).select(*scored.columns, unplaced))
            .unionByName(scored.where(~able).select("*", unplaced)))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    weighed = weights(docs, bucket_gains(docs, target))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return draw(stage(scored, "scores"), percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target).drop("n_words")


OP12_SQL = f"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, k:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}) ELSE a >> 1 END, c::BIGINT)) AS t),
d AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
runs AS (SELECT side, rid, unnest(w) AS f FROM w
         UNION ALL SELECT side, rid, w[i] || ' ' || w[i + 1]
           FROM (SELECT side, rid, w, unnest(range(1, len(w))) AS i FROM w)
         UNION ALL SELECT side, rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
           FROM (SELECT side, rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
counted AS (SELECT side, rid, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, xor(4294967295, list_reduce(
             list_transform(range(0, strlen(f)), lambda k: ('0x' || substr(x, (2 * k + 1)::INTEGER, 2))::BIGINT),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % {BUCKETS} AS b
           FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)), table_of),
c AS (SELECT side, rid, b, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
by_bucket AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s,
                     coalesce(sum(n) FILTER (side = 1), 0) AS t FROM c GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
            / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
          FROM by_bucket),
weighed AS (SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight
            FROM c JOIN gains USING (b) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (rid) WHERE side = 0),
placed AS (SELECT *, n_words >= {MIN_WORDS} AS able, row_number() OVER (
             PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS n_able FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN able AND place <= {DRAWN_PERCENT} * n_able // 100 THEN place END::BIGINT AS rank
FROM placed
"""
