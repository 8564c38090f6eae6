"""Benchmark decontamination: test items found inside documents of any length.

A document contains an item when at least 0.8 of the item's distinct five-word shingles occur in
it. Items are partitioned by the number of their shingles. For each partition, documents are seen
as overlapping windows little longer than the partition's longest item, so that the Jaccard
likeness of an item and the window around it stays high however long the document is. Each window
has a MinHash signature of ``HASHES`` values, and one equal value makes a candidate. Candidates
are verified by exact containment of shingles over the whole document.

A run of words that holds 0.8 of an item's shingles has a likeness of 0.29 or more with a window
around it, so it is missed with a chance of 0.71 ** 32, below 2e-5; a whole item is missed with
a chance below 3e-7. Items whose shingles are strewn over a document are found where one window
holds enough of them.

Windows do not suit items that repeat a shingle, whose length says nothing of their distinct
shingles, nor items of fewer than ``FEW`` shingles. These are not in the partitions: every shingle
of a document is looked up among theirs, which misses none wherever the shingles stand.

Items are taken in blocks of at most ``ITEMS`` rows; a block is what each task holds, so memory is
bounded however large the benchmark is. Documents are not shuffled.

Defined cases: null texts count as empty; an item without words is in no document; an item of
fewer than five words is one shingle, contained where its words stand together; repeated item rows
count once, repeated documents each; further columns are not looked at; empty tables give an empty
result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, schema_after, through_python
from weekloom.llm.licenses import joined_words

WIDTH = 5
CONTAINED = 0.8
HASHES = 32
ITEMS = 20_000
GROWTH = 1.5
GRAIN = 4
FEW = 8
CHUNK = 1 << 15


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return (random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1),
            random.integers(0, 1 << 63, n, np.uint64))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words."""
    from xxhash import xxh3_64_intdigest

    if len(words) < width:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[k:k + n]
    total ^= total >> np.uint64(31)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def exact_shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[k:k + width]) for k in range(len(words) - width + 1)}


class Index:
    """Items of one block by size partition, with the MinHash values of each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.width = width
        self.a, self.b = multipliers(HASHES)
        self.items, self.short = [], []
        parts: dict[int, list[int]] = {}
        looked_up: list[int] = []
        for item_id, text in items:
            words = joined_words(text)[0].split()
            if len(words) >= width:
                shingles = exact_shingles(words, width)
                hashes = shingle_hashes(words, width)
                if len(shingles) < len(hashes) or len(shingles) < FEW:
                    looked_up.append(len(self.items))
                else:
                    part = int(np.log(len(shingles)) / np.log(GROWTH) + 1e-9)
                    parts.setdefault(part, []).append(len(self.items))
                self.items.append((item_id, shingles, hashes))
            elif words:
                self.short.append((item_id, b" " + b" ".join(words) + b" "))
        self.parts = []
        for part, members in sorted(parts.items()):
            longest = max(len(self.items[m][2]) for m in members)
            step = GRAIN * max(1, -(-longest // (2 * GRAIN)))
            values = np.stack([self.mixed(self.items[m][2]).min(axis=1) for m in members])
            keys = (values.astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64)
                                                << np.uint64(32))).ravel()
            order = np.argsort(keys, kind="stable")
            owner = np.repeat(np.array(members), HASHES)[order]
            seen = np.zeros(1 << 20, bool)
            seen[values.ravel() & np.uint32(0xFFFFF)] = True
            self.parts.append((step, -(-(longest + step) // GRAIN), keys[order], owner, seen))
        self.overlap = max((p[1] * GRAIN for p in self.parts), default=0)
        own = [np.unique(self.items[m][2]) for m in looked_up]
        every = np.concatenate([*own, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.key_owner = np.repeat(np.array(looked_up, np.int64), [len(x) for x in own])[order]
        self.distinct = np.array([len(s) for _, s, _ in self.items], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64(0xFFFFF)] = True

    def by_lookup(self, hashes: np.ndarray, at_least: float) -> set[int]:
        """Items that windows do not suit, of which the document holds enough shingles."""
        if not len(self.keys):
            return set()
        own = np.unique(hashes[self.seen[hashes & np.uint64(0xFFFFF)]])
        low, high = (np.searchsorted(self.keys, own, side) for side in ("left", "right"))
        held = low < high
        places = [np.arange(i, j) for i, j in zip(low[held], high[held])]
        if not places:
            return set()
        items, shared = np.unique(self.key_owner[np.concatenate(places)], return_counts=True)
        return set(items[shared >= at_least * self.distinct[items]].tolist())

    def mixed(self, hashes: np.ndarray) -> np.ndarray:
        """The values of all hash functions, one row each."""
        return ((hashes[None, :] * self.a[:, None] + self.b[:, None])
                >> np.uint64(32)).astype(np.uint32)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of the document."""
        found: set[int] = set()
        if not self.parts:
            return found
        for begin in range(0, max(1, len(hashes)), CHUNK):
            part = hashes[begin:begin + CHUNK + self.overlap]
            if not len(part):
                continue
            grains = np.minimum.reduceat(
                self.mixed(part), np.arange(0, len(part), GRAIN), axis=1)
            for step, reach, keys, owner, seen in self.parts:
                starts = np.arange(0, grains.shape[1], step // GRAIN)
                # a window's least value: that of two runs of grains that cover it
                size = 1
                run = grains
                while size * 2 <= reach:
                    shifted = run.copy()
                    shifted[:, :-size] = np.minimum(run[:, :-size], run[:, size:])
                    run, size = shifted, size * 2
                last = np.minimum(starts + reach - size, grains.shape[1] - 1)
                last = np.maximum(last, starts)
                least = np.minimum(run[:, starts], run[:, last])
                row, col = np.nonzero(seen[least & np.uint32(0xFFFFF)])
                if len(row):
                    wanted = least[row, col].astype(np.uint64) | (
                        row.astype(np.uint64) << np.uint64(32))
                    wanted = np.unique(wanted)
                    low = np.searchsorted(keys, wanted, "left")
                    high = np.searchsorted(keys, wanted, "right")
                    for i, j in zip(low.tolist(), high.tolist()):
                        found.update(owner[i:j].tolist())
        return found

    def contained(self, text: str | None, at_least: float):
        """(item_id, shared, shingles) of the items that a text contains."""
        joined, _ = joined_words(text)
        words = joined.split()
        hits = [(item_id, 1, 1) for item_id, phrase in self.short if phrase in joined]
        hashes = shingle_hashes(words, self.width)
        near = self.candidates(hashes) | self.by_lookup(hashes, at_least)
        if near:
            own = exact_shingles(words, self.width)
            for k in sorted(near):
                item_id, shingles, _ = self.items[k]
                shared = len(shingles & own)
                if shared >= at_least * len(shingles):
                    hits.append((item_id, shared, len(shingles)))
        return hits


def item_blocks(benchmark: DataFrame, size: int = ITEMS):
    """The items in blocks of about ``size`` rows."""
    benchmark = benchmark.select("item_id", "text").distinct()
    n = benchmark.count()
    blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.where(block == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=repr)


def containment_pairs(docs: DataFrame, benchmark: DataFrame, at_least: float = CONTAINED,
                      width: int = WIDTH, block_items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all documents and items."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = schema_after(docs, ["doc_id"], f"item_id {item_type}, n_shared long, "
                          "n_shingles long, containment double")
    item_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]

    def search(items):
        def run(batches):
            index = Index(items, width)
            for batch in batches:
                at, rows = [], []
                for k, text in enumerate(batch.column("text")):
                    for hit in index.contained(text.as_py(), at_least):
                        at.append(k)
                        rows.append((*hit, hit[1] / hit[2]))
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())),
                     pa.array(columns[0], item_arrow), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())],
                    ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])
        return through_python(docs.select("doc_id", "text"), run, schema)

    found = None
    for items in item_blocks(benchmark, block_items):
        pairs = search(items)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, at_least: float = CONTAINED,
               block_items: int = ITEMS) -> DataFrame:
    """The rows that contain no item, with all their columns; no join and no shuffle."""
    schema = docs.schema

    def sift(items):
        def run(batches):
            index = Index(items, WIDTH)
            for batch in batches:
                yield batch.filter(pa.array(
                    [not index.contained(t.as_py(), at_least) for t in batch.column("text")],
                    pa.bool_()))
        return run

    for items in item_blocks(benchmark, block_items):
        docs = through_python(docs, sift(items), schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_pairs(documents(spark, sf_dir),
                             spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")
#: items of fewer than five words do not occur in the tables and are left out here
OP2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
      FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) i FROM b)),
n AS (SELECT item_id, count(*) n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles,
       count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles
"""
