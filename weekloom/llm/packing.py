"""Packing of documents into sequences of at most ``capacity`` tokens, shortest pack first.

A document's ids, closed by id 0, are cut every ``capacity`` ids; the rest is one shorter piece.
Lengths are placed longest first over the histogram of piece lengths. A length goes into the
packs with the most room; packs of the same lengths are one pattern with a count, so the work
depends on the number of lengths only. Pieces then find their place by their rank among the
pieces of their length.

Defined cases: a null or empty text has the closing id only; repeated rows and ids are packed as
often as they stand there; further columns are not looked at; an empty table gives an empty
result.
"""

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, ranked, schema_after, stage, through_python
from weekloom.llm.tokens import IdStore, vocabulary_path

CAPACITY = 1024
CLOSE = (0).to_bytes(4, "little")
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """[(count, lengths)]: packing patterns that take all pieces of the histogram.

    Lengths are placed longest first into the packs with the most room left; a pattern that has
    more packs than pieces are left is split in two.
    """
    open_packs: dict[int, list[list]] = {}
    rooms: list[int] = []
    done = []

    def put(room, count, lengths):
        if room == 0:
            done.append((count, lengths))
        elif room in open_packs:
            open_packs[room].append([count, lengths])
        else:
            open_packs[room] = [[count, lengths]]
            bisect.insort(rooms, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, lengths = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
                    rooms.pop()
                used = min(count, left)
                if used < count:
                    put(room, count - used, lengths)
                put(room - length, used, (*lengths, length))
                left -= used
            else:
                put(capacity - length, left, (length,))
                left = 0
    done += [(count, lengths) for room in open_packs for count, lengths in open_packs[room]]
    return done


def pattern_places(patterns: list[tuple[int, tuple]]) -> list[tuple]:
    """(length, from_rank, to_rank, times, base, offsets): where the ranks of a length go."""
    rows, taken, base = [], {}, 0
    for count, lengths in patterns:
        at, spots = 0, {}
        for length in lengths:
            spots.setdefault(length, []).append(at)
            at += length
        for length, offsets in spots.items():
            begin = taken.get(length, 0)
            end = begin + count * len(offsets)
            rows.append((length, begin, end, len(offsets), base, offsets))
            taken[length] = end
        base += count
    return rows


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut into pieces."""
    path = path or vocabulary_path()

    def run(batches):
        store = IdStore(path)
        for batch in batches:
            at, rows = [], []
            for k, found in enumerate(store.each(batch.column("text"))):
                ids = memoryview(found + CLOSE)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    at.append(k)
                    rows.append((start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())),
                 *[pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return through_python(docs.select("doc_id", "text"), run,
                          schema_after(docs, ["doc_id"], PIECES))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The driver holds one row per length (``capacity`` at most) and the patterns, whose number is
    bounded by the lengths too; both are broadcast.
    """
    cut = stage(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = cut.sparkSession.createDataFrame(
        pattern_places(shortest_pack_first(histogram, capacity)),
        "p_length long, from_rank long, to_rank long, times long, base long, "
        "offsets array<long>")
    numbered = ranked(cut, "length", ["doc_id", "start", "ids_crc32"], "rank")
    found = numbered.join(F.broadcast(places), (F.col("length") == F.col("p_length"))
                          & (F.col("rank") >= F.col("from_rank"))
                          & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        F.element_at("offsets", (nth % F.col("times") + 1).cast("int")).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
