"""Language ID by compression: each language has a zstandard raw-content dictionary; the text
belongs to the language whose dictionary makes it smallest, and is rejected when the runner-up
is nearly as small.

Dictionaries are fitted on a bounded sample: at most ``SAMPLE_DOCS`` distinct texts of a language,
of as many ids as there are, taken whole one after the other while they fit ``SAMPLE_BYTES``; a
text that does not fit what is left is passed over. Every text is encoded whole, as lower-case letters with single
spaces between, in blocks of ``BLOCK`` bytes, so that a long text is judged by its whole length
and not by what it repeats of itself.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; so
is every text when nothing could be learned. With one learned language the score is 1. Equal
sizes go to the language that sorts first, with score 0. Repeated rows repeat; further columns
are not looked at; an empty table gives an empty result.
"""

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, held_out, schema_after, spread_sample, through_python

SAMPLE_DOCS = 96
SAMPLE_BYTES = 1 << 17
BLOCK = 4096
LEVEL = 9
MIN_MARGIN = 0.01
UNDEFINED = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters of a text, with one space for anything between them."""
    return NO_LETTERS.sub(" ", (text or "").lower()).strip()


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS,
          sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionary of each language, from documents that are not held out.

    What reaches the driver is at most ``sample_docs`` pairs of a number and a size and then
    ``sample_bytes`` of text for each language.
    """
    known = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"),
                        F.octet_length("text").alias("size")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
        & F.col("size").between(1, sample_bytes))
    picked = spread_sample(known, "lang", sample_docs)
    sized = known.join(F.broadcast(picked), ["lang", "doc_id", "h"]).groupBy(
        "lang", "nth", "doc_id", "h").agg(F.max("size").alias("size"))
    left, taken = {}, []
    for row in sized.orderBy("lang", "nth").collect():
        room = left.setdefault(row["lang"], sample_bytes)
        if row["size"] <= room:
            left[row["lang"]] = room - row["size"]
            taken.append((row["lang"], row["doc_id"], row["h"], row["nth"]))
    if not taken:
        return {}
    wanted = docs.sparkSession.createDataFrame(taken, sized.select(
        "lang", "doc_id", "h", "nth").schema)
    texts = (known.join(F.broadcast(wanted), ["lang", "doc_id", "h"])
             .groupBy("lang", "nth").agg(F.min("text").alias("text")).collect())
    found: dict[str, list] = {}
    for row in sorted(texts, key=lambda r: (r["lang"], r["nth"])):
        found.setdefault(row["lang"], []).append(letters(row["text"]))
    return {lang: "\n".join(parts).encode() for lang, parts in sorted(found.items())}


def judged(rows: DataFrame, dictionaries: dict[str, bytes], min_margin: float,
           text_of: Callable) -> DataFrame:
    """The first column of the rows, lang_pred, score and rejected. ``text_of`` takes the texts
    from a batch, so that they need not be sent beside a column that holds them."""
    names = sorted(dictionaries)
    first = rows.columns[0]

    def run(batches):
        import zstandard

        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(
                dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(
                dict_data=content, write_content_size=False, write_dict_id=False).compress)

        def judge(text):
            data = letters(text).encode()
            if not names or not data:
                return UNDEFINED, 0.0, True
            if len(names) == 1:
                return names[0], 1.0, False
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(map(len, map(code, blocks))) for code in coders]
            best, second = sorted(sizes)[:2]
            margin = 1 - best / second
            return names[sizes.index(best)], margin, margin < min_margin

        for batch in batches:
            rows = [judge(t.as_py()) for t in text_of(batch)]
            pred, score, rejected = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(first), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [first, "lang_pred", "score", "rejected"])

    return through_python(rows, run, schema_after(
        rows, [first], "lang_pred string, score double, rejected boolean"))


def identify(docs: DataFrame, dictionaries: dict[str, bytes],
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected); the score is the saving over the runner-up."""
    return judged(docs.select("doc_id", "text"), dictionaries, min_margin,
                  lambda batch: batch.column("text"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes],
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language could be told, with all their columns."""
    at = docs.columns.index("text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return (judged(whole, dictionaries, min_margin, lambda batch: batch.column("row").field(at))
            .where("not rejected").select("row.*").to(docs.schema))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
