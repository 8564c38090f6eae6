"""Token counts at every prefix of a text: truncation and budget questions without re-encoding.

``prefix_table`` stores, per document, the exact count at every prefix in characters.
``tokens_at`` and ``longest_within`` answer questions from the stored counts.

Defined cases: a null text counts as empty; an empty text has no prefixes and 0 tokens; repeated
rows and ids give repeated results; further columns of the input are not looked at; an empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, schema_after
from weekloom.llm.tokens import prefix_counter, vocabulary_path

LIMIT = 1024


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Length in characters of the longest prefix of at most ``budget`` tokens.

    Counts may fall when a character joins tokens, so the last prefix that fits is sought.
    """
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def tokens_at(counts: np.ndarray, length: int) -> int:
    """Tokens of the prefix of ``length`` characters."""
    return int(counts[min(length, len(counts)) - 1]) if length > 0 and len(counts) else 0


def prefix_table(docs: DataFrame, path: str | None = None, budget: int = LIMIT,
                 keep_counts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fits_chars, counts): counts is a little-endian int64 array.

    ``fits_chars`` is the length of the longest prefix within ``budget`` tokens. Without
    ``keep_counts`` the array is used for the answers and then let go.
    """
    path = path or vocabulary_path()

    def run(batches):
        counter = prefix_counter(path)
        for batch in batches:
            rows = {"n_bytes": [], "n_tokens": [], "fits_chars": [], "counts": []}
            for text in batch.column("text"):
                text = text.as_py() or ""
                counts = counter.counts(text)
                rows["n_bytes"].append(len(text.encode()))
                rows["n_tokens"].append(tokens_at(counts, len(text)))
                rows["fits_chars"].append(longest_within(counts, budget))
                rows["counts"].append(counts.astype("<i8").tobytes() if keep_counts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(rows[c], pa.int64()) for c in
                                           ("n_bytes", "n_tokens", "fits_chars")],
                 pa.array(rows["counts"], pa.binary())],
                ["doc_id", "n_bytes", "n_tokens", "fits_chars", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, schema_after(
        docs, ["doc_id"], "n_bytes long, n_tokens long, fits_chars long, counts binary"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_table(documents(spark, sf_dir), keep_counts=False)
    return found.select("doc_id", "n_bytes", "n_tokens",
                        (F.col("n_tokens") > LIMIT).alias("over_limit"), "fits_chars")
