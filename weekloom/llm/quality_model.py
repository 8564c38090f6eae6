"""Quality classifier: a factorisation machine over hashed words, structure and size.

Features of a text: its lower-cased words hashed to ``WORD_SLOTS`` slots (weight: the square root
of their share), statistics of its structure, each as the slot of its range, and its length.
Pairwise interactions have rank ``RANK`` and are scored in linear time by the identity
sum_{i<j} <v_i,v_j> x_i x_j = ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2, summed over the rank.

The machine is fitted on at most ``SAMPLE_ROWS`` labelled rows that are not held out, those with
the smallest id hashes; repeated rows count once, and further texts of an id come last. Only their features reach the driver.

Defined cases: a null text counts as empty; an empty text has structure slots only and gets the
score these give; with nothing to learn from, the score is 0.5; repeated rows repeat; further
columns are not looked at; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import documents, held_out, schema_after

SAMPLE_ROWS = 6000
WORD_SLOTS = 1 << 16
RANK = 8
EPOCHS = 6
THRESHOLD = 0.3
UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
SIGN = b"#*$%&|<>!{}[]=_~^\\/"
STOP = b".,;:?"
#: statistic -> upper ends of its ranges; shares and counts of the lower-cased words or bytes
RANGES = {
    "upper": (.01, .03, .06, .1, .2, .4, .6),
    "digit": (.002, .01, .03, .1, .3),
    "sign": (.001, .005, .02, .05, .1, .2),
    "stop": (.002, .01, .02, .04, .08),
    "distinct": (.05, .1, .2, .3, .4, .5, .6, .7, .8, .9),
    "top": (.01, .03, .06, .1, .2, .4),
    "follow": (.005, .02, .1, .3, .6),
    "lines": (.05, .2, .4, .6, .8, .999),
    "word_bytes": (2, 3, 4, 5, 6, 7, 9, 12),
    "words": (1, 10, 20, 50, 100, 300, 1000, 5000),
    "line_words": (2, 5, 10, 20, 40, 100),
}
STAT_SLOTS = 16
SLOTS = WORD_SLOTS + STAT_SLOTS * len(RANGES)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; each slot once."""
    from xxhash import xxh32_intdigest

    data = (text or "").encode()
    words = data.lower().split()
    n, size = len(words), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    hashed = np.fromiter(map(xxh32_intdigest, words), np.int64, n)
    slots, counts = np.unique(hashed & (WORD_SLOTS - 1), return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    stats = {
        "upper": share(UPPER), "digit": share(DIGIT), "sign": share(SIGN), "stop": share(STOP),
        "distinct": len(slots) / n if n else 0, "top": counts.max() / n if n else 0,
        "follow": float(np.mean(hashed[1:] == hashed[:-1])) if n > 1 else 0,
        "lines": len(set(lines)) / len(lines) if lines else 0,
        "word_bytes": sum(map(len, words)) / n if n else 0, "words": n,
        "line_words": n / len(lines) if lines else 0,
    }
    at = [WORD_SLOTS + STAT_SLOTS * k + int(np.searchsorted(ends, stats[name]))
          for k, (name, ends) in enumerate(RANGES.items())]
    return (np.concatenate([slots, np.array(at, np.int64)]),
            np.concatenate([np.sqrt(counts / max(1, n)) * .3, np.full(len(at), 1.0)]))


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        terms = self.factors[slots] * values[:, None]
        pairs = .5 * float((terms.sum(0) ** 2).sum() - (terms ** 2).sum())
        return self.bias + float(self.weights[slots] @ values) + pairs


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS,
        rate: float = .05, decay: float = 1e-4) -> Machine:
    """Log loss by adaptive gradients, one row after the other in a fixed shuffled order."""
    random = np.random.default_rng(9)
    mean = (sum(y for _, _, y in rows) + 1) / (len(rows) + 2)
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(SLOTS),
                random.normal(0, .01, (SLOTS, RANK)))
    seen_w, seen_f = np.full(SLOTS, 1e-4), np.full((SLOTS, RANK), 1e-4)
    seen_b = 1e-4
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            slots, values, y = rows[k]
            own = m.factors[slots]
            terms = own * values[:, None]
            total = terms.sum(0)
            z = (m.bias + m.weights[slots] @ values
                 + .5 * ((total ** 2).sum() - (terms ** 2).sum()))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            step_w = g * values + decay * m.weights[slots]
            step_f = g * values[:, None] * (total - terms) + decay * own
            seen_b += g * g
            seen_w[slots] += step_w ** 2
            seen_f[slots] += step_f ** 2
            m.bias -= rate * g / np.sqrt(seen_b)
            m.weights[slots] -= rate * step_w / np.sqrt(seen_w[slots])
            m.factors[slots] = own - rate * step_f / np.sqrt(seen_f[slots])
    return m


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """The machine for ``quality``; null if no row can be learned from."""
    usable = labels.select("doc_id", "quality").where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # at most sample_rows pairs of numbers
    known = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "h").distinct()
    # an id may stand in any number of rows: distinct texts, the first of each id before others
    turn = F.row_number().over(W.partitionBy("doc_id", "quality").orderBy("h"))
    picked = (known.withColumn("turn", turn).where(F.col("turn") <= sample_rows)
              .orderBy("turn", F.xxhash64("doc_id"), "doc_id", "quality", "h")
              .limit(sample_rows).drop("turn"))
    known = texts.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "quality", "h").agg(
        F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([s for s, _ in found], pa.list_(pa.int64())),
                 pa.array([v for _, v in found], pa.list_(pa.float64())),
                 batch.column("quality").cast(pa.int32())],
                ["doc_id", "slots", "x", "y"])

    rows = known.select("doc_id", "text", "quality").mapInArrow(run, schema_after(
        docs, ["doc_id"], "slots array<long>, x array<double>, y int"))
    rows = rows.orderBy("doc_id", "y", "slots").toArrow()
    data = [(rows["slots"][k].values.to_numpy(), rows["x"][k].values.to_numpy(),
             int(rows["y"][k].as_py() == 1)) for k in range(rows.num_rows)]
    return fit(data) if data else None


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score): chance of label 1."""
    model = machine and (machine.bias, machine.weights.astype(np.float32),
                         machine.factors.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the slots

    def run(batches):
        m = Machine(*shared.value) if shared.value else None
        for batch in batches:
            z = np.array([m.margin(*features(t.as_py())) if m else 0.0
                          for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, schema_after(docs, ["doc_id"], "score double"))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
