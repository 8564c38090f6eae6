"""License scans: short notices found exactly by words and fuzzily by characters.

A notice that may have k edits is cut into k + 1 seeds; wherever it occurs, at least one seed
stands unchanged (pigeonhole). Seeds are searched first, and only around them the ``regex``
library's bounded-error matching verifies the edits and gives the span.

Texts are lower-cased (A-Z only) and reduced to words joined by single spaces.

Defined cases: a null text counts as empty; texts without a notice have empty labels, null places
and score 0; overlapping places count each; repeated rows repeat; further columns are not looked
at; an empty table gives an empty result.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weekloom.llm.common import documents, schema_after

#: notices searched word by word: phrase -> label
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: notices searched with edits: (text that may have edits, exact text after it, edits, label)
FUZZY = [
    ("under the mit license", "", 2, "mit"),
    ("apache license version ", "2", 2, "apache-2"),
    ("gnu general public license", "", 2, "gpl"),
    ("gnu lesser general public license", "", 3, "lgpl"),
    ("mozilla public license", "", 2, "mpl"),
    ("creative commons attribution", "", 2, "cc-by"),
    ("all rights reserved", "", 1, "all-rights-reserved"),
    ("redistribution and use in source and binary forms", "", 4, "bsd"),
]
#: bytes of words as they are, all others as spaces
WORD_BYTES = bytes(b if b > 0x7F or chr(b).islower() or chr(b).isdigit() else 0x20
                   for b in range(256))


def joined_words(text: str | None) -> tuple[bytes, int]:
    """The words of a text joined by single spaces with one at either end, and their number."""
    words = (text or "").encode().lower().translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" ", len(words)


def seeds(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, seed): the notice in edits + 1 parts of nearly equal length."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self):
        import regex

        self.base = [(f" {p} ".encode(), p.encode(), label) for p, label in BASE.items()]
        self.fuzzy = []
        for soft, hard, edits, label in FUZZY:
            pattern = regex.compile(
                b"(?be)(?<= )(?:%s){e<=%d}%s(?= )" % (soft.encode(), edits, hard.encode()))
            whole = (soft + hard).encode()
            self.fuzzy.append((pattern, whole, edits, label, seeds(soft.encode(), edits)))

    def exact(self, words: bytes) -> list[tuple[int, int, str]]:
        """(word, words, label) of every place of a base phrase."""
        found = []
        for padded, phrase, label in self.base:
            at = words.find(padded)
            while at >= 0:
                found.append((words.count(b" ", 0, at), phrase.count(b" ") + 1, label))
                at = words.find(padded, at + 1)
        return found

    def near(self, words: bytes) -> list[tuple[int, int, int, str, float]]:
        """(start, end, edits, label, likeness) in bytes of ``words``, within bounded edits."""
        found = []
        for pattern, whole, edits, label, parts in self.fuzzy:
            windows = []
            for offset, seed in parts:
                at = words.find(seed)
                while at >= 0:
                    windows.append((max(0, at - offset - edits - 1),
                                    at - offset + len(whole) + edits + 1))
                    at = words.find(seed, at + 1)
            reach = 0
            merged: list[list[int]] = []
            for begin, end in sorted(windows):
                if merged and begin <= reach:
                    merged[-1][1] = reach = max(reach, end)
                else:
                    merged.append([begin, end])
                    reach = end
            for begin, end in merged:
                for m in pattern.finditer(words, begin, min(end, len(words))):
                    n = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), n, label, 1 - n / len(whole)))
        return found


SPAN = "struct<start:int,end:int,edits:int,label:string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word places of base phrases, labels, best likeness and the fuzzy
    spans, given in bytes of the joined words."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words, n = joined_words(text.as_py())
                exact, near = scanner.exact(words), scanner.near(words)
                base = {x[2] for x in exact}
                starts = [x[0] for x in exact]
                out.append({
                    "n_words": n, "n_base": len(exact),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | {x[3] for x in near})),
                    "score": 1.0 if exact else max((x[4] for x in near), default=0.0),
                    "spans": [dict(zip(("start", "end", "edits", "label"), x)) for x in near]})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[f.name] for r in out], f.type)
                                           for f in FIELDS]],
                ["doc_id", *[f.name for f in FIELDS]])

    return docs.select("doc_id", "text").mapInArrow(run, schema_after(
        docs, ["doc_id"], "n_words long, n_base long, first_word long, last_word long, "
        f"base_labels string, labels string, score double, spans array<{SPAN}>"))


FIELDS = [
    pa.field("n_words", pa.int64()), pa.field("n_base", pa.int64()),
    pa.field("first_word", pa.int64()), pa.field("last_word", pa.int64()),
    pa.field("base_labels", pa.string()), pa.field("labels", pa.string()),
    pa.field("score", pa.float64()),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                          ("edits", pa.int32()), ("label", pa.string())]))),
]


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

