"""Steps of the dealt methods: documents counted per host, and the grid in the pipeline's stage."""

import numpy as np

from tests.llm.conftest import prose
from weekloom.llm import line_rules, simhash


def test_copies_count_as_documents(frame):
    """Six copies of a text under six ids hold its lines six times; one repeated row only once."""
    rows = [(k, prose(1, 6), None, "h", *[None] * 5) for k in range(6)]
    rows += [(50, prose(2, 6), None, "h", *[None] * 5)] * 6
    rows += [(60 + k, prose(1, 6), None, None, *[None] * 5) for k in range(3)]
    got = line_rules.line_rules(frame(rows), limit=5).collect()
    assert {r["doc_id"] for r in got if r["depleted"]} == set(range(6))
    left = line_rules.cleaned(frame(rows), limit=5).collect()
    assert sorted((r["host"] or "", r["text"]) for r in left) == sorted(
        [("h", prose(2, 6)), ("", prose(1, 6))])


def test_the_grid_finds_candidates_of_the_stage(spark, frame, monkeypatch):
    """Without shared smallest hashes, near copies whose prints are two bits apart still meet."""
    word = [f"w{k}" for k in range(4000)]
    base = " ".join(word)
    texts = [base, base + " a tail", base + " b end", prose(9, 30), prose(10, 30)]
    prints = [simhash.sketch(t)[3][0] for t in texts]
    near = [int(np.uint64((prints[0] ^ p) & (2 ** 64 - 1))).bit_count() for p in prints]
    assert max(near[:3]) <= simhash.MAX_BITS < min(near[3:])
    monkeypatch.setattr(simhash, "candidate_links", lambda classes, block: spark.createDataFrame(
        [], "a long, b long"))
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    assert {r["doc_id"] for r in simhash.keep_one(frame(rows)).collect()} == {0, 3, 4}
