"""SimHash groups, components and repeated bytes against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, prose
from weekloom.llm import simhash
from weekloom.llm.components import components
from weekloom.llm.repeats import (by_suffixes, keep_new, merged, repeated_windows,
                                  whole_characters, without_repeats)
from weekloom.llm.suffix_sort import (repeated_in_blocks, repeated_places, shared, suffix_array,
                                      suffixes)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def roots(items, linked):
    top = {x: x for x in items}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def flipped(r, base, n):
    for b in r.sample(range(64), n):
        base ^= 1 << b
    return base - (1 << 64) if base >> 63 else base


@pytest.mark.parametrize("cell", [2, 32])
def test_links_connect_what_two_bits_connect(spark, cell):
    """Clusters, chains and edge bits, with crowded cells and without."""
    r = random.Random(1)
    found = {0, -1, 1, -2, 3 << 62, (1 << 63) - 1, -(1 << 63)}
    found = {x - (1 << 64) if x >> 63 == 1 else x for x in found}
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(15):
            found.add(flipped(r, base, r.randint(0, 3)))
        for _ in range(6):
            base = flipped(r, base & (2 ** 64 - 1), 2) & (2 ** 64 - 1)
            found.add(base - (1 << 64) if base >> 63 else base)
    frame = spark.createDataFrame([(x,) for x in found], "fp long")
    got = {x["node"]: x["root"] for x in components(simhash.links(frame, cell)).collect()}
    want = roots(sorted(found), lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2)
    assert {x: got.get(x, x) for x in found} == want


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in
           components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_odd_rows(odd, empty):
    rows = odd_rows()
    got = simhash.near_duplicates(odd).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    assert Counter((r["doc_id"], r["fp"] & (2 ** 64 - 1)) for r in got) == Counter(
        (r[0], p) for r, p in zip(rows, prints))
    root = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    assert all(r["component_id"] == least.get(root[r["fp"] & (2 ** 64 - 1)]) for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(odd, empty):
    rows = odd_rows()
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema
    prints = {slow_fingerprint(r[1]) for r in rows}
    n = len(set(roots(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2).values()))
    found = kept.collect()
    assert len(found) == n
    assert len({slow_fingerprint(r["text"]) for r in found}) == n
    assert simhash.keep_one(empty).count() == 0


def jaccard(x, y):
    x, y = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def edited(r, text, n):
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 5])
def test_edited_copies_are_one_document(frame, block):
    """Copies with changed words, from far above 0.8 to far below, in crowded keys or not."""
    r = random.Random(6)
    texts = []
    for k in range(30):
        base = prose(3000 + k, 40)
        texts += [base, edited(r, base, r.randint(1, 14)), edited(r, base, r.randint(1, 14))]
    base = prose(77, 60)
    texts += [edited(r, base, r.randint(0, 9)) for _ in range(25)]
    near = [jaccard(a, b) for a, b in itertools.combinations(texts, 2)]
    assert sum(0.8 <= x < 0.95 for x in near) > 40 and sum(0.6 < x < 0.8 for x in near) > 10
    top = roots(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    kept = simhash.keep_one(frame(rows), block)
    assert {x["doc_id"] for x in kept.collect()} == set(top.values())


def slow_repeats(texts, span):
    count = Counter(t[k:k + span] for t in texts for k in range(len(t) - span + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - span + 1):
            if count[t[k:k + span]] > 1:
                flags[k:k + span] = True
        flags = flags[:-1]
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        out.append((len(t), int(flags.sum()), int(np.sum(np.diff([0, *flags.astype(int)]) == 1)),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes_in_order_with_common_prefixes():
    """Against plain sorting, with queues that spill after one tuple and later."""
    r = random.Random(1)
    for _ in range(400):
        text = [r.randint(0, r.choice([0, 1, 3, 25])) for _ in range(r.randint(0, 30))]
        text = text[:8] * 4 if r.random() < .3 else text
        order = sorted(range(len(text)), key=lambda k: text[k:])
        want = [(p, shared(text, order[n - 1], p) if n else 0) for n, p in enumerate(order)]
        assert list(suffixes(text, r.choice([1, 2, 5, 1000]))) == want


@pytest.mark.parametrize("crowd, compare", [
    (0, repeated_windows), (1000, repeated_windows), (1000, by_suffixes)])
def test_repeats_of_planted_passages(frame, monkeypatch, crowd, compare):
    """Passages at all offsets, overlapping, periodic, at either end, in crowded keys or not."""
    monkeypatch.setattr("weekloom.llm.repeats.CROWD", crowd)
    r = random.Random(4)
    passage, other = prose(900, 9), prose(901, 12)
    texts = []
    for k in range(40):
        cut = r.randint(0, 150)
        body = [prose(k, r.randint(1, 6)), passage[cut:cut + r.randint(150, 400)],
                prose(500 + k, 1), other[r.randint(0, 60):][:r.randint(190, 230)]]
        r.shuffle(body)
        texts.append("".join(body))
    texts += ["a" * 500, "b" * 200, "b" * 201, "ab" * 130, "é" * 150, passage, passage[:200],
              passage[1:200], "", prose(7, 30), prose(7, 30), "xyz" * 400]
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], len(x["removed"]),
                         hashlib.sha256(x["kept"]).hexdigest())
           for x in without_repeats(frame(rows), compare=compare).collect()}
    assert [got[k] for k in range(len(texts))] == slow_repeats([t.encode() for t in texts], 200)


def test_suffix_arrays_of_blocks():
    """Against plain sorting, packed into one number and not; contents against the external sort."""
    r = random.Random(2)
    for _ in range(400):
        text = [r.randint(0, r.choice([0, 1, 3, 25, 256])) for _ in range(r.randint(0, 40))]
        text = text[:r.randint(1, 9)] * 9 if r.random() < .3 else text
        span = r.choice([1, 3, 4, 5, 8, 15, 33])
        order = sorted(range(len(text)), key=lambda k: text[k:])
        want = [n > 0 and shared(text, order[n - 1], p) >= span for n, p in enumerate(order)]
        got, shares = suffix_array(np.array(text, np.uint16), span)
        assert (got.tolist(), shares.tolist()) == (order, want)
    for _ in range(100):
        contents = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(0, 40)))
                    for _ in range(r.randint(1, 6))]
        contents += contents[:r.randint(0, 2)]
        span = r.choice([1, 3, 4, 6, 9])
        got = [f.tolist() for f in repeated_in_blocks(contents, span)]
        assert got == repeated_places(contents, span)
    long = np.tile(np.frombuffer(prose(3, 400).encode(), np.uint8), 1 << 21 >> 14).astype(np.uint16)
    long = np.concatenate([long, long[::-1]])[:(1 << 21) + 1000]
    order, shares = suffix_array(long, 200)
    data = long.astype(np.uint8).tobytes()
    for n in r.sample(range(1, len(order)), 300):
        a, b = order[n - 1], order[n]
        assert data[a:] < data[b:]
        assert shares[n] == (data[a:a + 200] == data[b:b + 200] and max(a, b) + 200 <= len(data))


@pytest.mark.parametrize("bound", [{}, {"CROWD": 0}, {"CROWD_BYTES": 900}])
def test_the_stage_sorts_suffixes(spark, frame, monkeypatch, bound):
    """Texts lose what is there twice by its bytes, not by the hashes of windows: these are the
    same for all windows of crowded keys here, and near keys are compared by suffix arrays."""
    from corpus_pipeline import repeats_removed
    from weekloom.llm import repeats

    seen, near = [], repeats.near_contents
    monkeypatch.setattr(repeats, "near_contents", lambda rows, span, compare: (
        seen.append(compare), near(rows, span, compare))[1])
    for name, value in bound.items():
        monkeypatch.setattr(f"weekloom.llm.repeats.{name}", value)
    clash = lambda data, span: (np.zeros(len(data) - span + 1, np.uint64),) * 2
    monkeypatch.setattr("weekloom.llm.repeats.window_hashes", clash)
    r = random.Random(5)
    passage = prose(910, 12)
    texts = [prose(920 + k, 3) + passage[r.randint(0, 90):][:r.randint(190, 420)] + prose(940 + k, 2)
             for k in range(12)]
    texts += ["a" * 600, "ab" * 200, prose(960, 9)]
    texts.append(texts[-1][:250] + "é" * 20)
    docs = frame([(k, t, *[None] * 7) for k, t in enumerate(texts)])
    got = {x["doc_id"]: x["text"] for x in repeats_removed(spark, docs, None).collect()}
    assert seen == [repeated_in_blocks]
    want = slow_repeats([t.encode() for t in texts], 200)
    assert [hashlib.sha256(got[k].encode()).hexdigest() for k in range(len(texts))] == [
        w[3] for w in want]
    assert sum(w[1] for w in want) > 2000


def test_repeats_of_odd_rows(odd, empty):
    rows = odd_rows()
    want = Counter(zip([r[0] for r in rows],
                       slow_repeats([(r[1] or "").encode() for r in rows], 200)))
    got = Counter((x["doc_id"], (x["n_bytes"], x["n_removed"], len(x["removed"]),
                                 hashlib.sha256(x["kept"]).hexdigest()))
                  for x in without_repeats(odd).collect())
    assert got == want
    assert without_repeats(empty).count() == 0


def test_texts_stay_whole_characters(odd, empty):
    assert whole_characters("aéb".encode(), [[2, 3]]) == []
    assert whole_characters("aéb".encode(), [[0, 2]]) == [[0, 1]]
    assert merged([(0, 3), (3, 5), (9, 10)]) == [[0, 5], [9, 10]]
    kept = keep_new(odd)
    assert kept.schema.simpleString() == odd.schema.simpleString()
    assert kept.count() == len(odd_rows())
    assert kept.where(F.col("text").isNull()).count() == sum(r[1] is None for r in odd_rows())
    assert keep_new(empty).count() == 0


def test_blocks_send_on_trees_of_exact_links():
    r = random.Random(11)
    for n in (2, 30, 90):
        sets = [{r.randrange(400) for _ in range(r.randint(1, 60))} for _ in range(n)]
        sets += [s | {r.randrange(9000)} for s in sets[::3]] + [set(range(70_000))] * 2
        rows = [{"h": np.array(sorted(s), "<u8").tobytes()} for s in sets]
        near = simhash.similar(rows)
        want = [[len(a & b) >= .8 * len(a | b) for b in sets] for a in sets]
        assert near.tolist() == want
        links = simhash.forest(near)
        assert len(links) < len(sets)
        top = roots(range(len(sets)), lambda a, b: want[a][b])
        assert {k: top[k] for _, k in links} == {k: v for k, v in top.items() if v != k}
