"""Token counts and packing against the tokenizer library."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.conftest import odd_rows
from weekloom.llm.packing import CAPACITY, pack, pattern_places, shortest_pack_first
from weekloom.llm.token_counts import longest_within, prefix_table, tokens_at
from weekloom.llm.tokens import (
    IdStore, PrefixCounter, load_tokenizer, patterns, vocabulary_path)

BITS = ["a", "th", "e", " ", "  ", "\n", "'", "s", "'ll", "é", "中文", "😀", "1", "22", "!", "...",
        "<|endoftext|>", "<|end", "\t", "\x1c", " ", "don't", " the", "\r\n", "====",
        "\U00016100", "\U0001d4b3", "՘"]


def texts(n):
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_counts_at_every_prefix_and_ids_match_the_library():
    path = vocabulary_path()
    counter, store, library = PrefixCounter(path), IdStore(path), load_tokenizer(path)
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    for text in texts(400):
        assert counter.counts(text).tolist() == [
            len(encode(text[:k])) for k in range(1, len(text) + 1)], text
        assert np.frombuffer(store.ids(text), "<u4").tolist() == encode(text), text


def test_ids_of_a_column_in_small_blocks():
    path = vocabulary_path()
    store, library = IdStore(path), load_tokenizer(path)
    more = ["'s's'll", "a 's", "a\t's", "\u3000\u3000x", "x\u3000", "'", "'v", "it'd're'x", None, ""]
    column = pa.array([*more, *texts(300), *(r[1] for r in odd_rows())]).slice(1)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
    for store.BLOCK, store.LIMIT in ((1, 9), (40, 500_000), (1 << 21, 500_000)):
        assert [np.frombuffer(x, "<u4").tolist() for x in store.each(column)] == want
    assert not list(store.each(column.slice(0, 0)))


def test_known_pieces_cost_less_than_a_look_up_each():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
             for _ in range(3000)]
    text = " ".join(r.choices(words, k=300_000))
    store, pieces = IdStore(vocabulary_path()), patterns(False)[0]
    store.ids(text)
    known = {p: b"abcd" * 2 for p in pieces.findall(text)}
    took = [], []
    for _ in range(5):
        for k, work in enumerate((lambda: b"".join(map(known.get, pieces.findall(text))),
                                  lambda: store.ids(text))):
            began = time.process_time()
            work()
            took[k].append(time.process_time() - began)
    assert min(took[1]) < 0.8 * min(took[0]), took


def test_budget_questions():
    counts = PrefixCounter(vocabulary_path()).counts("the stones of the river")
    for budget in range(0, 8):
        k = longest_within(counts, budget)
        assert k == max([i for i in range(1, len(counts) + 1)
                         if tokens_at(counts, i) <= budget], default=0)
    assert tokens_at(counts, 0) == 0 and tokens_at(counts, 10_000) == counts[-1]


def test_prefix_table_on_odd_rows(odd, empty):
    library = load_tokenizer(vocabulary_path())
    want = Counter((r[0], len((r[1] or "").encode()),
                    len(library.encode(r[1] or "", add_special_tokens=False).ids))
                   for r in odd_rows())
    got = prefix_table(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(len(r["counts"]) // 8 == 0 or np.frombuffer(r["counts"], "<i8")[-1]
               == r["n_tokens"] for r in got)
    assert prefix_table(empty).count() == 0


def test_patterns_take_every_piece_once():
    r = random.Random(3)
    histogram = Counter(r.randint(1, 1024) for _ in range(5000)) + Counter({700: 2000, 324: 900})
    patterns = shortest_pack_first(dict(histogram), 1024)
    taken = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 1024
        for length in lengths:
            taken[length] += count
    assert taken == histogram
    ranks = defaultdict(list)
    for length, low, high, *_ in pattern_places(patterns):
        ranks[length].append((low, high))
    for length, spans in ranks.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing_is_whole(odd, empty):
    library = load_tokenizer(vocabulary_path())
    rows = pack(odd).collect()
    ids = {}
    for r in odd_rows():
        ids[r[0], zlib.crc32((r[1] or "").encode())] = library.encode(
            r[1] or "", add_special_tokens=False).ids + [0]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter()
    for doc in odd_rows():
        own = ids[doc[0], zlib.crc32((doc[1] or "").encode())]
        for k in range(0, len(own), CAPACITY):
            part = own[k:k + CAPACITY]
            want[doc[0], k, len(part), crc(part), len(own)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
                   for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert pack(empty).count() == 0
