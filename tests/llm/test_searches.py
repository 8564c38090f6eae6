"""Decontamination, licences, language ID and the quality model against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, prose
from weekloom.llm import decontaminate, language, licenses, packing, quality_model, repeats, simhash
from weekloom.llm.common import BATCH_BYTES, BATCH_SETTING, held_out

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def shingles(w, n=5):
    return {" ".join(w[k:k + n]) for k in range(len(w) - n + 1)}


def slow_pairs(docs, items, at_least=0.8):
    out = Counter()
    for item_id, item in items:
        w = words(item)
        if not w:
            continue
        own = shingles(w, min(5, len(w)))
        for doc_id, text in docs:
            shared = len(own & shingles(words(text), min(5, len(w))))
            if shared >= at_least * len(own):
                out[doc_id, item_id, shared, len(own)] += 1
    return out


def planted():
    r = random.Random(11)
    items = [(k, prose(1000 + k, r.randint(2, 9))) for k in range(60)]
    items += [(60, "four words only here"), (61, "solitary"), (62, ""), (63, None),
              (None, prose(5, 4))]
    docs = []
    for k in range(60):
        text = words(prose(k, r.randint(1, 120)))
        for item_id, item in r.sample(items[:60], 3):
            part = words(item)
            if r.random() < .5 and len(part) > 30:
                part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = part
        docs.append((k, " ".join(text).upper() if k % 2 else ", ".join(text)))
    docs += [(100, "we saw four words only here today"), (101, "Solitary!"), (102, items[3][1])]
    return docs, items


@pytest.mark.parametrize("block", [7, 20_000])
def test_contained_items(spark, block):
    docs, items = planted()
    found = decontaminate.containment_pairs(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), block_items=block).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"])
                   for r in found) == slow_pairs(docs, items)


def test_repetitive_items_hide_no_other(spark):
    """Items that repeat themselves a little or much, as long as others by distinct shingles."""
    r = random.Random(5)
    items, docs = [], []
    for k in range(40):
        text = [f"w{r.randrange(10 ** 6)}" for _ in range(64)]
        items.append((k, " ".join(text)))
        docs.append((k, prose(k, 150) + " " + " ".join(text) + " " + prose(k + 50, 150)))
    period = [f"p{n}" for n in range(60)]
    items += [(100, " ".join(period * 84)), (101, " ".join([*period[:40], *period[:30]])),
              (102, "only five words stand here"), (103, "and six words stand in here")]
    docs += [(100, " ".join(period * 84)), (101, prose(1, 300) + " " + " ".join(period) + " p0 p1 p2"),
             (102, " ".join(f"{prose(k, 9)} only five words stand here" for k in range(3))),
             (103, f"{prose(8, 300)} and six words stand in here {prose(9, 30)}")]
    found = decontaminate.containment_pairs(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"])
                   for r in found) == slow_pairs(docs, items)


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = [(1, prose(0, 12)), (2, "one"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in
                   decontaminate.containment_pairs(odd, bench).collect()) == slow_pairs(rows, items)
    dirty = {id(r) for r in rows for i in items if slow_pairs([r], [i])}
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.schema == odd.schema
    assert kept.count() == len(rows) - len(dirty)
    assert decontaminate.containment_pairs(empty, bench).count() == 0
    assert decontaminate.containment_pairs(odd, bench.where("false")).count() == 0
    assert decontaminate.keep_clean(odd, bench.where("false")).count() == len(rows)


def notices():
    r = random.Random(2)
    base = list(licenses.BASE) + [a + b for a, b, _, _ in licenses.FUZZY]
    texts = []
    for k in range(250):
        parts = words(prose(k, 2))
        for _ in range(r.randint(0, 3)):
            notice = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(notice))
                notice = notice[:at] + r.choice(["", "q", notice[at] + "z"]) + notice[at + 1:]
            at = r.randint(0, len(parts))
            parts[at:at] = notice.split()
        texts.append("-".join(parts) if k % 3 else " ".join(parts).title())
    return texts + ["cc by nc by nc cc-BY-NC", "cc by nc cc by nc", "under the mit licenses"]


def test_notices_exact_and_fuzzy(spark):
    texts = notices()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(frame).collect():
        w = words(texts[r["doc_id"]])
        starts = [(k, label) for p, label in licenses.BASE.items()
                  for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(starts)
        assert r["first_word"] == min((k for k, _ in starts), default=None)
        assert r["last_word"] == max((k for k, _ in starts), default=None)
        base = {x for _, x in starts}
        assert r["base_labels"] == ",".join(sorted(base))
        joined = " " + " ".join(w) + " "
        near = {label for soft, hard, k, label in licenses.FUZZY if regex.search(
            r"(?<= )(?:%s){e<=%d}%s(?= )" % (soft, k, hard), joined)}
        assert r["labels"] == ",".join(sorted(base | near)), joined
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= bool(starts)
        for s in r["spans"]:
            soft, hard, k, _ = next(x for x in licenses.FUZZY if x[3] == s["label"])
            assert s["edits"] <= k
            assert regex.fullmatch(r"(?:%s){e<=%d}%s" % (soft, s["edits"], hard),
                                   joined.encode()[s["start"]:s["end"]].decode())


def test_scan_of_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"]) for r in licenses.scan(odd).collect())
    assert got == Counter((r[0], len(words(r[1])), 0) for r in odd_rows())
    assert licenses.scan(empty).count() == 0


TONGUES = {"aa": "melon tarka visp ondo kelar", "bb": "grund schlau weiche stein brach",
           "cc": "oiseau plume jardin fleur matin"}


def speech(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.sample(TONGUES[lang].split(), 1)) + r.choice("aeiou")
                    for _ in range(n))


def test_language_of_held_out_texts(frame):
    r = random.Random(3)
    rows = [(k, speech(lang, k, r.randint(8, 200)), lang, None, None, None, None, None, None)
            for k, lang in enumerate(["aa", "bb", "cc"] * 80)]
    docs = frame(rows)
    dictionaries = language.learn(docs)
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    got = docs.join(language.identify(docs, dictionaries), "doc_id").where(
        held_out(F.col("doc_id"))).collect()
    assert len(got) > 30
    assert sum(x["lang"] == x["lang_pred"] for x in got) / len(got) > 0.97
    # labels of the row itself play no part
    blind = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    assert {tuple(x) for x in language.identify(blind, dictionaries).collect()} == {
        tuple(x) for x in language.identify(docs, dictionaries).collect()}


def test_every_language_is_learned_beside_repeated_ids(frame):
    """One id in many equal rows and in many different ones, and headers that texts share."""
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5]
    rows = [(ids[0], speech("aa", 1, 50), "aa")] * 400
    rows += [(ids[1], speech("aa", 1000 + k, 50), "aa") for k in range(400)]
    rows += [(k, f"aatext {speech('aa', k, 40)}", "aa") for k in ids[2:40]]
    rows += [(k, "shared header " * 200 + f"bbtext {speech('bb', k, 300)}", "bb")
             for k in ids[300:340]]
    docs = frame([(*r, *[None] * 6) for r in rows])
    found = language.learn(docs)
    assert sorted(found) == ["aa", "bb"]
    assert found["aa"].count(b"aatext") == 38
    assert len(found["aa"].splitlines()) == language.SAMPLE_DOCS
    assert len(set(found["aa"].splitlines())) == language.SAMPLE_DOCS
    # most of what is learned is not the header
    own = found["bb"].split()
    assert sum(w in (b"shared", b"header") for w in own) < 0.8 * len(own)


def test_labelled_rows_beside_repeated_ids(spark, frame, monkeypatch):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5][:60]
    rows = [(ids[0], "same text", *[None] * 7)] * 100
    rows += [(ids[1], f"text {k}", *[None] * 7) for k in range(100)]
    rows += [(k, f"text of {k}", *[None] * 7) for k in ids[2:]]
    marks = spark.createDataFrame([(k, k % 2) for k in ids] * 3, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model, "fit", seen.extend)
    quality_model.learn(frame(rows), marks, sample_rows=80)
    wanted = [quality_model.features(f"text of {k}")[0].tolist() for k in ids[2:]]
    got = [s.tolist() for s, _, _ in seen]
    assert len(got) == 80 and all(x in got for x in wanted)
    assert got.count(quality_model.features("same text")[0].tolist()) == 1


def test_language_of_odd_rows(odd, empty):
    dictionaries = language.learn(odd)
    rows = odd_rows()
    got = language.identify(odd, dictionaries).collect()
    assert len(got) == len(rows)
    letters = {r[0] for r in rows if r[0] is not None and not regex.search(r"\p{L}", r[1] or "")}
    for x in got:
        assert 0 <= x["score"] <= 1
        if x["doc_id"] in letters:
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
    kept = language.keep_identified(odd, dictionaries)
    assert kept.schema == odd.schema
    assert kept.count() == sum(not x["rejected"] for x in got)
    assert language.learn(empty) == {} and language.identify(empty, {}).count() == 0
    assert {x["lang_pred"] for x in language.identify(odd, {}).collect()} == {"und"}
    one = language.identify(odd, {"en": b"stone river cloud"}).collect()
    assert {x["score"] for x in one} == {0.0, 1.0}


def test_kept_rows_go_through_python_with_one_text(odd, monkeypatch):
    sent, of_frame = [], type(odd).mapInArrow

    def noted(frame, *args, **more):
        sent.extend(frame.schema.simpleString().split("text:string")[1:])
        return of_frame(frame, *args, **more)

    dictionaries = language.learn(odd)
    monkeypatch.setattr(type(odd), "mapInArrow", noted)
    kept = language.keep_identified(odd, dictionaries)
    assert len(sent) == 1
    want = Counter(odd.collect()) - Counter(kept.collect())
    lost = language.identify(odd, dictionaries).where("rejected").collect()
    assert Counter(r["doc_id"] for r in want.elements()) == Counter(r["doc_id"] for r in lost)


def test_python_takes_an_input_split_in_parts(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).select(
        F.expr("nullif(id, -1)").alias("doc_id"),
        F.expr("nullif(repeat('stone river cloud ', 240) || id, '')").alias("text"))
    limit, of_frame = BATCH_BYTES * 3 // 2, type(docs).mapInArrow

    def guarded(frame, run, *args):
        def small(batches):
            for batch in batches:
                assert batch.nbytes <= limit
                yield batch
        return of_frame(frame, lambda batches: run(small(batches)), *args)

    monkeypatch.setattr(type(docs), "mapInArrow", guarded)
    items = spark.createDataFrame([(1, prose(1, 9))], "item_id long, text string")
    steps = [lambda: language.keep_identified(docs, {"en": b"stone river cloud"}),
             lambda: simhash.sketches(docs),
             lambda: repeats.packed_texts(repeats.keyed(docs)),
             lambda: decontaminate.keep_clean(docs, items),
             lambda: packing.pieces(docs).select("doc_id").distinct()]
    for step in steps:
        spark.conf.unset(BATCH_SETTING)
        assert step().count() == 3000
    spark.conf.set(BATCH_SETTING, "1m")
    steps[0]()
    assert spark.conf.get(BATCH_SETTING) == "1m"
    spark.conf.unset(BATCH_SETTING)


def test_pairs_identity():
    import numpy as np

    r = np.random.default_rng(0)
    m = quality_model.Machine(.3, r.normal(size=50), r.normal(size=(50, 4)))
    slots, x = np.array([3, 9, 20, 41]), np.array([.5, 1., 2., .1])
    pairs = sum(float(m.factors[a] @ m.factors[b]) * x[i] * x[j]
                for i, a in enumerate(slots) for j, b in enumerate(slots) if i < j)
    assert abs(m.margin(slots, x) - (.3 + m.weights[slots] @ x + pairs)) < 1e-9


def test_quality_of_held_out_texts(spark, frame):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(500):
        good = r.random() < .7
        text = prose(k, r.randint(2, 20))
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60),
                             text.replace(" ", " ### ")])
        rows.append((k, text, None, None, None, None, None, None, None))
        labels.append((k, int(good)))
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    machine = quality_model.learn(docs, marks)
    got = quality_model.score(docs, machine).join(marks, "doc_id").where(
        held_out(F.col("doc_id"))).collect()
    assert len(got) > 60
    assert sum((x["score"] >= .3) == x["quality"] for x in got) / len(got) > .95


def test_quality_of_odd_rows(spark, odd, empty):
    marks = spark.createDataFrame(
        [(k, k % 2) for k in range(12)] + [(100, None), (None, 1), (3, 0)],
        "doc_id long, quality int")
    machine = quality_model.learn(odd, marks)
    got = quality_model.score(odd, machine).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x["score"] <= 1 for x in got)
    assert quality_model.learn(odd, marks.where("false")) is None
    assert {x["score"] for x in quality_model.score(odd, None).collect()} == {.5}
    assert quality_model.score(empty, machine).count() == 0
