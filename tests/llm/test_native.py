"""Line rules and shards, which are DataFrame code, and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import odd_rows, prose
from weekloom.llm import kd_shards, line_rules, queries
from weekloom.llm.common import ranked, stage


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if count[x] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def slow_rules(rows, limit, min_kept):
    lines = defaultdict(set)
    for text, host in {(r[1] or "", r[3]) for r in rows}:
        flat = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", text.lower()))
        lines[host, text] = {x.strip(" ") for x in flat.split("\n")} - {""}
    docs = Counter((host, x) for (host, _), xs in lines.items() for x in xs)
    out = Counter()
    for r in rows:
        own = lines[r[3], r[1] or ""]
        left = sum(len(x) for x in own if docs[r[3], x] <= limit)
        gone = left < min_kept * sum(map(len, own))
        counts = slow_counts(r[1])
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        out[(r[0], *counts, failed, gone, not failed and not gone)] += 1
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "depleted", "kept"]


def test_line_rules(frame, odd, empty):
    shared = prose(1, 8)
    rows = odd_rows() + [
        (1000 + k, shared + "\n" + prose(2000 + k, k % 12), None, f"h{k % 2}", *[None] * 5)
        for k in range(30)]
    got = line_rules.line_rules(frame(rows), limit=5).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == slow_rules(rows, 5, .3)
    assert any(r["depleted"] for r in got)
    assert line_rules.line_rules(empty).count() == 0


def test_lines_above_the_limit_go(frame):
    rows = [(k, f"Shared LINE {k}\n{prose(k, 3)}\n", None, "h", *[None] * 5) for k in range(9)]
    texts = sorted(r["text"] for r in line_rules.cleaned(frame(rows), limit=5).collect())
    assert texts == sorted(prose(k, 3) + "\n" for k in range(9))


def test_ranks_are_whole(spark):
    rows = stage(spark.createDataFrame(
        [("hot", k // 2) for k in range(900)] + [("cold", 1), (None, 2), (None, 3)],
        "g string, id long"), "test")
    got = defaultdict(list)
    for r in ranked(rows, "g", ["id"], "rank").collect():
        got[r["g"]].append(r["rank"])
    assert {g: sorted(x) for g, x in got.items()} == {
        "hot": list(range(900)), "cold": [0], None: [0, 1]}


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_nearly_equal(frame, shards):
    rows = [(k, prose(k % 900, 1 + k % 7), "en" if k % 3 else "de", f"s{min(k % 40, 12)}",
             *[None] * 5) for k in range(1500)]
    rows += [(5000 + k, prose(1, 4), "en", "s1", *[None] * 5) for k in range(700)]
    got = kd_shards.kd_shards(frame(rows), shards).collect()
    check_shards(rows, got, shards)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(size) == shards and max(size.values()) < 1.06 * min(size.values())


def test_repeated_rows_are_spread(frame):
    """One row repeated under one id, more than a third of all."""
    rows = [(k, prose(k, 2), "en", "s", *[None] * 5) for k in range(2500)]
    rows += [(7, prose(7, 2), "en", "s", *[None] * 5)] * 1500
    size = Counter()
    for r in kd_shards.kd_shards(frame(rows)).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.1 * min(size.values())


def test_shards_of_odd_rows(odd, empty):
    check_shards(odd_rows(), kd_shards.kd_shards(odd).collect(), 16)
    assert kd_shards.kd_shards(empty).count() == 0
    assert kd_shards.shards_for(100, 30) == 4


def test_queries_run_on_an_empty_table(spark, empty, tmp_path):
    folder = str(tmp_path)
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, folder).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name, tmp_path):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    names = ", ".join(sorted(found.columns))
    want = Counter(con.execute(f"SELECT {names} FROM ({queries.ORACLES[name]})").fetchall())
    assert Counter(map(tuple, found.select(*sorted(found.columns)).collect())) == want


def test_pipeline_stages(spark, frame, tmp_path):
    """Each stage against its operator's plain version, on its own input."""
    folder = str(tmp_path)
    passage, item = prose(600, 12), prose(601, 6)
    rows = [(k, prose(k, 10), "en", "s", 1) for k in range(30)]
    rows += [(100 + k, f"{prose(200 + k, 5)}\n{passage}\n{prose(300 + k, 5)}", "en", "s", 1)
             for k in range(5)]
    rows += [(200, prose(3, 10), "en", "s", 1), (201, prose(4, 10), "en", "s", 1),
             (300, prose(400, 30) + "\n" + item + "\n" + prose(401, 9), "en", "s", 1),
             (400, "12 34 !!", "en", "s", 1), (401, None, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, folder), "test")
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r for r in docs.collect()})
    ids = {r[0] for r in rows}
    assert set(kept[0]) == ids - {400, 401}
    assert set(kept[1]) == set(kept[0]) - {200, 201}
    assert set(kept[2]) == set(kept[1])
    for k in range(5):
        text = kept[2][100 + k]["text"]
        assert passage[20:-20] not in text and prose(200 + k, 5)[:60] in text
        assert kept[2][100 + k]["n_chars"] == len(text)
    assert set(kept[3]) == set(kept[2]) - {300}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
