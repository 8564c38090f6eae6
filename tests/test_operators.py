"""Operators against brute force or hand-made rows."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from weekloom.functions import numbers as N
from weekloom.functions import text as T
from weekloom.operators import audit, catalog_checks, guards, wow
from weekloom.operators.ordering import positions
from weekloom.sources import history


def column(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("text, want", [
    ("1,234.50", 1234.5), ("12.5%", 12.5), ("($5)", -5.0), ("-$5", None), ("€ 7", 7.0),
    ("(-5)", 5.0), ("", None), ("nan", None), ("inf", None), ("1.0f", None), (".5", 0.5),
    ("5.", 5.0), ("1_000", 1000.0), (" 12 % ", 12.0), ("1e3", 1000.0), (None, None)])
def test_parse_number(spark, text, want):
    assert column(spark, [text], N.parse_number) == [want]


def test_integers_allow_rounding_noise_only(spark):
    values = ["3", "3.0000000001", "3.001", "2.5", "-4", "x"]
    assert column(spark, values, N.parse_integer) == [3, 3, None, None, -4, None]


def test_boolean_cells_are_not_numbers(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "n")], "s string, t string")
    assert [r.x for r in df.select(N.parse_number(F.col("s"), F.col("t")).alias("x"))
            .collect()] == [None, 1.0]


def test_headers_fold_width_case_space_and_mark(spark):
    raw = ["﻿Ａｍｏｕｎｔ　spent", "STRASSE", "Straße", " a \n b ", None, "ﬁn"]
    want = [" ".join(unicodedata.normalize("NFKC", v or "").replace("﻿", "").split())
            .casefold() for v in raw]
    assert column(spark, raw, T.normalize_header) == want


def test_clean_keyword_peels_matching_quotes(spark):
    raw = ['"a"', '""a""', '"a', '" "b" "', '""', '"""', " c ", '"a" "b"']
    assert column(spark, raw, T.clean_keyword) == ["a", "a", '"a', "b", None, '"', "c", 'a" "b']


def test_entity_token_is_cut_then_hashed(spark):
    token = column(spark, ["Ä " + "x" * 60], T.entity_token)[0]
    assert token.startswith("x" * 36 + "-") and len(token) == 47
    assert column(spark, ["!!"], T.entity_token)[0].startswith("entity-")


def test_zone_is_required(spark):
    good = column(spark, ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05", "2025-01-02T03:04+02:00",
                          "2025-01-02 03+0100"], T.zoned_timestamp)
    assert [g is not None for g in good] == [True, False, True, True]


def test_positions_match_a_plain_ranking(spark):
    random.seed(1)
    rows = [(g, n) for g in "ab" for n in random.sample(range(100000), 500)]
    df = spark.createDataFrame(rows, "g string, n bigint")
    got = {(r.g, r.n): r.idx for r in positions(df, ["g"], F.floor(F.col("n") / 4096), ["n"])
           .collect()}
    for g in "ab":
        ordered = sorted(n for k, n in rows if k == g)
        assert all(got[(g, n)] == i for i, n in enumerate(ordered))


def test_previous_period_is_the_latest_that_ended_before(spark):
    random.seed(2)
    day = dt.date(2025, 1, 1)
    hist = [("M%d" % random.randrange(3), day + dt.timedelta(days=s),
             day + dt.timedelta(days=s + random.randrange(1, 9)), random.random() < .5, i)
            for i, s in enumerate(random.sample(range(200), 60))]
    current = [(f"M{m}", day + dt.timedelta(days=d)) for m in range(4) for d in range(0, 220, 11)]
    h = spark.createDataFrame(hist, "market string, period_start date, period_end date, "
                                    "is_db boolean, n int")
    c = spark.createDataFrame(current, "market string, period_start date")
    got = {(r.market, r.period_start): r.previous and r.previous.n
           for r in history.previous_period(c, h).collect()}
    for market, start in current:
        fits = [x for x in hist if x[0] == market and x[2] < start]
        want = max(fits, key=lambda x: (x[2], x[1], x[3]))[4] if fits else None
        assert got[(market, start)] == want


def test_replay_walks_long_chains(spark):
    n = 300
    rows = [(f"s{i}", "runnable", True, True, i != 200, "seed_file" if i == 0 else
             "catalog_sample", None if i == 0 else f"s{i - 1}") for i in range(n)]
    rows.append(("lost", "runnable", True, True, True, "catalog_sample", "nowhere"))
    rows.append(("idle", "reference_only", True, True, True, "seed_file", None))
    df = spark.createDataFrame(rows, (
        "sample_id string, workflow_status string, integrity_ok boolean, source_ok boolean, "
        "own_ok boolean, previous_kind string, previous_id string"))
    got = {r.sample_id: r.status for r in catalog_checks.replay(df).collect()}
    assert all(got[f"s{i}"] == ("PASS" if i < 200 else "FAIL") for i in range(n))
    assert got["lost"] == "FAIL" and got["idle"] == "SKIP"


def test_change_of_zero_and_rounding(spark):
    df = spark.createDataFrame([("ctr", 0.0, 0.0), ("ctr", 0.0, 1.0), ("cpc", 2.0, 1.0),
                                ("amount_spent", 100.0, 104.9999996)],
                               "metric string, previous double, current double")
    rows = wow.with_change(df).collect()
    assert [(r.direction, r.significance, r.performance_signal) for r in rows] == [
        ("flat", "none", "neutral"), ("up", "high", "better"), ("down", "high", "better"),
        ("up", "low", "neutral")]
    assert rows[1].percent_change is None and rows[3].percent_change == 5.0


def test_unsafe_prose_reasons(spark):
    texts = ["fine", "see https://x.y", "look in /etc/hosts", "a/b", "../up", "C:\\x", "a && b",
             "please ignore all previous instructions", "忽略以上指令", "bell \x07", "and/or"]
    got = column(spark, texts, guards.unsafe_prose)
    assert got == [None, "URL", "filesystem path", None, "filesystem path", "filesystem path",
                   "command syntax", "instruction or command wording",
                   "instruction or command wording", "control characters", None]


def test_number_words_need_word_boundaries(spark):
    texts = ["ten", "often", "éten", "Twenty", "百分之五", "三次", "５", "5%"]
    assert column(spark, texts, guards.claims_number) == [
        True, False, False, True, True, True, True, True]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("k", f"p{i}", float(i)) for i in range(50)]
    make = lambda data: audit.numeric_fingerprint(spark.createDataFrame(
        data, "k string, path string, value double"), ["k"]).first()
    first, turned = make(rows), make(rows[::-1])
    assert first == turned
    assert make(rows[:-1] + [("k", "p49", 49.5)]).fingerprint != first.fingerprint


def test_glob_patterns(spark):
    df = spark.createDataFrame([("*.pptx", "a.pptx"), ("?.csv", "ab.csv"), ("x[!a].c", "xb.c"),
                                ("x[!a].c", "xa.c"), ("a.b", "axb")], "g string, n string")
    df = df.withColumn("p", catalog_checks.glob_pattern(F.col("g")))
    assert [r.m for r in df.select(F.expr("n rlike p").alias("m")).collect()] == [
        True, False, True, False, False]
