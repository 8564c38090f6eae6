"""The whole weekly job over a good bundle and one mutation per issue code."""

import datetime as dt
import io
import csv

import pytest
from pyspark.sql import functions as F

from tests import golden
from weekloom import KEY, fixed
from weekloom.checks.output_checks import workbook_bytes
from weekloom.operators import facts as A
from weekloom.operators import marts
from weekloom.plans import weekly
from weekloom.sources import readers
from weekloom.sources.history import upsert

START, END = dt.date(2025, 1, 6), dt.date(2025, 1, 12)
RAW = ("bundle_id string, market string, period_start date, period_end date, file string, "
       "sheet string, row_no bigint, cells array<struct<s:string,t:string>>")


def raw_frame(spark, bundles):
    rows = []
    for bundle_id, (market, kinds) in bundles.items():
        for kind, records in kinds.items():
            headers = list(records[0])
            table = [headers] + [[r.get(h) for h in headers] for r in records]
            for n, record in enumerate(table, start=2):
                rows.append((bundle_id, market, START, END, f"{kind}.csv", "CSV", n,
                             [(v, "s") for v in record]))
    return spark.createDataFrame(rows, RAW)


def profile_frame(spark):
    products = [{"id": n.lower(), "display_name": f"PRODUCT {n}", "aliases": [f"PRODUCT {n}"],
                 "creative_pin": f"CREATIVE-{i}-0", "creative_asset": None}
                for i, n in enumerate(golden.NAMES)]
    rows = [(m, "1.0.0", "v1", "R", "USD", "T", 8, products, .01, .01, True, True, True, True)
            for m in ("MARKET A", "MARKET B", "MARKET C")]
    return A.prepare_profiles(spark.createDataFrame(rows, (
        "market string, schema_version string, template_version string, country_label string, "
        "currency string, report_title string, keyword_top_n int, products array<struct<"
        "id:string,display_name:string,aliases:array<string>,creative_pin:string,"
        "creative_asset:string>>, money_tolerance double, ratio_tolerance double, "
        "required_for_comparison boolean, require_all_three_products boolean, "
        "fail_on_missing_creative_metric boolean, fail_on_period_mismatch boolean")))


def history_frame(spark):
    week = dt.timedelta(days=7)
    metrics = [2800.0, 4900.0, 1.75, 33, 170, 84.8, 16.5, 10600, 1.06, 1.6]
    rows = [("MARKET A", START - week, END - week, *metrics, False, "seed.json"),
            ("MARKET A", START - 2 * week, END - 2 * week, *metrics, True, "history"),
            ("MARKET C", START - 3 * week, END - 3 * week, *metrics, True, "history")]
    return spark.createDataFrame(rows, (
        "market string, period_start date, period_end date, amount_spent double, "
        "purchase_value double, purchase_roas double, purchases bigint, adds_to_cart bigint, "
        "cost_per_purchase double, cost_per_add_to_cart double, link_clicks bigint, ctr double, "
        "add_to_cart_rate double, is_db boolean, source_file string"))


@pytest.fixture(scope="module")
def result(spark):
    raw = raw_frame(spark, golden.all_bundles())
    return weekly.weekly_report(raw, profile_frame(spark), history_frame(spark))


def codes_by_bundle(result):
    found = {}
    for row in result["issues"].select("bundle_id", "code").distinct().collect():
        found.setdefault(row.bundle_id, set()).add(row.code)
    return found


def test_good_bundle_passes_and_only_it(result):
    passed = {r.bundle_id for r in result["verdict"].where("passed").collect()}
    assert passed == {"good"}
    assert "good" not in codes_by_bundle(result)


def test_every_mutation_raises_its_code(result):
    found = codes_by_bundle(result)
    lacking = [code for code in golden.all_bundles() if code != "good"
               and code not in found.get(code, set())]
    assert lacking == []


def test_facts_of_the_good_bundle(result):
    facts = {n: f.where("bundle_id = 'good'") for n, f in result["facts"].items()}
    overall = facts["overall"].first()
    assert overall.amount_spent == 3000.0 and overall.link_clicks == 1500
    assert overall.add_to_cart_rate == pytest.approx(140 / 1500 * 100)
    days = facts["daily"].orderBy("idx").collect()
    assert [d.day.day for d in days] == list(range(6, 13))
    assert [r.product_id for r in facts["traffic"].orderBy("idx").collect()] == [
        "gamma", "beta", "alpha"]
    assert {r.purchases for r in facts["traffic"].collect()} == {None}
    words = facts["keywords"].orderBy("rank").collect()
    assert [(w.keyword, w.conversions) for w in words[:4]] == [
        ("word 4", 5.0), ("word 9", 5.0), ("word 3", 4.0), ("word 8", 4.0)]


def test_lineage_points_to_cells(result):
    rows = {r.target: r for r in result["lineage"].where("bundle_id = 'good'").collect()}
    spent = rows["current_overall.amount_spent"].sources[0]
    assert (spent.cell, spent.raw_value, spent.file) == ("C3", "$3,000.00", "overall.csv")
    assert len(rows["current_overall.add_to_cart_rate"].sources) == 2
    assert rows["keywords.0.keyword"].transform == fixed.UNQUOTE
    assert rows["previous_overall.ctr"].sources[0].source_kind == "history_seed"
    # 13 previous fields, 12 overall, 7 days x 6, and all rows of the other sections
    assert len(rows) == 13 + 12 + 42 + 3 * (7 + 7 + 16 + 12 + 12 + 6) + 8 * 5


def test_canonical_report_nests_children_in_order(result, spark):
    facts = {n: f.where("bundle_id = 'good'") for n, f in result["facts"].items()}
    report = marts.canonical_report(facts, result["reports"].where("bundle_id = 'good'")).first()
    assert len(report.daily) == 7 and report.daily[0].day == START
    assert [p.product_id for p in report.product_analyses] == ["alpha", "beta", "gamma"]
    assert report.product_analyses[1].creative.ad_name == "Creative-1-0"
    assert report.previous_overall.purchases == 33


def test_result_does_not_depend_on_row_order_or_partitions(spark, result):
    few = {k: v for k, v in golden.all_bundles().items() if k in ("good", "CLICK_RECONCILIATION")}
    raw = raw_frame(spark, few).orderBy(F.rand(seed=7)).repartition(7)
    again = weekly.weekly_report(raw, profile_frame(spark), history_frame(spark))
    pick = lambda df: sorted(map(tuple, df.where(
        F.col("bundle_id").isin(list(few))).select("bundle_id", "code", "path").collect()))
    assert pick(again["issues"]) == pick(result["issues"])


def test_files_on_disk_become_raw_rows(spark, tmp_path):
    kinds = golden.bundle()
    folder = tmp_path / "in"
    folder.mkdir()
    for kind in ("overall", "by_day"):
        out = io.StringIO()
        headers = list(kinds[kind][0])
        csv.writer(out).writerows([headers] + [[r[h] for h in headers] for r in kinds[kind]])
        (folder / f"{kind}.csv").write_text(out.getvalue(), encoding="utf-16")
    cells = "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(2))
    (folder / "book.xlsx").write_bytes(workbook_bytes({"S": {1: cells}}, ["Keyword", "Cost"]))
    files = readers.list_files(spark, str(folder))
    assert files.count() == 3
    rows = readers.read_delimited(files.where("path like '%.csv'"), ["path"])
    days = rows.where("path like '%by_day%'").orderBy("row_no").collect()
    assert len(days) == 8 and days[1].cells[0].s == "2025-01-12"
    book = readers.read_workbooks(files.where("path like '%.xlsx'"), ["path"]).first()
    assert [c.s for c in book.cells] == ["Keyword", "Cost"] and book.sheet == "S"


def test_history_commit_replaces_only_touched_markets(spark, tmp_path):
    from weekloom.sources.history import commit
    path = str(tmp_path / "history")
    schema = "market string, period_start date, period_end date, load_ts bigint, spent double"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    commit(spark, path, frame(("A", START, END, 1, 1.0), ("B", START, END, 1, 2.0)))
    commit(spark, path, frame(("A", START, END, 2, 3.0)))
    commit(spark, path, frame(("A", START, END, 1, 9.0)))
    kept = {r.market: r.spent for r in spark.read.parquet(path).collect()}
    assert kept == {"A": 3.0, "B": 2.0}
    assert upsert(frame(), frame()).columns == schema.replace(" string", "").replace(
        " date", "").replace(" bigint", "").replace(" double", "").split(", ")


def test_key_is_carried_everywhere(result):
    for frame in (*result["facts"].values(), result["lineage"], result["issues"]):
        assert set(KEY) <= set(frame.columns)
