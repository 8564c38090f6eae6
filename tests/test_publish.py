"""Runs that stop, repeat, mend or collide: what readers see is one committed run."""

import pytest

from tests import golden
from tests.test_discovery import exports
from tests.test_failures import with_spend
from tests.test_weekly import history_frame, profile_frame, raw_frame
from weekloom.plans import discovery, ingest, publish, weekly
from weekloom.sources import readers
from weekloom.sources import versions as V


def run_of(spark, bundles):
    return weekly.weekly_report(raw_frame(spark, bundles), profile_frame(spark),
                                history_frame(spark))


@pytest.fixture(scope="module")
def runs(spark):
    good, bad = golden.bundle(), with_spend("1e20")
    return {"first": run_of(spark, {"a": ("MARKET A", good), "c": ("MARKET C", bad)}),
            "mended": run_of(spark, {"a": ("MARKET A", bad), "c": ("MARKET C", good)})}


def tables(spark, folder):
    return {name: sorted(map(str, publish.stored(spark, folder, name).collect()))
            for name in publish.TABLES}


def test_mended_and_broken_bundles(spark, runs, tmp_path):
    folder = str(tmp_path / "out")
    publish.publish(spark, runs["first"], folder, 1)
    stored = lambda t: publish.stored(spark, folder, t)
    passed = lambda: {r.bundle_id: r.passed for r in stored("outcomes").collect()}
    assert passed() == {"a": True, "c": False}
    assert {r.bundle_id for r in stored("issues").where("severity = 'ERROR'").collect()} == {"c"}
    publish.publish(spark, runs["mended"], folder, 2)
    # market C has no week just before, so only its old errors are gone
    errors = {(r.bundle_id, r.code) for r in stored("issues").where("severity = 'ERROR'").collect()}
    assert ("c", "AMOUNT_OUT_OF_RANGE") not in errors and ("a", "AMOUNT_OUT_OF_RANGE") in errors
    assert passed()["a"] is False
    # what a bundle published is gone with it; history keeps the last record that passed
    assert stored("mart").where("bundle_id = 'a'").count() == 0
    assert stored("reports").where("bundle_id = 'a'").count() == 0
    assert [(r.bundle_id, r.load_ts) for r in stored("records").where("bundle_id = 'a'").collect()
            ] == [("a", 1)]


def test_a_run_that_stops_anywhere_changes_nothing(spark, runs, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    publish.publish(spark, runs["first"], folder, 1)
    before = tables(spark, folder)
    write = V.write
    for stop in range(len(publish.TABLES) + 1):
        count = iter(range(100))

        def stopping(rows, path):
            if next(count) == stop:
                raise OSError("stopped")
            write(rows, path)

        monkeypatch.setattr(V, "write", stopping)
        if stop == len(publish.TABLES):
            monkeypatch.setattr(V, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            publish.publish(spark, runs["mended"], folder, 2)
        assert tables(spark, folder) == before
    monkeypatch.undo()
    publish.publish(spark, runs["mended"], folder, 2)
    after = tables(spark, folder)
    assert after != before
    publish.publish(spark, runs["mended"], folder, 2)
    assert tables(spark, folder) == after


def test_two_bundles_of_one_week_publish_neither(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = golden.bundle()
    publish.publish(spark, run_of(spark, {"x": ("MARKET A", good), "y": ("MARKET A", good)}),
                    folder, 1)
    codes = {(r.bundle_id, r.code) for r in publish.stored(spark, folder, "issues").collect()}
    assert {("x", "DUPLICATE_MARKET_PERIOD"), ("y", "DUPLICATE_MARKET_PERIOD")} <= codes
    assert publish.stored_records(spark, folder).count() == 0


def test_a_newer_commit_is_not_overrun(spark, tmp_path):
    folder = str(tmp_path / "out")
    at = V.state(spark, folder)
    V.commit(spark, folder, at, "r1", 1, {"mart": {"1-2025": "r1"}})
    with pytest.raises(RuntimeError):
        V.commit(spark, folder, at, "r2", 2, {})
    assert V.state(spark, folder) == V.State(1, {"mart": {"1-2025": "r1"}})


def test_unchanged_bundles_are_not_decoded(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "in", str(tmp_path / "out")
    for bundle in ("one", "two"):
        (root / bundle).mkdir(parents=True)
        for name, body in exports(["keyword"] if bundle == "two" else []).items():
            (root / bundle / name).write_bytes(body)
    profiles = profile_frame(spark).where("market = 'MARKET A'")
    job = lambda **more: ingest.weekly_from_files(
        spark, str(root), profiles, history_frame(spark),
        outcomes=publish.stored(spark, folder, "outcomes"), **more)
    publish.publish(spark, job(), folder, 1)
    first = {r.bundle_id.rsplit("/", 1)[1]: r for r in
             publish.stored(spark, folder, "outcomes").collect()}
    assert (first["one"].passed, first["two"].passed) == (True, False)
    assert first["one"].source_sha256 and first["two"].source_sha256 is None
    record = publish.stored_records(spark, folder).first()
    assert record.source_bundle_sha256 == first["one"].source_sha256
    asked = []
    decode = readers.decode_files
    monkeypatch.setattr(readers, "decode_files", lambda files, *a: asked.append(
        sorted({r.bundle_id.rsplit("/", 1)[1] for r in files.select("bundle_id").collect()}))
        or decode(files, *a))
    before = tables(spark, folder)
    again = job()
    assert asked == [[]] and again["bundles"].count() == 0
    publish.publish(spark, again, folder, 2)
    assert tables(spark, folder) == before
    (root / "two" / "keyword.csv").write_bytes(exports()["keyword.csv"])
    publish.publish(spark, job(), folder, 3)
    assert asked[1:] == [["two"]]
    outcomes = publish.stored(spark, folder, "outcomes")
    asked_now = discovery.triaged(discovery.listed(spark, str(root)))
    for context, changed in (("", 0), ("new profiles", 2)):
        prints = discovery.fingerprints(asked_now, discovery.contents(spark, str(root)), context)
        assert discovery.changed_bundles(prints, outcomes).count() == changed
