"""From listings and archives to reports: nothing that is listed gets lost."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tests import golden
from tests.test_weekly import history_frame, profile_frame, raw_frame
from weekloom import fixed
from weekloom.plans import discovery, ingest, weekly
from weekloom.sources import readers

LISTING = ("bundle_id string, file string, path string, length bigint, is_symlink boolean, "
           "is_file boolean")


def csv_bytes(records):
    out = io.StringIO()
    headers = list(records[0])
    csv.writer(out).writerows([headers] + [[r.get(h) for h in headers] for r in records])
    return out.getvalue().encode()


def exports(skip=()):
    return {f"{k}.csv": csv_bytes(v) for k, v in golden.bundle().items() if k not in skip}


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def encrypted(payload):
    """The archive with the flag of encryption set on every member."""
    data = bytearray(payload)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        k = data.find(mark)
        while k >= 0:
            data[k + at] |= 1
            k = data.find(mark, k + 4)
    return bytes(data)


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    full = exports()
    folders = {
        "good": {**full, "notes.txt": b"x", "~$a.csv": b"x", "deep/odd.csv": b"no,header\n1,2\n"},
        "deep": {f"a/{n}" if k % 2 else f"b/c/{n}": v for k, (n, v) in enumerate(full.items())},
        "bad": {"a.csv": b"\xc3\x28", "b.xlsx": b"no workbook"},
        "twice": {**full, "copy.csv": full["keyword.csv"]},
        "short": exports(["creative", "audience"])}
    archives = {
        "flat.zip": zipped({f"x/{n}": v for n, v in full.items()}),
        "inner.zip": zipped({"week.zip": zipped(full), "other.zip": zipped(exports(["keyword"])),
                             "__MACOSX/week.zip": b"x", "read.me": b"x"}),
        "several.zip": zipped({"a.zip": zipped(full), "b.zip": zipped(full)}),
        "locked.zip": zipped({"a.zip": encrypted(zipped(full))}),
        "half.zip": zipped({"a.zip": encrypted(zipped(full)), "b.zip": zipped(full)}),
        "odd.zip": zipped({**full, "odd.csv": b"a,b\n1,2\n"}),
        "broken.zip": b"no archive"}
    for folder, members in folders.items():
        for name, body in members.items():
            target = root / folder / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(body)
    for name, body in archives.items():
        (root / name).write_bytes(body)
    profiles = profile_frame(spark).where("market = 'MARKET A'")
    return ingest.weekly_from_files(spark, str(root), profiles, history_frame(spark))


def name(bundle_id):
    return bundle_id.rsplit("/", 1)[1]


def test_every_bundle_of_the_listing_has_an_outcome(job):
    passed = {name(r.bundle_id) for r in job["verdict"].where("passed").collect()}
    assert passed == {"good", "deep", "flat.zip", "inner.zip", "half.zip"}
    lost = {}
    errors = job["unkeyed"].unionByName(job["source_issues"]).where("severity = 'ERROR'")
    for r in errors.collect():
        lost.setdefault(name(r.bundle_id), set()).add(r.code)
    failed = {name(r.bundle_id) for r in job["verdict"].where("not passed").collect()}
    assert {"bad", "short", "several.zip", "locked.zip", "odd.zip", "broken.zip"} <= set(lost)
    assert failed == {"twice"}
    assert lost["bad"] == {"NO_PROFILE", "MISSING_SOURCE"}
    assert "ARCHIVE_NOT_RESOLVED" in lost["several.zip"] & lost["broken.zip"] & lost["odd.zip"]
    assert {name(r.bundle_id) for r in job["bundles"].collect()} == passed | failed | set(lost)


def test_every_file_has_a_row(job):
    found = {}
    for r in job["discovery"].collect():
        found.setdefault(name(r.bundle_id), {})[r.file] = (r.reason, r.kind)
    good = found["good"]
    assert {f: k for f, (r, k) in good.items() if r is None} == {
        f"{k}.csv": k for k in golden.bundle()}
    assert good["notes.txt"][0] == "unsupported_extension"
    assert good["~$a.csv"][0] == "temporary"
    assert good["deep/odd.csv"][0] == "unrecognized_source"
    assert {r for r, _ in found["bad"].values()} == {"unrecognized_source"}
    assert found["several.zip"]["several.zip"][0] == "several_bundles"
    assert found["locked.zip"]["locked.zip"][0] == "no_bundle"
    assert found["broken.zip"]["broken.zip"][0] == "unreadable_archive"
    assert len(found["inner.zip"]) == len(found["flat.zip"]) == 8
    warned = job["source_issues"].where("code = 'UNRECOGNIZED_SOURCE'").collect()
    assert {(name(r.bundle_id), r.path) for r in warned} == {
        ("bad", "files.a.csv"), ("bad", "files.b.xlsx")}
    assert all(r.message for r in warned)


def test_archives_give_what_rows_give(job, spark):
    same = weekly.weekly_report(raw_frame(spark, {"good": ("MARKET A", golden.bundle())}),
                                profile_frame(spark), history_frame(spark))
    for section in ("overall", "traffic", "keywords", "creative"):
        names = list(fixed.SECTION_FIELDS[section])
        of = lambda facts: sorted(map(str, facts.select(*names).collect()))
        want = of(same["facts"][section])
        for bundle in ("good", "deep", "flat.zip", "inner.zip"):
            assert of(job["facts"][section].where(F.col("bundle_id").endswith("/" + bundle))) == want


def test_each_complete_bundle_has_a_digest(job):
    digests = {name(r.bundle_id): r.source_sha256 for r in job["sources"].collect()}
    assert {"good", "deep", "flat.zip", "inner.zip"} <= set(digests)
    assert "short" not in digests and "twice" not in digests
    import hashlib
    assert digests["inner.zip"] == hashlib.sha256(zipped(exports())).hexdigest()


def test_all_reasons_of_a_supplied_listing(spark):
    rows = [("r", f, f"/r/{f}", n, link, plain) for f, n, link, plain in (
        ("a.csv", 5, False, True), (".hidden.csv", 5, False, True), (".git/x.csv", 5, False, True),
        (".git/y.csv", 5, False, True), ("__MACOSX/x.csv", 5, False, True),
        ("~$b.xlsx", 5, False, True), ("c.tmp", 5, False, True), ("d.csv", 5, True, True),
        ("e.pdf", 5, False, True), ("f.csv", 5, False, False),
        ("g.csv", fixed.MAX_SOURCE_BYTES + 1, False, True))]
    rows += [("many", f"{k}.csv", f"/many/{k}.csv", 1, False, True)
             for k in range(fixed.MAX_CANDIDATE_FILES + 1)]
    rows += [("full", f"{k}.csv", f"/full/{k}.csv", 1, False, True)
             for k in range(fixed.MAX_CANDIDATE_FILES)]
    content = spark.createDataFrame(
        [("/r/a.csv", b"x,y\n1,2\n")] + [(f"/{b}/{k}.csv", b"") for b in ("many", "full")
                                         for k in range(257)], "path string, content binary")
    found = discovery.decoded(discovery.triaged(spark.createDataFrame(rows, LISTING)), content)
    counts = {(r.bundle_id, r.reason): r.n for r in discovery.reason_counts(found["files"]).collect()}
    assert counts == {
        ("r", "hidden_or_system"): 3, ("r", "temporary"): 2, ("r", "symbolic_link"): 1,
        ("r", "unsupported_extension"): 1, ("r", "not_regular_file"): 1,
        ("r", "unrecognized_source"): 2, ("many", "too_many_candidates"): 257,
        ("full", "unrecognized_source"): 256}
    codes = {(r.bundle_id, r.code) for r in discovery.discovery_issues(found).where(
        "severity = 'ERROR'").collect()}
    assert ("many", "TOO_MANY_CANDIDATES") in codes and ("r", "MISSING_SOURCE") in codes


def test_a_listed_file_that_is_gone_is_named(spark):
    listing = spark.createDataFrame([("r", "a.csv", "/r/a.csv", 5, False, True)], LISTING)
    none = spark.createDataFrame([], "path string, content binary")
    row = discovery.decoded(discovery.triaged(listing), none)["files"].first()
    assert (row.file, row.reason, row.detail) == ("a.csv", "unrecognized_source",
                                                  "could not be read")


def test_streams_end_with_one_record_and_flush_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(readers, "BATCH_BYTES", 1000)
    body = "Keyword,Conversions\n" + "".join(f"{'w' * 90},{k}\n" for k in range(300))
    files = spark.createDataFrame([("a.csv", body.encode()), ("b.csv", b""), ("c.tsv", b"\xff"),
                                   ("d.csv", b'"open')], "file string, content binary")
    got = readers.decode_files(files, ["file"]).collect()
    ends = {r.file: (r.error is None, r.n_rows) for r in got if r.record == "file"}
    assert ends == {"a.csv": (True, 301), "b.csv": (True, 0), "c.tsv": (False, 0),
                    "d.csv": (True, 1)}
    probe = list(readers._stream(body.encode(), "a.csv", probe=True))
    assert len(probe) == fixed.HEADER_SCAN_ROWS + 2
