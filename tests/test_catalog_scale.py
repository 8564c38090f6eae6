"""Joins of the catalog checks: rows without a key stay out, no side is sent to the driver."""

from weekloom.operators import catalog_checks as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LINK = "struct<kind:string,sample_id:string,path:string,sha256:string>"


def test_integrity_joins_are_not_broadcast(spark):
    refs = spark.createDataFrame(
        [("a", "approved", "source", ("file", None), "f/1", "0" * 64),
         ("b", "candidate", "source", None, None, None),
         ("c", "candidate", "source", ("file", None), "f/2", None)],
        "sample_id string, review_status string, role string, "
        "ref struct<kind:string,member_name:string>, path string, expected string")
    inventory = spark.createDataFrame([("f/1", "1" * 64)], "path string, sha256 string")
    found = C.asset_issues(refs, inventory)
    assert sorted(map(tuple, found.collect())) == [
        ("a", "SOURCE_HASH_MISMATCH"), ("b", "MISSING_SOURCE_REF"), ("c", "MISSING_SOURCE")]
    assert "Broadcast" not in plan(found)


def test_archives_that_cannot_be_read(spark, tmp_path):
    """Zip files, one cut short, one with a spoiled member and one that is none: a reference into
    these has one code more and no check of its members; as a plain file or whole they pass."""
    import hashlib
    import io
    import zipfile

    from weekloom.sources import inventory as I

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("a.txt", "some text that stands in the archive as it is")
    good = made.getvalue()
    payloads = {"good.zip": good, "cut.zip": good[:-30], "none.zip": b"no archive",
                "spoiled.zip": good.replace(b"some", b"sOme", 1)}
    stamp = "path string, length bigint, modified timestamp, content binary"
    known = I.scanned(spark.createDataFrame(
        [(p, len(b), None, b) for p, b in payloads.items()], stamp)).cache()
    files = known.where("member is null and sha256 is not null")
    members = known.where("member is not null or problem is not null").selectExpr(
        "path", "member as name", "sha256 as digest", "problem")
    digest = hashlib.sha256(b"some text that stands in the archive as it is").hexdigest()
    refs = []
    for path, role in zip([*payloads, "gone.zip"], ["deck", "deck", "source", "deck", "deck"]):
        for kind in ("archive_member", "archive_member_set", "archive", "file"):
            refs.append((f"{path} {kind}", "candidate", role, (
                kind, "a.txt", digest, ["*.txt"], [digest]), path, None))
    refs = spark.createDataFrame(
        refs, "sample_id string, review_status string, role string, ref struct<kind:string,"
        "member_name:string,member_sha256:string,selectors:array<string>,"
        "member_sha256s:array<string>>, path string, expected string")
    broken = C.unreadable(members)
    packed = C.readable(refs, broken)
    found = C.asset_issues(refs, files, broken)
    every = found.unionByName(C.member_issues(packed, members)).unionByName(
        C.member_set_issues(packed, members))
    codes = sorted(tuple(r) for r in every.collect() if not r.sample_id.startswith("gone"))
    assert codes == sorted(
        (f"{path} {kind}", f"INVALID_{role}_ARCHIVE") for path, role in
        (("cut.zip", "DECK"), ("none.zip", "SOURCE"), ("spoiled.zip", "DECK"))
        for kind in ("archive_member", "archive_member_set"))
    assert {r.code for r in found.collect() if r.sample_id.startswith("gone")} == {"MISSING_DECK"}
    assert "Broadcast" not in plan(found)


def test_links_are_not_broadcast(spark):
    day = "date'2024-01-01'"
    samples = spark.sql(f"""
        select id as sample_id, 'M' as market, {day} + n as period_start, {day} + n + 6 as period_end,
               'approved' as review_status, 'runnable' as workflow_status,
               cast(p as {LINK}) as previous_source
        from values ('a', 0, named_struct('kind', 'seed_file', 'sample_id', null, 'path', 's',
                     'sha256', 'x')),
                    ('b', 7, named_struct('kind', 'catalog_sample', 'sample_id', 'a', 'path', null,
                     'sha256', null)),
                    ('c', 9, named_struct('kind', 'catalog_sample', 'sample_id', 'a', 'path', null,
                     'sha256', null)),
                    ('d', 0, named_struct('kind', 'catalog_sample', 'sample_id', null, 'path', 's',
                     'sha256', null)),
                    ('e', 0, null) as t(id, n, p)""")
    seeds = spark.createDataFrame([("s", "0" * 64)], "path string, sha256 string")
    found = C.previous_issues(samples, seeds)
    assert sorted(map(tuple, found.collect())) == [
        ("a", "INVALID_PREVIOUS_SEED_SHA256"), ("c", "PREVIOUS_SAMPLE_NOT_ADJACENT"),
        ("d", "PREVIOUS_SAMPLE_MISSING"), ("e", "MISSING_PREVIOUS_SOURCE")]
    assert "Broadcast" not in plan(found)


def test_replay_is_not_broadcast(spark):
    rows = [(k, "runnable", True, True, True, "seed_file" if k == "a" else "catalog_sample", p)
            for k, p in (("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", None))]
    samples = spark.createDataFrame(
        rows, "sample_id string, workflow_status string, integrity_ok boolean, "
        "source_ok boolean, own_ok boolean, previous_kind string, previous_id string")
    found = C.replay(samples)
    assert sorted((r.sample_id, r.status) for r in found.collect()) == [
        ("a", "PASS"), ("b", "PASS"), ("c", "FAIL"), ("d", "FAIL"), ("e", "FAIL")]
    assert "Broadcast" not in plan(found)


def test_bundles_of_one_kind_are_ranked_once(spark):
    """Two hundred bundles of one market, token and folder make one window's worth of decks; a
    bundle that stands twice keeps the better score of a deck."""
    bundles = spark.createDataFrame(
        [("m", k, "f", "t") for k in range(200)] + [("m", 0, "g", "u"), ("m", 300, None, None)],
        "market string, bundle_id long, folder string, token string")
    decks = spark.createDataFrame(
        [("m", 1, "f", "x", ["t"], ["t"]), ("m", 2, "g", "x", ["u"], ["u"]),
         ("m", 3, "g", "m x", [], ["t", "u"])],
        "market string, deck_id long, folder string, file_name string, primary array<string>, "
        "visible array<string>")
    found = C.pair_candidates(bundles, decks)
    rows = {(r.bundle_id, r.place): (r.deck_id, r.score, r.auto_pair) for r in found.collect()}
    for k in range(1, 200):
        assert [rows[k, p] for p in (1, 2, 3)] == [(1, 120, True), (3, 50, False), (2, 0, False)]
    assert [rows[0, p] for p in (1, 2, 3)] == [(1, 120, False), (2, 120, False), (3, 70, False)]
    assert [rows[300, p] for p in (1, 2, 3)] == [(3, 10, False), (1, 0, False), (2, 0, False)]
    assert len(rows) == 603
    # the decks of the pools meet market, token and folder, and no bundle
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n")
             if "bundle_id" in x and "hit" in x]
    assert not joins
