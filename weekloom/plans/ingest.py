"""From a folder of exports to keyed raw rows: one bundle per folder or archive, profile and
period found in the files themselves."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import KEY
from weekloom.functions.text import normalize_header
from weekloom.issues import FIELDS, issue
from weekloom.operators.facts import normalize_text
from weekloom.operators.recognize import bundle_period, match_profiles, recognize, value
from weekloom.plans import discovery as D
from weekloom.plans.weekly import weekly_report
from weekloom.session import cut


def resolved_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """(bundle_id, market, n_profiles): profiles that a bundle's names and pins fit exactly.

    Only profiles of which a pin occurs in a bundle are tried on it, so that no pairs are formed
    that an equality does not give.
    """
    known = profiles.select(F.col("market").alias("profile"), "products")
    pins = known.select("profile", F.explode("products").alias("p")).select(
        "profile", normalize_header(F.col("p.creative_pin")).alias("pin"))
    ads = rows.where("kind = 'creative'").select(
        *KEY, normalize_header(value("Ads")["s"]).alias("normalized"))
    tried = ads.join(pins, ads["normalized"] == pins["pin"]).select(*KEY, "profile").distinct()
    names = rows.where("kind = 'by_product'").select(
        *KEY, normalize_text(value("Name")["s"]).alias("normalized")).where("normalized <> ''")
    fits = match_profiles(names.join(tried, KEY), ads.join(tried, KEY), known).where("matched")
    return fits.groupBy("bundle_id").agg(F.min("profile").alias("market"),
                                         F.count("*").alias("n_profiles"))


def keyed_rows(found: dict[str, DataFrame], profiles: DataFrame
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw rows with full keys, what keeps bundles from having one, what discovery says against
    any bundle); ``found`` as ``decoded`` gives it.

    The period is that of the overall file and the market that of the one fitting profile. The
    bundles are those of the listing, so one in which nothing could be read is here too.
    """
    raw = found["rows"]
    known = recognize(D.provisional(raw))
    period = known["tables"].where("kind = 'overall'").select(
        "bundle_id", F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    agreed = bundle_period(known["tables"]).select("bundle_id", "agreed")
    bundles = cut(found["bundles"]
                  .join(period, "bundle_id", "left").join(agreed, "bundle_id", "left")
                  .join(resolved_profiles(known["rows"], profiles), "bundle_id", "left"))
    good = bundles.where("n_profiles = 1 and start is not null and end is not null")
    keys = cut(good.select("bundle_id", "market", F.col("start").alias("period_start"),
                           F.col("end").alias("period_end")))
    lost = bundles.join(keys.select("bundle_id"), "bundle_id", "left_anti")
    code = (F.when(F.col("n_profiles").isNull(), "NO_PROFILE")
            .when(F.col("n_profiles") > 1, "AMBIGUOUS_PROFILE").otherwise("OVERALL_PERIOD_MISSING"))
    named = lost.select("bundle_id", F.lit("").alias("market"), F.col("start").alias("period_start"),
                        F.col("end").alias("period_end"), "n_profiles", code.alias("code"))
    problems = issue(named, "ERROR", F.col("code"), "profile", actual=F.coalesce(
        "n_profiles", F.lit(0)), expected=F.lit(1)).select(*KEY, *FIELDS)
    said = D.discovery_issues(found).select("bundle_id", *FIELDS)
    # of keyed bundles the report itself says which kinds are missing
    said = named.select(*KEY).join(said, "bundle_id").unionByName(
        keys.join(said.where("code = 'UNRECOGNIZED_SOURCE'"), "bundle_id"))
    rows = raw.join(keys, "bundle_id")
    return (rows.select(*KEY, "file", "sheet", "row_no", "cells"), problems,
            said.select(*KEY, *FIELDS))


def weekly_from_decoded(found: dict[str, DataFrame], profiles: DataFrame, history: DataFrame
                        ) -> dict:
    """The weekly job over decoded files. ``issues`` holds what discovery says against keyed
    bundles too; ``unkeyed`` the bundles left out and why, ``source_issues`` what discovery says
    against these; ``sources`` the digest of each bundle."""
    rows, problems, said = keyed_rows(found, profiles)
    said = cut(said)
    result = weekly_report(cut(rows), profiles, history)
    return {**result, "issues": result["issues"].unionByName(said.where("market <> ''")),
            "unkeyed": cut(problems), "source_issues": said.where("market = ''"),
            "discovery": found["files"], "bundles": found["bundles"],
            "sources": cut(D.bundle_digests(found))}


def weekly_from_files(spark: SparkSession, path: str, profiles: DataFrame, history: DataFrame,
                      listing: DataFrame | None = None, outcomes: DataFrame | None = None,
                      context: str = "") -> dict:
    """The weekly job over a folder: its folders and its archives are the bundles.

    With the ``outcomes`` of earlier runs, bundles whose bytes have not changed since are left
    out before anything of them is decoded. ``context`` names the configuration; a bundle is
    unchanged only under the same one. ``prints`` has the fingerprint of each bundle's bytes.
    """
    content = D.contents(spark, path)
    asked = cut(D.triaged(D.listed(spark, path) if listing is None else listing))
    prints = cut(D.fingerprints(asked, content, context))
    if outcomes is not None:
        same = prints.join(D.changed_bundles(prints, outcomes), "bundle_id", "left_anti")
        asked = cut(asked.join(same, "bundle_id", "left_anti"))
    result = weekly_from_decoded(D.decoded(asked, content), profiles, history)
    return {**result, "prints": prints}
