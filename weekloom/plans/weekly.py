"""The weekly job: raw rows to facts, issues, verdicts and change facts for all bundles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.issues import publishable, verdict
from weekloom.operators import facts as A
from weekloom.operators import lineage as L
from weekloom.operators import rules as U
from weekloom.operators import wow as X
from weekloom.operators.recognize import recognize
from weekloom.session import cut, cut_all
from weekloom.sources.history import previous_period

REPORT_FIELDS = ["schema_version", "template_version", "country_label", "currency",
                 "report_title"]


def report_heads(overall: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per bundle: configuration texts and overall metrics."""
    first = overall.groupBy(*KEY).agg(F.min_by(F.struct(
        F.col("source_start").alias("overall_start"), F.col("source_end").alias("overall_end"),
        *fixed.OVERALL_METRICS), "row_no").alias("o")).select(*KEY, "o.*")
    config = profiles.select("market", *REPORT_FIELDS)
    return first.join(config, "market").withColumns({
        "config_market": F.col("market"), "overall_market": F.col("market")})


def report_rows(overall: DataFrame, profiles: DataFrame, history: DataFrame) -> DataFrame:
    """One row per bundle: its head and the previous record."""
    return previous_period(report_heads(overall, profiles), history).withColumn(
        "previous_market", F.when(F.col("previous").isNotNull(), F.col("market")))


def staged_issues(*parts: DataFrame, groups: int = 6) -> DataFrame:
    """All parts, written in a few groups at once: one plan of every rule would take longest."""
    chunks = {k: U.union_issues(*parts[k::groups]) for k in range(min(groups, len(parts)))}
    return U.union_issues(*cut_all(chunks).values())


def check_report(found: dict, facts: dict, reports: DataFrame, profiles: DataFrame,
                 lineage: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """All issues of all bundles: reading problems and every reconciliation rule.

    ``asked`` holds the profiles as given, ``profiles`` those that can be used.
    """
    products = A.dim_product(profiles)
    sums = cut(U.measures(facts))
    w = cut(U.wide(sums, reports, profiles))
    bundles = found["per_kind"]
    return staged_issues(
        U.profile_rules(bundles, profiles if asked is None else asked),
        U.report_rules(bundles, reports), U.amount_rules(sums), A.reading_issues(found, facts, profiles), U.metadata_rules(reports, profiles),
        U.source_rules(reports, found["tables"], profiles), U.history_rules(reports, profiles),
        U.coverage_rules(w), U.daily_sum_rules(w), U.product_sum_rules(w), U.cart_rate_rules(w),
        U.product_set_rules(w, facts, products), U.total_rules(w),
        U.cross_view_rules(sums, reports, profiles, products),
        U.creative_rules(facts["creative"], profiles, products),
        U.keyword_rules(facts["keywords"], reports, profiles),
        U.lineage_rules(L.expected_targets(facts, reports), lineage))


def weekly_report(raw: DataFrame, profiles: DataFrame, history: DataFrame,
                  vendor: str | None = None) -> dict:
    """Facts, reports, lineage, issues and verdicts; ``profiles`` as ``prepare_profiles`` gives.

    ``vendor`` names the header that exports of that vendor use for the average value.

    Stages that several later ones read are written once and read back.
    """
    found = recognize(raw)
    asked, profiles = profiles, U.single_profiles(profiles)
    facts = cut_all(A.build_facts(found, profiles, vendor))
    reports = cut(report_rows(facts["overall"], profiles, history))
    lineage = cut(L.build_lineage(facts, reports))
    issues = check_report(found, facts, reports, profiles, lineage, asked)
    return {"found": found, "facts": facts, "reports": reports, "lineage": lineage,
            "issues": issues, "verdict": verdict(found["per_kind"], issues)}


def snapshot_pairs(reports: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Published reports with the latest published snapshot before them, and the gate.

    ``stored`` holds key and currency of snapshots from earlier runs.
    """
    snapshots = reports.select("market", "period_start", "period_end", "bundle_id", "currency",
                               F.lit(True).alias("is_db"))
    if stored is not None:
        snapshots = snapshots.unionByName(stored.select(
            "market", "period_start", "period_end", "bundle_id", "currency",
            F.lit(False).alias("is_db")))
    found = previous_period(reports.drop("previous", "previous_market"), snapshots)
    found = found.withColumn("previous", F.when(
        F.col("previous").isNotNull(), F.struct("market", "previous.*")))
    return X.gate(found)


def change_report(result: dict, stored: DataFrame | None = None,
                  earlier: DataFrame | None = None) -> DataFrame:
    """Change facts of publishable bundles whose previous week was published too.

    ``stored`` and ``earlier`` are snapshots of earlier runs and their entities.
    """
    reports = publishable(result["reports"], result["issues"])
    pairs = snapshot_pairs(reports, stored).where("status = 'available'").select(
        *KEY, "currency", F.col("previous.bundle_id").alias("prev_bundle_id"))
    facts = result["facts"]
    names = facts["summary"].select(*KEY, "product_id", "display_name")
    rows = X.entities(facts)
    if earlier is not None:
        # a bundle of this run counts with its rows of this run
        rows = rows.unionByName(earlier.join(reports.select("bundle_id"), "bundle_id",
                                             "left_anti"))
    return X.change_facts(cut(rows), cut(pairs), names)
