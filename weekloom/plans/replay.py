"""Replay of catalog samples: every sample's week is run against the record that its catalog entry
links to, checked by all rules and compared with its frozen report; then chains are resolved.

Facts of a week do not depend on history, so all samples are run at once whatever their links
are; only the previous record is looked up per sample. A sample whose predecessor does not pass
fails in the last step, as it would if weeks were run one after the other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.issues import verdict
from weekloom.operators import catalog_checks as C
from weekloom.operators import lineage as L
from weekloom.plans.weekly import check_report, report_heads
from weekloom.session import cut
from weekloom.sources import history as H

RECORD = [*H.SEED_FIELDS, "is_db", "source_file"]


def linked_previous(samples: DataFrame, heads: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bundle_id, previous): the record that a sample's link gives it.

    ``samples(sample_id, bundle_id, market, period_start, previous_kind, previous_id)``; a seed
    file's records are ``seeds(previous_id, record fields)``, a linked sample gives the metrics of
    its own week. Only records of the market that end before the week count, the latest of them.
    """
    own = heads.join(samples.select("bundle_id", "sample_id"), "bundle_id").select(
        F.col("sample_id").alias("previous_id"), *H.SEED_FIELDS, F.lit(True).alias("is_db"),
        F.lit("history").alias("source_file"))
    ends = samples.select("bundle_id", "previous_kind", "previous_id", F.col("market").alias(
        "s_market"), F.col("period_start").alias("s_start"))
    found = [ends.where(F.col("previous_kind") == kind).join(records.select(
        "previous_id", F.struct(*RECORD).alias("r")), "previous_id")
        for kind, records in (("catalog_sample", own), ("seed_file", seeds))]
    both = found[0].unionByName(found[1]).where(
        (F.col("r.market") == F.col("s_market")) & (F.col("r.period_end") < F.col("s_start")))
    return both.groupBy("bundle_id").agg(F.max_by("r", F.struct(
        "r.period_end", "r.period_start", "r.is_db")).alias("previous"))


def canonical_values(facts: dict[str, DataFrame], reports: DataFrame) -> DataFrame:
    """(key, path, value, is_history_file): every published value of a report under its path."""
    def tall(df: DataFrame, heads: list[Column], names: list[str]) -> DataFrame:
        fields = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("string").alias("v"))
                           for n in names])
        rows = df.select(*KEY, F.explode(F.array(*heads)).alias("p"), fields.alias("f")).select(
            *KEY, "p", F.explode("f").alias("f"))
        return rows.select(*KEY, F.concat("p", F.lit("."), "f.n").alias("path"),
                           F.col("f.v").alias("value"), F.lit(False).alias("is_history_file"))

    result = tall(reports, [F.lit("report")], ["market", "currency", "report_title"])
    names = ["period_start", "period_end", *fixed.OVERALL_METRICS]
    entry = lambda n, column, file: F.struct(
        F.lit(f"previous_overall.{n}").alias("path"), F.col(f"previous.{column}").cast("string")
        .alias("value"), F.lit(file).alias("is_history_file"))
    flat = reports.where("previous is not null").select(*KEY, F.explode(F.array(
        *[entry(n, n, False) for n in names], entry("file", "source_file", True))).alias("x"))
    result = result.unionByName(flat.select(*KEY, "x.*"))
    for section in fixed.SECTION_FIELDS:
        result = result.unionByName(tall(facts[section], L.prefixes(section)[:1],
                                         list(fixed.SECTION_FIELDS[section])))
    return result


def replay_run(samples: DataFrame, found: dict, facts: dict[str, DataFrame], profiles: DataFrame,
               seeds: DataFrame, goldens: DataFrame) -> DataFrame:
    """``samples`` with ``own_ok``, ``golden_match``, ``status`` and ``reason``.

    Further columns of ``samples``: workflow_status, integrity_ok, source_ok. ``found`` and staged
    ``facts`` are those of the samples' bundles; ``goldens(sample_id, path, value,
    is_history_file)`` holds frozen reports, of as many samples as have one.
    """
    heads = cut(report_heads(facts["overall"], profiles))
    previous = linked_previous(samples, heads, seeds)
    reports = cut(heads.join(previous, "bundle_id", "left").withColumn(
        "previous_market", F.col("previous.market")))
    lineage = cut(L.build_lineage(facts, reports))
    passed = verdict(found["per_kind"], check_report(found, facts, reports, profiles, lineage))
    named = samples.select("bundle_id", "sample_id")
    frozen = goldens.select("sample_id").distinct()
    actual = canonical_values(facts, reports).join(named, "bundle_id").join(
        frozen, "sample_id", "left_semi")
    off = C.golden_diff(actual, goldens, ["sample_id"]).select("sample_id").distinct()
    marks = (samples.join(passed.select("bundle_id", "passed"), "bundle_id", "left")
             .join(frozen.withColumn("frozen", F.lit(True)), "sample_id", "left")
             .join(off.withColumn("off", F.lit(True)), "sample_id", "left"))
    match = F.when(F.col("frozen"), F.col("off").isNull())
    own = F.coalesce("passed", F.lit(False)) & F.coalesce(match, F.lit(True))
    return C.replay(cut(marks.withColumns({"golden_match": match, "own_ok": own}).drop(
        "passed", "frozen", "off")))
