"""Where every published value came from, one row per target."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import KEY, fixed
from weekloom.functions.numbers import cell_reference

TRANSFORMS = {("campaign", "purchase_rate"): fixed.TIMES_100,
              ("campaign", "add_to_cart_rate"): fixed.TIMES_100,
              ("keywords", "keyword"): fixed.UNQUOTE}


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def prefixes(section: str) -> list[Column]:
    """Target paths of a fact row, without the field."""
    idx = _text("idx")
    at = lambda head, tail="": F.concat(F.lit(head), idx, F.lit(tail))
    return {
        "overall": [F.lit("current_overall")], "daily": [at("daily.")],
        "summary": [at("product_summaries."), at("product_analyses.", ".summary")],
        "campaign": [at("product_analyses.", ".campaign")],
        "creative": [at("product_analyses.", ".creative")],
        "traffic": [at("traffic.")], "audience": [at("audience.")],
        "keywords": [F.concat(F.lit("keywords."), (F.col("rank") - 1).cast("string"))],
    }[section]


def source_cell(cell: Column) -> Column:
    return F.struct(F.lit("bundle").alias("source_kind"), F.col("file"), F.col("sheet"),
                    F.col("row_no").alias("row"), cell["col"].cast("bigint").alias("column"),
                    cell_reference(cell["col"], F.col("row_no")).alias("cell"),
                    cell["header"].alias("header"), cell["s"].alias("raw_value"))


def section_lineage(facts: DataFrame, section: str) -> DataFrame:
    """Each field of each fact row with the cells it was read from, which the row carries."""
    fields = list(fixed.SECTION_FIELDS[section])
    entries = [(name, TRANSFORMS.get((section, name), fixed.IDENTITY), [at])
               for at, name in enumerate(fields)]
    if section == "overall":
        place = {name: at for at, name in enumerate(fields)}
        entries += [("add_to_cart_rate", fixed.CART_RATE,
                     [place["adds_to_cart"], place["link_clicks"]]),
                    ("period_start", fixed.ISO_DATE, [len(fields)]),
                    ("period_end", fixed.ISO_DATE, [len(fields) + 1])]
    plan = F.array(*[F.struct(
        F.lit(name).alias("field"), F.lit(transform).alias("transform"),
        F.array(*[F.lit(at) for at in places]).alias("places"))
        for name, transform, places in entries])
    placed = facts.select(*KEY, "file", "sheet", "row_no", "cells",
                          F.explode(F.array(*prefixes(section))).alias("p"))
    spread = placed.withColumn("e", F.explode(plan)).withColumn(
        "picked", F.transform("e.places", lambda at: F.get("cells", at)))
    return spread.select(*KEY, F.concat("p", F.lit("."), "e.field").alias("target"),
                         F.col("e.transform").alias("transform"),
                         F.transform("picked", source_cell).alias("sources"))


def history_lineage(reports: DataFrame) -> DataFrame:
    """The previous record's fields point to the history row they came from."""
    names = ["market", "period_start", "period_end", *fixed.OVERALL_METRICS]
    present = reports.where("previous is not null")
    raw = {n: F.col(f"previous.{n}" if n != "market" else "market").cast("string")
           for n in names}
    absent = F.lit(None)
    items = F.array(*[F.struct(
        F.lit(n).alias("field"),
        F.array(F.struct(
            F.when(F.col("previous.is_db"), "history_db").otherwise("history_seed")
            .alias("source_kind"),
            F.col("previous.source_file").alias("file"), absent.cast("string").alias("sheet"),
            absent.cast("bigint").alias("row"), absent.cast("bigint").alias("column"),
            absent.cast("string").alias("cell"), F.lit(n).alias("header"),
            raw[n].alias("raw_value"))).alias("sources")) for n in names])
    return present.select(*KEY, F.explode(items).alias("e")).select(
        *KEY, F.concat(F.lit("previous_overall."), "e.field").alias("target"),
        F.lit(fixed.FROM_HISTORY).alias("transform"), F.col("e.sources").alias("sources"))


def build_lineage(facts: dict[str, DataFrame], reports: DataFrame) -> DataFrame:
    """Lineage of all sections: facts are unpivoted, nothing is joined or shuffled."""
    result = history_lineage(reports)
    for section in fixed.SECTION_FIELDS:
        result = result.unionByName(section_lineage(facts[section], section))
    return result


def expected_targets(facts: dict[str, DataFrame], reports: DataFrame) -> DataFrame:
    """(key, target) of every value that a report publishes."""
    def targets(df, heads, names):
        spread = df.select(*KEY, F.explode(F.array(*heads)).alias("p"))
        spread = spread.withColumn("f", F.explode(F.array(*[F.lit(n) for n in names])))
        return spread.select(*KEY, F.concat("p", F.lit("."), "f").alias("target"))

    dates = ["period_start", "period_end"]
    result = targets(reports, [F.lit("current_overall")], [*dates, *fixed.OVERALL_METRICS])
    result = result.unionByName(targets(
        reports.where("previous is not null"), [F.lit("previous_overall")],
        [*dates, *fixed.OVERALL_METRICS]))
    for section, fields in fixed.SECTION_FIELDS.items():
        if section != "overall":
            heads = prefixes(section)[:1]
            result = result.unionByName(targets(facts[section], heads, list(fields)))
    return result
