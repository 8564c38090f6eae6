"""Strict reading of report configurations: JSON texts to typed profiles, every problem a row.

A text becomes one VARIANT value; its objects are taken apart as maps of variants, so a key that
no model knows is found like a missing one. Values are taken as a lenient reader takes them: text
that spells a number or a truth value counts as one, a number never counts as text. A configuration
with a problem gives no profile.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.text import casefold, strip
from weekloom.session import cut


class Field(NamedTuple):
    """The kind of a value; ``default`` is its text if the key may be left out."""

    kind: str
    default: str | None = None
    optional: bool = False


REQUIRED = Field("text")
MODELS = {
    "": {"schema_version": Field("text", "1.0.0", True), "template_version": REQUIRED,
         "market": REQUIRED, "country_label": REQUIRED, "currency": REQUIRED,
         "report_title": REQUIRED, "keyword_top_n": Field("integer", "8", True),
         "products": Field("array"), "history": Field("object", None, True),
         "quality": Field("object", None, True)},
    "products": {"id": REQUIRED, "display_name": REQUIRED, "aliases": Field("array"),
                 "creative_pin": REQUIRED, "creative_asset": Field("text or null", None, True)},
    "history": {"database": Field("text", "history/report_history.sqlite3", True),
                "seed_file": Field("text or null", None, True),
                "required_for_comparison": Field("boolean", "true", True)},
    "quality": {"money_tolerance": Field("number", "0.01", True),
                "ratio_tolerance": Field("number", "0.01", True),
                "require_all_three_products": Field("boolean", "true", True),
                "fail_on_missing_creative_metric": Field("boolean", "true", True),
                "fail_on_period_mismatch": Field("boolean", "true", True)}}
TRUE, FALSE = ["1", "on", "t", "true", "y", "yes"], ["0", "off", "f", "false", "n", "no"]
OBJECT = "map<string,variant>"
#: the head of a variant's schema: its kind
KINDS = {"STRING": "text", "BOOLEAN": "boolean", "BIGINT": "integer", "DOUBLE": "number",
         "DECIMAL": "number", "FLOAT": "number", "VOID": "null", "ARRAY": "array",
         "OBJECT": "object"}
NUMERIC = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def kind_of(v: Column) -> Column:
    """text, integer, number, boolean, null, array or object; null where there is no value."""
    head = F.regexp_extract(F.schema_of_variant(v), r"\A([A-Z]+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), head)


def opened(v: Column) -> Column:
    """A variant with what it says: ``struct<v, kind, raw, low>``."""
    raw = F.try_variant_get(v, "$", "string")
    return F.struct(v.alias("v"), kind_of(v).alias("kind"), raw.alias("raw"),
                    F.lower(strip(raw)).alias("low"))


def opened_map(v: Column) -> Column:
    """The members of an object, each opened; null for anything else."""
    return F.transform_values(F.try_variant_get(v, "$", OBJECT), lambda _, x: opened(x))


def number_of(cell: Column) -> Column:
    written = F.when(cell["low"].rlike(NUMERIC), cell["low"])
    return F.when(cell["kind"].isin("text", "integer", "number"), written.try_cast("double"))


def boolean_of(cell: Column) -> Column:
    spelled = F.when(cell["kind"].isin("text", "boolean", "integer"), cell["low"])
    return F.when(spelled.isin(TRUE), True).when(spelled.isin(FALSE), False)


def fits(cell: Column, kind: str) -> Column:
    """Whether a value that is there is of a kind."""
    if kind == "text or null":
        return cell["kind"].isin("text", "null")
    if kind == "number":
        return number_of(cell).isNotNull()
    if kind == "integer":
        return F.coalesce(number_of(cell) % 1 == 0, F.lit(False))
    if kind == "boolean":
        return boolean_of(cell).isNotNull()
    return cell["kind"] == kind


def problem(name: Column, what: str, value: Column | None = None) -> Column:
    value = F.lit(None) if value is None else value
    return F.struct(name.alias("name"), F.lit(what).alias("problem"),
                    value.cast("string").alias("value"))


def problems_of(rows: DataFrame, model: str, prefix: Column) -> DataFrame:
    """(profile, path, problem, value) of objects ``m``, a map of opened values, of one model."""
    fields = MODELS[model]
    m = F.col("m")
    found = []
    for name, field in fields.items():
        cell, there = F.try_element_at(m, F.lit(name)), F.map_contains_key(m, name)
        absent = F.lit(False) if field.optional else ~there
        found.append(F.when(absent, problem(F.lit(name), "missing_key")).when(
            there & ~F.coalesce(fits(cell, field.kind), F.lit(False)),
            problem(F.lit(name), "wrong_type", cell["kind"])))
    unknown = F.transform(F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in fields])),
                          lambda k: problem(k, "unknown_key"))
    every = F.concat(F.array_compact(F.array(*found)), unknown)
    return rows.select("profile", prefix.alias("prefix"), F.explode(every).alias("p")).select(
        "profile", F.concat("prefix", "p.name").alias("path"), "p.problem", "p.value")


def parsed(configs: DataFrame) -> DataFrame:
    """(profile, m): the outer object of each ``configs(profile, text)``; null if it is none."""
    return configs.select("profile", F.try_parse_json("text").alias("v")).select(
        "profile", opened_map(F.col("v")).alias("m"))


def part(rows: DataFrame, name: str) -> DataFrame:
    """The objects under one key of the outer object."""
    return rows.select("profile", F.try_element_at("m", F.lit(name))["v"].alias("v")).select(
        "profile", opened_map(F.col("v")).alias("m")).where("m is not null")


def items(rows: DataFrame, name: str, *kept: str) -> DataFrame:
    """(profile, kept, at, kind, m): the elements of an array; ``m`` is null for what is no object."""
    v = F.try_element_at("m", F.lit(name))["v"]
    return rows.select("profile", *kept, F.posexplode(F.try_variant_get(v, "$", "array<variant>"))
                       .alias("at", "v")).select("profile", *kept, "at", F.coalesce(
                           kind_of(F.col("v")), F.lit("null")).alias("kind"),
                           opened_map(F.col("v")).alias("m"))


def value_of(name: str, field: Field, m: str = "m") -> Column:
    """The value under a key, or its default, in the type of its kind."""
    cell = F.try_element_at(m, F.lit(name))
    read = {"number": number_of(cell), "integer": number_of(cell).try_cast("int"),
            "boolean": boolean_of(cell)}.get(field.kind, cell["raw"])
    kind = {"number": "double", "integer": "int", "boolean": "boolean"}.get(field.kind, "string")
    return F.coalesce(read, F.lit(field.default).cast(kind)).alias(name)


def config_problems(configs: DataFrame) -> DataFrame:
    """(profile, path, problem, value) of ``configs(profile, text)``."""
    every = cut(parsed(configs))
    rows = every.where("m is not null")
    goods = items(rows, "products")
    at = lambda tail="": F.concat(F.lit("products."), F.col("at").cast("string"),
                                  F.lit(tail))
    objects = goods.where("m is not null")
    words = items(objects.withColumnRenamed("at", "product"), "aliases", "product")
    named = objects.select("profile", F.try_element_at("m", F.lit("id"))["raw"].alias("id"), strip(
        casefold(F.try_element_at("m", F.lit("creative_pin"))["raw"])).alias("pin"))
    top = F.try_element_at("m", F.lit("keyword_top_n"))

    def twice(column, what):
        return named.where(F.col(column).isNotNull()).groupBy(
            "profile", F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(
            "profile", F.lit("products").alias("path"), F.lit(what).alias("problem"), "value")

    def one(df, path, what, value):
        return df.select("profile", path.alias("path"), F.lit(what).alias("problem"),
                         value.cast("string").alias("value"))

    parts = [
        one(every.where("m is null"), F.lit(""), "no_object", F.lit(None)),
        problems_of(rows, "", F.lit("")),
        problems_of(part(rows, "history"), "history", F.lit("history.")),
        problems_of(part(rows, "quality"), "quality", F.lit("quality.")),
        problems_of(objects, "products", at(".")),
        one(goods.where("m is null"), at(), "wrong_type", F.col("kind")),
        one(words.where("kind <> 'text'").withColumn("at", F.col("product")), at(".aliases"),
            "wrong_type", F.col("kind")),
        twice("id", "duplicate_product_id"), twice("pin", "duplicate_creative_pin"),
        one(rows.where((number_of(top) < 1) | (number_of(top) > fixed.KEYWORD_LIMIT)),
            F.lit("keyword_top_n"), "out_of_range", top["low"])]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def read_profiles(configs: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """Profiles of the configurations without a problem, with defaults filled in; products stand
    in the order of the text. ``problems`` is what ``config_problems`` gives, if already known."""
    if problems is None:
        problems = config_problems(configs)
    bad = problems.select("profile").distinct()
    rows = parsed(configs.join(bad.hint("merge"), "profile", "left_anti"))
    inner = {n: opened_map(F.try_element_at("m", F.lit(n))["v"]) for n in ("history", "quality")}
    fields = lambda model, m: [value_of(n, f, m) for n, f in MODELS[model].items()
                               if f.kind not in ("array", "object")]
    flat = rows.withColumns(inner).select(
        "profile", *fields("", "m"), *fields("history", "history"), *fields("quality", "quality"))
    aliases = F.try_variant_get(F.try_element_at("m", F.lit("aliases"))["v"], "$", "array<string>")
    product = F.struct(
        *[value_of(n, MODELS["products"][n]) for n in ("id", "display_name")],
        aliases.alias("aliases"),
        *[value_of(n, MODELS["products"][n]) for n in ("creative_pin", "creative_asset")])
    listed = items(rows, "products").groupBy("profile").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("at", product.alias("p")))), lambda x: x["p"]).alias("products"))
    return flat.join(listed, "profile", "left")
