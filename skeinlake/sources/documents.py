"""Open JSON documents as VARIANT columns, with typed rules for their legacy forms; nested answers in XML. (A-05, Y-16, K-10)

A document keeps every field it has, known or not. A rule names a section that is a map from ids to records and was a list
of records in older documents; both give the same map. What is malformed is set apart with its text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keyed:
    """The section ``name`` maps ids to records; in a list, a record's id is its field ``key``."""

    name: str
    key: str = "id"


@dataclass(frozen=True)
class Typed:
    """The section ``name`` is read as ``kind``, null where it is missing or of another type."""

    name: str
    kind: str


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _map_of(doc: str, rule: Keyed) -> Column:
    """A section as map<string, variant> from its map form, or from its list form: of records with one id the last holds,
    one without an id is kept under its place, and no section at all is an empty map."""
    key = _path(rule.key)
    items = F.try_variant_get(doc, _path(rule.name), "array<variant>")
    pairs = F.transform(items, lambda x, i: F.struct(F.coalesce(F.try_variant_get(x, key, "string"), F.concat(F.lit("#"), i)).alias("k"), x.alias("v")))
    ids = F.transform(pairs, lambda x: x["k"])
    back = F.reverse(ids)
    last = F.filter(pairs, lambda x, i: i == F.size(ids) - F.array_position(back, x["k"]))
    from_list = F.map_from_entries(F.when(F.size(F.array_distinct(ids)) == F.size(ids), pairs).otherwise(last))
    from_map = F.try_variant_get(doc, _path(rule.name), "map<string,variant>")
    return F.coalesce(from_map, from_list, F.create_map().cast("map<string,variant>"))


def open_documents(raw: DataFrame, col: str, rules: list[Keyed | Typed]) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected). Documents have a column for each rule and ``rest``, a map of all other fields of the top
    level; the other columns of ``raw`` stay. Rejected rows have the text that isn't a JSON object."""
    doc = "__doc"
    parsed = raw.withColumn(doc, F.try_parse_json(col))
    parsed = parsed.withColumn("__top", F.try_variant_get(doc, "$", "map<string,variant>"))
    columns = [_map_of(doc, r).alias(r.name) if isinstance(r, Keyed) else F.try_variant_get(doc, _path(r.name), r.kind).alias(r.name) for r in rules]
    known = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    rest = F.map_filter("__top", lambda k, _: ~F.array_contains(known, k)).alias("rest")
    keep = [F.col(f"`{c}`") for c in raw.columns if c != col]
    fine = parsed.filter(F.col("__top").isNotNull()).select(*keep, *columns, rest)
    return fine, parsed.filter(F.col("__top").isNull()).select(*raw.columns)


def document_schema(raw: DataFrame, col: str) -> DataFrame:
    """One row (schema): the type that holds all documents, to see which shapes there are before writing rules."""
    return raw.select(F.try_parse_json(col).alias("v")).agg(F.schema_of_variant_agg("v").alias("schema"))


def xml_answers(raw: DataFrame, col: str, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(answers, malformed): the part of a text from the first ``<root`` to the last ``</root>`` under a declared schema.

    Repeated tags are arrays, attributes have names with an underscore in front. ``answer`` holds what was read; texts
    without such a part, or whose part isn't well formed, are set apart as they are. (K-10)
    """
    bad = "__malformed"
    part = F.regexp_extract(col, rf"(?s)<{root}[\s>].*</{root}>", 0)
    got = raw.withColumn("answer", F.from_xml(part, f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE"}))
    wrong = (part == "") | F.col(col).isNull() | F.col(f"answer.{bad}").isNotNull() | F.col("answer").isNull()
    wrong = F.coalesce(wrong, F.lit(True))
    return got.filter(~wrong).withColumn("answer", F.col("answer").dropFields(bad)), got.filter(wrong).select(*raw.columns)
