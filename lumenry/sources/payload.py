"""Payloads without a schema: posts of JSON of any shape, as VARIANT, without fields of secret-like names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .state import SECRET, scrubbed

#: Where a post's time may stand, in the order in which it is looked for, in the post and then in the payload that it holds.
TIMES = ("created_at", "source_posted_at")
RAW = "raw"  # a payload that a captured post holds


def read_payloads(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of JSON files, or with ``lines`` of one payload a line.

    items: file, item (VARIANT), one row for each object of {"data": [...]}, {"data": {...}},
    [...] or {...}. errors: file, error, text, of what isn't JSON or holds no object. Blank texts are neither.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    held = raw.withColumn("v", F.try_parse_json("value"))
    kind = lambda v: F.schema_of_variant(v)
    data = F.try_variant_get("v", "$.data", "variant")
    many = lambda v: F.try_variant_get(v, "$", "array<variant>")
    is_list = lambda v: kind(v).startswith("ARRAY")
    is_object = lambda v: kind(v).startswith("OBJECT")
    items = (
        F.when(is_list(F.col("v")), many(F.col("v"))).when(is_object(F.col("v")) & is_list(data), many(data))
        .when(is_object(F.col("v")) & is_object(data), F.array(data)).when(is_object(F.col("v")) & data.isNull(), F.array(F.col("v")))
    )
    found = held.select("file", "value", F.col("v").isNotNull().alias("sound"), F.filter(items, is_object).alias("items"))
    none = F.coalesce(F.size("items"), F.lit(0)) <= 0
    empty = F.col("sound") & (F.coalesce(F.size("items"), F.lit(-1)) == 0)  # an empty list of posts is no error
    errors = found.filter(none & ~empty).select("file", F.when(F.col("sound"), "no object").otherwise("malformed JSON").alias("error"), F.col("value").alias("text"))
    return found.select("file", F.explode("items").alias("item")), errors


def posts(items: DataFrame) -> DataFrame:
    """post_id, text, posted_at, api_text, full_text_source, media_keys, urls of items (VARIANT).

    A field of the item goes before that of the payload it holds; a longer note stands for its text. Items
    without an id are left out; a time that can't be read is null.
    """
    def told(path: str, kind: str = "string") -> list[Column]:
        return [F.try_variant_get("item", f"$.{top}{path}", kind) for top in ("", f"{RAW}.")]

    filled = lambda c: F.when(F.trim(c) != "", c)
    first = lambda path: F.coalesce(*map(filled, told(path)))
    note, api = first("note_tweet.text"), F.coalesce(*[filled(x) for path in ("api_text", "text") for x in told(path)])
    at = F.coalesce(*[x for path in TIMES for x in map(filled, told(path))])
    return items.select(
        F.coalesce(*told("id")).alias("post_id"), F.coalesce(note, *told("text")).alias("text"), F.try_to_timestamp(at).alias("posted_at"), api.alias("api_text"),
        F.when(note.isNotNull(), "note_tweet").otherwise("text").alias("full_text_source"),
        F.coalesce(*told("attachments.media_keys", "array<string>")).alias("media_keys"), F.coalesce(*told("entities.urls", "array<struct<url:string,expanded_url:string>>")).alias("urls"),
    ).filter("post_id is not null")


def schema_of(items: DataFrame, column: str = "item") -> t.DataType:
    """The schema of all values of a VARIANT column: one grouped pass, so fields that nobody listed are in it."""
    told = items.agg(F.schema_of_variant_agg(column)).first()[0]
    ddl = re.sub(r"\bVOID\b", "STRING", told.replace("OBJECT<", "STRUCT<"))
    return t._parse_datatype_string(ddl)


def _without_mixed(value: Column, kind: t.DataType) -> Column:
    """Values whose kind differs from row to row as texts; those that hold a secret-like name as null."""
    if isinstance(kind, t.VariantType):
        text = F.to_json(value)
        return F.when(~F.lower(text).rlike(r'"[^"]*(?:' + SECRET.pattern + r')[^"]*"\s*:'), text)
    if isinstance(kind, t.StructType):
        return F.when(value.isNotNull(), F.struct(*[_without_mixed(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])) if kind.fields else F.lit(None).cast("string")
    return F.transform(value, lambda x: _without_mixed(x, kind.elementType)) if isinstance(kind, t.ArrayType) else value


def scrubbed_items(items: DataFrame, column: str = "item") -> DataFrame:
    """The items as typed columns, without fields of secret-like names at any depth, whatever fields they have; of items without fields one null column."""
    kind = schema_of(items, column)
    if not isinstance(kind, t.StructType) or not kind.fields:
        return items.select(F.lit(None).cast("string").alias(column))
    typed = items.select(F.from_json(F.to_json(column), kind).alias("r"))
    plain = typed.select(_without_mixed(F.col("r"), kind).alias("r")).select("r.*")
    return plain.select(*scrubbed(plain.schema))
