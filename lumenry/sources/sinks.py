"""What leaves the engine: the published JSON, rows for a keyed sheet, typed properties for a document store, display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

MOST_TEXT = 2000  # characters of a rich text property


def _names(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def positioned(rows: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows`` with ``position``, their place in ``order`` from 1 on; rows that tie in all of it stand in any order.

    Columns of ``order`` may be collated. Ranges are sorted each by itself; their sizes, one
    row a range, give where each begins, so no task sees more than its range.
    """
    by = _names(order)
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows).repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = kept(dealt.withColumn("_at", F.monotonically_increasing_id()))  # the partition above 33 bits, the row's number there below
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", before.alias("_before"))  # ``n`` rows at most
    joined = placed.join(F.broadcast(begins), part == F.col("_part"))
    return joined.withColumn("position", F.col("_before") + inside + 1).drop("_at", "_part", "_before", "_n")


def write_in_order(rows: DataFrame, path: str, order: list[str | Column], parts: int | None = None) -> str:
    """Parquet files whose rows, with their ``position``, stand in order, file after file; returns the folder."""
    _dealt(kept(positioned(rows, order, parts)), parts).write.mode("overwrite").parquet(path)
    return path


def _dealt(placed: DataFrame, parts: int | None) -> DataFrame:
    n = parts or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "position").sortWithinPartitions("position")


def write_json(rows: DataFrame, path: str, order: list[str | Column], parts: int | None = None) -> None:
    """A JSON array of objects in order, over what was there: the files, one after the other in order of their names, are its text. Nulls are written as such."""
    spark, names = rows.sparkSession, rows.columns
    placed = kept(positioned(rows, order, parts))
    n = placed.count()
    if not n:
        spark.createDataFrame([("[]",)], "value string").write.mode("overwrite").text(path)
        return
    each = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    text = F.concat(F.when(F.col("position") == 1, "[").otherwise(","), each, F.when(F.col("position") == n, "]").otherwise(""))
    _dealt(placed, parts).select(text.alias("value")).write.mode("overwrite").text(path)


def sheet_upsert(old: DataFrame, new: DataFrame, keys: list[str], protected: list[str], manual: str = "manual", order: list[str] | None = None) -> DataFrame:
    """``old`` with ``new`` by keys; rows marked as manual keep their protected columns.

    Of rows that repeat a key in ``new`` the last by ``order`` counts, or the largest.
    """
    cells = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.coalesce(F.col(manual), F.lit(False)).alias(manual), F.struct(*cells).alias("o"))
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*cells), F.struct(*(order or cells))).alias("n"))
    both = before.join(fresh, keys, "full_outer")
    pick = lambda c: F.when(F.col("n").isNull() | (F.coalesce(F.col(manual), F.lit(False)) & F.lit(c in protected)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*keys, F.coalesce(F.col(manual), F.lit(False)).alias(manual), *[pick(c).alias(c) for c in cells])


def properties(df: DataFrame, kinds: dict[str, str], options: dict[str, list[str]] | None = None) -> Column:
    """A JSON object of typed properties. kinds: title, rich_text, select, url, number, date or checkbox by column.

    A select whose value isn't among its ``options`` gets the first of them; nulls are left out.
    """
    def encoded(c: str, kind: str) -> Column:
        value = F.col(c)
        if kind in ("title", "rich_text"):
            return F.struct(F.array(F.struct(F.struct(F.substring(value.cast("string"), 1, MOST_TEXT).alias("content")).alias("text"))).alias(kind))
        if kind == "select":
            known = (options or {}).get(c)
            name = F.when(value.isin(*known), value).otherwise(F.lit(known[0])) if known else value
            return F.struct(F.struct(name.alias("name")).alias("select"))
        if kind == "date":
            return F.struct(F.struct(value.cast("string").alias("start")).alias("date"))
        return F.struct(value.alias(kind))

    return F.to_json(F.struct(*[F.when(F.col(c).isNotNull(), encoded(c, k)).alias(c) for c, k in kinds.items()]))


def shortened(text: Column, most: int = 12) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def name_richness(name: Column) -> Column:
    """How much a display name tells: its length, with a bonus for several words and for marks of a series."""
    return F.length(name) + F.when(name.rlike(r"\s"), 3).otherwise(0) + F.when(name.rlike(r"[0-9]|vol|Vol"), 2).otherwise(0)
