"""Incremental sync: new posts in micro-batches, each once, put into the kept state (merging them: ``calendar``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.publish import diff_rows, validation_summary
from ..operators.summary import page_order, page_rows
from ..sources.shared import kept
from ..sources.state import kept_first, write_version


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_once(stream: DataFrame, key: str, time: str, lateness: str | None = None) -> DataFrame:
    """Rows of new keys. With ``lateness`` the keys kept in state are bounded by a watermark on ``time``; without, they all are kept."""
    return stream.dropDuplicates([key]) if lateness is None else stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def sync(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands all that is there to ``merge`` in micro-batches, then ends; what a batch saw counts as done once ``merge`` returns.

    A batch that fails is handed over again, so ``merge`` should be an upsert.
    """
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Counts by event-time window and kind; an extension beside the sync."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def backfill(posts: DataFrame, state: DataFrame, key: str, first: list[str]) -> DataFrame:
    """Older posts put into the state without touching the cursor: known ids stay as they are, others are added."""
    return kept_first(state, posts.join(state.select(key), key, "left_anti"), key, first)


def refresh(events: DataFrame, published: DataFrame, as_of: Column, path: str, dry_run: bool = True, parts: int | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """(check, differences, folder): projects the events, checks the rows, compares them with what is published, and writes.

    Nothing is written in a dry run, with rows in error, or where no row differs. ``parts``: over how many tasks rows are dealt.
    """
    return refreshed(kept(page_rows(events, as_of, parts)), published, path, dry_run, parts)


def refreshed(rows: DataFrame, published: DataFrame, path: str, dry_run: bool = True, parts: int | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """``refresh`` of rows that are projected already (and kept, as they are read several times). A dry run works nothing out before its results are asked for."""
    told = validation_summary(rows)
    differs = diff_rows(published, rows, "id", ["event_date", "event_name", "venue", "ticket_summary", "application_summary", "ticket_url"], parts)
    if dry_run:
        return told, differs, None
    differs, sound = kept(differs), told.first()
    changed = differs.filter("change <> 'kept'").limit(1).count()
    write = not sound.n_bad_rows and not sound.n_repeated_ids and changed
    return told, differs, write_version(rows.orderBy(*page_order()), path) if write else None
