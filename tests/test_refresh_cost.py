"""A dry run of the refresh projects rows once, and leaves the rest to who asks for its results."""

from __future__ import annotations

from lumenry.streaming import sync as Y


def test_dry_run_starts_no_job(spark):
    rows = spark.sql("SELECT k AS id, '2024-06-01' AS event_date, n AS event_name, '' AS venue, '' AS ticket_summary, '' AS application_summary, '' AS ticket_url, true AS is_ready FROM VALUES ('a', 'x'), ('b', 'y'), ('c', 'z') t(k, n)")
    before = spark.sql("SELECT k AS id, '2024-06-01' AS event_date, n AS event_name, '' AS venue, '' AS ticket_summary, '' AS application_summary, '' AS ticket_url FROM VALUES ('b', 'y'), ('c', 'w'), ('d', 'v') t(k, n)")
    spark.sparkContext.setJobGroup("dry", "dry run")
    told, differs, where = Y.refreshed(rows, before, "unused")
    assert where is None and not spark.sparkContext.statusTracker().getJobIdsForGroup("dry")
    spark.sparkContext.setJobGroup("", "")
    assert sorted(tuple(r) for r in differs.collect()) == [("added", 1), ("changed", 1), ("kept", 1), ("removed", 1)]
    assert told.first().n_rows == 3
