"""Payloads of any shape, the keyed table and its log, words that titles lack."""

from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from lumenry.operators import match as M
from lumenry.sources import keyed, payload


def test_payloads(spark, tmp_path):
    texts = {
        "many": json.dumps({"data": [{"id": "1", "text": "a", "created_at": "2026-04-01T09:00:00Z", "access_token": "x"}, {"id": 2, "raw": {"text": "inner", "source_posted_at": "2026-04-01T18:00:00+09:00", "note_tweet": {"text": "long"}}}, {"no": "id"}, 5]}),
        "one": json.dumps({"data": {"id": "3", "text": " ", "raw": {"text": "b"}, "odd": {"deep": [{"bearer": 1, "kept": 2}]}, "mixed": {"Secret": 1}}}),
        "list": json.dumps([{"id": "4", "created_at": "soon", "note_tweet": {"text": "  "}, "mixed": "text"}]),
        "bare": json.dumps({"id": "5", "text": "c", "mixed": [{"a": 1}], "unknown": {"x": {"y": 1}}}),
        "none": json.dumps({"data": []}), "broken": '{"data": [', "number": "17", "blank": "  ",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    items, errors = payload.read_payloads(spark, str(tmp_path))
    got = {r.post_id: r for r in payload.posts(items).withColumn("posted_at", F.date_format("posted_at", "HH:mm")).collect()}
    assert {k: (r.text, r.posted_at, r.full_text_source) for k, r in got.items()} == {
        "1": ("a", "09:00", "text"), "2": ("long", "09:00", "note_tweet"), "3": (" ", None, "text"), "4": (None, None, "text"), "5": ("c", None, "text"),
    }
    assert got["2"].api_text == "inner" and got["3"].api_text == "b"
    assert sorted((Path(r.file).stem, r.error) for r in errors.collect()) == [("broken", "malformed JSON"), ("number", "no object")]
    held = payload.scrubbed_items(items)
    told = json.dumps([json.loads(x) for x in held.toJSON().collect()]).lower()
    assert not any(w in told for w in ("token", "bearer", "secret")) and '"kept": 2' in told and '"y": 1' in told
    assert payload.scrubbed_items(items.limit(0)).count() == 0


def test_keyed_table(spark, tmp_path):
    """Batches count once, readers see one version, bytes of a batch follow the batch, compaction changes nothing."""
    t = keyed.KeyedTable(str(tmp_path / "t"), "k long, at int, v string", "k", ("at", "v"), buckets=4, compact_every=1000)
    assert t.read(spark).count() == 0
    rng, want = random.Random(1), {}
    batch = lambda rows: spark.createDataFrame(rows, "v string, k long, at int")
    size = lambda n: sum(p.stat().st_size for p in Path(t.path, "deltas", str(n)).rglob("*.parquet"))
    for n in range(4):
        rows = [(f"v{n}-{i}", rng.choice([None, *range(40)]) if n else i, rng.randrange(5)) for i in range(4000 if n == 0 else 30)]
        assert t.append(batch(rows), n) and not t.append(batch([("again", 1, 99)]), n)
        for v, k, at in rows:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        if n == 1:
            before = t.read(spark)
            known = dict(want)
            t.compact(spark)
    assert {r.k: (r.at, r.v) for r in before.collect()} == known
    assert {r.k: (r.at, r.v) for r in t.read(spark).collect()} == want
    assert size(3) < size(0) / 4
    t.compact(spark)
    assert t._commits(spark) == (3, []) and {r.k: (r.at, r.v) for r in t.read(spark).collect()} == want
    assert [(r.at, r.v) for r in t.lookup(spark, 7).collect()] == [want[7]] and t.lookup(spark, 10**6).count() == 0
    Path(t.path, "deltas", "9", "bucket=0").mkdir(parents=True)  # a batch that was never committed
    assert t.read(spark).count() == len(want)


def test_alias_key(spark):
    words, ends = ("oneman", "onemanlive"), ("live", "onemanlive")

    def plain(x):
        last = None
        while x != last:
            last = x
            for w in sorted(words, key=len, reverse=True):
                if x.startswith(w) and len(x) > len(w):
                    x = x[len(w) :]
                    break
            for w in sorted(ends, key=len, reverse=True):
                if x.endswith(w) and len(x) > len(w):
                    x = x[: -len(w)]
                    break
        return x

    rng = random.Random(2)
    names = ["".join(rng.choices(["oneman", "live", "a", "li", "ve", "onemanlive"], k=rng.randrange(9))) for _ in range(300)] + ["live" * 60, ""]
    got = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").select("n", M.alias_key(F.col("n"), words, ends).alias("a")).collect()
    assert all(r.a == (None if r.n is None else plain(r.n)) for r in got) and len(got) == 303


def test_published_order(spark, tmp_path):
    from lumenry.sources import sinks

    rng = random.Random(3)
    rows = [(k, rng.choice(["b", "B", "a", "Ä", None]), rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, name string, v double").repartition(7)
    want = [k for k, *_ in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[0]))]
    order = [F.collate("name", "UTF8_LCASE"), "k"]
    where = sinks.write_in_order(df, str(tmp_path / "p"), order, parts=5)
    got = [(r.k, r.position) for f in sorted(Path(where).glob("part-*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert got == [(k, n + 1) for n, k in enumerate(want)]
    sinks.write_json(df, str(tmp_path / "j"), order, parts=3)
    files = sorted(Path(tmp_path / "j").glob("part-*.txt"))
    assert len(files) > 1 and [r["k"] for r in json.loads("".join(f.read_text() for f in files))] == want
    sinks.write_json(df.limit(0), str(tmp_path / "none"), order)
    assert "".join(f.read_text() for f in Path(tmp_path / "none").glob("part-*.txt")).strip() == "[]"


def test_archive_cursor(spark, tmp_path):
    """Newer ids once, however files come; older ones never; null ids are left out."""
    from lumenry.sources.archive_stream import PostArchive

    spark.dataSource.register(PostArchive)
    folder, schema = str(tmp_path / "in"), "text string, post_id long"

    def run():
        stream = spark.readStream.format("post_archive").option("path", folder).schema(schema).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.post_id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    add = lambda ids: spark.createDataFrame([(f"t{i}", i, 0) for i in ids], "text string, post_id long, more int").coalesce(1).write.mode("append").parquet(folder)
    add([5, 9, None, 2**60])
    assert run() == [5, 9, 2**60]
    assert run() == [5, 9, 2**60]
    add([7, 2**60, 2**60 + 1])
    add([2**60 + 2, 1])
    assert run() == [5, 9, 2**60, 2**60 + 1, 2**60 + 2]
