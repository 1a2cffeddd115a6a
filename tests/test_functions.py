from __future__ import annotations

import datetime as dt
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lumenry.functions import dates as D
from lumenry.functions import text as T
from lumenry.operators import extract as X
from lumenry.operators import match as M
from lumenry.operators import publish as R
from lumenry.sources import state as K


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expression(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_text(spark):
    assert one(spark, T.spaces, " Ａ　ｂ\t c ") == "A b c"
    assert one(spark, T.folded, "Straße　Ｘ") == "strassex"
    assert one(spark, T.name_key, "【Live】 ー A!") == "livea"
    assert one(spark, T.url_key, "HTTPS://Ex.org/a/?utm_source=x&b=1&fbclid=2#z)") == "https://ex.org/a?b=1"
    assert one(spark, T.url_key, None) == ""
    assert one(spark, T.price, "一般 ¥3,500円") == 3500
    assert one(spark, T.price, "free") is None
    assert one(spark, T.clock, "18時30分") == "18:30"
    assert one(spark, T.clock, "25:00") == "25:00"
    assert one(spark, T.clock, "30:00") is None
    assert one(spark, T.clock_range, "特典会 19:00〜20:30") == "19:00-20:30"
    assert one(spark, T.cleaned, "★ Live #tag https://x.y ☆") == "Live"
    assert one(spark, lambda a, b: T.similarity(a, b), "abcd", "bcde") == 0.75
    assert one(spark, lambda a, b: T.similarity(a, b), "", "x") == 0.0


def test_dates(spark):
    posted = lambda d: F.lit(d).cast("date")
    day = lambda m, d: dt.date(2024, m, d)
    assert one(spark, lambda c: D.event_date(c, posted("2024-12-20")), "1/5 at") == dt.date(2025, 1, 5)
    assert one(spark, lambda c: D.event_date(c, posted("2024-05-20")), "2/31") is None
    got = one(spark, lambda c: D.event_dates(c, posted("2024-05-01")), "2024/6/1 と 5/3(金)〜5/5 9/21・22")
    assert got == [day(6, 1), day(5, 3), day(5, 4), day(5, 5), day(9, 21), day(9, 22)]
    assert one(spark, lambda c: D.event_dates(c, posted("2024-05-01")), "no date") == []
    assert one(spark, lambda c: D.weekday_label(c.cast("date")), "2024-05-06") == "月"


def test_extract_handles_absent_fields(spark):
    df = spark.createDataFrame([(1, None, dt.datetime(2024, 5, 1)), (2, "", dt.datetime(2024, 5, 1)), (3, "本日『A』 OPEN/START 17:30/18:00 特典会 20:00", dt.datetime(2024, 5, 1, 20))], "post_id long, text string, posted_at timestamp")
    rows = {r.post_id: r for r in X.extract(df).collect()}
    assert rows[1].event_date is None and rows[2].event_name is None
    assert rows[3].event_date == dt.date(2024, 5, 2)  # five in the morning of the next day in the schedule's zone
    assert (rows[3].event_name, rows[3].open_time, rows[3].start_time) == ("A", "17:30", "18:00")


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "event_id long, event_date date, event_dates array<date>")
    assert R.occurrences(empty).count() == 0
    none = spark.createDataFrame([(1, None, None)], "event_id long, event_date date, event_dates array<date>")
    assert [r.day for r in R.occurrences(none).collect()] == [None]
    ids = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("x",)], "post_id string")
    assert K.cursor(ids).first().cursor == "9007199254740993"


def test_posts_of_all_shapes(spark, tmp_path):
    post = lambda k: {"id": str(k), "text": f"t{k}", "created_at": "2024-05-01T00:00:00Z"}
    shapes = ({"data": [post(1), post(2)], "includes": {"media": []}}, {"data": post(3)}, [post(4)], {**post(5), "note_tweet": {"text": "long"}})
    for k, x in enumerate(shapes):
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    (tmp_path / "bad.json").write_text("{")
    got = {r.post_id: r.text for r in K.read_posts(spark, str(tmp_path)).collect()}
    assert got == {"1": "t1", "2": "t2", "3": "t3", "4": "t4", "5": "long"}
    newest = K.newest(K.read_posts(spark, str(tmp_path)), since="2", limit=2)
    assert [r.post_id for r in newest.collect()] == ["5", "4"]


def test_secrets_are_scrubbed(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('access_token', 'x', 'b', 2) AS s, 'y' AS bearer")
    assert df.select(*K.scrubbed(df.schema)).first().asDict(recursive=True) == {"a": 1, "s": {"b": 2}}


def test_pieces_of_near_keys_meet():
    draw = random.Random(3)
    near = 0
    for _ in range(20000):
        a = "".join(draw.choices("abcd", k=draw.randint(1, 40)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(len(b) + 1)
            b[k : k + draw.randint(0, 1)] = draw.choices("abcd", k=draw.randint(0, 1))
        b = "".join(b)
        if b and SequenceMatcher(None, a, b).ratio() >= 0.92:
            near += a != b
            offered = {b[x:y] for x, y in M._parts(len(b))}
            sizes = {y - x for n in range(-(-len(a) * 23 // 27), len(a) * 27 // 23 + 1) for x, y in M._parts(n)}
            assert offered & {a[k : k + s] for s in sizes for k in range(len(a) - s + 1)}
    assert near > 1000


def test_best_match_is_that_of_all_pairs(spark):
    draw = random.Random(5)
    names = ["summer night festival", "summer night festivals", "summer nite festival", "winter acoustic evening", "winter acoustic evenin", "abc live", "abc live!x"]
    venues = ["shibuya hall one", "shibuya hall on", "shibuya hall two x", "namba club", "namba club b", ""]
    fields = "event_name string, venue string, ticket_url string, event_date date, event_dates array<date>, open_time string, start_time string"

    def row(dated):
        day = dt.date(2024, 5, draw.randint(1, 28)) if dated else None
        return (draw.choice(names), draw.choice(venues), draw.choice([None, None, f"https://x.y/{draw.randint(1, 9)}"]), day, None, None, None)

    posts = [(f"p{k}", draw.choice(["sold_out", "ticket_update", "initial_announcement"]), *row(k % 3 == 0)) for k in range(60)]
    posts.append(("p60", "ticket_update", "nothing in common", "elsewhere", None, None, None, None, None))
    events = [(k, ["p60"] if k == 7 else None, *row(k % 4 != 0)) for k in range(60)]
    p = spark.createDataFrame(posts, f"post_id string, source_kind string, {fields}")
    e = spark.createDataFrame(events, f"event_id long, post_ids array<string>, {fields}")
    left, right = M.keyed(p), M.keyed(e)
    every = left.select([F.col(c).alias("a_" + c) for c in left.columns]).crossJoin(right.select([F.col(c).alias("b_" + c) for c in right.columns]))
    same = F.coalesce(F.array_contains("b_post_ids", F.col("a_post_id")), F.lit(False))
    scores = every.select("a_post_id", "b_event_id", M.match_score("a_", "b_", F.col("a_source_kind"), same).alias("score")).collect()
    best = {}
    for r in scores:
        if r.score >= 0.45:
            best[r.a_post_id] = min(best.get(r.a_post_id, (0, 0)), (-r.score, r.b_event_id))
    got = {r.post_id: (-r.score, r.event_id) for r in M.best_match(p, e).collect() if r.score >= 0.45}
    assert got == best and got["p60"] == (-1.0, 7) and len(got) > 20


def test_state_keeps_what_came_first(spark, tmp_path):
    from lumenry.sources import state as K

    old = spark.createDataFrame([("1", "a", 10), ("2", "b", 20)], "post_id string, text string, processed_at int")
    new = spark.createDataFrame([("2", "B", 99), ("3", "c", 30), ("3", "d", 31)], old.schema)
    assert sorted(map(tuple, K.kept_first(old, new, "post_id", ["processed_at"]).collect())) == [("1", "a", 10), ("2", "B", 20), ("3", "d", 31)]
    grown = K.migrated(old, {"source": ("string", F.lit("x")), "text": ("string", F.lit(""))})
    assert [tuple(r) for r in grown.orderBy("post_id").collect()] == [("1", "a", 10, "x"), ("2", "b", 20, "x")]
    ids = spark.createDataFrame([("9", 1), ("10", 1), ("zz", 5), ("10a", 7)], "post_id string, posted_at int")
    assert K.latest_record(ids).first().post_id == "10a"
    assert [r.post_id for r in ids.orderBy(*K.record_order()).collect()] == ["10", "9", "10a", "zz"]
    merged, counts = K.archive_merge(old, old, "post_id", ["text"])
    assert K.write_if_changed(merged, counts, str(tmp_path / "archive")) is None
    merged, counts = K.archive_merge(old, new, "post_id", ["text"])
    assert spark.read.parquet(K.write_if_changed(merged, counts, str(tmp_path / "archive"))).count() == 3


def test_published_json_is_read_as_it_is(spark, tmp_path):
    from lumenry.sources import state as K

    rows, errors = K.read_public(spark, str(tmp_path / "none"), "id string, n int")
    assert rows.count() == errors.count() == 0
    (tmp_path / "good.json").write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    (tmp_path / "bad.json").write_text("{oops")
    rows, errors = K.read_public(spark, str(tmp_path / "*.json"), "id string, n int") if False else K.read_public(spark, str(tmp_path), "id string, n int")
    assert sorted((r.id, r.n) for r in rows.collect()) == [("a", 1), ("b", None)]
    assert [r.error for r in errors.collect()] == ["malformed JSON"]


def test_secrets_in_arrays_and_maps(spark):
    from lumenry.sources import state as K

    df = spark.sql("SELECT array(named_struct('access_token', 'x', 'a', 1)) AS held, map('Secret', 1, 'open', 2) AS m, named_struct('bearer', 'b', 'in', named_struct('authorization', 1, 'z', 2)) AS s, 1 AS my_token")
    assert K.secret_names(df.schema) == ["held.access_token", "s.bearer", "s.in.authorization", "my_token"]
    out = df.select(*K.scrubbed(df.schema))
    assert out.first().asDict(True) == {"held": [{"a": 1}], "m": {"open": 2}, "s": {"in": {"z": 2}}}


def test_views(spark):
    from lumenry.operators import report as Q

    rows = spark.createDataFrame([(1, "2026-06-02", "b", "x", "2026-05-09"), (2, "2026-06-02", "a", "x", None), (3, None, "c", "y", "2026-05-01")], "event_id int, event_day string, event_name string, venue string, deadline_day string")
    assert [r.event_id for r in Q.in_page_order(rows).collect()] == [2, 1, 3] and [r.event_id for r in Q.in_page_order(rows, "deadline").collect()] == [3, 1, 2]
    assert [(r.day, r.event_ids) for r in Q.grouped(rows).collect()] == [("2026-06-02", [2, 1]), (None, [3])]
    assert [r.day for r in Q.grouped(rows, "deadline").collect()] == ["2026-05-01", "2026-05-09", None]
    entries = spark.createDataFrame([("d", "application", 1), ("d", "live", 2), ("e", "payment", 3), ("e", "application", 3)], "day string, kind string, event_id int")
    assert [tuple(r) for r in Q.cell_entries(entries).collect()] == [("d", "live", 2), ("e", "application", 3)]
    assert [tuple(r) for r in Q.cell_entries(entries, "payment").collect()] == [("e", "payment", 3)]
    assert spark.range(1).select(Q.month_keys(F.lit("2026-11"), 3)).first()[0] == ["2026-11", "2026-12", "2027-01"]
    day = spark.createDataFrame([("2026-02-30T1", "2026-03-01"), (None, "x"), ("2026-02-28T10:00", None)], "a string, b string").select(Q.deadline_day(F.col("a"), F.col("b")).cast("string")).collect()
    assert [r[0] for r in day] == ["2026-03-01", None, "2026-02-28"]
