"""Rules that classify posts, and the codes that words of a ticket line stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, fixed, let, once, spaces

# Words that decide what a post is, first match first.
KINDS = (
    ("correction", ("訂正", "修正", "変更", "お詫び", "誤り")),
    ("sold_out", ("sold out", "soldout", "完売", "売り切れ")),
    ("same_day_reminder", ("本日", "今日")),
    ("day_before_reminder", ("明日",)),
    ("timetable_update", ("タイムテーブル", "出演時間", "出番", "tt解禁", "特典会時間")),
    ("initial_announcement", ("next live", "ライブ出演", "出演決定", "出演情報", "情報解禁", "公演決定")),
    ("ticket_update", ("チケット", "当日券", "販売", "予約", "発売", "受付")),
    ("initial_announcement", ("ライブ", "live", "公演")),
)
POSITIVE = (
    "next live", "ライブ", "live", "出演", "日付", "場所", "公演", "イベント", "タイムテーブル", "特典会", "会場", "開場", "開演", "チケット",
    "ticketdive", "tiget", "livepocket", "抽選", "先着", "一般販売", "当日券", "本日", "明日", "明後日",
)
NEGATIVE = ("グッズ", "goods", "通販", "music video", "楽曲配信", "サブスク", "写真", "オフショット", "ラジオ配信", "coming soon", "キャンペーン", "live digest", "新商品", "配信開始", "リリース", "自撮り")
HARD = ("アンチコンプリート", "学力テスト", "直前sp", "ラジオ配信", "coming soon", "comingsoon", "近日公開", "近日解禁", "キャンペーン", "music video", "musicvideo", "mv公開", "live digest", "livedigest", "御礼", "ありがとうございました")
SIGNING = ("ニックネーム", "サイン", "日付", "コメント")  # all of them
PROFILE = ("プロフィール", "自己紹介", "メンバー紹介", "name┊", "name｜")
THANKS, NO_THANKS = ("ありがとう",), ("チケット", "開場", "開演", "出演時間", "申込", "受付", "販売開始", "販売中")
NOTICE, NO_NOTICE = ("お知らせ",), ("ライブ", "live", "公演", "出演", "チケット", "開場", "開演", "申込", "受付", "販売")
TOLD_IN_TEXT = ("会場", "場所", "開場", "開演", "チケット", "出演時間", "特典会", "http", "livepocket", "tiget")
IMAGE_ONLY = ("本日はこちら", "明日はこちら", "本日のライブはこちら", "明日のライブはこちら")
TICKET_HOSTS = ("ticketdive.com", "t-dv.com", "tiget.net", "livepocket.jp", "ticketvillage.jp", "eplus.jp", "l-tike.com", "pia.jp", "zaiko.io")
STREAM_HOSTS = ("nicovideo.jp", "youtube.com", "youtu.be", "twitcasting.tv")
TIERS = (
    ("VIP", ("VIP", "vip")), ("SS", ("SS",)), ("カメラ", ("カメラ",)), ("前方", ("前方",)), ("優先", ("優先",)),
    ("一般", ("一般", "通常", "前売", "当日")), ("その他", ("Tシャツ", "無料チケット", "後方")),
)
SALE_TYPES = (
    ("当日券", ("当日券",)), ("一般", ("一般販売", "一般発売", "一般受付")), ("抽選", ("抽選", "当落")),
    ("先着", ("先着", "受付開始", "受付締切", "販売開始", "販売終了")),
)
STATUSES = {"on_sale": "販売中", "same_day": "販売中", "same_day_available": "販売中", "upcoming": "未販売", "sold_out": "完売", "ended": "販売終了"}


def first_of(text: Column, rules, otherwise: str | None = None) -> Column:
    """The code of the first rule with a word in the text."""
    codes = {w: code for code, words in reversed(rules) for w in words}  # of a word of several rules the first one's
    words = [w for _, held in rules for w in held]
    table = F.map_from_arrays(fixed(codes), fixed(codes.values()))
    code = let(text, lambda x: table[F.get(F.filter(fixed(words), lambda w: x.contains(w)), F.lit(0))])
    return code if otherwise is None else F.coalesce(code, F.lit(otherwise))


def source_kind(text: Column) -> Column:
    return first_of(F.lower(text), KINDS, "other")


def ticket_tier(text: Column) -> Column:
    return first_of(F.coalesce(text, F.lit("")), TIERS, "不明")


def sale_type(text: Column) -> Column:
    return first_of(text, SALE_TYPES)


def names_sale(text: Column) -> Column:
    """Whether a text has a ``sale_type``, by one look."""
    return any_of(text, [w for _, words in SALE_TYPES for w in words])


def status_label(status: Column) -> Column:
    """The shown label of a status code; unknown codes pass, null is unknown."""
    table = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    return F.coalesce(table[status], status, F.lit("不明"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def _on(url: Column, hosts) -> Column:
    return host(url).rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$")


def is_streaming_url(url: Column) -> Column:
    return _on(url, STREAM_HOSTS)


def is_ticket_url(url: Column) -> Column:
    """On a ticket seller's host or with a path that says ticket, and not on a streaming host."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]*([^?#]*)", 1))
    return ~is_streaming_url(url) & (_on(url, TICKET_HOSTS) | path.rlike(r"(^|[/_-])tickets?([/_-]|$)"))


#: Words by which a post that names a member is about a live all the same.
ABOUT_LIVE = ("ライブ", "live", "公演", "出演", "会場", "場所", "開場", "開演", "チケット", "ticket")


def names_member(text: Column, lines: Column, members: tuple[str, ...]) -> Column:
    """Whether a lower-case text has a member's name as a line of its own, or names one and nothing of a live."""
    names = [m.lower() for m in members]
    return F.exists(lines, lambda x: x.isin(*names)) | (any_of(text, names) & ~any_of(text, ABOUT_LIVE)) if names else F.lit(False)


#: What ``classify`` reads of a post besides its text.
FEATURES = ("event_date", "event_name", "venue", "ticket_url", "has_time", "has_performance")


def classify(posts: DataFrame, text: str = "text", members: tuple[str, ...] = ()) -> DataFrame:
    """Adds classification, confidence and kind, by ordered rules over features that posts carry.

    ``members``: names of the act's members; a post that names one and nothing of a live introduces them. Features: event_date, event_name, venue, ticket_url (null where absent), has_time,
    has_performance (boolean). The first rule that holds decides.
    """
    held = once(posts, {"_t": F.lower(spaces(F.col(text)))})
    held = once(held, {"_bare": F.regexp_replace("_t", r"\s+", "")})
    t, bare = F.col("_t"), F.col("_bare")
    has = {c: F.col(c).isNotNull() for c in ("event_date", "event_name", "venue", "ticket_url")}
    features = [*has.values(), F.col("has_time"), F.col("has_performance")]
    structured = sum((f.cast("int") for f in features), F.lit(0))
    positive = F.size(F.filter(fixed(POSITIVE), lambda w: t.contains(w)))
    kind = source_kind(F.col(text))
    live = has["venue"] | has["ticket_url"] | F.col("has_time") | F.col("has_performance")
    bare_lines = F.transform(F.split(t, r"\R"), lambda x: F.trim(x))
    profile = t.rlike(r"\bprofile\s*0?[1-9]\b") | bare.rlike("profile[0-9]+") | (any_of(t, PROFILE) & ~live) | (names_member(t, bare_lines, members) & ~live)
    signing = t.contains(SIGNING[0])
    for word in SIGNING[1:]:
        signing = signing & t.contains(word)
    hard = any_of(t, HARD) | any_of(bare, HARD) | signing
    seller = any_of(t, TICKET_HOSTS)
    nothing = any_of(t, NEGATIVE) | (any_of(t, THANKS) & ~any_of(t, NO_THANKS)) | (any_of(t, NOTICE) & ~any_of(t, NO_NOTICE))
    rules = (
        (profile, "non_event", "high"),
        (hard, "non_event", "high"),
        (t.contains("live schedule digest") & ~(has["event_date"] | has["venue"] | F.col("has_time") | has["ticket_url"]), "non_event", "high"),
        (nothing & ~live & ~seller, "non_event", "high"),
        (any_of(bare, IMAGE_ONLY) & ~any_of(t, TOLD_IN_TEXT) & (structured < 3), "needs_review", "low"),
        (has["ticket_url"] & ~has["event_date"] & ~has["event_name"], "needs_review", "low"),
        (kind.isin("timetable_update", "correction") & (structured < 2), "needs_review", "low"),
        ((structured >= 3) | (has["event_date"] & (has["event_name"] | has["venue"] | has["ticket_url"])), "event", "high"),
        ((positive >= 2) & (structured >= 1), "event", "medium"),
        (positive > 0, "needs_review", "low"),
    )
    verdict, confidence = F.lit("non_event"), F.lit("high")
    for condition, code, sure in reversed(rules):
        verdict = F.when(condition, F.lit(code)).otherwise(verdict)
        confidence = F.when(condition, F.lit(sure)).otherwise(confidence)
    told = {"classification": verdict, "classification_confidence": confidence, "source_kind": F.when(profile | hard, "other").otherwise(kind)}
    return once(held, told).select(*[F.col(f"`{c}`") for c in posts.columns], *[c for c in told if c not in posts.columns])  # a filter of classes is no reason to work them out twice
