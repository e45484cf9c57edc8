"""Candidate payloads of any shape as VARIANT: pages to items, items to candidate rows, and what could not be read with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_time

# ---- fixed values ----
NON_VIDEO = ("image", "images", "album", "photo", "note")
NESTED = ("contents", "data", "posts", "list")
ID_FIELDS = ("content_id", "aweme_id")
TITLE_LENGTH = 60
PERMALINK = "https://www.douyin.com/video/"
# ---- end of fixed values ----
#: How deep a page may lie in objects.
DEPTH = 4


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _there(value: Column, path: str) -> Column:
    """The value at ``path``, null for a JSON null too."""
    found = _get(value, path)
    return F.when(~F.is_variant_null(found), found)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _list(value: Column) -> Column:
    """A JSON list as an array; anything else is empty."""
    return F.coalesce(F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def _text(value: Column, path: str) -> Column:
    """The text or number at ``path``, trimmed; null if blank or nothing of that kind."""
    return F.nullif(F.trim(_get(value, path, "string")), F.lit(""))


def unwrap(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``seq, item, reason`` of every item that a payload holds, beside the payload's other columns.

    A payload is one item (an object with an id field), an object with ``items``, an object that holds one of
    these or a list under ``contents``, ``data``, ``posts`` or ``list``, or a bare list. What holds no item has one row with
    ``reason``: ``not_json``, ``no_items`` (a known shape that is empty), ``unknown_shape``; list entries that are no
    objects are ``not_an_object``.
    """
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*[F.col(f"`{c}`") for c in rest], F.try_parse_json(column).alias("_v"))
    single = lambda v: F.coalesce(_get(v, ID_FIELDS[0]), _get(v, ID_FIELDS[1])).isNotNull()
    for _ in range(DEPTH):
        inner = F.coalesce(*[_there(F.col("_v"), k) for k in NESTED])
        deeper = _is(F.col("_v"), "OBJECT") & ~single(F.col("_v")) & _get(F.col("_v"), "items").isNull() & inner.isNotNull()
        rows = rows.withColumn("_v", F.when(deeper, inner).otherwise(F.col("_v")))
    v = F.col("_v")
    shape = F.when(v.isNull(), "not_json").when(_is(v, "OBJECT") & single(v), "single").when(_is(v, "OBJECT") & _get(v, "items").isNotNull(), "page").when(_is(v, "ARRAY"), "list").otherwise("unknown_shape")
    rows = rows.withColumn("_shape", shape)
    items = F.when(F.col("_shape") == "single", F.array(v)).when(F.col("_shape") == "page", _list(_get(v, "items"))).when(F.col("_shape") == "list", _list(v)).otherwise(F.array().cast("array<variant>"))
    rows = rows.withColumn("_items", items)
    why = F.when(F.col("_shape").isin("not_json", "unknown_shape"), F.col("_shape")).when(F.size("_items") == 0, "no_items")
    each = rows.select(*[F.col(f"`{c}`") for c in rest], why.alias("_why"), F.posexplode_outer("_items").alias("seq", "item"))
    reason = F.coalesce("_why", F.when(~_is(F.col("item"), "OBJECT"), "not_an_object"))
    return each.select(*[F.col(f"`{c}`") for c in rest], F.coalesce("seq", F.lit(0)).alias("seq"), "item", reason.alias("reason"))


def _urls(entry: Column) -> Column:
    """The urls of a stream: its own, then those of its list, which holds texts or objects."""
    own = F.array(F.when(_is(_get(entry, "url"), "STRING"), _text(entry, "url")))
    more = F.transform(_list(_get(entry, "urls")), lambda u: F.when(_is(u, "STRING"), F.try_variant_get(u, "$", "string")).otherwise(_text(u, "url")))
    return F.filter(F.concat(own, more), lambda u: F.coalesce(u, F.lit("")) != "")


def streams(item: Column) -> Column:
    """Every url of an item's streams as structs that sort by preference: no watermark, bitrate, size, first listed."""
    media = _get(item, "media")
    entries = F.concat(F.filter(F.array(_get(media, "video")), lambda x: x.isNotNull()), _list(_get(media, "streams")))
    number = lambda entry, path: F.coalesce(_get(entry, path, "double"), F.lit(0.0))
    marked = lambda entry: F.coalesce(_get(entry, "watermark", "boolean"), F.lit(False))
    one = lambda entry, at: F.transform(_urls(entry), lambda u, k: F.struct((~marked(entry)).alias("clean"), number(entry, "bitrate").alias("bitrate"), number(entry, "size_bytes").alias("size"), (-k).alias("first"), (-at).alias("entry"), u.alias("url")))
    return F.flatten(F.transform(entries, one))


def normalize(items: DataFrame, platform: str = "douyin") -> DataFrame:
    """Flat candidate rows of ``unwrap``'s good items, and ``issues``: fields that were there but could not be read.

    An item without an id has ``reason`` ``no_id``. A length comes in milliseconds or else seconds, the title
    from the description's first characters where it is blank, kinds of pictures mean no video, the best
    http(s) stream is the media url. Rows that ``unwrap`` gave a reason stay as they are, without values.
    """
    item = F.col("item")
    rest = [c for c in items.columns if c not in ("item", "reason")]
    rows = items.withColumn("_all", streams(item)).withColumn("_tags", F.array_compact(F.transform(_list(_get(item, "tags")), lambda t: F.when(_is(t, "STRING"), F.try_variant_get(t, "$", "string")).otherwise(_text(t, "name")))))
    video = F.coalesce(*[_text(item, f) for f in ID_FIELDS])
    playable = F.array_max(F.filter("_all", lambda s: s["url"].rlike("^https?://")))["url"]
    pictures = (F.size(_list(_get(item, "media.images"))) > 0) & (F.size("_all") == 0)
    kind = F.coalesce(F.lower(_text(item, "kind")), F.when(pictures, "images").otherwise("video"))
    milliseconds, seconds = _text(item, "duration_ms"), _text(item, "duration")
    length = F.when(milliseconds.isNotNull(), F.bround(milliseconds.try_cast("double") / 1000.0, 3)).otherwise(seconds.try_cast("double"))
    moment = _text(item, "created_at")
    title, about = _text(item, "title"), _text(item, "description")
    cover = F.get(F.filter(F.transform(_list(_get(item, "media.covers")), lambda c: F.get(_urls(c), 0)), lambda u: u.isNotNull()), 0)
    stats = F.map_filter(F.coalesce(F.try_variant_get(item, "$.stats", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: x.isNotNull())
    unread = lambda name, raw, value: F.when(raw.isNotNull() & value.isNull(), name)
    issues = F.array_compact(F.array(unread("duration", F.coalesce(milliseconds, seconds), length), unread("created_at", moment, parse_time(moment)), unread("stats", _there(item, "stats"), F.try_variant_get(item, "$.stats", "map<string,string>"))))
    good = F.col("reason").isNull()
    value = lambda c, name: F.when(good, c).alias(name)
    return rows.select(
        *[F.col(f"`{c}`") for c in rest], F.coalesce("reason", F.when(video.isNull(), "no_id")).alias("reason"), F.lit(platform).alias("platform"), value(video, "platform_video_id"),
        value(F.coalesce(_text(item, "web_url"), F.concat(F.lit(PERMALINK), video)), "source_url"), value(F.coalesce(title, F.substring(about, 1, TITLE_LENGTH), F.lit("")), "title"),
        value(F.coalesce(_text(item, "author.nickname"), _text(item, "author.unique_id"), F.lit("")), "author"), value(F.coalesce(_text(item, "author.sec_uid"), _text(item, "author.uid")), "author_id"),
        value(length, "duration"), value(kind, "kind"), value(kind.isin(*NON_VIDEO), "no_video"), value(parse_time(moment), "published_at"), value(playable, "media_url"), value(cover, "cover_url"),
        value(F.size("_all"), "n_streams"), value(F.col("_tags"), "tags"), value(stats, "stats"), F.when(good, issues).alias("issues"),
    )
