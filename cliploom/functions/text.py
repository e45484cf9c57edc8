"""Scalar text functions on built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redactions in order, fixed values: bearer tokens, sk- keys, key=value secrets.
SECRETS = (
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._-]+", "Bearer <redacted>"),
    (r"\bsk-[A-Za-z0-9._-]{6,}", "sk-<redacted>"),
    (r"(?i)\b(api[-_]?key|authorization|token|secret|password|cookie)\b\s*[:=]\s*[\"']?([^\s\"',;)]+)", "$1=<redacted>"),
)
#: Patterns of video ids in pages, fixed values: links, then JSON fields.
VIDEO_IDS = ("/(?:video|note)/([0-9]{6,})", '"(?:aweme_id|awemeId|aweme_id_str)"\\s*:\\s*"?([0-9]{10,})"?')


def sanitize_error(c: Column, most: int = 600) -> Column:
    """Credentials out, then at most ``most`` characters, the last three of a cut text being dots; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, text in SECRETS:
        c = F.regexp_replace(c, pattern, text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def redact_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]{7,}", "<num>")


def parse_time(c: Column) -> Column:
    """ISO text, or a number of seconds or (13 digits) milliseconds since the epoch."""
    number = F.when(c.rlike("^[0-9]{1,13}$"), c.try_cast("long"))
    stamp = F.timestamp_millis(F.when(F.length(c) >= 13, number).otherwise(number * 1000))
    return F.coalesce(stamp, c.try_cast("timestamp"))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/video/([0-9]{6,})", 1), F.lit(""))


def page_video_ids(html: Column, patterns: tuple[str, ...] = VIDEO_IDS) -> Column:
    """Video ids of a page in order of first appearance: all links first, then all JSON fields; null has none."""
    found = [F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), F.lit(1)) for p in patterns]
    return F.array_distinct(F.concat(*found))


def _absolute(url: Column) -> Column:
    """Blanks off, and ``https:`` before a url that starts with two slashes."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    return F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(bare)


def permalink_id(url: Column) -> Column:
    """The id of a video or note in the path of a url, else null."""
    path = F.regexp_extract(_absolute(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.nullif(F.regexp_extract(path, VIDEO_IDS[0], 1), F.lit(""))


def is_permalink(url: Column, site: str) -> Column:
    """Whether a url on a host that ends with ``site`` has the id of a video or note in its path."""
    host = F.lower(F.regexp_extract(_absolute(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return host.endswith(site) & permalink_id(url).isNotNull()


def canonical_url(url: Column, prefix: str) -> Column:
    """``prefix`` and the id, or the url without its query where it holds no id."""
    own = permalink_id(url)
    return F.when(own.isNotNull(), F.concat(F.lit(prefix), own)).otherwise(F.substring_index(_absolute(url), "?", 1))
