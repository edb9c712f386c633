"""Paths, prefix keys and time keys."""

from __future__ import annotations

from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_segment(segment: Column) -> Column:
    """Percent-encoding with only letters, digits and ``_.-~`` left as they are."""
    plain = F.url_encode(segment.cast("string"))
    return F.replace(F.replace(F.replace(plain, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_key(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(path, encode_segment), "/"))


def prefix_keys(path: Column) -> Column:
    """Keys of all non-empty prefixes, shortest first; an empty path has none."""
    encoded = F.transform(path, encode_segment)
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(encoded, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))


def leaf_key(keys: Column) -> Column:
    """The longest prefix key; an empty list raises an error."""
    return F.element_at(keys, -1)


def leaf_key_or_blank(keys: Column) -> Column:
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit(""))


TIME_FORMATS = ("/yyyy", "/yyyy/MM", "/yyyy/MM/dd", "/yyyy/MM/dd/HH")


def time_keys(ts: Column) -> Column:
    return F.array(*(F.date_format(ts, f) for f in TIME_FORMATS))


def hour_shard(ts: Column) -> Column:
    return F.date_format(ts, TIME_FORMATS[-1])


def time_path(ts: Column) -> Column:
    return F.array(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts))


def day_key(path: Column, separator: str = "-") -> Column:
    """The day of a time path without padding; miners join by '-', evidence by '/'."""
    return F.array_join(F.slice(path.cast("array<string>"), 1, 3), separator)


def utc_iso(ts: Column) -> Column:
    """ISO text in UTC; microseconds only where there are any. The session's time zone must be UTC."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def parse_time(text: str) -> dict:
    """Parts of an ISO time in UTC; a time without a zone is taken as UTC."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    parts = {name: getattr(at, name) for name in ("year", "month", "day", "hour", "minute", "second")}
    return parts | {"iso": at.isoformat().replace("+00:00", "Z")}


def plain_prefix_keys(path: list[str]) -> list[str]:
    encoded = [quote(str(x), safe="") for x in path]
    return ["/" + "/".join(encoded[:n]) for n in range(1, len(encoded) + 1)]


def plain_time_keys(parts: dict) -> list[str]:
    text = f"/{parts['year']:04d}/{parts['month']:02d}/{parts['day']:02d}/{parts['hour']:02d}"
    return [text[:5], text[:8], text[:11], text]


def hashed_segment(segment: Column, salt: str) -> Column:
    return F.concat(F.lit("hash-sha256:"), F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), segment), 256))


def hashed_path(path: Column, salt: str) -> Column:
    return F.transform(path, lambda s: hashed_segment(s, salt))
