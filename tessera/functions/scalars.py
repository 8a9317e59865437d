"""Scalar functions as columns: everything here stays in the JVM unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by file extension, as the common registries have them.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "ogg": "audio/ogg", "flac": "audio/flac",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "md": "text/markdown", "py": "text/x-python",
    "json": "application/json", "xml": "text/xml", "pdf": "application/pdf", "zip": "application/zip", "mp4": "video/mp4",
}
OCTET_STREAM = "application/octet-stream"


def padded_id(n: Column) -> Column:
    """Six digits, zero-filled."""
    return F.format_string("%06d", n)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def object_key(path: Column, prefix: str = "model/") -> Column:
    """The key under which a file is uploaded: prefix and base name."""
    return F.concat(F.lit(prefix), basename(path))


def extension(path: Column) -> Column:
    """The lower-cased extension of the last path part, without the dot; '' where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(OCTET_STREAM))


def is_media(mime: Column) -> Column:
    return mime.like("image/%") | mime.like("audio/%")


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "\r\n", "")


def text_or_base64(content: Column, is_text: Column) -> tuple[Column, Column]:
    """(content, encoding): text where the type says so and the bytes are valid UTF-8, else Base64."""
    ok = is_text & F.is_valid_utf8(content.cast("string"))
    return F.when(ok, content.cast("string")).otherwise(base64_plain(content)), F.when(ok, F.lit("utf-8")).otherwise(F.lit("base64"))


def iso_time(ts: Column) -> Column:
    """ISO 8601 in the session's zone, UTC, the fraction left out where it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def permissions(mode: Column) -> Column:
    """The last three octal digits of a file mode."""
    return F.right(F.conv(mode.cast("string"), 10, 8), F.lit(3))


def env_name_safe(s: Column) -> Column:
    """An environment variable's name: upper case, other characters to _, and _ in front of a digit."""
    clean = F.regexp_replace(F.upper(s), "[^A-Z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def sanitize(s: Column) -> Column:
    """Every character that isn't an ASCII letter or digit to _."""
    return F.regexp_replace(s, "[^A-Za-z0-9]", "_")


def host_of(address: Column) -> Column:
    """What stands before the first slash or question mark, any scheme removed first."""
    return F.regexp_replace(F.regexp_replace(address, "^[a-z]+://", ""), "[/?].*", "")


def token_of(address: Column, name: str) -> Column:
    """The value of a parameter in an address, up to the next &; an address without it stays as it is."""
    return F.regexp_replace(address, f"(?s).*{re.escape(name)}=([^&]+).*", "$1")


def indented(items: Column, fields: Sequence[str]) -> Column:
    """An array of structs as JSON with an indent of two, as tools show it: only these fields, nulls as null."""
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    line = lambda x, f: F.concat(F.lit(f'    "{f}": '), F.when(x[f].isNull(), F.lit("null")).otherwise(quoted(x[f])))
    one = lambda x: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[line(x, f) for f in fields]), F.lit("\n  }"))
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(items, one), ",\n"), F.lit("\n]")))


def allowed_hosts(given: Column, default: Column, *more: Column) -> Column:
    """A comma-joined list: given or the default, and what is appended; nulls are left out."""
    return F.concat_ws(",", F.coalesce(given, default), *more)


def release_name(override: Column, chart: Column, release: Column) -> Column:
    """A release's full name: the override, else the release where it holds the chart's name, else both; 63 characters
    at most, without one trailing dash."""
    full = F.coalesce(override, F.when(F.contains(release, chart), release).otherwise(F.concat_ws("-", release, chart)))
    return F.regexp_replace(F.substring(full, 1, 63), "-$", "")


def label_value(s: Column) -> Column:
    return F.replace(s, F.lit("+"), F.lit("_"))


def canonical_json(entries: Column) -> Column:
    """A map<string,string> as JSON with sorted keys and a space after comma and colon."""
    quote = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    sorted_ = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("{"), F.concat_ws(", ", F.transform(sorted_, lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"])))), F.lit("}"))


def short_hash(s: Column) -> Column:
    """The first eight hex digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, 8)


def gib(n: Column) -> Column:
    return F.round(n / F.lit(float(1 << 30)), 2)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def general(x: Column, digits: int = 4) -> Column:
    """A number with so many significant digits in general format (a Python function, Arrow-batched)."""
    @F.pandas_udf("string")
    def fmt(v: pd.Series) -> pd.Series:
        return v.map(lambda z: None if z is None or z != z else f"{z:0.{digits}}")

    return fmt(x)


def run_name(ts: Column, experiment: Column, batch: Column, rate: Column) -> Column:
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), experiment, F.concat(F.lit("bs"), batch.cast("string")), F.concat(F.lit("lr"), rate.cast("string")))


def coerced(value: Column, error: Column) -> Column:
    """A result as text; where there is an error, its text with "Error: " in front."""
    return F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(value.cast("string"))


def within(path: Column, allowed: list[str], prefix_only: bool = False) -> Column:
    """Whether a resolved path lies in one of the allowed directories. prefix_only: any common prefix passes, so that
    /data2 counts as inside /data; some callers rely on that reading."""
    tests = [F.startswith(path, F.lit(d)) if prefix_only else (path == d) | F.startswith(path, F.lit(d.rstrip("/") + "/")) for d in allowed]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
