"""Text columns: names, paths, sizes, times, chunks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no such function."""
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalize_text(c: Column) -> Column:
    """Lower case, no accents, runs of separators and white space as one space, trimmed."""
    low = F.lower(c)
    # Only texts beyond ASCII go to Python; the others have nothing to decompose.
    plain = F.coalesce(_decomposed(F.when(F.octet_length(low) != F.length(low), low)), low)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\\/._\-]+", " "), r"\s+", " "))


def split_scheme(url: Column) -> tuple[Column, Column]:
    """(scheme or null, what follows)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, F.lit(1), at - 1)), F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)


def folded_path(path: Column) -> Column:
    """Absolute path without empty and '.' segments, with '..' taking the one before it."""
    keep = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(acc, s):
        return F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(keep, F.array().cast("array<string>"), step), "/"))


def base_url(url: Column) -> Column:
    scheme, rest = split_scheme(url)
    return F.when(scheme.isNull() | (scheme == "osfs"), F.lit("osfs:///")).otherwise(F.concat(scheme, F.lit("://"), F.substring_index(rest, "/", 1), F.lit("/")))


def path_in_fs(url: Column) -> Column:
    scheme, rest = split_scheme(url)
    at = F.instr(rest, "/")
    remote = F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit("/"))
    return folded_path(F.when(scheme.isNull() | (scheme == "osfs"), rest).otherwise(remote))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_local_url(url: Column) -> Column:
    return ~F.contains(url, F.lit("://")) | url.startswith("osfs://")


def capped_lines(text: Column, lines: int = 300, chars: int = 30_000) -> Column:
    """Leading whole lines with their line ends: at most `lines`, and at most `chars` characters."""
    parts = F.split(text, "\n")
    ended = F.filter(F.transform(parts, lambda s, k: F.when(k < F.size(parts) - 1, F.concat(s, F.lit("\n"))).otherwise(s)), lambda s: s != "")
    first = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        n = acc["n"] + F.length(line)
        full = acc["full"] | (n > chars)
        return F.struct(n.alias("n"), full.alias("full"), F.when(full, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"))

    return F.array_join(F.aggregate(F.slice(ended, 1, lines), first, step, lambda acc: acc["out"]), "")


def preview(text: Column, chars: int = 4096, lines: int = 25, shown: int = 400) -> Column:
    """The first lines of a text, cut to `shown` characters and dots."""
    head = F.array_join(F.slice(F.split(F.regexp_replace(F.substring(text, 1, chars), r"\n\z", ""), "\n"), 1, lines), "\n")
    return F.when(F.length(head) > shown, F.concat(F.substring(head, 1, shown), F.lit("..."))).otherwise(head)


def human_size(n: Column) -> Column:
    """0B, or a number of 1024-based units, rounded to two decimals."""
    units = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
    out = None
    for k in range(len(units) - 1, -1, -1):
        shown = F.concat(F.round(n.cast("double") / F.lit(float(1 << (10 * k))), 2).cast("string"), F.lit(" " + units[k]))
        out = F.when(n >= F.lit(1 << (10 * k)), shown) if out is None else out.when(n >= F.lit(1 << (10 * k)), shown)
    return out.otherwise(F.lit("0B"))


def human_length(seconds: Column) -> Column:
    """HH:MM:SS, the seconds rounded half to even."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    s = F.bround(seconds % 60, 0).cast("long")
    two = lambda c: F.when(c < 10, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat_ws(":", two(h), two(m), two(s))


def human_time_ago(then: Column, now: Column) -> Column:
    """Years, months, days, hours and minutes since, without zeros; null: Never."""
    months = F.floor(F.months_between(now, then, roundOff=False)).cast("int")
    # The whole months that fit: months_between counts part days, so step back if that overshoots.
    months = F.when(then + F.make_interval(F.lit(0), months) > now, months - 1).otherwise(months)
    rest = F.unix_timestamp(now) - F.unix_timestamp(then + F.make_interval(F.lit(0), months))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + unit)))
    parts = F.concat_ws(" ", part(F.floor(months / 12), "years"), part(months % 12, "months"), part(F.floor(rest / 86400), "days"), part(F.floor(rest % 86400 / 3600), "hours"), part(F.floor(rest % 3600 / 60), "minutes"))
    return F.when(then.isNull(), F.lit("Never")).when(F.unix_timestamp(now) - F.unix_timestamp(then) < 60, F.lit("Just now")).otherwise(F.concat(parts, F.lit(" ago")))


def literal_priority(path: Column, query: str) -> Column:
    """4 whole path, 3 a component of it, 2 a part of it, else 0; case-insensitive."""
    q = (query or "").strip().strip('"').lower().replace("\\", "/")
    comp = q.strip("/")
    p = F.lower(F.translate(path, "\\", "/"))
    out = F.lit(0)
    if q:
        out = F.when(p == q, 4)
        if comp:
            out = out.when(F.array_contains(F.filter(F.split(p, "/"), lambda s: s != ""), comp), 3)
        out = out.when(F.contains(p, F.lit(q)), 2).otherwise(0)
    return out


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of token windows; the last window ends at the end."""
    step = size - overlap if size > overlap else size
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def unquoted(c: Column) -> Column:
    """URL-decoded twice; a bad escape leaves a text as it is."""
    # A plus sign is not a space here.
    once = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    return once(once(c))


def is_unsafe(value: Column) -> Column:
    """Names a system folder, or is a path with a parent segment; both after decoding."""
    v = unquoted(value)
    parent = F.exists(F.split(F.translate(v, "\\", "/"), "/"), lambda s: s == "..")
    path_like = F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\"))
    return F.contains(F.lower(v), F.lit("/etc/")) | F.contains(F.lower(v), F.lit("/proc/")) | (path_like & parent)


#: A string literal of JSON, with the colon that makes it a field's name.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'


def json_strings(payload: Column) -> Column:
    """All string values of a JSON text at any depth, in the text's order; names of fields aren't values.

    One pass over the literals, so depth costs nothing. A text that isn't JSON is one value itself; null has none.
    """
    literals = F.filter(F.regexp_extract_all(payload, F.lit(_LITERAL), F.lit(0)), lambda x: x.endswith('"'))
    values = F.from_json(F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]")), "array<string>")
    return F.when(payload.isNull(), F.array().cast("array<string>")).when(F.try_parse_json(payload).isNull(), F.array(payload)).otherwise(values)


def capped_bytes(text: Column, most: int) -> Column:
    """The longest start of a text that has so many UTF-8 bytes at most."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)
