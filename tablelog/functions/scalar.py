"""Scalar functions whose names or null rules differ from Spark's own."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def iif(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def scalar_max(*columns: Column) -> Column:
    """The largest argument; null if any is null."""
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.greatest(*columns))


def scalar_min(*columns: Column) -> Column:
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.least(*columns))


def _any_null(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def unicode_of(text: Column) -> Column:
    """The code point of the first character, null for empty text."""
    return F.when(F.length(text) > 0, F.conv(F.hex(F.encode(F.substring(text, 1, 1), "UTF-32")), 16, 10).cast("bigint"))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def glob_pattern(pattern: str) -> str:
    """A GLOB pattern (* ? [set]) as an anchored regular expression."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            inner = pattern[k + 1 : end]
            negate = inner.startswith("^")
            out.append("[" + ("^" if negate else "") + re.sub(r"([\\\[\]&])", r"\\\1", inner[negate:]) + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_pattern(pattern))


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to ASCII case."""
    return text.ilike(pattern, escape) if escape else text.ilike(pattern)


def julianday(ts: Column) -> Column:
    """Days since noon of the Julian epoch, of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000) + F.lit(2_440_587.5)


#: Strftime fields and the date_format letters for them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def strftime(form: str, ts: Column) -> Column:
    parts = []
    for piece in re.findall(r"%.|[^%]+", form):
        if piece == "%s":
            parts.append(F.unix_seconds(ts.cast("timestamp")).cast("string"))
        elif piece == "%w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif piece in STRFTIME:
            parts.append(F.date_format(ts, STRFTIME[piece]))
        else:
            parts.append(F.lit("%" if piece == "%%" else piece))
    return F.concat(*parts)


def json_extract(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def total(c: Column) -> Column:
    """The sum as a real number, 0.0 over no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0).cast("double"))


def group_concat(c: Column, separator: str = ",", order: Column | None = None) -> Column:
    """Joined texts; with `order`, in its order."""
    text = c.cast("string")
    if order is None:
        return F.listagg(text, F.lit(separator))
    pairs = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)
