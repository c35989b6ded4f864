"""Hierarchical keys: arrays of components, compared component by component.

A range is the prefix that its keys begin with; the empty prefix covers all.
Everything is a Column expression, so prefix tests run inside generated code
and covering lookups become equi-joins on exploded ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_COMPONENTS = 256


def covers_key(prefix: Column, key: Column) -> Column:
    """Whether `key` begins with all components of `prefix`."""
    return (F.size(prefix) <= F.size(key)) & (F.slice(key, F.lit(1), F.size(prefix)) == prefix)


def overlaps(a: Column, b: Column) -> Column:
    """Two prefixes overlap where one covers the other."""
    return covers_key(a, b) | covers_key(b, a)


def intersection(a: Column, b: Column) -> Column:
    """The narrower of two overlapping prefixes, null if they are disjoint."""
    return F.when(covers_key(a, b), b).when(covers_key(b, a), a)


def ancestors(key: Column) -> Column:
    """All prefixes of `key`, the empty one and the key itself included."""
    return F.transform(F.sequence(F.lit(0), F.size(key)), lambda n: F.slice(key, F.lit(1), n))


def encode(key: Column) -> Column:
    """Order-preserving flat bytes of an array<binary>: 00 becomes 00 01, a component ends with 00 00."""
    hexed = F.transform(key, lambda c: F.concat(F.regexp_replace(F.hex(c), "(..)", "$1 "), F.lit("")))
    escaped = F.transform(hexed, lambda h: F.concat(F.replace(h, F.lit("00 "), F.lit("0001 ")), F.lit("0000")))
    return F.unhex(F.replace(F.array_join(escaped, ""), F.lit(" "), F.lit("")))


def decode(flat: Column) -> Column:
    """The array<binary> that encode() wrote."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.hex(flat), "(..)", "$1 "), F.lit("(00 01 |00 00 |.. )"), F.lit(1))
    plain = F.transform(pieces, lambda p: F.when(p == "00 01 ", "00").when(p == "00 00 ", "|").otherwise(F.rtrim(p)))
    return F.transform(F.split(F.regexp_replace(F.array_join(plain, ""), r"\|$", ""), r"\|"), F.unhex)
