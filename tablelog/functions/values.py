"""Storage-class values: lossless dynamic columns, affinity and key images.

A dynamic value is struct<t, i, r, s, b>: its class (null, integer, real, text,
blob) and one filled field. Key images are byte strings whose equality is the
engine's key equality: integers and integral reals agree, text never equals a
number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VALUE_TYPE = "struct<t:string,i:bigint,r:double,s:string,b:binary>"
#: The affinity of a declared type, by the first fragment that occurs in it.
AFFINITY = (("INT", "integer"), ("CHAR", "text"), ("CLOB", "text"), ("TEXT", "text"), ("BLOB", "blob"), ("REAL", "real"), ("FLOA", "real"), ("DOUB", "real"))
STRICT_TYPES = ("INT", "INTEGER", "REAL", "TEXT", "BLOB", "ANY")


def affinity_of(declared: str, strict: bool = False) -> str:
    name = " ".join(declared.upper().split())
    if strict and name == "ANY":
        return "blob"
    return next((a for part, a in AFFINITY if part in name), "numeric")


def spark_type(declared: str, strict: bool = False) -> str:
    return {"integer": "bigint", "text": "string", "blob": "binary", "real": "double"}.get(affinity_of(declared, strict), VALUE_TYPE)


def value(kind: str, c: Column | None = None) -> Column:
    """A dynamic value of one class; nulls are of class null."""
    fields = {"integer": ("i", "bigint"), "real": ("r", "double"), "text": ("s", "string"), "blob": ("b", "binary")}
    if kind == "null":
        c = F.lit(None)
    made = F.struct(
        F.when(c.isNull(), "null").otherwise(kind).alias("t"),
        *((c.cast(t) if kind == k else F.lit(None).cast(t)).alias(n) for k, (n, t) in fields.items()))
    return made


def typeof(v: Column) -> Column:
    return v["t"]


def quote(v: Column) -> Column:
    """The literal that writes a dynamic value."""
    return (F.when(v["t"] == "integer", v["i"].cast("string")).when(v["t"] == "real", v["r"].cast("string"))
            .when(v["t"] == "text", F.concat(F.lit("'"), F.replace(v["s"], F.lit("'"), F.lit("''")), F.lit("'")))
            .when(v["t"] == "blob", F.concat(F.lit("X'"), F.hex(v["b"]), F.lit("'"))).otherwise("NULL"))


def with_affinity(v: Column, affinity: str) -> Column:
    """The stored value: text that reads as a number becomes one under numeric affinities, numbers become text under text."""
    if affinity == "text":
        number = v["t"].isin("integer", "real")
        return F.when(number, value("text", F.coalesce(v["i"].cast("string"), v["r"].cast("string")))).otherwise(v)
    if affinity == "real":
        whole = F.coalesce(v["r"], v["i"].cast("double"), v["s"].try_cast("double"))
        return F.when(v["t"].isin("integer", "text") & whole.isNotNull(), value("real", whole)).otherwise(v)
    if affinity in ("integer", "numeric"):
        as_int, as_real = F.coalesce(v["s"].try_cast("bigint"), F.when(_integral(v["r"]), v["r"].cast("bigint"))), v["s"].try_cast("double")
        whole_text = F.when(_integral(as_real), as_real.cast("bigint"))
        return (F.when(v["t"].isin("text", "real") & as_int.isNotNull(), value("integer", as_int))
                .when((v["t"] == "text") & whole_text.isNotNull(), value("integer", whole_text))
                .when((v["t"] == "text") & as_real.isNotNull(), value("real", as_real)).otherwise(v))
    return v


def _integral(r: Column) -> Column:
    return (r == F.floor(r).cast("double")) & (F.abs(r) < F.lit(9.2e18))


def strict_ok(v: Column, declared: str) -> Column:
    """Whether a strict column of this type takes the value."""
    kind = declared.upper()
    if kind == "ANY":
        return F.lit(True)
    want = {"INT": "integer", "INTEGER": "integer", "REAL": "real", "TEXT": "text", "BLOB": "blob"}[kind]
    return v["t"].isin(want, "null")


def key_image(v: Column) -> Column:
    """Bytes that are equal where keys are: class tag, then the value; null gives a lone 00."""
    number = F.coalesce(v["i"], F.when(_integral(v["r"]), v["r"].cast("bigint")))
    flipped = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return (F.when(number.isNotNull(), F.unhex(F.concat(F.lit("01"), flipped)))
            .when(v["t"] == "real", F.concat(F.unhex(F.lit("02")), F.encode(v["r"].cast("string"), "utf-8")))
            .when(v["t"] == "text", F.concat(F.unhex(F.lit("03")), F.encode(v["s"], "utf-8")))
            .when(v["t"] == "blob", F.concat(F.unhex(F.lit("04")), v["b"])).otherwise(F.unhex(F.lit("00"))))
