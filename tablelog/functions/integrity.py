"""Pseudonyms and sealed values from built-in cryptographic functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 of a binary message under a 32-byte binary key, as hex."""
    block = F.rpad(F.hex(key), 128, "0")
    inner, outer = _xored(block, 0x36), _xored(block, 0x5C)
    return F.sha2(F.concat(F.unhex(outer), F.unhex(F.sha2(F.concat(F.unhex(inner), message), 256))), 256)


def _xored(block: Column, pad: int) -> Column:
    """Each byte of a hex block xored with `pad`."""
    table = {f"{b:02X}": f"{b ^ pad:02X}" for b in range(256)}
    pairs = F.regexp_extract_all(block, F.lit("(..)"), F.lit(1))
    mapping = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(pairs, lambda p: F.try_element_at(mapping, p)), "")


def pseudonyms(key: Column, root: Column) -> Column:
    """An array<binary> key with every component replaced by its keyed digest.

    The digest's key is derived from the parent path, so equal paths keep equal
    pseudonyms, prefixes stay prefixes, and order is lost.
    """
    start = F.struct(F.hex(root).alias("k"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, c: F.struct(hmac_sha256(F.unhex(acc["k"]), F.concat(F.lit(b"path"), c)).alias("k"), F.concat(acc["out"], F.array(hmac_sha256(F.unhex(acc["k"]), c))).alias("out"))
    return F.aggregate(key, start, step, lambda acc: acc["out"])


def seal(value: Column, key: Column, bound_to: Column) -> Column:
    """AES-GCM with the operation it belongs to as authenticated data."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound_to)


def unseal(sealed: Column, key: Column, bound_to: Column) -> Column:
    """The sealed value, null if it was changed or belongs elsewhere."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)
