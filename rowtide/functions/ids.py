"""Derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of `name` in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def seed(name: Column) -> Column:
    """The first four bytes of the name's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")


def content_key(*parts: Column) -> Column:
    """A key for an exact input: the SHA-256 over length-prefixed parts, so no two inputs share one text; null is a part of its own."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-:")) for p in parts]
    return F.sha2(F.concat(*framed), 256)
