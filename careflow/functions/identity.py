"""Stable pseudonyms and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonymize(value: Column, salt: str | None = None) -> Column:
    """First 16 hex characters of SHA-256 of the UTF-8 text; null stays null. A salt is ours and off by default."""
    text = value.cast("string")
    if salt is not None:
        text = F.concat(F.lit(salt), text)
    return F.substring(F.sha2(text, 256), 1, 16)


def bucket(key: Column, n: int) -> Column:
    """A bucket 0..n-1 from the key's hash: the same wherever and however often it is computed."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def split_of(key: Column, train: int = 8, validation: int = 1, total: int = 10) -> Column:
    """train, validation or test by the key's bucket."""
    b = bucket(key, total)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")
