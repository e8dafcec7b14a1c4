"""Deterministic hashes for selection and jitter, as columns.

A hash is the SHA-256 of a seed and parts joined with byte 31, in hex; hex
order is the order of the 256-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def seeded(seed: Column, *parts: Column | str) -> Column:
    """64 hex digits; a str part is a literal."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, seed.cast("string"), *texts), 256)


def fraction(digest: Column) -> Column:
    """The hash as a fraction of its range, from its first 52 bits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def modulo(digest: Column, n: Column | int) -> Column:
    """The 256-bit hash modulo n, n below 2 ** 31: eight words folded one after the other."""
    n = F.lit(n) if isinstance(n, int) else n
    word = lambda i: F.conv(F.substring(digest, F.lit(8) * i + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: (acc * 4294967296 + word(i)) % n.cast("long"))


def odd(digest: Column) -> Column:
    return F.substring(digest, -1, 1).isin("1", "3", "5", "7", "9", "b", "d", "f")
