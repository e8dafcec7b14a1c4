"""Fragmented source tables to one evidence table of 13 columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.synthetic import ROLE_NAMES, ROLES

EVIDENCE = ("source_type", "source_id", "source_ts", "observed_ts", "actor", "service", "intent", "policy", "action", "outcome", "source_pointer", "correlation_id", "content_hash")


def _escaped(c: Column) -> Column:
    """Text as inside a JSON string of ASCII characters only: short escapes, else four hex digits, surrogates beyond the first plane."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(ch: Column) -> Column:
        n = F.ascii(ch).cast("long")
        high, low = F.shiftright(n - 0x10000, 10) + 0xD800, (n - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        short = reduce(lambda out, e: out.when(ch == e[0], e[1]), [('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")], F.when(F.lit(False), ""))
        return short.when(n.between(32, 126), ch).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    chars = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: one(F.substring(c, i, F.lit(1))))
    plain = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(c.rlike(r"[^\x20-\x7E]"), F.concat_ws("", chars)).otherwise(plain)


def content_hash(*cols) -> F.Column:
    """SHA-256 of the compact, ASCII-only JSON array of the values: numbers bare, text quoted."""
    parts = []
    for name, number in cols:
        value = F.col(name).cast("string")
        if not number:
            value = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
        parts.append(F.coalesce(value, F.lit("null")))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def to_evidence(df: DataFrame, plane: str) -> DataFrame:
    """One plane's rows under the evidence names, with its literal intent and the hash of its values."""
    names = dict(zip(ROLE_NAMES, ROLES[plane], strict=False))
    rows = df.select(F.lit(plane).alias("source_type"), "source_id", *[F.col(n).alias(r) for r, n in names.items()], F.lit(ROLES[plane][8]).alias("intent"))
    rows = rows.withColumn("observed_ts", F.col("source_ts"))
    hashed = [(c, c == "source_id") for c in EVIDENCE[:-1]]
    return rows.select(*EVIDENCE[:-1], content_hash(*hashed).alias("content_hash"))


def unified(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [to_evidence(df, plane) for plane, df in tables.items()])


def projected(df: DataFrame) -> DataFrame:
    """The evidence of rows of several planes that have the roles' names already, with source_type: one scan."""
    intent = F.create_map(*[F.lit(x) for plane, names in ROLES.items() for x in (plane, names[8])])
    rows = df.withColumns({"observed_ts": F.col("source_ts"), "intent": F.element_at(intent, F.col("source_type"))})
    return rows.select(*EVIDENCE[:-1], content_hash(*[(c, c == "source_id") for c in EVIDENCE[:-1]]).alias("content_hash"))


def lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    """Point lookup in reconstruction order; the equality reaches the scan."""
    return df.where(F.col(column) == value).orderBy("source_ts", "source_type", "source_id")


def equal_layouts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_only, right_only, left_rows, right_rows): rows by which two layouts differ, counting repeats, and their sizes."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(b.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    n = both.groupBy(*cols).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"))
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return n.agg(more("l", "r").alias("left_only"), more("r", "l").alias("right_only"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))
