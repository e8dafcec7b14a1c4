"""Strict readers: JSON lines, JSON documents, CSV with a header contract, checksum manifests, log exports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input breaks its declared shape."""


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value VARIANT, raw, error): one row a non-blank line; bad lines and non-objects keep their text and a reason.

    Repeated keys and non-finite numbers are not JSON here.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw")
    v = F.try_parse_json("raw")
    kind = F.schema_of_variant(v)
    error = F.when(v.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
    return lines.select(F.when(error.isNull(), v).alias("value"), "raw", error.alias("error"))


def json_records(spark: SparkSession, path: str, member: str = "records") -> DataFrame:
    """(path, position, record, error): records of files that hold one object, an array, a collection or JSON lines.

    A file that can't be read to its end gives what came before, and one row with the reason.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def values(text: str) -> tuple[list, str | None]:
            decoder, at, out = json.JSONDecoder(), 0, []
            while at < len(text):
                while at < len(text) and text[at].isspace():
                    at += 1
                if at < len(text):
                    try:
                        value, at = decoder.raw_decode(text, at)
                    except ValueError as e:
                        return out, f"not JSON at character {getattr(e, 'pos', at)}"
                    out.append(value)
            if len(out) == 1 and isinstance(out[0], list):
                return out[0], None
            if len(out) == 1 and isinstance(out[0], dict) and isinstance(out[0].get(member), list):
                return out[0][member], None
            return out, None

        for b in batches:
            rows = []
            for p, text in b.itertuples(index=False):
                found, error = values(text)
                rows += [(p, i, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None) for i, v in enumerate(found)]
                rows += [(p, len(found), None, error)] * (error is not None)
            yield pd.DataFrame(rows, columns=["path", "position", "record", "error"])

    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, "path string, position long, record string, error string")


def csv(spark: SparkSession, path: str, columns: list[str], ordered: bool = False, types: dict[str, str] | None = None) -> DataFrame:
    """Rows of a CSV file whose header has exactly these columns, in this order if ordered.

    All are text but those with a type; error then names the columns whose text isn't of their type.
    """
    found = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    names = found.columns
    if len(set(names)) != len(names):
        raise ContractError(f"repeated columns: {names}")
    if (names != columns) if ordered else (sorted(names) != sorted(columns)):
        raise ContractError(f"columns are {names}, not {columns}")
    if not types:
        return found.select(*columns)
    bad = F.concat_ws(",", *[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), c) for c, t in types.items()])
    return found.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in columns], F.nullif(bad, F.lit("")).alias("error"))


def targets(spark: SparkSession, path: str, member: str = "targets") -> dict[str, str]:
    """Pinned versions by name from a small JSON manifest; every one must be an exact version."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    held = found.get(member) if isinstance(found, dict) else None
    if not isinstance(held, dict) or not held:
        raise ContractError(f"no {member}")
    if bad := sorted(k for k, v in held.items() if not isinstance(v, str) or not re.fullmatch(r"v?[0-9]+\.[0-9]+\.[0-9]+", v)):
        raise ContractError(f"not pinned: {bad}")
    return held


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(digest, path, error) of a checksum file; absolute paths and those that climb are errors."""
    line = r"\A([0-9a-f]{64})  ([^\r\n]+)\z"
    rows = spark.read.text(path).where("value <> ''").select(F.regexp_extract("value", line, 1).alias("digest"), F.regexp_extract("value", line, 2).alias("path"))
    unsafe = F.col("path").rlike(r"\A/|(?:\A|/)\.\.(?:/|\z)|\\")
    return rows.withColumn("error", F.when(F.col("digest") == "", "malformed").when(unsafe, "unsafe path"))


_TAGS = {"stringValue": str, "intValue": int, "doubleValue": float, "boolValue": bool, "bytesValue": str}


def _plain(value):
    """A tagged log value without its tags, at any depth."""
    if not isinstance(value, dict):
        return value
    for tag in _TAGS.keys() & value.keys():
        held = value[tag]
        return _TAGS[tag](held) if tag == "intValue" else held
    if "arrayValue" in value:
        return [_plain(v) for v in (value["arrayValue"] or {}).get("values", [])]
    if "kvlistValue" in value:
        return {e.get("key"): _plain(e.get("value")) for e in (value["kvlistValue"] or {}).get("values", [])}
    return None


def any_value(v: Column) -> Column:
    """The text of a tagged log value, whichever its tag; lists and maps become plain JSON. Only those reach Python."""

    @F.pandas_udf("string")
    def nested(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else json.dumps(_plain(json.loads(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    flat = F.coalesce(*[F.get_json_object(v, f"$.{t}") for t in _TAGS])
    return F.coalesce(flat, nested(F.when(flat.isNull(), v)))


LOG_EXPORT = "resourceLogs array<struct<scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,body:string>>>>>>"


def log_records(df: DataFrame, raw: str) -> DataFrame:
    """(time, body): records of log exports, three levels down."""
    rows = df.select(F.from_json(raw, LOG_EXPORT).alias("e")).select(F.explode("e.resourceLogs").alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("l"))
    return rows.select(F.col("l.timeUnixNano").alias("time"), any_value(F.col("l.body")).alias("body"))


def marked_lines(spark: SparkSession, path: str, job: str, step: str, pattern: str) -> DataFrame:
    """(found,) matches of a pattern in one job's step of a tab-separated log."""
    parts = F.split("value", "\t", 3)
    rows = spark.read.text(path).select(parts[0].alias("job"), parts[1].alias("step"), parts[2].alias("line"))
    return rows.where((F.col("job") == job) & (F.col("step") == step)).select(F.regexp_extract("line", pattern, 0).alias("found")).where("found <> ''")
