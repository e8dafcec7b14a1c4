"""Allowlist projection with a ledger of what was dropped, and redaction of free JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_json(raw: Column, allowed: dict[str, str]) -> Column:
    """The allowed top-level members (name: pattern) of a JSON object whose text matches in full; others are left out."""
    m = F.from_json(raw, "map<string,string>")
    kept = F.map_filter(m, lambda k, v: F.lit(False) if not allowed else _any(k, v, allowed))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def _any(k: Column, v: Column, allowed: dict[str, str]) -> Column:
    out = F.lit(False)
    for name, pattern in allowed.items():
        out = out | ((k == name) & v.rlike(rf"\A(?:{pattern})\z"))
    return out


def drops(df: DataFrame, raw: str, allowed: dict[str, str]) -> DataFrame:
    """(path, reason, dropped): counts of left-out members. Names outside the allowlist are never recorded, only '*'."""
    entry = F.explode(F.map_entries(F.from_json(raw, "map<string,string>"))).alias("e")
    rows = df.select(entry).select("e.key", "e.value")
    known = F.col("key").isin(*allowed)
    bad = known & ~F.coalesce(_any(F.col("key"), F.col("value"), allowed), F.lit(False))
    rows = rows.where(bad | ~known).select(F.when(known, F.col("key")).otherwise("*").alias("path"), F.when(known, "invalid_value").otherwise("not_allowlisted").alias("reason"))
    return rows.groupBy("path", "reason").agg(F.count("*").alias("dropped"))


#: Members that go, members whose value is replaced (names in lower case), and the marks that stand instead.
DROPPED = ("sourceIPs", "authentication.kubernetes.io/credential-id", "authentication.kubernetes.io/issued-credential-id")
REPLACED = ("token", "ca.crt", "tls.crt", "certificate-authority-data", "client-certificate-data", "client-key-data")
PROJECTED = "serviceAccountToken"
SENSITIVE, PROJECTION, ABSOLUTE, CERTIFICATE, LOCAL = "<redacted-sensitive-value>", "<redacted-service-account-token-projection>", "<redacted-absolute-path>", "<redacted-certificate>", "<redacted-local-path>"
_LOCAL = re.compile(r"/(?:Users|home)/[^\s\"',}\]]+")
_SECRET = re.compile(r"(?i)bearer\s+[a-z0-9._~+/=-]+|-----BEGIN [A-Z ]+-----|/(?:Users|home)/[^/\s\"]+")


def _masked(name: str, value: str) -> str:
    """Text under a member's name: paths by the name, certificates and local paths by the text."""
    if value.startswith("/") and name != "requestURI" and name.lower().endswith("path"):
        return ABSOLUTE
    return CERTIFICATE if "-----BEGIN CERTIFICATE-----" in value else _LOCAL.sub(LOCAL, value)


def redact(value, name: str = ""):
    """A JSON value of any depth without what mustn't be public."""
    if isinstance(value, str):
        return _masked(name, value)
    if isinstance(value, list):
        return [redact(v, name) for v in value]
    if not isinstance(value, dict):
        return value
    mark = {k: SENSITIVE if k.lower() in REPLACED else PROJECTION for k in value if k.lower() in REPLACED or k == PROJECTED}
    return {k: mark[k] if k in mark else redact(v, k) for k, v in value.items() if k not in DROPPED}


def redacted_json(df: DataFrame, column: str, into: str = "redacted") -> DataFrame:
    """df with a column of redacted JSON of any depth, keys sorted; null where the text isn't JSON. Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            try:
                return json.dumps(redact(json.loads(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        for s in texts:
            yield s.map(one)

    return df.withColumn(into, run(F.col(column)))


def unsafe_paths(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys.., path) of JSON members that a public record must not have: sensitive names, keys, home paths."""

    def walk(value, path=""):
        if isinstance(value, dict):
            for k, v in value.items():
                if k.lower() in REPLACED or k in DROPPED or k == PROJECTED:
                    yield f"{path}.{k}"
                yield from walk(v, f"{path}.{k}")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        elif isinstance(value, str) and _SECRET.search(value):
            yield path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                try:
                    out += [(*row[:-1], p) for p in walk(json.loads(row[-1]))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=[*keys, "path"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, column).mapInPandas(run, f"{kinds}, path string")
