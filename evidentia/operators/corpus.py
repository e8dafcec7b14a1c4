"""Checks over stored corpora, runs and pilots: scans, contracts, cohorts, pooled statistics, orders and reproducible loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import modulo, seeded
from .faults import _chosen

#: What no public text may hold.
PRIVATE = {
    "absolute_path": r"/(?:Users|home)/[A-Za-z0-9._-]+",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "bearer_token": r"(?i)\bbearer\s+[a-z0-9._~+/=-]{16,}",
    "placeholder": r"\b(?:TODO|TBD|FIXME|XXX)\b",
}
FORBIDDEN = r"(?:\A|/)(?:\.DS_Store|__pycache__|\.env|[^/]*\.(?:pyc|pem|key|p12|kubeconfig))(?:/|\z)"


def findings(df: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(key, rule, hits): how often whole texts hold what each rule forbids; texts without a hit have no row."""
    rules = rules or PRIVATE
    found = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("hits")) for n, p in rules.items()])).alias("f")
    return df.select(key, found).select(key, "f.rule", "f.hits").where("hits > 0")


def forbidden_names(files: DataFrame, path: str = "path", pattern: str = FORBIDDEN) -> DataFrame:
    return files.where(F.col(path).rlike(pattern))


def unsafe_members(files: DataFrame, path: str = "path", size: str = "size", most: int = 64 << 20, deep: int = 16) -> DataFrame:
    """(path, error) of archive members that climb, are absolute, lie too deep or are too large."""
    p = F.col(path)
    error = F.when(p.rlike(r"\A/|\\|\x00") | (p == ""), "not a relative path").when(p.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), "climbs").when(F.size(F.split(p, "/")) > deep, "too deep").when(F.col(size) > most, "too large")
    return files.select(path, error.alias("error")).where("error is not null")


def consecutive(df: DataFrame, column: str, last: int) -> DataFrame:
    """(missing, extra, repeated): what keeps the ids from being exactly 1 to last."""
    counts = df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    inside = F.col("id").between(1, last)
    return counts.agg((F.lit(last) - F.count_if(inside)).alias("missing"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))


def typed_contract(df: DataFrame, raw: str, wanted: dict[str, object]) -> DataFrame:
    """df with broken: the paths whose value or type isn't the wanted one; 1 is neither 1.0 nor "1" nor true."""
    v = F.try_parse_json(raw)
    types = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE|DECIMAL.*", str: "STRING"}
    said = []
    for path, want in wanted.items():
        got = F.try_variant_get(v, path, "variant")
        ok = F.coalesce(F.schema_of_variant(got).rlike(f"^(?:{types[type(want)]})$"), F.lit(False)) & F.coalesce(F.try_variant_get(v, path, {bool: "boolean", int: "long", float: "double", str: "string"}[type(want)]) == F.lit(want), F.lit(False))
        said.append(F.when(~ok, path))
    return df.withColumn("broken", F.array_compact(F.array(*said)))


def png_size(content: Column) -> Column:
    """(width, height) of a PNG header, null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    magic = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452") & (F.length(content) >= 24)
    return F.when(magic, F.struct(number(17).alias("width"), number(21).alias("height")))


def missing_phrases(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """(phrase,) that no text holds; one pass, one flag a phrase."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(text).contains(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(phrases)])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("there")) for i, p in enumerate(phrases)])).alias("x")).where("not x.there").select("x.phrase")


def pilot_errors(count: str, share: str) -> Column:
    """Why a pilot's row breaks its number rules: plain decimals only, counts whole, shares within 0 to 1."""
    whole, number = r"\A(?:0|[1-9][0-9]*)\z", r"\A(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
    return F.array_compact(F.array(F.when(~F.coalesce(F.col(count).rlike(whole), F.lit(False)), f"{count}: no whole number"), F.when(~F.coalesce(F.col(share).rlike(number), F.lit(False)), f"{share}: no number"), F.when(F.col(share).rlike(number) & (F.col(share).cast("double") > 1), f"{share}: over 1")))


def pooled(df: DataFrame, by: list[str], covered: str, wanted: str, false: str, claimed: str) -> DataFrame:
    """(by.., coverage, false_fraction): ratios of sums, null where nothing was wanted or claimed."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(covered), F.sum(wanted)).alias("coverage"), F.try_divide(F.sum(false), F.sum(claimed)).alias("false_fraction"))


def version_mismatch(df: DataFrame, wanted: str, found: dict[str, str]) -> Column:
    """Names of the components whose version isn't the wanted one, sorted and joined."""
    return F.concat_ws(",", *[F.when(~F.coalesce(F.ltrim(F.col(c), F.lit("v")) == F.ltrim(F.col(wanted), F.lit("v")), F.lit(False)), n) for n, c in sorted(found.items())])


def target_of(tag: Column, targets: dict[str, str], shape: str) -> Column:
    """The pinned version that a tag selects by its one capturing group; null for tags outside the list."""
    key = F.regexp_extract(tag, shape, 1)
    table = F.create_map(*[F.lit(x) for kv in sorted(targets.items()) for x in kv])
    return F.when(key != "", F.try_element_at(table, key))


def outcomes(jobs: DataFrame, run: str, job: str, conclusion: str, expected: tuple[str, ...]) -> DataFrame:
    """(run, outcome, jobs): one outcome a run: failure before cancelled before skipped before success; incomplete if a job that it needs isn't there."""
    has = lambda c: F.bool_or(F.col(conclusion) == c)
    per = jobs.groupBy(run).agg(F.count("*").alias("jobs"), F.size(F.array_intersect(F.collect_set(job), F.array(*map(F.lit, expected)))).alias("needed"), *[has(c).alias(f"is_{c}") for c in ("failure", "cancelled", "skipped")])
    out = F.when(F.col("is_failure"), "failure").when(F.col("needed") < len(set(expected)), "incomplete").when(F.col("is_cancelled"), "cancelled").when(F.col("is_skipped"), "skipped").otherwise("success")
    return per.select(run, out.alias("outcome"), "jobs")


def sole(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, invocations, sole): whether a tag was invoked exactly once and every field is there."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return df.groupBy(by).agg(F.count("*").alias("invocations"), ((F.count("*") == 1) & F.bool_and(whole)).alias("sole"))


def order_differences(expected: DataFrame, observed: DataFrame, position: str, value: str) -> DataFrame:
    """(position, expected, observed) where two ordered lists differ."""
    e, o = expected.select(position, F.col(value).alias("expected")), observed.select(position, F.col(value).alias("observed"))
    return e.join(o, position, "full").where(~F.col("expected").eqNullSafe(F.col("observed")))


def design_differences(observed: DataFrame, factors: dict[str, list]) -> DataFrame:
    """(factors.., status): members that a full cross of the factors misses or has too many; the cross is as large as the design."""
    spark, names = observed.sparkSession, list(factors)
    want = None
    for n, values in factors.items():
        one = spark.createDataFrame([(v,) for v in values], [n])
        want = one if want is None else want.crossJoin(one)
    got = observed.groupBy(*names).agg(F.count("*").alias("n"))
    both = want.withColumn("w", F.lit(1)).join(got, names, "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.select(*names, status.alias("status")).where("status is not null")


def cohort_summary(runs: DataFrame, version: str, ok: str, wanted: int) -> DataFrame:
    """One row: versions, how many are complete, runs, good runs, and the cohort's status."""
    per = runs.groupBy(version).agg(F.count("*").alias("n"), F.count_if(ok).alias("good"))
    out = per.agg(F.count("*").alias("versions"), F.count_if((F.col("n") == wanted) & (F.col("good") == wanted)).alias("complete_versions"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good_runs"))
    return out.withColumn("status", F.when(F.col("versions") == 0, "empty").when(F.col("complete_versions") == F.col("versions"), "complete_success").when(F.col("good_runs") == 0, "failed").otherwise("partial"))


def attempts(df: DataFrame, run: str, attempt: str, conclusion: str) -> DataFrame:
    """(run, attempts, first, last, recovered): how a run's attempts went."""
    first, last = F.min_by(conclusion, attempt), F.max_by(conclusion, attempt)
    return df.groupBy(run).agg(F.count("*").alias("attempts"), first.alias("first"), last.alias("last"), ((first != "success") & (last == "success")).alias("recovered"))


def totals(df: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    """One row of sums and balanced: whether the parts add up to the whole."""
    out = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (whole, *parts)])
    return out.withColumn("balanced", F.col(whole) == sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def object_sizes(df: DataFrame, name: str, size: str) -> DataFrame:
    return df.groupBy(name).agg(F.sum(size).alias("bytes"), F.count("*").alias("pages")).orderBy(name)


def rotation(df: DataFrame, trial: str, variants: list[str], offset: int = 0) -> DataFrame:
    """(trial, position, variant): each trial runs all variants, starting one further than the trial before."""
    k = len(variants)
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(F.array(*map(F.lit, variants)), ((F.col(trial) + offset + i) % k + 1).cast("int")))).alias("position", "variant")
    return df.select(trial, at)


def accounting(inputs: DataFrame, assigned: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """(key, status) of events that are lost, counted twice or unknown: assigned and removed ones must make up the input."""
    rows = inputs.select(key, F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(assigned.select(key, F.lit(0).alias("i"), F.lit(1).alias("o"))).unionByName(removed.select(key, F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = rows.groupBy(key).agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    status = F.when(F.col("o") == 0, "lost").when(F.col("i") == 0, "unknown").when(F.col("o") > F.col("i"), "counted twice")
    return n.select(key, status.alias("status")).where("status is not null")


def deliveries(events: DataFrame, key: str, rate: float, retry: int, label: str, seed: int) -> DataFrame:
    """events with phase: what a lossy delivery does with each. Exactly round(n * rate) are dropped at first and recovered after the restart; every retry-th of the others, by hash, is sent twice.

    turn is the shuffled order: the place of the event's hash.
    """
    rows = events.withColumn("seed", F.lit(seed).cast("long"))
    h = seeded(F.col("seed"), label, F.col(key))
    marked = _chosen(rows, rate, h, key)
    twice = ~F.col("__hit") & (modulo(seeded(F.col("seed"), f"{label}-retry", F.col(key)), retry) == 0)
    return marked.withColumns({"turn": h, "phase": F.when(F.col("__hit"), "dropped_then_recovered").when(twice, "sent_twice").otherwise("sent")}).drop("__hit", "seed")

