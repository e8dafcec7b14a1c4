"""URL filter: blocked Bloom filter before an exact hash join (operator 2).

Entries are canonical URLs: a lower-case host and a path. An entry covers its
host and all subdomains, and all paths that start with its own. A URL's
candidate keys are its host's suffixes with its path cut at each length that
occurs in the list. A blocked Bloom filter (one 256-bit block a key, 8 bits
set in it) lets through possible hits; an exact join on the key removes the
false ones; the longest entry wins, a rule before a listed URL.

The filter is a table of blocks whose number has a fixed upper bound, so it
can be broadcast at any size of the list: beyond the bound only the share of
false hits rises, and the exact join still removes them.

Defined results: a null URL or one without "://" has an empty host and path
and fits no entry; repeated rows and equal ids give repeated results; an empty
list blocks nothing; an empty table gives an empty result; columns besides the
id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS_MOST = 1 << 18
BITS = 256

#: Rules as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Names of junk hosts. Under org the rule decides, so the list has them under the other two only.
JUNK = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
LISTED = [(f"{name}.example.{top}", "/", "block") for name in JUNK for top in ("com", "net")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url):
    """Columns host and path of a URL."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _masks(key):
    """Four words of a block with two bits set in each."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom(entries: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3), and the number of blocks."""
    blocks = 16
    while blocks < BLOCKS_MOST and blocks * BITS < 12 * n_keys:
        blocks *= 2
    own = entries.select(F.pmod(F.xxhash64("entry"), F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("entry")))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def url_filter(spark: SparkSession, df: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, listed, verdict) for each row; entries: (host, path, verdict, is_rule)."""
    listed = entries.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("entry"), F.length("path").alias("n_path"), F.length("host").alias("n_host"), F.col("verdict").alias("entry_verdict"), "is_rule").distinct()
    size = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("n_path")).alias("cuts")).first()
    host, path = split_url(F.col(url))
    rows = df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    cuts = F.filter(F.lit(list(size["cuts"])).cast("array<int>"), lambda n: n <= F.length("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    asked = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(keys)).alias("candidate"))
    table, blocks = bloom(listed, size["n"])
    asked = asked.select("*", F.pmod(F.xxhash64("candidate"), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("candidate")))])
    possible = asked.join(F.broadcast(table), "block")
    for i in range(4):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    hits = possible.join(listed, possible["candidate"] == listed["entry"])
    best = lambda cond, what: F.max_by(F.when(cond, F.col(what)), F.when(cond, F.struct(F.length("entry"), F.col("n_host"))))
    rule = F.col("is_rule")
    judged = hits.groupBy("host", "path").agg(best(rule, "entry").alias("rule"), best(rule, "entry_verdict").alias("rule_verdict"), best(~rule, "entry").alias("listed"), best(~rule, "entry_verdict").alias("listed_verdict"))
    out = rows.join(judged, ["host", "path"], "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule", "listed", F.coalesce("rule_verdict", "listed_verdict", F.lit(default)).alias("verdict"))


def entries_from(spark: SparkSession, path: str) -> DataFrame:
    """Rules and a list that is kept as a table (Parquet) of urls: (url, verdict, is_rule)."""
    host, path_ = split_url(F.when(F.instr("url", "://") > 0, F.col("url")).otherwise(F.concat(F.lit("any://"), F.col("url"))))
    return spark.read.parquet(path).select(host.alias("host"), F.when(path_ == "", "/").otherwise(path_).alias("path"), "verdict", "is_rule").where("host <> ''")


def default_entries(spark: SparkSession) -> DataFrame:
    """The contract's rules and the built-in list."""
    rows = [(*r, True) for r in RULES] + [(*r, False) for r in LISTED]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def _values(rows: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows)


SQL = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_values(RULES)}),
listed(h, p, v) AS (VALUES {_values(LISTED)}),
asked AS (SELECT DISTINCT host, path FROM parts WHERE host <> ''),
by_rule AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM asked JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
by_list AS (
  SELECT host, path, arg_max(v, length(h || p)) AS v, arg_max(h || p, length(h || p)) AS listed
  FROM asked JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(by_rule.v, by_list.v, 'allow') AS verdict, listed
FROM parts LEFT JOIN by_rule ON parts.host = by_rule.host AND parts.path = by_rule.path
LEFT JOIN by_list ON parts.host = by_list.host AND parts.path = by_list.path
"""
