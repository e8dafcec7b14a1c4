"""Harmonic packing of documents into sequences of fixed capacity (operator 7).

A document's ids, with an end id, are cut into full sequences and a rest. The
rest's length lies in a reciprocal class: class k holds the lengths that fit k
times into a sequence but not k + 1 times. A rest that would leave too much of
its slot empty gives off a piece that fills a slot of the next class exactly.
Every k pieces of class k make a sequence. A piece's place in its class is its
rank in its partition plus the ranks of the partitions before, so workers fill
sequences independently; only counts per class and partition are exchanged.
The pieces beyond each class's last full sequence, a number bounded by the
classes alone, are packed together, largest first.

Defined results: a null text counts as empty and is its end id alone; repeated
rows are packed as often as they occur; a null key stays null; an empty table
gives no pieces; columns besides the key and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored
from .tokens import MOST_CACHED, encode

CAPACITY, END = 4096, 2
FULL_ENOUGH = 0.97
SMALL = 64
CUTS = 3
PIECE = 256


def slots(length: int, capacity: int = CAPACITY) -> tuple[int, int]:
    """(class number, pieces per sequence) of a piece's length; lengths up to SMALL have a class each."""
    return (length - 1, capacity // length) if length <= SMALL else (SMALL + capacity // length, capacity // length)


def most_class(capacity: int = CAPACITY) -> int:
    """The largest class number: that of the shortest length above SMALL."""
    return SMALL + capacity // (SMALL + 1)


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces that n ids are cut into."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(CUTS - 1):
        if rest <= SMALL or rest * (capacity // rest) >= FULL_ENOUGH * capacity:
            break
        exact = capacity // (capacity // rest + 1)
        out.append(exact)
        rest -= exact
    return out + [rest] * (rest > 0)


def _cut(tokenizer: str, capacity: int, with_ids: bool, cached: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks: Counter = Counter()
        end = END.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                b = batch.slice(at, PIECE)
                rows, of = [], []
                for i, ids in enumerate(encode([x or "" for x in b.column(1).to_pylist()], tokenizer, cached)):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for n in pieces(total, capacity):
                        own = ids[4 * start : 4 * (start + n)]
                        kind, per = slots(n, capacity)
                        rows.append((start, n, zlib.crc32(own), total, kind, per, part, ranks[kind], own if with_ids else None))
                        of.append(i)
                        ranks[kind] += 1
                        start += n
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64(), pa.binary()]
                yield pa.record_batch([b.column(0).take(pa.array(of, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", *NAMES])

    return cut


NAMES = ["start", "length", "ids_crc32", "doc_tokens", "class", "per", "part", "rank", "ids"]


def _left(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        """Best fit of the longest first; rooms: free space and number of each open sequence."""
        rows = rows.sort_values(["length", "key", "start", "part", "rank"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        rooms: list[tuple[int, int]] = []
        seq, made = [], 0
        for n in rows["length"]:
            at = bisect_left(rooms, (n, -1))
            if at == len(rooms):
                free, s, made = capacity, made, made + 1
            else:
                free, s = rooms.pop(at)
            seq.append(s)
            if free > n:
                insort(rooms, (free - n, s))
        rows["bin"], rows["slot"] = seq, range(len(rows))
        return rows

    return pack


def pack(spark: SparkSession, df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, cached: int = MOST_CACHED) -> DataFrame:
    """One row a piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and its ids on demand.

    cached: words whose ids a worker keeps, some 200 bytes each.
    """
    kind = df.schema[key].dataType.simpleString()
    made = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_cut(tokenizer, capacity, with_ids, cached), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, per int, part int, rank long, ids binary")
    made, _ = stored(spark, made if with_ids else made.drop("ids"), "pieces")
    counts = made.groupBy("class", "per", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), (F.sum("n").over(Window.partitionBy("class")) / F.col("per")).cast("long").alias("bins"))
    # a class has one row a partition; small beside the pieces, so a hot class is not exchanged by its number if the table is small
    placed = made.join(counts, ["class", "part"]).withColumn("at", F.col("first") + F.col("rank"))
    placed = placed.withColumns({"bin": F.floor(F.col("at") / F.col("per")).cast("long"), "slot": F.col("at") % F.col("per")})
    full = placed.where("bin < bins").drop("first", "bins", "at")
    # at most capacity // length pieces a class are left over, whatever the input
    left = placed.where("bin >= bins").drop("first", "bins", "at")
    last = most_class(capacity) + 1
    left = left.groupBy(F.lit("left")).applyInPandas(_left(capacity), left.schema).withColumn("class", F.lit(last))
    both = full.unionByName(left).withColumn("sequence_id", F.col("bin") * (last + 1) + F.col("class"))
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset")]
    if with_ids:
        out.append(F.col("ids"))
    return both.select(*out)
