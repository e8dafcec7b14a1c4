"""Document fingerprints by invertible Bloom lookup sketches (operator 1), in DataFrame functions only.

A text is cut into paragraphs: lines, long ones again at the first sentence
end after PARAGRAPH code points. Its set of paragraph digests goes into a
sketch of three subtables of s cells each; a cell holds a count, the xor of
its digests and the xor of their checks. Two sketches of equal size subtract
cell by cell, and what both have cancels. Peeling takes a digest from every
cell that holds exactly one, removes it from its other cells, and repeats:
what it recovers are the digests in which the texts differ. The likeness is
the share of paragraphs that both have: (|A| + |B| - recovered) / (|A| + |B|).

The fingerprint is the paragraph count and a sketch of BASE cells a subtable,
so equal texts have equal fingerprints. The two fingerprints of a pair are
subtracted and peeled first. Where they differ in more than such a sketch can
tell, larger ones are made of the same digests: sized by both paragraph counts
and peeled by aggregations whose grouping all lies below the row's id, so
cells and digests are exchanged once with their row and never again. Pairs
that do not peel within ROUNDS are tried again with sketches twice as large,
and twice again, in their own rows.

Defined results: a null text counts as empty; an empty text has no paragraphs,
and two of them have likeness 1; null keys come last in the order; rows with
equal keys follow each other by a hash of their text; the last row's next is
the first, so a lone row is its own next; an empty table gives an empty
result; columns besides the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, whole_text

PARAGRAPH = 100
BASE, BASE_ROUNDS = 4, 12
ROUNDS = 6
RETRIES, RETRY_ROUNDS = 3, 40
BUCKET_ROWS, BUCKETS_MOST = 500, 1 << 16
NULL_KEY = -(1 << 63)

_UNITS = rf"[^\n]{{{PARAGRAPH},}}?[.!?](?=\s)|[^\n]+"
_LOW = (1 << 40) - 1
_FOUND, _DIGEST = 1 << 39, (1 << 39) + 1


def digests(text: str) -> str:
    """SQL: distinct paragraph digests of a text column."""
    return f"array_distinct(transform(regexp_extract_all({text}, r'{_UNITS}', 0), p -> xxhash64(trim(p))))"


def _cells(k: str, s: str) -> list[str]:
    """SQL: the three cells of a digest k in a sketch of s cells a subtable, s a power of two up to 2 ** 20."""
    return [f"({j} * {s} + (shiftrightunsigned({k}, {20 * j}) & ({s} - 1)))" for j in range(3)]


def _check(k: str) -> str:
    return f"xxhash64({k}, 1L)"


# --- sketches in one row, as sorted arrays of cells -------------------------------------------------


def _entries(keys: str, s: str, sign: int) -> str:
    made = ", ".join(f"named_struct('c', {c}, 'n', {sign}L, 'k', k, 'h', {_check('k')})" for c in _cells("k", s))
    return f"flatten(transform({keys}, k -> array({made})))"


def _merged(entries: str) -> str:
    """SQL: sum of the entries by cell, without the cells that cancel."""
    zero = "named_struct('c', -1L, 'n', 0L, 'k', 0L, 'h', 0L)"
    pushed = "if(a.cur.n = 0 and a.cur.k = 0 and a.cur.h = 0, a.done, array_append(a.done, a.cur))"
    step = (
        "if(a.cur.c = x.c, named_struct('done', a.done, 'cur', named_struct('c', x.c, 'n', a.cur.n + x.n, 'k', a.cur.k ^ x.k, 'h', a.cur.h ^ x.h)), "
        f"named_struct('done', {pushed}, 'cur', x))"
    )
    return f"aggregate(sort_array({entries}), named_struct('done', cast(array() as array<struct<c:bigint,n:bigint,k:bigint,h:bigint>>), 'cur', {zero}), (a, x) -> {step}, a -> {pushed})"


def peeled(start: str, s: str, rounds: int) -> str:
    """SQL: (cells, found) of subtracted cells after peeling; peeled to the end if no cell is left."""
    pure = f"array_distinct(transform(filter(t.cells, z -> abs(z.n) = 1 and {_check('z.k')} = z.h), z -> named_struct('n', z.n, 'k', z.k)))"
    gone = ", ".join(f"named_struct('c', {c}, 'n', -q.n, 'k', q.k, 'h', {_check('q.k')})" for c in _cells("q.k", s))
    left = _merged(f"concat(u.cells, flatten(transform(u.pure, q -> array({gone}))))")
    once = f"transform(array(named_struct('cells', t.cells, 'found', t.found, 'pure', {pure})), u -> if(size(u.pure) = 0, named_struct('cells', u.cells, 'found', u.found), named_struct('cells', {left}, 'found', concat(u.found, transform(u.pure, q -> q.k)))))[0]"
    return f"aggregate(sequence(1, {rounds}), named_struct('cells', {start}, 'found', cast(array() as array<bigint>)), (t, i) -> if(size(t.cells) = 0, t, {once}))"


def difference(a: str, b: str, s: str, rounds: int = RETRY_ROUNDS) -> str:
    """SQL: peeled() of the sketches of two digest arrays, subtracted."""
    return peeled(_merged(f"concat({_entries(a, s, 1)}, {_entries(b, s, -1)})"), s, rounds)


def base_cells(keys: str, s: int = BASE) -> str:
    """SQL: all cells of a digest array's sketch of s cells a subtable."""
    cell = lambda j: f"aggregate(filter({keys}, k -> {_cells('k', f'{s}L')[j]} = {j * s} + c), named_struct('n', 0L, 'k', 0L, 'h', 0L), (a, k) -> named_struct('n', a.n + 1, 'k', a.k ^ k, 'h', a.h ^ {_check('k')}))"
    table = lambda j: f"transform(transform(sequence(0, {s - 1}), c -> named_struct('c', {j * s}L + c, 'z', {cell(j)})), y -> named_struct('c', y.c, 'n', y.z.n, 'k', y.z.k, 'h', y.z.h))"
    return f"concat({', '.join(table(j) for j in range(3))})"


def rendered(keys: str, cells: str) -> str:
    """SQL: a digest array's number and its sketch as text: for each cell 4 digits of the count and 16 each of the xors."""
    text = f"array_join(transform({cells}, z -> concat(lpad(hex(z.n), 4, '0'), lpad(hex(z.k), 16, '0'), lpad(hex(z.h), 16, '0'))), '')"
    return f"lower(concat(hex(size({keys})), ':', {text}))"


def subtracted(a: str, b: str) -> str:
    """SQL: the cells of two equally large sketches in which they differ."""
    both = f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c, 'n', p.n - q.n, 'k', p.k ^ q.k, 'h', p.h ^ q.h))"
    return f"filter({both}, z -> z.n <> 0 or z.k <> 0 or z.h <> 0)"


# --- all pairs of a table -----------------------------------------------------------------------------


def _size(total: str) -> str:
    """SQL: log2 of the cells a subtable for so many digests."""
    return f"cast(ceil(log2(greatest({total} / 2.0D, {float(BASE)}D))) as int)"


def _peeled(rows: DataFrame) -> DataFrame:
    """(rid, found0, left0, found1, left1): digests recovered and cells left for each of a row's two pairs.

    A cell's id holds its pair, its sketch's size and its number; all groupings
    have rid first, by which the rows are dealt already.
    """
    pairs = rows.selectExpr("rid", "a", "inline(filter(array(named_struct('kind', 0L, 'o', if(base0 is null, e, null)), named_struct('kind', 1L, 'o', if(base1 is null, x, null))), z -> z.o is not null))")
    pairs = pairs.selectExpr("rid", f"{_size('(size(a) + size(o))')} as lg", "kind", "explode(concat(transform(a, k -> named_struct('k', k, 'n', 1L)), transform(o, k -> named_struct('k', k, 'n', -1L)))) as d")
    pairs = pairs.selectExpr("rid", "shiftleft(kind, 60) + shiftleft(cast(lg as bigint), 40) as base", "shiftleft(1L, lg) as s", "d.k as k", "d.n as n", f"{_check('d.k')} as h")
    cells = pairs.selectExpr("rid", f"explode(array({', '.join(f'base + {c}' for c in _cells('k', 's'))})) as pk", "n", "k", "h")
    some = "n <> 0 or k <> 0 or h <> 0"
    summed = [F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")]
    cells = cells.groupBy("rid", "pk").agg(*summed).where(some)
    own, base, s = "named_struct('pk', pk, 'key', 0L, 'n', n, 'k', k, 'h', h)", f"(pk - (pk & {_LOW}L))", "shiftleft(1L, cast(shiftright(pk, 40) & 255 as int))"
    for _ in range(ROUNDS):
        digest = f"named_struct('pk', {base} + {_DIGEST}L, 'key', k, 'n', n, 'k', k, 'h', h)"
        cells = cells.selectExpr("rid", f"inline(if(abs(n) = 1 and (pk & {_LOW}L) < {_FOUND}L and {_check('k')} = h, array({own}, {digest}), array({own})))")
        # one digest may be alone in several cells
        cells = cells.groupBy("rid", "pk", "key").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max("h").alias("h"))
        gone = ", ".join(f"named_struct('pk', {base} + {c}, 'n', -n, 'k', k, 'h', h)" for c in _cells("k", s))
        cells = cells.selectExpr("rid", f"inline(if((pk & {_LOW}L) = {_DIGEST}L, array(named_struct('pk', {base} + {_FOUND}L, 'n', 1L, 'k', 0L, 'h', 0L), {gone}), array(named_struct('pk', pk, 'n', n, 'k', k, 'h', h))))")
        cells = cells.groupBy("rid", "pk").agg(*summed).where(some)
    found, kind = F.expr(f"(pk & {_LOW}L) = {_FOUND}L"), F.expr("shiftright(pk, 60)")
    out = []
    for i in range(2):
        out += [F.sum(F.when(found & (kind == i), F.col("n")).otherwise(0)).alias(f"found{i}"), F.sum(F.when(~found & (kind == i), 1).otherwise(0)).alias(f"left{i}")]
    return cells.groupBy("rid").agg(*out)


def _next_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, key, text, a, next text, x): each row with the next by descending key, whatever the keys' gaps.

    Buckets are ranges of keys that end at keys of the table, so the row that
    follows a bucket's last is known before the exchange and goes along.
    """
    raw = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    size = df.agg(F.count("*").alias("n"), F.max(raw).alias("top")).first()
    n = min(BUCKETS_MOST, size["n"] // BUCKET_ROWS + 1)
    bounds: list[int] = []
    if n > 1:
        got = df.agg(F.percentile_approx(raw, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
        bounds = sorted(set(got))
    fine = [bounds[i : i + 256] for i in range(0, len(bounds), 256)] or [[]]
    array = lambda v: f"cast(array({', '.join(f'{x}L' if x > NULL_KEY else 'cast(-9223372036854775808 as bigint)' for x in v)}) as array<bigint>)"
    coarse = array([f[-1] for f in fine if f])
    place = f"size(filter({coarse}, b -> b < key))"
    rows = df.select(raw.alias("key"), F.col(key).alias("id"), whole_text(text).alias("text"))
    blocks = f"array({', '.join(map(array, fine))})"
    rows = rows.selectExpr("*", f"{place} as block").selectExpr("*", f"{blocks} as blocks")
    own = "coalesce(get(blocks, block), cast(array() as array<bigint>))"
    rows = rows.selectExpr("key", "id", "text", "block", f"{own} as ends", f"size(filter({own}, b -> b < key)) as at")
    # the bucket after a block's last key is the first of the next block, whose number a short block doesn't reach
    follows = "if(at + 1 = size(ends), 256 * (block + 1), 256 * block + at + 1)"
    rows = rows.selectExpr("key", "id", "text", "256 * block + at as bucket", "array_contains(ends, key) as edge", f"{follows} as follows")
    ghosts = f"if(edge, named_struct('bucket', follows, 'ghost', 1), null), if(key = {array([size['top'] or 0])}[0], named_struct('bucket', 0, 'ghost', 2), null)"
    rows = rows.selectExpr("key", "id", "text", f"{digests('text')} as a", "xxhash64(text) as tie", f"filter(array(named_struct('bucket', bucket, 'ghost', 0), {ghosts}), z -> z is not null) as at")
    rows = rows.selectExpr("key", "id", "text", "a", "tie", "inline(at)").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), "tie")
    rows = rows.select("id", "text", "a", "ghost", F.lead("text").over(order).alias("following"), F.lead("a").over(order).alias("x"), (F.col("bucket").cast("long") * (1 << 32) + F.row_number().over(order)).alias("rid"))
    return rows.where("ghost = 0").drop("ghost")


def fingerprint_versions(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness.

    The edited text has its second half replaced by as much of the next row's
    beginning. (key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs, edited_digests: the recovered
    digests' number)
    """
    rows = _next_rows(df, key, text)
    half = "cast(length(text) div 2 as int)"
    rows = rows.selectExpr("rid", "id", "a", "x", "cast(length(text) as bigint) as n_chars", f"concat(substring(text, 1, length(text) - {half}), substring(following, 1, {half})) as edited")
    rows = rows.selectExpr("rid", "id", "a", "x", "n_chars", "unhex(sha2(edited, 256)) as sha", f"{digests('edited')} as e")
    rows = rows.selectExpr("*", *[f"{base_cells(o)} as c{o}" for o in "aex"])
    # the fingerprints themselves are subtracted and peeled first
    small = lambda o: f"transform(array({peeled(subtracted('ca', f'c{o}'), f'{BASE}L', BASE_ROUNDS)}), r -> if(size(r.cells) = 0, cast(size(array_distinct(r.found)) as bigint), null))[0]"
    rows = rows.selectExpr("rid", "id", "a", "e", "x", "n_chars", "sha", f"{rendered('a', 'ca')} as fingerprint", f"{rendered('e', 'ce')} as edited_fingerprint", f"{small('e')} as base0", f"{small('x')} as base1")
    rows, _ = stored(spark, rows, "versions")  # digests only; else the texts would be exchanged for both sides of the join
    joined = rows.join(_peeled(rows.where("base0 is null or base1 is null").select("rid", "a", "e", "x", "base0", "base1").repartition("rid")), "rid", "left").na.fill(0, ["found0", "left0", "found1", "left1"])
    for i, o in enumerate(("e", "x")):
        total, prior = f"(size(a) + size({o}))", f"coalesce(base{i}, if(left{i} = 0, found{i}, null))"
        joined = joined.selectExpr("*", f"{prior} as try0")
        for t in range(1, RETRIES + 1):
            s = f"shiftleft(1L, {_size(total)} + {t})"
            joined = joined.selectExpr("* except (try%d)" % (t - 1), f"coalesce(try{t - 1}, transform(array({difference('a', o, s)}), r -> if(size(r.cells) = 0, cast(size(array_distinct(r.found)) as bigint), null))[0]) as try{t}")
        joined = joined.withColumnRenamed(f"try{RETRIES}", f"differ{i}")
        # what no sketch could tell is counted exactly
        exact = f"size(array_except(a, {o})) + size(array_except({o}, a))"
        joined = joined.selectExpr(f"* except (differ{i})", f"coalesce(differ{i}, cast({exact} as bigint)) as differ{i}")
    near = lambda i, o: f"if(size(a) + size({o}) = 0, 1.0D, (size(a) + size({o}) - differ{i}) / cast(size(a) + size({o}) as double))"
    return joined.selectExpr(
        f"id as `{key}`",
        "n_chars",
        "lower(hex(sha)) as edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        f"{near(0, 'e')} as near_edited",
        f"{near(1, 'x')} as near_next",
        "cast(size(a) as bigint) as n_paragraphs",
        "differ0 as n_edited_digests",
        "base0 is not null and base1 is not null as by_fingerprint",
    )
