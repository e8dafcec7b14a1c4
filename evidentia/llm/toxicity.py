"""Toxicity by a linear-chain conditional random field (operator 5).

The field has two states a token, clean and toxic. A token's features are its
word, its prefixes and its suffixes, as far as they tell toxic documents from
clean ones in the labelled sample; tokens of toxic documents that have such a
feature are the positive tokens of the training sequences. Forward-backward
gives each token's marginal; a document's largest and summed marginals go
through a logistic function into its score, and tokens with a marginal of a
half or more are the offending spans.

Most tokens have no feature and the same potential. Runs of them are powers of
one 2 x 2 matrix, so exact marginals cost only the tokens that matter, and
whole texts of any length are scored.

The model is fitted on the driver on a bounded sample of labelled rows: at
most MOST_TOXIC and MOST_CLEAN documents, those with the smallest hashed ids,
as far as they have MOST_CHARS code points in all. Features are chosen by
their counts in all of them, near copies counted once; the field's weights are
fitted on at most MOST_SEGMENTS / 2 segments of SEGMENT words with such
features of each label, and a quarter as many without, chosen by a hash.

Defined results: null and empty texts have no tokens and get the score of a
text without evidence; documents without a label are scored like others;
null labels and labels of absent documents teach nothing; of contradicting
labels of a document the toxic one counts; without toxic examples every score
is the share of toxic labels (0 without labels); repeated rows give repeated
scores; columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TOXIC, MOST_CLEAN = 1500, 3000
THRESHOLD = 0.7
MOST_CHARS = 60_000_000
SEGMENT, MOST_SEGMENTS, STEPS = 256, 2500, 60
BANDS = 24
BUCKETS = 1 << 22
PIECE = 512
MOST_CACHED = 100_000
WORD = re.compile(r"[^\W\d_]+")
AFFIXES = range(3, 9)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    lower = text.lower()
    # only a capital that lower case makes longer could move a later run
    return WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in WORD.findall(text)]


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in AFFIXES if len(word) > k), *(f"*{word[-k:]}" for k in AFFIXES if len(word) > k)]


@dataclass
class Model:
    """Weights of a fitted field and of its document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-40.0, 0.0, 0.0, 0.0]))

    def __post_init__(self) -> None:
        self._seen: dict[str, float] = {}
        a = np.exp(self.steps - self.steps.max())
        self.a = a
        self.neutral = a * np.exp([0.0, self.bias])[None, :]
        values, vectors = np.linalg.eig(self.neutral)
        self.values, self.vectors, self.inverse = values.real, vectors.real, np.linalg.inv(vectors.real)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "steps": self.steps, "score": self.score}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, word: str) -> float:
        """Sum of the weights of a word's features; 0 for most."""
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) > MOST_CACHED:
                self._seen.clear()
            got = self._seen[word] = sum(self.weights.get(f, 0.0) for f in _features(word))
        return got

    def _power(self, k: int) -> np.ndarray:
        """neutral ** k, scaled to a largest entry of 1."""
        m = (self.vectors * (self.values / self.values.max()) ** k) @ self.inverse
        return np.maximum(m / m.max(), 1e-300)

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, probability of toxic) of the tokens with features and their neighbours."""
        at = [i for i, w in enumerate(words) if self.weight(w)]
        if not at:
            return []
        at = sorted({j for i in at for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        psi = [np.exp([0.0, self.bias + self.weight(words[i])]) for i in at]
        # what a run of k neutral tokens and the step after it do, for the gap before each position
        gap = [self._power(j - i - 1) @ self.a for i, j in zip(at, at[1:], strict=False)]
        first = np.ones(2) if at[0] == 0 else np.array([1.0, math.exp(self.bias)]) @ self._power(at[0] - 1) @ self.a
        forward = [first * psi[0] / (first * psi[0]).sum()]
        for g, p in zip(gap, psi[1:], strict=True):
            v = forward[-1] @ g * p
            forward.append(v / v.sum())
        back = [self._power(len(words) - 1 - at[-1]) @ np.ones(2)]
        for g, p in zip(reversed(gap), reversed(psi[1:]), strict=True):
            v = g @ (p * back[-1])
            back.append(v / v.sum())
        both = [f * b for f, b in zip(forward, reversed(back), strict=True)]
        return [(i, float(v[1] / v.sum())) for i, v in zip(at, both, strict=True)]

    def document(self, marginals: list[tuple[int, float]], n: int) -> float:
        """Score of a document of n words."""
        z = float(self.score @ evidence([p for _, p in marginals], n))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def evidence(p: list[float], n: int) -> np.ndarray:
    """What the score is a function of: 1, largest marginal, their sum, and their share of the words."""
    return np.array([1.0, max(p, default=0.0), math.log1p(sum(p)), math.sqrt(sum(p) / max(1, n))])


class _Sample:
    """Training documents as arrays of word numbers, so that equal words are held once."""

    def __init__(self, docs: list[tuple[str, int]]) -> None:
        index: dict[str, int] = {}
        self.docs = [(np.array([index.setdefault(w, len(index)) for w in words_of(x or "")], np.int32), int(t)) for x, t in docs]
        self.words = list(index)

    def texts(self) -> Iterator[tuple[list[str], int]]:
        for ids, toxic in self.docs:
            yield [self.words[i] for i in ids], toxic

    def groups(self) -> list[tuple[np.ndarray, int]]:
        """Distinct words of each group of near copies of one label, so that a feature counts once a group: copies would make their every word look toxic."""
        sets = [np.unique(ids) for ids, _ in self.docs]
        up = list(range(len(sets)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        rng = np.random.default_rng(7)
        salts = rng.integers(1, 1 << 31, 3 * BANDS, dtype=np.int64) * 2 + 1
        met: dict[tuple, int] = {}
        for i, (s, (_, toxic)) in enumerate(zip(sets, self.docs, strict=True)):
            if not len(s):
                continue
            least = ((s[None, :].astype(np.int64) + 1) * salts[:, None] * 0x9E3779B1 % ((1 << 61) - 1)).min(1)
            for band in range(BANDS):
                j = met.setdefault((toxic, band, *least[3 * band : 3 * band + 3].tolist()), i)
                if top(i) != top(j):
                    common = len(np.intersect1d(s, sets[j], assume_unique=True))
                    if 2 * common >= len(s) + len(sets[j]) - common:
                        up[max(top(i), top(j))] = min(top(i), top(j))
        members: dict[int, list[int]] = {}
        for i in range(len(sets)):
            members.setdefault(top(i), []).append(i)
        return [(np.unique(np.concatenate([sets[i] for i in own])), self.docs[k][1]) for k, own in members.items()]


def _telling(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Whether counts in toxic and clean documents differ: by likelihood ratio, and ten times as common in toxic ones."""
    share = toxic / max(1, toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log(a / (a + b) / share) + np.where(b > 0, b * np.log(b / (a + b) / (1 - share)), 0.0)
    return (a >= 4) & (a * clean >= 10 * b * toxic) & (gain >= 12)


def _selected(sample: _Sample) -> list[str]:
    """Features that tell toxic documents: first by hashed counts, then by the exact ones of what is left."""
    docs = sample.groups()
    n = [sum(t == y for _, t in docs) for y in (0, 1)]
    buckets = [np.array([zlib.crc32(f.encode()) % BUCKETS for f in _features(w)], np.int32) for w in sample.words]
    counts = np.zeros((2, BUCKETS), np.int32)
    for ids, toxic in docs:
        if len(ids):
            counts[toxic][np.unique(np.concatenate([buckets[i] for i in ids]))] += 1
    # a collision adds to a bucket, so one test of the toxic counts alone loses nothing
    likely = _telling(counts[1].astype(float), np.zeros(BUCKETS), n[1], n[0]) if n[1] else np.zeros(BUCKETS, bool)
    names: dict[str, int] = {}
    of = [[names.setdefault(f, len(names)) for f, h in zip(_features(w), hashes, strict=True) if likely[h]] for w, hashes in zip(sample.words, buckets, strict=True)]
    exact = np.zeros((2, len(names)))
    for ids, toxic in docs:
        if own := sorted({f for i in ids for f in of[i]}):
            exact[toxic, own] += 1
    good = _telling(exact[1], exact[0], n[1], n[0]) if n[1] else np.zeros(0, bool)
    return sorted(f for f, i in names.items() if good[i])


def _fit_field(sample: _Sample, names: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions that make the training sequences likeliest, by Adam with a small penalty."""
    ids = {f: i for i, f in enumerate(names)}
    of = [[ids[f] for f in _features(w) if f in ids] for w in sample.words]
    # the bound takes segments of all documents alike, by a hash of their places
    place: dict[int, list[tuple[int, int, int]]] = {0: [], 1: [], 2: []}
    for d, (doc, toxic) in enumerate(sample.docs):
        for at in range(0, len(doc), SEGMENT):
            kind = toxic if any(of[i] for i in doc[at : at + SEGMENT]) else 2
            place[kind].append((zlib.crc32(b"%d:%d" % (d, at)), d, at))
    chosen = [x for kind in (1, 0) for x in sorted(place[kind])[: MOST_SEGMENTS // 2]]
    chosen += sorted(place[2])[: max(200, len(chosen) // 4)]
    segments = [([of[i] for i in sample.docs[d][0][at : at + SEGMENT]], sample.docs[d][1]) for _, d, at in chosen]
    rows, width = len(segments), SEGMENT
    y, real = np.zeros((rows, width), int), np.zeros((rows, width), bool)
    cell, feat = [], []
    for r, (own, toxic) in enumerate(segments):
        real[r, : len(own)] = True
        for c, f in enumerate(own):
            if f:
                y[r, c] = toxic
                cell += [r * width + c] * len(f)
                feat += f
    cell, feat = np.array(cell, int), np.array(feat, int)
    pair = real[:, 1:]
    steps_seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.concatenate([np.full(len(names), 1.0), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = real.sum()
    for step in range(1, STEPS + 1):
        w, bias, t = theta[: len(names)], theta[len(names)], theta[-4:].reshape(2, 2)
        s = np.bincount(cell, w[feat], rows * width).reshape(rows, width) + bias
        a, e = np.exp(t), np.exp(np.clip(s, -40, 40))
        f, b = np.empty((width, rows, 2)), np.empty((width, rows, 2))
        f[0] = np.stack([np.ones(rows), e[:, 0]], 1)
        f[0] /= f[0].sum(1, keepdims=True)
        for c in range(1, width):
            nxt = f[c - 1] @ a
            nxt[:, 1] *= e[:, c]
            f[c] = nxt / nxt.sum(1, keepdims=True)
        b[-1] = 0.5
        for c in range(width - 2, -1, -1):
            nxt = b[c + 1].copy()
            nxt[:, 1] *= e[:, c + 1]
            nxt = nxt @ a.T
            nxt /= nxt.sum(1, keepdims=True)
            b[c] = np.where(real[:, c + 1][:, None], nxt, 0.5)
        both = f * b
        p = (both[..., 1] / both.sum(2)).T
        hop = f[:-1, :, :, None] * a * np.stack([np.ones((width - 1, rows)), e[:, 1:].T], 2)[:, :, None, :] * b[1:, :, None, :]
        hop /= hop.sum((2, 3), keepdims=True)
        expected = (hop * pair.T[:, :, None, None]).sum((0, 1))
        gap = np.where(real, y - p, 0.0)
        grad = np.concatenate([np.bincount(feat, gap.ravel()[cell], len(names)) - 0.1 * w, [gap.sum()], (steps_seen - expected).ravel() - 0.1 * theta[-4:]]) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return theta[: len(names)], float(theta[len(names)]), theta[-4:].reshape(2, 2)


def _fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small penalty, by Newton steps."""
    out = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -40, 40)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(out))
        out = out + np.clip(np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.05 * out), -4, 4)
    return out


def fit(docs: list[tuple[str, int]], rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from (text, toxic) rows; rates: documents that a clean and a toxic row of the sample stand for."""
    sample = _Sample(docs)
    share = sum(rates[t] for _, t in sample.docs if t) / max(1e-9, sum(rates[t] for _, t in sample.docs))
    names = _selected(sample)
    if not names:
        return Model(score=np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0]))
    w, bias, steps = _fit_field(sample, names)
    model = Model(dict(zip(names, w.tolist(), strict=True)), bias, steps)
    x = np.array([evidence([p for _, p in model.marginals(words)], len(words)) for words, _ in sample.texts()])
    y = np.array([t for _, t in sample.docs])
    model.score = _fit_score(x, y, np.array(rates)[y])
    return model


def remainder(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows of docs that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (remainder(key) != 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    ids = spark.createDataFrame(parts[0].unionByName(parts[1]).collect(), known.schema)
    sizes = docs.select(F.col(key).alias("k"), F.length(text).alias("n")).join(F.broadcast(ids), "k").groupBy("k", F.xxhash64("k").alias("h")).agg(F.max(F.coalesce("n", F.lit(0))).alias("n")).collect()
    held, total = [], 0
    for r in sorted(sizes, key=lambda r: r["h"]):
        total += r["n"]
        if total <= MOST_CHARS or not held:
            held.append((r["k"],))
    ids = ids.join(spark.createDataFrame(held, T.StructType([ids.schema["k"]])), "k")
    # as many rows as the bounds allow, at any size of the input
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("k")).select("id", "text", "y").dropDuplicates(["id"]).toPandas().sort_values("id")
    have = rows["y"].value_counts()
    rates = tuple(counts.get(y, 0) / max(1, int(have.get(y, 0))) for y in (0, 1))
    return fit(list(zip(rows["text"], rows["y"], strict=True)), rates)


def _held(model: Model, spans: bool):
    def scored(texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        scores, found = [], []
        for x in texts:
            words = words_of(x)
            marks = model.marginals(words)
            scores.append(model.document(marks, len(words)))
            bad = [(i, p) for i, p in marks if p >= 0.5] if spans else []
            where = list(WORD.finditer(x)) if bad else []
            found.append([{"start": where[i].start(), "end": where[i].end(), "marginal": p} for i, p in bad])
        return scores, found

    return scored


def score_toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(key, score, spans): offending code-point spans of the text with their marginals."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _held(shared.value, spans)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                b = batch.slice(at, PIECE)
                s, found = score([x or "" for x in b.column(1).to_pylist()])
                yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array(found, span)], ["k", "score", "spans"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")
    return out.withColumnRenamed("k", key)


def without_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns as they are, whose score is below the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _held(shared.value, False)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                b = batch.slice(at, PIECE)
                s, _ = score([x or "" for x in b.column(place).to_pylist()])
                yield b.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return df.mapInArrow(run, df.schema)
