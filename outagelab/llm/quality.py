"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The machine is fitted on a bounded sample of labelled documents and scores every whole text. Pairwise interactions cost
linear time by the sum-of-squares identity: the sum over pairs of <v_i, v_j> x_i x_j equals half of
sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
FACTORS = 8
SAMPLE = 12_000     # most labelled rows the fit may use
EPOCHS = 8
BATCH = 256
RATE = 0.05
SHRINK = 1e-4
THRESHOLD = 0.3
FOLDS = 5

STATISTICS = (
    "log_words", "log_chars", "log_lines", "word_length", "distinct_share", "top_word_share", "upper_share", "digit_share",
    "space_share", "non_ascii_share", "stop_share", "comma_share", "bang_share", "bar_share", "mark_share", "other_share",
    "line_length", "short_line_share", "repeated_line_share", "log_declared_chars", "no_declared_chars",
)
_CLASSES = np.full(256, 10, np.int64)  # what kind of character a byte is; 10: any other
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256),
                             b".", b",;:", b"!?", b"|", b"#$%&*")):
    _CLASSES[list(_bytes)] = _k


def features(text: str | None, declared_chars: float | None, cache: dict, bits: int = BITS) -> tuple[np.ndarray, ...]:
    """Buckets and values of the hashed words (length 1 together) and the structure and metadata statistics."""
    raw = (text or "").encode("utf-8", "replace")
    counts = Counter(raw.split())
    n_words, mask = sum(counts.values()), (1 << bits) - 1
    buckets = np.empty(len(counts), np.int64)
    for k, word in enumerate(counts):
        at = cache.get(word)
        if at is None:
            if len(cache) > 500_000:
                cache.clear()
            at = cache[word] = xxhash.xxh32_intdigest(word) & mask
        buckets[k] = at
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    values /= max(np.sqrt((values ** 2).sum()), 1e-12)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=11) if raw else np.zeros(11)
    lines = raw.split(b"\n")
    n_bytes, n_lines = max(len(raw), 1), len(lines)
    letters = max(kinds[0] + kinds[1], 1)
    missing = declared_chars is None or declared_chars != declared_chars
    stats = np.array([
        math.log1p(n_words), math.log1p(len(raw)), math.log1p(n_lines), min(sum(map(len, counts)) / max(len(counts), 1), 100),
        len(counts) / max(n_words, 1), max(counts.values(), default=0) / max(n_words, 1), kinds[0] / letters,
        *(kinds[k] / n_bytes for k in (2, 3, 4, 5, 6, 7, 8, 9, 10)),
        math.log1p(n_bytes / n_lines), sum(len(x) < 20 for x in lines) / n_lines, 1 - len(set(lines)) / n_lines,
        0.0 if missing else math.log1p(max(declared_chars, 0)), float(missing)])
    return buckets, values, stats


@dataclass
class FactorisationMachine:
    """Weights of the hashed words, then of the standardised statistics. Size: 2**bits * (factors + 1) numbers."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int = BITS

    def score(self, text: str | None, declared_chars: float | None, cache: dict) -> float:
        buckets, values, stats = features(text, declared_chars, cache, self.bits)
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        at = (1 << self.bits) + np.arange(len(z))
        i, x = np.concatenate([buckets, at]), np.concatenate([values, z])
        vx = self.factors[i] * x[:, None]
        y = self.bias + self.weights[i] @ x + 0.5 * float((vx.sum(axis=0) ** 2).sum() - (vx ** 2).sum())
        return 1 / (1 + math.exp(-min(max(y, -30.0), 30.0)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS,
                factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 1) -> FactorisationMachine:
    """Adaptive gradient descent on the log loss. Without rows every score is one half."""
    d, base = len(STATISTICS), 1 << bits
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(base + d), rng.normal(0, 0.05, (base + d, factors)), 0.0
    if not rows:
        return FactorisationMachine(0.0, w, np.zeros_like(v), np.zeros(d), np.ones(d), bits)
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    z = np.clip((stats - mean) / scale, -5, 5)
    share = min(max(target.mean(), 0.01), 0.99)
    bias, gw, gv, gb = math.log(share / (1 - share)), np.full(base + d, 1e-8), np.full(v.shape, 1e-8), 1e-8
    batches = []
    for lo in range(0, len(rows), BATCH):
        part = range(lo, min(lo + BATCH, len(rows)))
        idx = np.concatenate([np.concatenate([rows[r][0], base + np.arange(d)]) for r in part])
        val = np.concatenate([np.concatenate([rows[r][1], z[r]]) for r in part])
        lens = np.array([len(rows[r][0]) + d for r in part])
        used, inverse = np.unique(idx, return_inverse=True)
        batches.append((used, inverse, val, lens, np.concatenate([[0], np.cumsum(lens)[:-1]]), target[lo:lo + len(lens)]))
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            used, inverse, val, lens, first, t = batches[b]
            vu = v[used]
            vx = vu[inverse] * val[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            y = bias + np.add.reduceat(w[used][inverse] * val, first)
            y = y + 0.5 * ((sums ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), first))
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - t) / len(t)
            gx = np.repeat(g, lens) * val
            dw = np.bincount(inverse, gx, len(used)) + SHRINK * w[used]
            dv = np.empty_like(vu)
            for f in range(factors):
                dv[:, f] = np.bincount(inverse, gx * (np.repeat(sums[:, f], lens) - vx[:, f]), len(used))
            dv += SHRINK * vu
            gb += g.sum() ** 2
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            bias -= RATE * g.sum() / math.sqrt(gb)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return FactorisationMachine(bias, w, v, mean, scale, bits)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from the fit: the remainder of the CRC of its id as text is 0; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
          label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Null labels and ids are left out; contradicting labels of an id count as their mean; repeated documents count as often
    as they occur among the sampled rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__label"))
    # Narrow rows decide who is in the sample; only the sampled texts are read into features.
    chosen = known.orderBy(F.xxhash64(F.lit(5), "__id"), "__id").limit(sample)
    # At most ``sample`` ids: a proven bound, so that the texts are not shuffled to find them.
    rows = _columns(docs, text_col, chars_col, F.col(id_col).alias("__id")).join(F.broadcast(chosen), "__id")

    def run(batches):
        cache: dict = {}
        for pdf in batches:
            found = [features(t, c, cache, bits) for t, c in zip(pdf["__text"], pdf["__chars"])]
            yield pd.DataFrame({"i": pdf["__id"].astype(str), "y": pdf["__label"],
                                "a": [f[0].astype(np.int32).tobytes() for f in found],
                                "b": [f[1].astype(np.float32).tobytes() for f in found], "c": [f[2].tobytes() for f in found]})

    got = rows.mapInPandas(run, "i string, y double, a binary, b binary, c binary")
    table = got.orderBy(F.xxhash64(F.lit(6), "i"), "i", "y", "c").limit(sample).collect()
    return fit_machine([(np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.float32), np.frombuffer(r["c"])) for r in table],
                       np.array([r["y"] for r in table], np.float64), bits)


def _columns(docs: DataFrame, text_col: str, chars_col: str | None, *more: Column) -> DataFrame:
    chars = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    return docs.select(*more, F.col(text_col).alias("__text"), chars.cast("double").alias("__chars"))


def scored(machine: FactorisationMachine, text: Column, chars: Column) -> Column:
    """Score of each text, 0 to 1; null and empty texts are scored by their statistics like any other."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts, declared in batches:
            yield pd.Series([machine.score(t, c, cache) for t, c in zip(texts, declared)], dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()(text, chars.cast("double"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str | None = "n_chars", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document row: id, ``held_out``, ``score`` and ``predicted``."""
    machine = train(docs, labels, id_col, text_col, chars_col, **options)
    rows = _columns(docs, text_col, chars_col, F.col(id_col))
    return rows.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                       scored(machine, F.col("__text"), F.col("__chars")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              chars_col: str | None = "n_chars", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, with all their columns, that are scored at least ``threshold``."""
    machine = train(docs, labels, id_col, text_col, chars_col, **options)
    chars = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    return docs.withColumn("__score", scored(machine, F.col(text_col), chars)).where(
        F.col("__score") >= threshold).drop("__score")
