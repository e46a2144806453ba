"""Substring dedup by Rabin-Karp hashes of every fixed-length window of words.

A window whose word sequence also starts in a document of smaller id is repeated; overlapping repeated windows merge into
maximal removal intervals. Window hashes roll (prefix sums of word hashes times powers of an odd base, modulo 2**64, twice
independently, from one 64-bit hash of each word).

Scale: hashes of all windows of all documents would be many times the corpus. So each window first names an anchor, the
least hash of the shingles of half its length; equal windows have equal anchors, so a window can only be repeated if its
anchor occurs in two documents. Of equal word sequences only the row of least id is looked at; the others repeat it whole.
Anchors (one for about thirteen words) are counted in Spark with partial aggregates. Neighbouring windows with one shared anchor
make a stretch, which is hashed as a whole: a stretch that a smaller id holds too is repeated in all its windows. Only where
an anchor has several different stretches, the windows of the first holder of each are hashed, counted and joined back.
No group of equal windows is ever gathered: keys with many rows are joined by broadcast, of which there can only be few
(``join_counted``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard, stage
from .common import KEY, TEXT, document_key, join_counted, keyed, release_shuffles

WINDOW = 50
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)   # odd, so that they have inverses modulo 2**64


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(ws: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Rolling polynomial hashes; keeps the powers of its base for the longest text met so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, values: np.ndarray, length: int) -> np.ndarray:
        first = np.arange(max(len(values) + 1 - length, 0))
        return self.ranges(values, first, first + length)

    def ranges(self, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the values from ``first`` up to ``end``, wherever they lie."""
        n = len(values)
        if n > len(self.up):
            self.up, self.down = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mixed((sums[end] - sums[first]) * self.down[first])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values, by doubling."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, window: int, roller: Roller) -> np.ndarray:
    """The anchor of each window: the least hash of its shingles of half its length."""
    gram = (window + 1) // 2
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return least_of(roller(hashes, gram), window - gram + 1)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone


def _summary(source: DataFrame, window: int) -> DataFrame:
    """Per document row: words, digest of the untouched text and the distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, roller = WordHashes(), Roller(BASES[0])
        for batch in batches:
            n_words, digests, lists = [], [], []
            for text in batch.column(1):
                ws = _split(text.as_py())
                n_words.append(len(ws))
                digests.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                lists.append(np.unique(anchors(word_hashes(ws, cache), window, roller)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[KEY, "n_words", "digest", "anchors"])

    kind = source.schema[KEY].dataType.simpleString()
    return source.mapInArrow(run, f"{KEY} {kind}, n_words long, digest string, anchors array<long>")


def _hashed(texts: DataFrame, column: str, pick) -> DataFrame:
    """One row for each range of words that ``pick`` finds in a text: id, row, both hashes, first window and windows.

    ``pick`` gets the word hashes, the value of ``column`` and a roller, and returns first windows, numbers of windows, words
    per range and anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rollers = WordHashes(), [Roller(b) for b in BASES]
        for batch in batches:
            rows, parts = [], []
            for k in range(batch.num_rows):
                h = word_hashes(_split(batch.column(2)[k].as_py()), cache)
                at, n, length, anchor = pick(h, batch.column(3)[k].values, rollers[0])
                if len(at):
                    rows.append(np.full(len(at), k))
                    parts.append((rollers[0].ranges(h, at, at + length).view(np.int64),
                                  rollers[1].ranges(mixed(h), at, at + length).view(np.int64),
                                  at.astype(np.int32), n.astype(np.int32), anchor.view(np.int64)))
            if rows:
                who = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who)] + [pa.array(np.concatenate(x)) for x in zip(*parts)],
                    names=["id", "row", "h1", "h2", "start", "windows", "anchor"])

    source = texts.select(F.col(KEY)["id"].alias("id"), "row", TEXT, column)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, row long, h1 long, h2 long, start int, "
                                  "windows int, anchor long")


def _stretches(texts: DataFrame, window: int) -> DataFrame:
    """Runs of neighbouring windows with the same anchor, if it is among the row's ``shared`` ones."""

    def pick(h, shared, roller):
        anchor = anchors(h, window, roller)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(first, len(anchor)))
        keep = np.isin(anchor[first], np.asarray(shared).view(np.uint64))
        first, n = first[keep], n[keep]
        return first, n, n + window - 1, anchor[first]

    return _hashed(texts, "shared", pick)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """The windows of the row's ``parts``, which are stretches."""

    def pick(h, parts, roller):
        first, n = (np.asarray(parts.field(x), np.int64) for x in ("start", "windows"))
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return at, np.ones_like(at), window, np.zeros_like(at)

    return _hashed(texts, "parts", pick).drop("windows", "anchor")


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the given ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts)
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > upto[:-1]]))
    return starts[new], upto[np.append(new[1:], len(starts)) - 1]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: key, ``n_words``, removal ``spans`` (words, end exclusive), ``n_removed``, ``kept_sha256``.

    Words are parts between ASCII white space, unchanged. A null text has no words; texts shorter than a window lose
    nothing; null ids are neither smaller nor larger than any id, so they remove nothing and lose nothing; rows of equal
    id do not remove from each other; repeated rows have equal results.
    """
    source = keyed(docs, id_col, text_col)
    summary = stage(_summary(source, window), "substring-anchors")
    named = summary.where(F.col(KEY)["id"].isNotNull() & (F.col("n_words") >= window)).withColumn("id", F.col(KEY)["id"])
    heads = stage(named.groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")), "substring-heads")
    # Both keys decide the task, so the copies of one text do not meet.
    firsts = named.join(heads.select("digest", F.col("head").alias("id")), ["digest", "id"])
    marks = stage(firsts.select(KEY, "id", F.explode("anchors").alias("anchor")), "substring-marks")
    shared = stage(marks.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
                   .where("a < b").select("anchor", "n"), "substring-shared")
    wanted = join_counted(marks, shared, ["anchor"]).groupBy(KEY).agg(F.collect_set("anchor").alias("shared"))
    texts = stage(source.join(wanted, KEY).withColumn("row", F.monotonically_increasing_id()), "substring-texts")
    discard(marks, shared)
    release_shuffles(docs.sparkSession)
    same = ["h1", "h2", "windows"]
    stretches = stage(_stretches(texts, window), "substring-stretches")
    # A class is one sequence of words; its first holder stands for it, all others lose it whole.
    classes = stage(stretches.groupBy(*same, "anchor").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")), "substring-classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed_up = join_counted(classes.drop("n"), several, ["anchor"]).select(*same, F.lit(True).alias("several"))
    judged = join_counted(stretches.drop("anchor"), classes.drop("anchor"), same)
    again = stage(judged.where("id > a").select("row", "start", "windows"), "substring-again")
    held = stage(judged.where("id = a").drop("a", "id").join(mixed_up, same, "left_semi"), "substring-held")
    discard(stretches, classes)
    release_shuffles(docs.sparkSession)
    parts = held.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("parts"))
    windows = stage(_windows(texts.join(parts, "row"), window), "substring-windows")
    first = stage(windows.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
                  .where("a < b").select("h1", "h2", "a", "n"), "substring-first")
    single = join_counted(windows, first, ["h1", "h2"]).where("id > a").select("row", "start", F.lit(1).alias("windows"))
    removed = stage(again.unionByName(single).groupBy("row").agg(
        F.collect_list(F.struct("start", "windows")).alias("parts")), "substring-parts")
    discard(again, held, windows, first)
    release_shuffles(docs.sparkSession)
    cut = texts.select(KEY, TEXT, "row").join(removed, "row").select(KEY, TEXT, "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts, digests = [], [], []
            for text, parts in zip(batch.column(1), batch.column(2)):
                ws = _split(text.as_py())
                first, n = (np.asarray(parts.values.field(x)) for x in ("start", "windows"))
                a, b = _merge(first, first + n + window - 1)
                kept = np.ones(len(ws), bool)
                for x, y in zip(a, b):
                    kept[x:y] = False
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                counts.append(int(len(ws) - kept.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, k in zip(ws, kept) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=[KEY, "spans", "n_removed", "kept"])

    kind = source.schema[KEY].dataType.simpleString()
    cuts = stage(cut.mapInArrow(run, f"{KEY} {kind}, spans array<struct<start:int,end:int>>, n_removed long, kept string")
                 .dropDuplicates([KEY]), "substring-cuts")
    discard(texts, removed)
    release_shuffles(docs.sparkSession)
    # Whoever repeats a whole word sequence of a smaller id loses all of it; the others lose what was cut above.
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    result = summary.drop("anchors").join(cuts, KEY, "left")
    judged = join_counted(result, heads, ["digest"], "left").withColumn("again", F.coalesce(F.col(KEY)["id"] > F.col("head"), F.lit(False)))
    return judged.select(
        KEY, "n_words",
        F.when(F.col("again"), everything).otherwise(
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))).alias("spans"),
        F.when(F.col("again"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("again"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"))


def digest(repeats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return repeats.select(F.col(KEY)["id"].alias(id_col), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, repeated passages cut out; a changed text has one space between its words."""
    spans = find_repeats(docs, id_col, text_col, window).where("n_removed > 0").select(KEY, "spans").dropDuplicates([KEY])

    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, parts in zip(texts, found):
            if parts is None:
                out.append(text)
                continue
            ws, kept = _split(text), []
            at = 0
            for p in parts:
                kept += ws[at:p["start"]]
                at = p["end"]
            out.append(b" ".join(kept + ws[at:]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(KEY, document_key(id_col, text_col)).join(spans.withColumnRenamed("spans", "__spans"), KEY, "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.pandas_udf(cut, "string")(text_col, "__spans"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
