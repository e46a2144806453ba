"""Forests grown in parts, and a search in which smaller forests are the first parts of larger ones.

A forest's trees are independent, so a fit of 300 trees and one of 200 are a forest of 500 whose votes are added, and the first
part is a forest of 300. A search grows, per leaf size and fold, the parts of the largest size that is asked for, and
scores every size from the running sums of the same votes.

Trees grow side by side, each in one task (``growth``): features are cut into bins, one byte each, and the binned rows go to every
task. A search votes on the held-out rows where the trees are, and no tree of it leaves its task. The trees of a fitted
forest are a stage, and rows to score travel to them, once per different binned row; the driver holds edges of bins and
importances only. What a forest predicts depends on its rows and seed, not on their partitions, as far as the edges of the
bins are the same; these are exact up to ``POINTS`` values of a feature in a block of rows, else close to its quantiles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import discard, stage
from . import growth
from .growth import BINS, MAX_DEPTH

PART = 500          # trees of a part
PARALLEL = 8        # jobs that run side by side
POINTS = 10_000     # values that describe a feature in a block of rows
CELLS = 1 << 20     # rows times features of a block
TASKS_PER_CORE = 4  # of a growth, if it has so many trees


def _side_by_side(spark, work, tasks: Sequence, parallelism: int = PARALLEL) -> list:
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), tasks, chunksize=1)


def _winner(votes: Column) -> Column:
    """Class of most votes, the lower one of a tie."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("double")


# Binned rows ---------------------------------------------------------------------------------

def _matrix(x: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 0)


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Features ``x`` and all columns of a bounded number of rows at a time."""
    held, size = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        return _matrix(table.column("x").chunk(0)), table
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("x").flatten())
            if size >= cells:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each feature in a block and how many rows each stands for."""
    for x, _ in _blocks(batches, 4 * CELLS):
        rows = []
        for column in x.T:
            values, counts = np.unique(column, return_counts=True)
            if len(values) > POINTS:
                at = (np.arange(POINTS) + 0.5) * (len(column) / POINTS)
                values, counts = values[np.searchsorted(np.cumsum(counts), at)], np.full(POINTS, len(column) / POINTS)
            rows.append((values, counts.astype(float)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([v for v, _ in rows], pa.list_(pa.float64())),
                                          pa.array([c for _, c in rows], pa.list_(pa.float64()))], ["feature", "v", "c"])


def _cut(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Between any two values if they are few, else where shares of the rows end; a value on an edge is below it."""
    values, at = np.unique(values, return_inverse=True)
    between = (values[:-1] + values[1:]) / 2
    if len(values) <= BINS:
        return between
    # MLlib's rule: an edge before the value at which the count moves away from the next multiple of a share.
    upto = np.cumsum(np.bincount(at, counts))
    stride, out = upto[-1] / BINS, []
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _edges_of(table: pa.Table) -> pa.Table:
    flat = [np.concatenate([np.asarray(x) for x in table.column(c).to_numpy()]) for c in ("v", "c")]
    return pa.table({"feature": table.column("feature")[:1], "edges": pa.array([_cut(*flat)], pa.list_(pa.float64()))})


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """A row of bin numbers per row."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], "left")
    return out


@dataclass(frozen=True)
class _Packed:
    """Binned rows as a stage of blocks; ``held`` marks rows that are only scored."""

    blocks: DataFrame
    edges: tuple[np.ndarray, ...]
    classes: int
    rows: int


def _packed(data: DataFrame, weight_col: str | None, held: Column | None = None) -> _Packed:
    fitted = data if held is None else data.where(~held)
    label = F.col("label")
    bad = label.isNull() | F.isnan(label) | (label < 0) | (label != F.floor(label)) | (label > 99)
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    rows, most, wrong, light = fitted.agg(F.count(F.lit(1)), F.max("label"), F.count_if(bad),
                                          F.count_if(weight.isNull() | F.isnan(weight) | (weight < 0))).first()
    if wrong or light or not rows:
        raise ValueError(f"{rows} rows to fit, {wrong} with a label that is no class number, {light} without a weight")
    x = vector_to_array("features").alias("x")
    found = fitted.select(x).mapInArrow(_described, "feature INT, v ARRAY<DOUBLE>, c ARRAY<DOUBLE>").groupBy("feature").applyInArrow(
        _edges_of, "feature INT, edges ARRAY<DOUBLE>")
    edges = tuple(np.array(r["edges"]) for r in sorted(found.collect(), key=lambda r: r["feature"]))

    def pack(batches):
        for values, table in _blocks(batches, CELLS):
            columns = [table.column(c).to_numpy().astype(t) for c, t in (("label", np.uint8), ("weight", np.float64), ("held", np.bool_))]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (_binned(values, edges), *columns)],
                                             ["x", "y", "w", "held"])

    every = data if held is None else data.where(held.isNotNull())
    blocks = every.select(x, "label", weight.alias("weight"), (F.lit(False) if held is None else held).alias("held")).mapInArrow(
        pack, "x BINARY, y BINARY, w BINARY, held BINARY")
    return _Packed(stage(blocks, "forest-rows", "zstd"), edges, max(2, int(most) + 1), rows)


# Growth --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Piece:
    """Trees ``first`` to ``last`` of a part, from one set of rows."""

    family: int
    part: int
    first: int
    last: int
    max_depth: int
    min_leaf: int
    seed: int
    subset: int
    bootstrap: bool


def _dealt(pieces: Sequence[_Piece], tasks: int) -> list[list[_Piece]]:
    """Pieces for each of at most ``tasks`` tasks, about as many trees each, neighbours together."""
    total = sum(p.last - p.first for p in pieces)
    tasks = max(1, min(tasks, total))
    ends = [total * (i + 1) // tasks for i in range(tasks)]
    out: list[list[_Piece]] = [[] for _ in ends]
    done, task = 0, 0
    for p in pieces:
        first = p.first
        while first < p.last:
            last = min(p.last, first + ends[task] - done)
            out[task].append(_Piece(p.family, p.part, first, last, *list(p.__dict__.values())[4:]))
            done, first = done + last - first, last
            task += done == ends[task]
    return out


def _grown(sets: Sequence[_Packed], pieces: Sequence[Sequence[_Piece]], score: bool) -> DataFrame:
    """Trees of the pieces of every set of rows, or with ``score`` their votes on the held-out rows of the set."""
    spark = sets[0].blocks.sparkSession
    tasks = math.ceil(TASKS_PER_CORE * spark.sparkContext.defaultParallelism / len(sets))
    work: list[tuple[int, list[_Piece]]] = []
    dealt = None
    for i, (rows, own) in enumerate(zip(sets, pieces, strict=True)):
        groups = _dealt(own, tasks)
        numbers = F.sequence(F.lit(len(work)), F.lit(len(work) + len(groups) - 1))
        work += [(i, g) for g in groups]
        part = rows.blocks.withColumn("task", F.explode(numbers))
        dealt = part if dealt is None else dealt.unionByName(part)
    shape = [(len(s.edges), s.classes) for s in sets]

    def run(batches):
        task, held = None, []
        for batch in batches:
            if batch.num_rows:
                task = batch.column("task")[0].as_py()
                held += zip(*(batch.column(c).to_pylist() for c in ("x", "y", "w", "held")))
        if task is None:
            return
        number, own = work[task]
        width, classes = shape[number]
        x = np.ascontiguousarray(np.concatenate([np.frombuffer(b[0], np.uint8).reshape(-1, width) for b in held]).T)
        y, w, out = (np.concatenate([np.frombuffer(b[i], t) for b in held]) for i, t in ((1, np.uint8), (2, np.float64), (3, np.bool_)))
        held.clear()
        fit, rest = (growth.Rows(np.ascontiguousarray(x[:, m]), y[m], w[m], classes).ordered() for m in (~out, out))
        del x, y, w
        step = max(1, growth.BLOCK // max(1, fit.x.shape[1]))
        for p in own:
            votes = np.zeros((rest.x.shape[1], classes))
            for first in range(p.first, p.last, step):
                keys = [growth.tree_key(p.seed + 1000 * p.part, t) for t in range(first, min(p.last, first + step))]
                grove, importances = growth.grow(fit, keys, p.max_depth, p.min_leaf, p.subset, p.bootstrap)
                if score:
                    grove.score(rest.x, votes)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p.part], pa.int32()), pa.array([grove.trees], pa.int32()),
                         pa.array([importances], pa.list_(pa.float64())), pa.array([grove.packed()], pa.binary())],
                        ["part", "trees", "importances", "grove"])
            if score:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((number, pa.int32()), (p.family, pa.int32()), (p.part, pa.int32()), (classes, pa.int32()),
                                                   (votes.tobytes(), pa.binary()), (rest.y.tobytes(), pa.binary()))],
                    ["number", "family", "part", "classes", "votes", "labels"])

    schema = ("number INT, family INT, part INT, classes INT, votes BINARY, labels BINARY" if score else
              "part INT, trees INT, importances ARRAY<DOUBLE>, grove BINARY")
    return dealt.repartitionById(len(work), "task").mapInArrow(run, schema)


def _subset(width: int, trees: int) -> int:
    """Features that a node draws: all for a single tree, else the root of their number."""
    return width if trees == 1 else math.ceil(math.sqrt(width))


@dataclass(frozen=True)
class ForestPart:
    """Trees as a stage of groves; scores like a fitted forest."""

    groves: DataFrame
    getNumTrees: int
    featureImportances: DenseVector
    edges: tuple[np.ndarray, ...]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        return GrownForest((self,)).transform(df)


def _votes(parts: Sequence[ForestPart], codes: DataFrame) -> DataFrame:
    """``_code`` (a binned row) and ``_votes`` of all trees of parts with the same bins, a row per different code."""
    spark, width, classes = codes.sparkSession, len(parts[0].edges), max(p.classes for p in parts)

    def pack(batches):
        for batch in batches:
            step = max(1, CELLS // width)
            for i in range(0, batch.num_rows, step):
                own = batch.column("_code").slice(i, step)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(own.to_pylist())], pa.binary())],
                                                 ["chunk", "data"])

    # Written, as the names of the chunks must not change.
    chunks = stage(codes.distinct().mapInArrow(pack, "chunk STRING, data BINARY"), "forest-codes", "zstd")
    groves = reduce(DataFrame.unionByName, [p.groves.select("grove", "part", F.lit(i).alias("of")) for i, p in enumerate(parts)])
    cores = spark.sparkContext.defaultParallelism
    across = min(2 * cores, groves.count())
    down = math.ceil(TASKS_PER_CORE * cores / across)
    # A grid of tasks: a share of the trees meets a share of the rows.
    trees = groves.select(F.lit(None).cast("string").alias("chunk"), F.col("grove").alias("data"),
                          F.pmod(F.xxhash64("grove"), F.lit(across)).cast("int").alias("a"), F.explode(
                              F.sequence(F.lit(0), F.lit(down - 1))).alias("d"))
    rows = chunks.select("chunk", "data", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"),
                         F.pmod(F.xxhash64("chunk"), F.lit(down)).cast("int").alias("d"))
    dealt = trees.unionByName(rows).withColumn("task", F.col("a") * down + F.col("d")).repartitionById(
        across * down, "task").sortWithinPartitions(F.col("chunk").asc_nulls_first())

    def score(batches):
        own = []
        for batch in batches:
            for chunk, data, a in zip(*(batch.column(c) for c in ("chunk", "data", "a"))):
                if not chunk.is_valid:
                    own.append(growth.Grove.unpacked(data.as_py()))
                    continue
                x = np.frombuffer(data.as_py(), np.uint8).reshape(-1, width)
                turned, votes = np.ascontiguousarray(x.T), np.zeros((len(x), classes))
                for grove in own:
                    grove.score(turned, votes[:, :grove.votes.shape[1]])
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([data.as_py() if a.as_py() == 0 else None], pa.binary()),
                                                  pa.array([votes.tobytes()], pa.binary())], ["chunk", "data", "votes"])

    def add(batches):
        for batch in batches:
            for data, each in zip(batch.column("data"), batch.column("votes")):
                total = np.sum([np.frombuffer(v.as_py()) for v in each.values], axis=0)
                code = data.as_py()
                for i in range(0, len(code) // width, 10_000):
                    some = total[i * classes:(i + 10_000) * classes]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([code[k * width:(k + 1) * width] for k in range(i, i + len(some) // classes)], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) + 1, classes), pa.int32()), pa.array(some))],
                        ["_code", "_votes"])

    scored = dealt.mapInArrow(score, "chunk STRING, data BINARY, votes BINARY").groupBy("chunk").agg(
        F.max("data").alias("data"), F.collect_list("votes").alias("votes"))
    return scored.select("data", "votes").mapInArrow(add, "_code BINARY, _votes ARRAY<DOUBLE>")


@dataclass(frozen=True)
class GrownForest:
    """Parts of one forest; scores like a fitted forest."""

    parts: tuple[ForestPart, ...]

    @property
    def trees(self) -> int:
        return sum(p.getNumTrees for p in self.parts)

    def first(self, trees: int) -> GrownForest:
        """The forest of the first parts, which must end at ``trees``."""
        kept, count = [], 0
        for part in self.parts:
            if count < trees:
                kept.append(part)
                count += part.getNumTrees
        if count != trees:
            raise ValueError(f"no parts of this forest add up to {trees} trees")
        return GrownForest(tuple(kept))

    @property
    def featureImportances(self) -> DenseVector:
        """Mean of the trees' importances; sums to 1 unless no tree has a split."""
        total = sum(p.featureImportances.toArray() * p.getNumTrees for p in self.parts)
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def voted(self, df: DataFrame) -> DataFrame:
        """``df`` with the votes of all trees; equal binned rows are scored once."""
        alike: dict[tuple, list[ForestPart]] = {}
        for p in self.parts:
            alike.setdefault(tuple(e.tobytes() for e in p.edges), []).append(p)
        names = []
        for i, parts in enumerate(alike.values()):
            edges = parts[0].edges

            def coded(x: pa.Array) -> pa.Array:
                return pa.array([row.tobytes() for row in _binned(_matrix(x), edges)] if len(x) else [], pa.binary())
            rows = df.withColumn("_code", F.arrow_udf(coded, "binary")(vector_to_array("features")))
            df = rows.join(_votes(parts, rows.select("_code")), "_code").drop("_code").withColumnRenamed("_votes", f"_votes_{i}")
            names.append(f"_votes_{i}")
        # Forests of fewer classes have no votes for the others.
        added = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))), map(F.col, names))
        return df.withColumn("_votes", added).drop(*names)

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
        return self.voted(df).withColumns({
            "rawPrediction": array_to_vector("_votes"),
            "probability": array_to_vector(F.transform("_votes", lambda v: v / total)),
            "prediction": _winner(F.col("_votes")),
        }).drop("_votes")


def part_sizes(sizes: Sequence[int], part: int = PART) -> list[int]:
    """Sizes of parts, none above ``part``, such that running sums hit every one of ``sizes``."""
    out, grown = [], 0
    for size in sorted(set(sizes)):
        while grown < size:
            out.append(min(part, size - grown))
            grown += out[-1]
    return out


def _parts(data: DataFrame, sizes: Mapping[int, int], max_depth: int, min_leaf: int, seed: int, weight_col: str | None,
           single: bool = False) -> tuple[ForestPart, ...]:
    """Parts by number, each of so many trees, from one growth. A ``single`` tree is of all rows and features."""
    if max_depth > MAX_DEPTH:
        raise ValueError(f"a tree can be at most {MAX_DEPTH} deep, not {max_depth}")
    rows = _packed(data, weight_col)
    width = len(rows.edges)
    pieces = [_Piece(0, number, 0, size, max_depth, min_leaf, seed, _subset(width, size if single else max(2, size)), not single)
              for number, size in sizes.items()]
    groves = stage(_grown([rows], [pieces], False), "forest")
    discard(rows.blocks)
    sums = groves.groupBy("part").agg(F.array(*[F.sum(F.get("importances", F.lit(f))) for f in range(width)]).alias("s"))
    found = {r["part"]: np.array(r["s"]) for r in sums.collect()}
    return tuple(ForestPart(groves.where(F.col("part") == number), size, Vectors.dense(found[number] / (found[number].sum() or 1.0)),
                            rows.edges, rows.classes) for number, size in sizes.items())


def _fit(data: DataFrame, trees: int, number: int, max_depth: int, min_leaf: int, seed: int, weight_col: str | None) -> ForestPart:
    return _parts(data, {number: trees}, max_depth, min_leaf, seed, weight_col)[0]


def grow(data: DataFrame, trees: int = 100, max_depth: int = 30, min_leaf: int = 1, seed: int = 42,
         weight_col: str | None = None, part: int | None = None) -> GrownForest:
    """A forest of ``trees`` trees, in parts of ``part`` trees if told so; each part draws its rows with a seed of its own."""
    return GrownForest(_parts(data, dict(enumerate(part_sizes([trees], part or trees))), max_depth, min_leaf, seed, weight_col))


@dataclass(frozen=True)
class Forest:
    """An estimator; a forest of one ``single`` tree is a decision tree."""

    trees: int
    max_depth: int
    min_leaf: int = 1
    seed: int = 42
    single: bool = False

    def fit(self, data: DataFrame) -> GrownForest:
        return GrownForest(_parts(data, {0: self.trees}, self.max_depth, self.min_leaf, self.seed, None, self.single))


@dataclass(frozen=True)
class ForestSearch:
    """``scores``: {setting: mean score}, in the order drawn; settings are (trees, max_depth, min_leaf)."""

    scores: dict[tuple[int, int, int], float]
    bestModel: GrownForest

    @property
    def best(self) -> tuple[int, int, int]:
        return max(self.scores, key=self.scores.get)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(*k, float(v)) for k, v in self.scores.items()],
                                     "trees INT, max_depth INT, min_leaf INT, score DOUBLE")


def weighted_f1(cells: dict[tuple[float, float], int]) -> float:
    """F1 per class weighted by its rows, from counts by (label, prediction); an undefined F1 is zero."""
    total, score = sum(cells.values()), 0.0
    for cls in {label for label, _ in cells}:
        support = sum(n for (label, _), n in cells.items() if label == cls)
        predicted = sum(n for (_, p), n in cells.items() if p == cls)
        score += support / total * 2 * cells.get((cls, cls), 0) / (support + predicted)
    return score


def _counted(table: pa.Table) -> pa.Table:
    """Rows by label and prediction after each part of a fold's forest, from the votes of its tasks."""
    first = {c: table.column(c)[0].as_py() for c in ("number", "family", "classes", "labels")}
    labels, classes = np.frombuffer(first["labels"], np.uint8), first["classes"]
    parts = table.column("part").to_pylist()
    votes, out = np.zeros((len(labels), classes)), []
    for part in sorted(set(parts)):
        for at, own in enumerate(parts):
            if own == part:
                votes += np.frombuffer(table.column("votes")[at].as_py()).reshape(-1, classes)
        cells = np.bincount(labels.astype(np.int64) * 256 + votes.argmax(1), minlength=0)
        out += [(first["number"], first["family"], part, cell // 256, cell % 256, int(cells[cell])) for cell in np.flatnonzero(cells)]
    names = ("number", "family", "part", "label", "prediction", "n")
    types = (*[pa.int32()] * 3, pa.float64(), pa.float64(), pa.int64())
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, types))})


def search(data: DataFrame, settings: Sequence[tuple[int, int, int]], k: int, fold: str = "fold", seed: int = 42,
           weight_col: str | None = None, part: int = PART) -> ForestSearch:
    """Cross-validate settings (trees, max_depth, min_leaf) by weighted F1 and grow the best one on all rows."""
    families: dict[tuple[int, int], list[int]] = {}
    for trees, depth, leaf in settings:
        families.setdefault((depth, leaf), []).append(trees)
    if any(depth > MAX_DEPTH for depth, _ in families):
        raise ValueError(f"a tree can be at most {MAX_DEPTH} deep")
    # Bins are of the rows that a fold is fitted on.
    sets = _side_by_side(data.sparkSession, lambda i: _packed(data, weight_col, F.col(fold) == i), range(k))
    parts = [part_sizes(sizes, part) for sizes in families.values()]
    pieces = [[_Piece(f, number, 0, size, depth, leaf, seed, _subset(len(s.edges), max(2, size)), True)
               for f, (depth, leaf) in enumerate(families) for number, size in enumerate(parts[f])] for s in sets]
    counts = _grown(sets, pieces, True).groupBy("number", "family").applyInArrow(
        _counted, "number INT, family INT, part INT, label DOUBLE, prediction DOUBLE, n BIGINT").collect()
    discard(*[s.blocks for s in sets])
    cells: dict[tuple, dict] = {}
    for r in counts:
        cells.setdefault((r["family"], r["part"], r["number"]), {})[r["label"], r["prediction"]] = r["n"]
    scores = {}
    for trees, depth, leaf in settings:
        f = list(families).index((depth, leaf))
        last = next(i for i in range(len(parts[f])) if sum(parts[f][:i + 1]) == trees)
        per_fold = [weighted_f1(cells[f, last, i]) for i in range(k) if (f, last, i) in cells]
        scores[trees, depth, leaf] = sum(per_fold) / len(per_fold)
    best = max(scores, key=scores.get)
    return ForestSearch(scores, grow(data, best[0], best[1], best[2], seed, weight_col))
