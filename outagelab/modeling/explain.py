"""Local explanation of single predictions by a weighted linear fit around a row.

Each chosen row is perturbed inside Spark, all perturbed rows are scored in one distributed
``transform``, and one small weighted least-squares system per row is solved. Its moments are summed
where the copies are made, so a shuffle carries one row of moments per key and not all copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perturbed(rows: DataFrame, key: str, size: int, samples: int, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """``samples`` noisy copies of every row's feature vector; the first copy is the row itself.

    Noise is a function of key, copy and position, so it is the same on every recomputation.
    """
    def offset(copy, i):
        bits = F.pmod(F.xxhash64(F.col(key), copy, i, F.lit(seed)), F.lit(2_000_001)) - 1_000_000
        return F.when(copy == 0, F.lit(0.0)).otherwise(bits / 1_000_000.0 * spread)

    # The inner dimension is fixed by the model, the outer one by the sample count.
    positions = F.sequence(F.lit(0), F.lit(size - 1))
    copies = rows.select(key, vector_to_array("features").alias("_x"),
                         F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("copy"))
    noise = F.transform(positions, lambda i: offset(F.col("copy"), i))
    return copies.withColumn("z", noise).withColumn(
        "features", array_to_vector(F.zip_with("_x", "z", lambda x, z: x + z))
    ).drop("_x")


def explain_rows(model, rows: DataFrame, key: str, features: Sequence[str], samples: int = 200,
                 spread: float = 1.0, width: float | None = None, seed: int = 42) -> DataFrame:
    """(key, feature, weight): local linear effect of each feature on the model's score."""
    from .estimators import scored, tasks_worth

    size = len(features)
    width = width or 0.75 * size ** 0.5
    # The work lies in the copies, so few rows are dealt over as many tasks as their copies are worth.
    dealt = rows.repartition(tasks_worth(rows.sparkSession, rows.count() * samples), key)
    cloud = scored(model, perturbed(dealt, key, size, samples, spread, seed))
    distance = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + v * v)
    weighted = cloud.select(key, "z", "score", F.exp(-distance / (width * width)).alias("w"))
    p = size + 1

    def sums(batches):
        # The copies of a row stand together, so nearly every run is a whole row; what is cut or apart meets in the aggregate.
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            change = pc.fill_null(pc.not_equal(keys.slice(0, n - 1), keys.slice(1)), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            x = np.hstack([np.ones((n, 1)), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, size)])
            xw = x * batch.column(3).to_numpy(zero_copy_only=False)[:, None]
            score = batch.column(2).to_numpy(zero_copy_only=False)
            found = np.stack([np.concatenate([(xw[a:b].T @ x[a:b]).ravel(), xw[a:b].T @ score[a:b]])
                              for a, b in zip(starts, [*starts[1:], n])])
            lists = pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * found.shape[1], found.ravel())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), lists], [key, "v"])

    @F.pandas_udf("array<double>")
    def solved(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        flat = np.vstack(v.to_numpy())
        grams = flat[:, :p * p].reshape(-1, p, p) + 1e-6 * np.eye(p)
        return pd.Series(list(np.linalg.solve(grams, flat[:, p * p:, None])[:, 1:, 0]))

    kind = rows.schema[key].dataType.simpleString()
    parts = weighted.mapInArrow(sums, f"`{key}` {kind}, v array<double>").select(key, array_to_vector("v").alias("v"))
    systems = parts.groupBy(key).agg(Summarizer.sum(F.col("v")).alias("v"))
    weights = systems.select(key, solved(vector_to_array("v")).alias("weight"))
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("weight"))
    return weights.select(key, F.inline(pairs).alias("feature", "weight"))
