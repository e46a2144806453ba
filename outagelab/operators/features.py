"""Feature operators: multi-hot blocks, deciles, z-scores, variance filter, column roles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import UNKNOWN
from .ordering import exact_quantiles

# A vocabulary becomes columns, so it must be small; beyond this the job stops with an error.
MAX_COLUMNS = 10_000


def safe_name(text: str) -> str:
    """Column name without characters that need quoting."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", text)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def text(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_attributes(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Distinct (key, variable, value) rows of several columns in one pass.

    This is the form every encoder reads: no row per combination of attributes is needed.
    """
    flags = {f.name for f in df.schema if f.dataType.simpleString() == "boolean"}

    def as_text(c: str) -> Column:
        shown = quoted(c).cast("string")
        return F.coalesce(F.initcap(shown) if c in flags else shown, F.lit(UNKNOWN))

    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), as_text(c).alias("value")) for c in cols])
    return df.select(F.col(key), F.inline(pairs)).distinct()


def _tagged(longs: Sequence[DataFrame]) -> DataFrame:
    parts = [long.select("variable", "value", F.lit(i).alias("src")) for i, long in enumerate(longs)]
    return reduce(DataFrame.unionByName, parts)


def vocabulary(*longs: DataFrame, common: bool = True, drop_reference: bool = True) -> dict[str, list[str]]:
    """Values per variable, in order, for the columns of a multi-hot block.

    With ``common`` only values that every frame holds are kept. The last value of each variable
    in the merged vocabulary is the reference level and gets no column.
    """
    return vocabulary_by_source(_tagged(longs), "src", len(longs) if common else 1, drop_reference)


def _shared_values(tagged: DataFrame, src: str, sources: int, drop_reference: bool) -> tuple[DataFrame, DataFrame]:
    """(variable, value) held by at least ``sources`` sources, and the last value of every variable."""
    values = tagged.groupBy("variable", "value").agg(F.count_distinct(src).alias("_n"))
    last = values.groupBy("variable").agg(F.max("value").alias("_last"))
    shared = values.filter(F.col("_n") >= sources).join(last, "variable")
    if drop_reference:
        shared = shared.filter(F.col("value") != F.col("_last"))
    return shared.select("variable", "value"), last


def vocabulary_rows(*longs: DataFrame) -> DataFrame:
    """The common vocabulary without reference levels as (variable, value) rows, none of which travel to the driver."""
    return _shared_values(_tagged(longs), "src", len(longs), True)[0]


def vocabulary_by_source(tagged: DataFrame, src: str, sources: int = 2, drop_reference: bool = True,
                         max_columns: int = MAX_COLUMNS):
    """The same from one frame, for values held by at least ``sources`` different sources."""
    shared, last = _shared_values(tagged, src, sources, drop_reference)
    # Only values that become columns travel to the driver.
    rows = shared.limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} columns to encode")
    out: dict[str, list[str]] = {r["variable"]: [] for r in last.select("variable").orderBy("variable").collect()}
    for variable, value in sorted((r["variable"], r["value"]) for r in rows):
        out[variable].append(value)
    return out


def column_names(vocab: Mapping[str, Sequence[str]], naming=safe_name) -> dict[tuple[str, str], str]:
    """(variable, value) to output column, kept unique after the names are made safe."""
    names: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    for variable, values in vocab.items():
        for value in values:
            name = naming(f"{variable}_{value}")
            while name in used:
                name += "_"
            used.add(name)
            names[(variable, value)] = name
    return names


def multi_hot(long: DataFrame, key: str, vocab: Mapping[str, Sequence[str]], naming=safe_name) -> DataFrame:
    """0/1 columns per (variable, value), one row per key; a key may hold several values.

    One aggregate for all variables. Duplicates combine before the shuffle.
    """
    names = column_names(vocab, naming)
    item = F.concat_ws("\u0001", "variable", "value")
    wanted = {f"{var}\u0001{val}": name for (var, val), name in names.items()}
    hits = long.select(key, F.when(item.isin(*wanted), item).alias("_item"))
    # A pivot: a row updates one cell instead of all.
    wide = hits.groupBy(key).pivot("_item", list(wanted)).agg(F.max(F.lit(1)))
    return wide.selectExpr(key, *[f"coalesce(`{i}`, 0) as `{name}`" for i, name in wanted.items()])


def decile_edges(df: DataFrame, value: str, q: int = 10) -> list[float]:
    """Distinct quantile edges, ``q + 1`` numbers at most."""
    probabilities = [i / q for i in range(q + 1)]
    rows = exact_quantiles(df, value, probabilities).collect()
    return sorted({r["quantile"] for r in rows if r["quantile"] is not None})


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins 1..n over the edges; the lowest edge belongs to bin 1."""
    choice = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int"))
    for i, right in enumerate(edges[1:], start=1):
        choice = choice.when(value <= F.lit(float(right)), F.lit(i))
    return choice


def bin_label(edges: Sequence[float], i: int) -> str:
    """``left_right`` label of bin ``i``; the left edge is rounded to four places."""
    return f"{round(edges[i - 1], 4)}_{edges[i]}"


def bin_labels(value: Column, edges: Sequence[float]) -> Column:
    number = bin_number(value, edges)
    labels = F.array(*[F.lit(bin_label(edges, i)) for i in range(1, len(edges))])
    return F.when(number.isNotNull(), F.element_at(labels, number))


@dataclass(frozen=True)
class ZScore:
    """Column means and sample deviations, fitted once and applied without a shuffle."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "ZScore":
        row = df.selectExpr(*[f"{f}(`{c}`) as {n}{i}" for i, c in enumerate(cols)
                              for n, f in (("m", "avg"), ("s", "stddev_samp"))]).first()
        return cls({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)})

    def apply(self, df: DataFrame) -> DataFrame:
        """A constant column becomes zero."""
        scaled = {
            c: f"(`{c}` - {mean!r}D) / {dev!r}D" if dev else f"if(`{c}` is null, null, 0D)"
            for c, (mean, dev) in self.stats.items()
        }
        return df.selectExpr(*[f"{scaled[c]} as `{c}`" if c in scaled else f"`{c}`" for c in df.columns])


def unpivot(df: DataFrame, keep: Sequence[str], cols: Sequence[str],
            where: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keep..., variable, value) rows as doubles; ``where`` tests a value before rows are made."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("variable"), quoted(c).cast("double").alias("value")) for c in cols
    ])
    if where is not None:
        pairs = F.filter(pairs, lambda p: where(p["value"]))
    return df.select(*[quoted(k) for k in keep], F.inline(pairs))


def per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[Column], Column]],
               by: Sequence[str] = ()) -> DataFrame:
    """Statistics of many columns in one aggregate over the wide rows, then one row per column."""
    wide = df.groupBy(*by).agg(*[
        stat(quoted(c).cast("double")).alias(f"{name}{i}")
        for i, c in enumerate(cols) for name, stat in stats.items()
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}{i}").alias(name) for name in stats])
        for i, c in enumerate(cols)
    ])
    return wide.select(*by, F.inline(rows))


def column_variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population variance per column, long form."""
    return per_column(df, cols, {"variance": F.var_pop})


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.09) -> list[str]:
    """Columns whose population variance is strictly above the threshold."""
    kept = {r["variable"] for r in column_variances(df, cols).filter(F.col("variance") > threshold).collect()}
    return [c for c in cols if c in kept]


def common_columns(a: DataFrame | Iterable[str], b: DataFrame | Iterable[str]) -> list[str]:
    """Columns of ``a`` that ``b`` has too, in the order of ``a``."""
    left = a.columns if isinstance(a, DataFrame) else list(a)
    right = set(b.columns if isinstance(b, DataFrame) else b)
    return [c for c in left if c in right]


def one_sided_columns(a: Iterable[str], b: Iterable[str]) -> list[str]:
    return sorted(set(a) ^ set(b))


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames on their common columns."""
    shared = common_columns(a, b)
    return a.select(*[quoted(c) for c in shared]), b.select(*[quoted(c) for c in shared])


def drop_columns(df: DataFrame, names: Sequence[str] = (), containing: Sequence[str] = ()) -> DataFrame:
    """Drop columns by list and by name substring."""
    keep = [c for c in df.columns if c not in set(names) and not any(s in c for s in containing)]
    return df.select(*[quoted(c) for c in keep])


def label_last(df: DataFrame, key: str, label: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, label)]
    return df.select(quoted(key), *[quoted(c) for c in rest], quoted(label))


def nonzero_profile(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The non-zero features of each row, long form."""
    return unpivot(df, [key], cols, where=lambda v: v.isNotNull() & (v != 0))
