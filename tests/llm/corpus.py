"""Hand-made corpora for the corpus operators: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "hash long, shard int, size long, print long, score double, start int, root long")

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "Ne", "pu", "ré", "sü") for b in ("ta", "ru", "go", "xi", "zan", "b9", "d-e")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, source) with planted copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 70), "The same footer on every site."
    out: list[tuple] = []
    for k in range(n):
        text = sentence(rng, rng.randint(1, 160))
        if k % 7 == 3:
            text = out[k - 3][1]                                        # exact copy
        elif k % 7 == 4:
            text = text + "\n" + passage + " " + sentence(rng, 5)       # shared passage
        elif k % 7 == 5:
            text = f"{text}\n{line}\n\n  {line}\nEnd {k}"
        out.append((k, text, f"s{k % 6}"))
    out += [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, " \t\n ", None), (n + 3, "word", None), (None, sentence(rng, 80), "s2"),
            (n + 4, "du " * 3000, "s3"), (n + 5, "é" * 400, "s3"), (5, out[5][1], "s5"), (n + 6, passage, "s4")]
    return out


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    data = rows() if data is None else data
    wide = [(i, t, "en", s, None if t is None or k % 5 == 0 else len(t), 7, 7, 7, 7, 0.5, 7, 7) for k, (i, t, s) in enumerate(data)]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
