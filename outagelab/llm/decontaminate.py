"""Benchmark decontamination by winnowing.

Every run of ``window`` words keeps the least hash of its ``gram``-word shingles (its fingerprint). Equal runs have equal
fingerprints, so a run that a document shares with a benchmark item cannot be missed. Fingerprints of both sides are
joined; only where they meet are the runs themselves spelled out (the hit is extended to the whole run) and compared word
by word. Items shorter than a run are looked up whole, by their own length.

Scale: fingerprints leave a document as narrow distinct rows; the benchmark's fingerprints and runs are written tables, so
that their size decides how they are joined. Texts travel only for documents with a common fingerprint. Runs are joined to
distinct benchmark runs (one row each), and lists of items are built once per distinct set of runs, so no hot passage
makes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard, stage
from .common import KEY, NOT_ALPHANUMERIC, NOT_ALPHANUMERIC_CASED, TEXT, ascii_lower, document_key, keyed, let, words

WINDOW = 10
GRAM = 6


def benchmark_words(text: Column) -> Column:
    return words(ascii_lower(text), NOT_ALPHANUMERIC)


def _grams(hashes: Column, n: int) -> Column:
    """Hash of each run of n word hashes."""
    return F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0))),
        lambda h, i: F.xxhash64(F.lit(n), h, *[F.get(hashes, i + j) for j in range(1, n)]))


def _fingerprints(hashes: Column, window: int, gram: int) -> Column:
    """Least gram hash of each run of ``window`` words, in order of the runs."""
    span = window - gram + 1
    return let(_grams(hashes, gram), lambda g: F.transform(
        F.slice(g, F.lit(1), F.greatest(F.size(g) - (span - 1), F.lit(0))),
        lambda h, i: F.least(h, *[F.get(g, i + j) for j in range(1, span)]) if span > 1 else h))


def _hashes(ws: Column) -> Column:
    """Hash of each word in lower case. Words that agree with A-Z lowered agree in lower case too, so hashing whole-case
    lowered words (much quicker than lowering A-Z alone) finds every common run; the comparison of words is exact."""
    return F.transform(ws, lambda w: F.xxhash64(F.lower(w)))


def _runs(ws: Column, prints: Column, length: int) -> Column:
    """(start, length, fingerprint, words) of each run; ``prints`` holds a fingerprint per start."""
    return F.transform(prints, lambda p, i: F.struct(
        i.alias("start"), F.lit(length).alias("length"), p.alias("print"),
        F.array_join(F.slice(ws, i + 1, F.lit(length)), " ").alias("content")))


def benchmark_runs(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Item, length, fingerprint and words of every run of the benchmark; a shorter item is one run."""
    items = benchmark.select(F.col(item_col).alias("item"), benchmark_words(F.col(text_col)).alias("ws"))
    items = items.where(F.size("ws") > 0)
    ws = F.col("ws")
    whole = F.array(F.struct(
        F.lit(0).alias("start"), F.size(ws).alias("length"),
        F.expr("cast(null as bigint)").alias("print"), F.array_join(ws, " ").alias("content")))
    for n in range(1, window):
        gram_n = F.get(_grams(_hashes(ws), n), F.lit(0))
        whole = F.when(F.size(ws) == n, F.array(F.struct(
            F.lit(0).alias("start"), F.lit(n).alias("length"), gram_n.alias("print"),
            F.array_join(ws, " ").alias("content")))).otherwise(whole)
    long_items = _runs(ws, let(_hashes(ws), lambda h: _fingerprints(h, window, gram)), window)
    runs = F.when(F.size(ws) >= window, long_items).otherwise(whole)
    return (items.select("item", F.explode(runs).alias("r"))
            .select("item", F.col("r.length").alias("length"), F.col("r.print").alias("print"),
                    F.col("r.content").alias("content")).distinct())


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document (id and text) with its words, the spans it shares with the benchmark and the items.

    Columns: id, hash of the text, ``n_words``, ``spans`` (ordered disjoint structs of ``start`` and ``end`` in words, null
    if clean) and ``items`` (ordered item ids as text, null if clean). Null and empty texts have no words and no spans; an
    empty or wordless benchmark leaves everything clean; items with equal texts are all named; null item ids are not.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    source = keyed(docs, id_col, text_col)
    runs = stage(benchmark_runs(benchmark, item_col, item_text_col, window, gram), "benchmark-runs")
    distinct_runs = stage(runs.select("length", "print", "content").distinct(), "benchmark-distinct-runs")
    prints = stage(distinct_runs.select("print").distinct(), "benchmark-prints")
    # At most window - 1 lengths: which short items exist at all.
    short = sorted(r[0] for r in distinct_runs.where(F.col("length") < window).select("length").distinct().collect())

    def doc_prints(h: Column) -> Column:
        arrays = [_fingerprints(h, window, gram)] + [_grams(h, n) for n in short]
        return F.array_distinct(F.concat(*arrays))

    # One marker row per document keeps its word count through the join; its value only spreads the markers.
    tokens = source.select(KEY, _hashes(words(F.col(TEXT), NOT_ALPHANUMERIC_CASED)).alias("h"))
    narrow = tokens.select(
        KEY, F.size("h").alias("n_words"), F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("marker"), F.xxhash64(KEY).alias("print"))),
            F.transform(let(F.col("h"), doc_prints), lambda p: F.struct(F.lit(False).alias("marker"), p.alias("print"))),
        )).alias("f")).select(KEY, "n_words", "f.marker", "f.print")
    met = narrow.join(prints.withColumn("known", F.lit(True)), "print", "left")
    per_doc = stage(
        met.where("marker or known").groupBy(KEY).agg(
            F.max("n_words").alias("n_words"),
            F.collect_set(F.when(~F.col("marker"), F.col("print"))).alias("prints")), "document-prints")

    # Extend the hits of the few documents that have any: spell out their runs and compare them with the benchmark's.
    candidates = per_doc.where(F.size("prints") > 0).select(KEY, "prints")
    texts = source.join(candidates, KEY).select(
        KEY, "prints", benchmark_words(F.col(TEXT)).alias("ws"))

    def spelled(h: Column) -> Column:
        arrays = [_runs(F.col("ws"), _fingerprints(h, window, gram), window)]
        arrays += [_runs(F.col("ws"), _grams(h, n), n) for n in short]
        return F.concat(*[F.filter(a, lambda r: F.array_contains(F.col("prints"), r["print"])) for a in arrays])

    found = texts.select(KEY, F.explode(let(_hashes(F.col("ws")), spelled)).alias("r"))
    found = found.select(KEY, "r.start", "r.length", "r.content").distinct()
    exact = found.join(distinct_runs.select("length", "content"), ["length", "content"])
    hits = stage(
        exact.groupBy(KEY).agg(
            F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("hits"),
            F.array_sort(F.collect_set(F.md5("content"))).alias("contents"))
        .select(KEY, _merged(F.col("hits")).alias("spans"), "contents",
                F.md5(F.array_join("contents", ",")).alias("class")), "document-hits")

    # Documents with the same runs have the same items: look each set up once.
    classes = hits.groupBy("class").agg(F.first("contents").alias("contents"))
    named = runs.select("item", F.md5("content").alias("content"))
    items = (classes.select("class", F.explode("contents").alias("content")).join(named, "content")
             .groupBy("class").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    labelled = hits.join(items, "class", "left").select(KEY, "spans", "items")
    discard(prints)
    return per_doc.join(labelled, KEY, "left").select(
        F.col(KEY)["id"].alias(id_col), F.col(KEY)["hash"].alias("text_hash"), "n_words", "spans", "items")


def _merged(hits: Column) -> Column:
    """The words covered by (start, end) structs, as ordered disjoint spans."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        hits, lambda x: F.sequence(x["start"], x["end"] - 1)))))

    def spans(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))

    return let(covered, spans)


def contamination(spans: DataFrame) -> DataFrame:
    """Digest of :func:`find_spans`: counts of words and items, and a hash of the item list."""
    covered = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_hit = F.coalesce(covered, F.lit(0).cast("long"))
    items = F.coalesce(F.col("items"), F.expr("cast(array() as array<string>)"))
    return spans.select(
        spans.columns[0], F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_hit: int = 0, **options) -> DataFrame:
    """The documents, with all their columns, that share at most ``max_hit`` words with the benchmark."""
    spans = find_spans(docs, benchmark, id_col, text_col, **options)
    covered = F.aggregate(F.col("spans"), F.lit(0), lambda n, s: n + s["end"] - s["start"])
    hit = spans.where(covered > max_hit).select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias(KEY))
    return docs.withColumn(KEY, document_key(id_col, text_col)).join(hit, KEY, "left_anti").drop(KEY)
