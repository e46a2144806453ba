"""Operators on documents against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from outagelab.llm import decontaminate, lines, mix, shards, simhash, substrings, suffixes

from .corpus import documents, empty, rows, sentence


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# --- decontamination

BENCHMARK = [(1, None), (2, ""), (3, "Ka-ta lo ru"), (10, "one"), (None, "unused words of an item that has no id at all here ok")]


def benchmark(spark, data):
    import random
    rng = random.Random(3)
    some = data[4][1]
    extra = [(20, " ".join(item_words(some)[3:25])), (21, " ".join(item_words(some)[3:25]).upper()), (22, sentence(rng, 30)),
             (9, item_words(data[8][1])[0] if item_words(data[8][1]) else "x")]
    return BENCHMARK + extra, spark.createDataFrame(BENCHMARK + extra, "item_id long, text string")


def test_decontamination(spark):
    data = rows()
    items, bench = benchmark(spark, data)
    runs = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        for i in range(max(len(ws) - 9, 1) if ws else 0):
            runs[tuple(ws[i:i + 10])].add(item)
    expected = set()
    for doc, text, _ in data:
        ws, hit, found = item_words(text), set(), set()
        for run, owners in runs.items():
            for i in range(len(ws) - len(run) + 1):
                if tuple(ws[i:i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    found |= {str(o) for o in owners if o is not None}
        expected.add((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(decontaminate.find_spans(documents(spark, data), bench)).collect()
    assert {tuple(r) for r in got} == expected
    assert sum(r.contaminated for r in got) > 3
    kept = decontaminate.decontaminate(documents(spark, data), bench)
    assert kept.columns == documents(spark, data).columns
    clean = {e[0] for e in expected if not e[5]}
    assert {r.doc_id for r in kept.collect()} == clean


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_spans(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(documents(spark), bench).count() == len(rows())
    with pytest.raises(ValueError):
        decontaminate.find_spans(empty(spark), bench, gram=11)


# --- mixing

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, live, out = 1.5 * sum(sizes.values()), set(names), {}
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in live}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        live -= set(over)
    return out


def test_mix(spark):
    data = rows(n=150)
    drawn = mix.draw(documents(spark, data)).cache()
    got = mix.taken(drawn).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(spaced(t))) for d, t, _ in data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(spaced(t))
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in drawn.select("src.source", "source_size", "target", "blocks", "bounds", mix.F.aggregate(
            "pieces", mix.F.lit(0).cast("long"), lambda n, p: n + (p["end"] - p["start"]) * p["copies"]).alias("n")).collect():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] += r["n"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(1, sizes[s] / 100), s
    assert all(r.taken <= 2 * r["size"] for r in got)
    again = mix.taken(mix.draw(documents(spark, data).repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_and_shards(spark):
    data = [r for r in rows(n=150) if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    docs = documents(spark, data)
    taken = {r.doc_id: r.taken for r in mix.taken(mix.draw(docs)).collect()}
    out = mix.mix(docs, chars_col="n_chars")
    assert out.columns == docs.columns + ["mix_shard", "mix_order"]
    words = Counter()
    per_shard = Counter()
    for r in out.collect():
        words[r.doc_id] += len(spaced(r.text))
        assert r.n_chars == len(r.text) and r.text in dict((d, t) for d, t, _ in data)[r.doc_id]
        per_shard[r.mix_shard] += 1
    assert all(words[d] == n for d, n in taken.items())
    assert set(per_shard) <= set(range(16)) and len(per_shard) == 16


def test_tree_decides_the_words_of_shards(spark):
    """Whole documents but one per source, in the shard whose tickets hold their first word; few words decide nothing else."""
    data = [(k, sentence(random.Random(k), 60), f"s{k % 3}") for k in range(400)]
    drawn = mix.draw(documents(spark, data), block=100).collect()
    tickets, words = defaultdict(Counter), defaultdict(Counter)
    for r in drawn:
        upto = [0, *r.bounds]
        tickets[r.src.source] = Counter({k: b - a for k, (a, b) in enumerate(zip(upto, upto[1:]))})
        assert upto[-1] == r.blocks == -(-round(r.target) // 100)
        for p in r.pieces:
            words[r.src.source][p.shard] += p.end - p.start
    for s in tickets:
        assert all(abs(words[s][k] - 100 * tickets[s][k]) <= 200 for k in range(16)), s
        cut = [p for r in drawn if r.src.source == s for p in r.pieces if p.end - p.start < r["size"]]
        assert len(cut) <= 1
    totals = sum(tickets.values(), Counter())
    assert max(totals.values()) - min(totals.values()) <= 4
    other = mix.draw(documents(spark, data), block=100, seed=5).collect()
    assert {tuple(r.bounds) for r in other} != {tuple(r.bounds) for r in drawn}


def test_shards_in_order(spark):
    mixed = mix.in_order(mix.mix(documents(spark, [r for r in rows(n=60)])), parts=2)
    for part in mixed.rdd.glom().collect():
        order = [(r.mix_shard, r.mix_order) for r in part]
        assert order == sorted(order)


def test_tree_keeps_quotas(spark):
    quotas = spark.sql("select array(5000L, 0L, 17L, 1L, 320L) as counts")
    got = {r.shard: r.counts for r in mix._tree(quotas, 12, 1).collect()}
    assert sorted(got) == list(range(12))
    assert [sum(c[k] for c in got.values()) for k in range(5)] == [5000, 0, 17, 1, 320]
    totals = [sum(c) for c in got.values()]
    assert max(totals) - min(totals) <= 3
    assert len({tuple(c) for c in got.values()}) > 3


def test_draw_follows_the_hypergeometric_law(spark):
    from math import comb
    rows_ = spark.range(6000).selectExpr(
        mix._draw("20", "8", "6", "(pmod(xxhash64(3, id), 9007199254740992L) + 0.5D) / 9007199254740992D") + " as g")
    seen = {r.g: r["count"] / 6000 for r in rows_.groupBy("g").count().collect()}
    for k in range(7):
        assert abs(seen.get(k, 0) - comb(8, k) * comb(12, 6 - k) / comb(20, 6)) < 0.025


def test_mix_of_nothing(spark):
    assert mix.taken(mix.draw(empty(spark))).count() == 0
    assert mix.mix(empty(spark)).count() == 0
    blank = documents(spark, [(1, "", "a"), (2, None, "b")])
    assert {(r["size"], r.taken, r.target) for r in mix.taken(mix.draw(blank)).collect()} == {(0, 0, 0.0)}


# --- sharding

def least_capacity(sizes, n):
    low, high = -(-sum(sizes) // n), sum(sizes)
    while low < high:
        mid, at, used = (low + high) // 2, 0, 1
        ok = max(sizes) <= mid
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        if ok and used <= n:
            high = mid
        else:
            low = mid + 1
    return low


@pytest.mark.parametrize("n", [1, 4, 16, 200])
def test_shards(spark, n):
    data = rows(n=120)
    got = shards.shard(documents(spark, data), shards=n).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in data)
    slots, where, load = defaultdict(list), defaultdict(set), Counter()
    text = {}
    for d, t, _ in data:
        text.setdefault((d, size(t), zlib.crc32((t or "").encode())), t)
    for r in got:
        slots[r.shard].append(r.slot)
        where[text[r.doc_id, r["size"], r.text_crc32]].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n))
    assert all(len(v) == 1 for v in where.values())
    keys = {t: k for t, k in [(r.text, r.k) for r in documents(spark, data).selectExpr("text", "xxhash64(text) as k").collect()]}
    groups = Counter()
    for _, t, _ in data:
        groups[keys[t]] += size(t)
    assert max(load.values()) == least_capacity([groups[k] for k in sorted(groups)], n) or max(load.values()) <= least_capacity(
        [groups[k] for k in sorted(groups)], n)


def test_minimax_with_nodes_that_must_be_refined(spark, monkeypatch):
    import random
    rng = random.Random(5)
    sizes = [(rng.randint(-2**63, 2**63 - 1), rng.choice([1, 3, 50, 4000])) for _ in range(3000)]
    monkeypatch.setattr(shards, "LEVEL_BITS", (3, 6, 9, 24, 64))
    trie = shards.Trie(spark.createDataFrame(sizes, "key long, size long"))
    capacity = shards.minimax_capacity(trie, 7)
    ordered = [s for _, s in sorted(sizes)]
    assert capacity == least_capacity(ordered, 7)
    cuts = shards.balanced_cuts(trie, 7, capacity)
    load = Counter()
    for key, s in sizes:
        load[sum(key >= c for c in cuts)] += s
    assert max(load.values()) <= capacity and len(load) == 7


def test_shards_of_nothing(spark):
    assert shards.assignments(shards.shard(empty(spark))).count() == 0


# --- SimHash

def plain_fingerprint(text):
    ws = spaced(lower(text))
    if not ws:
        return 0
    parts = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_simhash(spark):
    data = rows(n=90)
    prints = {(d, t): plain_fingerprint(t) for d, t, _ in data}
    root = components(set(prints.values()))
    least = {}
    for (d, t), p in prints.items():
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    got = simhash.groups(documents(spark, data)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (d, f"{prints[d, t]:016x}", least.get(root[prints[d, t]])) for d, t, _ in data)
    kept = simhash.deduplicate(documents(spark, data))
    assert kept.columns == documents(spark, data).columns
    assert kept.count() == len(set(root.values()))


def test_near_fingerprints_over_many_shards(spark, monkeypatch):
    import random
    rng = random.Random(2)
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "LEAF", 8)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:80]]
    crowd = [base[0] ^ (1 << i) for i in range(64)]
    prints = sorted(set(base + near + crowd))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"))
    from outagelab.llm.components import connected_components
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = components(prints)
    mine = defaultdict(set)
    for p, s in zip(prints, signed):
        mine[got.get(s, s)].add(p)
    theirs = defaultdict(set)
    for p in prints:
        theirs[want[p]].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_of_nothing(spark):
    assert simhash.groups(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


# --- repeated passages

def test_substrings_of_long_texts_with_edits(spark):
    """A text of over a megabyte, its copy with a changed word every few thousand, a copy with other spaces, and a period."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    edited = [w if k % 3000 else "changed" for k, w in enumerate(base)]
    data = [(1, " ".join(base), "s"), (2, " ".join(edited), "s"), (3, "\n".join(base), "s"), (4, "du da " * 300, "s"),
            (5, "da du " * 200, "s"), (None, " ".join(base), "s")]
    first = {}
    for doc, text, _ in data[:5]:
        ws = spaced(text)
        for k in range(len(ws) - 49):
            first.setdefault(hash(tuple(ws[k:k + 50])), doc)
    expected = {None: 0}
    for doc, text, _ in data[:5]:
        ws, upto, lost = spaced(text), 0, 0
        for k in range(len(ws) - 49):
            if first[hash(tuple(ws[k:k + 50]))] < doc:
                lost += k + 50 - max(k, upto)
                upto = k + 50
        expected[doc] = lost
    got = substrings.find_repeats(documents(spark, data))
    assert {r.doc_id: r.n_removed for r in substrings.digest(got).collect()} == expected
    assert 0 < expected[2] < expected[3] == 200_000 and expected[4] == 0 < expected[5]


def test_joins_of_hot_keys(spark, monkeypatch):
    from outagelab.llm import common
    monkeypatch.setattr(common, "HOT", 10)
    rows_ = spark.createDataFrame([(k % 7 if k % 2 else 99, k) for k in range(200)] + [(None, 500), (1000, 501)], "k long, v long")
    counted = rows_.where("k < 1000").groupBy("k").count().withColumnRenamed("count", "n").withColumn("name", mix.F.col("k") + 1)
    for how, n in (("inner", 200), ("left", 202)):
        got = common.join_counted(rows_, counted, ["k"], how).collect()
        assert len(got) == n and all(r.name == (None if r.v >= 500 else r.k + 1) for r in got)


def test_substrings(spark):
    data = rows(n=90)
    first = {}
    for d, t, _ in data:
        ws = spaced(t)
        for i in range(len(ws) - 49):
            if d is not None:
                k = tuple(ws[i:i + 50])
                first[k] = min(d, first.get(k, d))
    expected = Counter()
    for d, t, _ in data:
        ws = spaced(t)
        keep = [True] * len(ws)
        for i in range(len(ws) - 49):
            if d is not None and first[tuple(ws[i:i + 50])] < d:
                keep[i:i + 50] = [False] * 50
        kept = [w for w, k in zip(ws, keep) if k]
        expected[d, len(ws), len(ws) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    docs = documents(spark, data)
    got = Counter(tuple(r) for r in substrings.digest(substrings.find_repeats(docs)).collect())
    assert got == expected and sum(k[2] > 0 for k in got) > 10
    cleaned = substrings.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(data)
    assert {(r.doc_id, len(spaced(r.text))) for r in cleaned.collect()} == {(k[0], k[1] - k[2]) for k in expected}
    assert substrings.find_repeats(empty(spark)).count() == 0


def test_suffixes(spark):
    data = rows(n=90)
    seen, expected = set(), {}
    order = sorted({(d, t) for d, t, _ in data}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for d, t in order:
        raw = (t or "").encode()
        keep = bytearray(b"\1" * len(raw))
        for i in range(len(raw) - 99):
            w = raw[i:i + 100]
            if w in seen:
                keep[i:i + 100] = bytes(100)
            seen.add(w)
        kept = bytes(c for c, k in zip(raw, keep) if k)
        spans = len(re.findall(b"\0+", bytes(keep)))
        expected[d, t] = (d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    docs = documents(spark, data)
    got = Counter(tuple(r) for r in suffixes.digest(suffixes.find_repeats(docs)).collect())
    assert got == Counter(expected[d, t] for d, t, _ in data) and sum(k[2] > 0 for k in got) > 10
    cleaned = suffixes.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(data)
    assert suffixes.find_repeats(empty(spark)).count() == 0


def test_suffixes_of_an_anchor_with_many_stretches(spark, monkeypatch):
    import random
    rng = random.Random(4)
    limit, seen, found = 2000, set(), []
    monkeypatch.setattr(suffixes, "ANCHOR_BYTES", limit, raising=False)
    sort = suffixes._sorted_shards
    monkeypatch.setattr(suffixes, "_sorted_shards", lambda s, n: found.append(
        max(r.n for r in s.groupBy("anchor").agg(suffixes.F.sum(suffixes.F.octet_length("text")).alias("n")).collect())) or sort(s, n))
    passage, tails = sentence(rng, 60), [sentence(rng, 9) for _ in range(3)]
    data = [(k, sentence(rng, 12) + (" " if k % 3 else tails[k % 5 % 3]) + passage + tails[k % 3][:k % 40] + sentence(rng, 12), "s")
            for k in range(80)]
    data += [(100 + k, "du " * (900 + k), "s") for k in range(3)] + [(200, "é" * 1500, "s"), (None, sentence(rng, 3) + passage, "s")]
    expected = set()
    for d, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw, keep = t.encode(), bytearray(b"\1" * len(t.encode()))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                keep[i:i + 100] = bytes(100)
            seen.add(raw[i:i + 100])
        kept = bytes(c for c, k in zip(raw, keep) if k)
        expected.add((d, len(raw), len(raw) - len(kept), len(re.findall(b"\0+", bytes(keep))), hashlib.sha256(kept).hexdigest()))
    got = suffixes.digest(suffixes.find_repeats(documents(spark, data))).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(data)
    assert 0 < found[0] <= limit


def test_induced_order():
    import random

    import numpy as np
    rng = random.Random(1)
    for t in range(120):
        text = np.array([rng.choice([1, 2, 3, 9]) for _ in range(rng.randint(1, 150))] + [0], np.uint16)
        depth = 300 if t % 2 else 8
        order = suffixes.induced_order(text, depth, 64 if t % 3 else 1 << 20)  # the small limit keeps the queue on disk
        found = [text[i:i + depth].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and found == sorted(found)


def test_induced_common_prefixes():
    import random

    import numpy as np
    rng = random.Random(2)
    for t in range(120):
        text = [rng.choice([[1, 2], [1, 2, 3, 9], [5]][t % 3]) for _ in range(rng.randint(1, 120))]
        text = np.array(text + text[:len(text) // 2] + text + [0], np.uint16)
        depth = 300 if t % 2 else 7
        order, common = suffixes.induced(text, depth, 64 if t % 4 else 1 << 20)
        found = [text[i:i + depth].tolist() for i in order]
        for before, after, n in zip(found, found[1:], common[1:].tolist()):
            assert before[:n] == after[:n] and (n == depth or before[n:n + 1] != after[n:n + 1])


def test_a_shard_larger_than_the_queue(monkeypatch):
    import random

    import numpy as np
    rng = random.Random(3)
    passages = [bytes(rng.choices(b"abcdefgh ", k=110)) for _ in range(3000)]
    texts = [bytes(rng.choices(b"abcdefgh ", k=30)) + rng.choice(passages) + bytes(rng.choices(b"abcdefgh ", k=20)) for _ in range(24_000)]
    spilled, push = [], suffixes.RunQueue.push

    def counted(queue, *args):
        push(queue, *args)
        spilled.append(queue.file is not None)
    monkeypatch.setattr(suffixes.RunQueue, "push", counted)
    got = suffixes.repeated_starts(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64), 100)
    seen, expected = set(), []
    for text in texts:
        windows = [text[i:i + 100] for i in range(len(text) - 99)]
        expected.append([i for i, w in enumerate(windows) if w in seen])
        seen.update(windows)
    assert [x.tolist() for x in got] == expected and sum(map(len, expected)) > 100_000 and any(spilled)


def test_stored_leaves_no_shuffle_files(spark):
    import glob
    import os
    import tempfile
    import time

    from pyspark.sql import functions as F

    from outagelab.llm.common import stored
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())

    def files():
        return {f for f in glob.glob(f"{root}/blockmgr-*/*/shuffle_*")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    spark.range(3000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    assert files() - before
    before = files()
    out = stored(spark.range(3000).groupBy((F.col("id") % 1000).alias("k")).count(), "counted")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name) == setting
    assert out.agg(F.count("k"), F.sum("count")).first() == (1000, 3000)


def test_memory_of_a_shard():
    import random
    import tracemalloc

    import numpy as np
    rng = random.Random(4)
    vocabulary = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(4000)]
    texts = [b" ".join(rng.choices(vocabulary, k=60)) for _ in range(3000)]
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        suffixes.repeated_starts(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64), 100)
        assert tracemalloc.get_traced_memory()[1] < 40 * size
    finally:
        tracemalloc.stop()


# --- lines

def test_lines(spark):
    data = rows(n=90)
    sites = defaultdict(set)
    for _, t, s in data:
        for line in (t or "").split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if bare:
                sites[bare].add(s)
    assert any(len(s) >= 3 for s in sites.values())
    expected = Counter()
    for d, t, _ in data:
        every = (t or "").split("\n")
        gone = [len(sites.get(x.strip(" \t\n\x0b\x0c\r"), ())) >= 3 for x in every]
        kept = "\n".join(x for x, g in zip(every, gone) if not g)
        expected[d, sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in every), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    docs = documents(spark, data)
    got = lines.digest(lines.remove_boilerplate(docs, min_sites=3))
    assert Counter(tuple(r) for r in got.collect()) == expected and sum(k[2] > 0 for k in expected) > 5
    assert lines.remove_boilerplate(empty(spark)).count() == 0


def test_site_spread_far_from_and_near_the_limit(spark):
    pairs = [((line, line), site) for line, n in ((1, 3), (2, 49), (3, 50), (4, 51), (5, 400)) for site in range(n)] * 2
    rows_ = spark.createDataFrame(pairs, "line struct<a:long,b:long>, site long")
    rows_ = rows_.withColumn("site", lines.F.xxhash64("site"))
    assert sorted(r.line.a for r in lines.boilerplate(rows_, 50).collect()) == [3, 4, 5]
