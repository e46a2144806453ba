"""Exact dedup, manifest and prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from outagelab.llm import exact, manifest, ordered, trie

from .corpus import documents, empty, rows


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be merged into one range otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- positions and running totals

def test_positions_and_totals_carry_over_ranges(spark):
    data = [(g, k, k % 5) for g, n in (("a", 700), ("b", 1), ("c", 90)) for k in range(n)] + [("c", 7, 3)]
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "g string, k long, v long").repartition(6)
    stored = ordered.in_order(df, ["g"], ["k"], "test")
    assert stored.select(ordered.ROW).distinct().count() == len(data)
    assert stored.select((stored[ordered.ROW] / (1 << ordered.RANGE_BITS)).cast("int")).distinct().count() > 1
    placed = ordered.positions(stored, ["g"]).collect()
    for g in "abc":
        own = sorted((r.pos, r.k) for r in placed if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r.size for r in placed if r.g == g} == {len(own)}
    totals = ordered.running(stored.where("g <> 'c' or k <> 7"), ["g"], ["v"]).collect()
    for g in "ab":
        own = sorted((r.k, r.v) for r in totals if r.g == g)
        assert own == [(k, sum(i % 5 for i in range(k + 1))) for k, _ in own]


# --- exact dedup

def plain_groups(data):
    groups = defaultdict(list)
    for doc, text, _ in data:
        groups[text or ""].append(-1 if doc is None else doc)
    return groups


def test_exact_dedup(spark):
    data = rows() + [(500, "x" * 3_000_000, "s"), (501, "x" * 2_999_999 + "y", "s"), (502, "x" * 3_000_000, "s"), (None, "word", "s")]
    groups = plain_groups(data)
    got = exact.mark(documents(spark, data), digests=True).collect()
    expected = Counter((doc, max(groups[text or ""]), len(groups[text or ""]), sha(text or "")) for doc, text, _ in data)
    assert Counter((r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    stays = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and set(stays) == {sha(t) for t in groups}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.deduplicate(documents(spark, data)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept) == sorted((max(g), t) for t, g in groups.items())
    assert kept[0].hash == 7 and exact.mark(empty(spark)).count() == 0 and exact.deduplicate(empty(spark)).count() == 0


def test_exact_dedup_hashes_whole_texts_of_survivors_only(spark):
    start = "the same beginning of sixty-four characters or somewhat more than that: "
    data = [(1, start + "a", "s"), (2, start + "b", "s"), (3, start + "longer", "s"), (4, "other beginning, same length".ljust(len(start) + 1), "s")]
    got = {r.doc_id: r.survives for r in exact.survivors(documents(spark, data), "text", F.col("doc_id")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_exact_dedup_without_shared_slots(spark, monkeypatch):
    monkeypatch.setattr(exact, "SLOTS", 2)      # every slot is shared: more hashes, the same groups
    data = rows()
    sizes = {r.doc_id: r.group_size for r in exact.mark(documents(spark, data)).collect()}
    groups = plain_groups(data)
    assert sizes == {doc: len(groups[text or ""]) for doc, text, _ in data}


# --- manifest

def h(*parts):
    return sha("".join(parts))


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def plain_levels(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, place, arity):
    for level in levels[:-1]:
        start = place - place % arity
        yield "".join(level[start:place]), "".join(level[place + 1:start + arity])
        place //= arity


def plain_manifest(data, arity=8):
    """data: (doc_id, text, lang, source, n_chars)"""
    groups = defaultdict(list)
    for row in data:
        groups[row[2]].append((-1 if row[0] is None else row[0], leaf(row, row[1]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for place, (_, digest, row) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            path = [*siblings(trees[g], place, arity), *siblings(top, k, arity)]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], digest, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in path]), folded, folded == top[-1][0]))
    return Counter(out)


def manifest_rows(n=150):
    rng = random.Random(5)
    langs = ["en"] * 6 + ["de", "fr", None, "", "é", "zz", "a1", "a2", "a3", "a4", "a5"]
    data = [(k, rng.choice([None, "", "Abc déf É", "lower only", "X" * rng.randint(1, 40), "Y" * 9000]), rng.choice(langs), rng.choice([None, "s", "t"]),
             rng.choice([None, 3, 70])) for k in range(n)]
    return data + [(None, "No Id", "en", "s", 1), data[3], data[3], (7, "Same Id", data[7][2], "s", 1), (999, "alone", "only", None, None)]


@pytest.mark.parametrize("arity", [8])
def test_manifest(spark, arity):
    data = manifest_rows()
    wide = "doc_id long, text string, lang string, source string, n_chars long, digest int, size int, idx int, tree int, path string"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, "p") for r in data], wide).repartition(5)
    got = Counter(tuple(r) for r in manifest.tampered_proofs(docs).collect())
    assert got == plain_manifest(data, arity)
    assert 0 < sum(n for row, n in got.items() if not row[-1]) < len(data)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(4, "Text", None, None, None)]
    assert Counter(map(tuple, manifest.tampered_proofs(spark.createDataFrame(one, schema)).collect())) == plain_manifest(one)
    assert manifest.tampered_proofs(spark.createDataFrame([], schema)).count() == 0


def test_binary_manifest_has_a_root_over_all_levels(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(21)], "doc_id long, text string")
    tree = manifest.build(docs, F.lit("all"), F.col("doc_id"), manifest.leaf([F.col("text")]), arity=2)
    levels = plain_levels([h(f"{len(f't{k}')}:t{k}") for k in range(21)], 2)
    assert tree.root.first().root == levels[-1][0] and len(tree.levels) == len(levels)
    proofs = tree.proofs().select((manifest.fold(F.col("digest"), F.col("path")) == F.col("root")).alias("ok"))
    assert proofs.count() == 21 and proofs.where("not ok").count() == 0


# --- prefix trie

CHATS = "conv_id long, turn long, role string, text string, pos int, d int, n int, k1 string, words string"


def plain_rebuilt(data):
    own = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            own[conv].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        n = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:n] + own[c][n:]
    return out


def plain_trie(convs):
    """convs: {id: [(role, text), ...]}"""
    nodes = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    below = defaultdict(lambda: [0, 0])
    for p, members in nodes.items():
        saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in kids
            below[p[:d]][1] += saved
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], *below[p], sha(ends)))
    return Counter(out)


def chats(spark, data, partitions=4):
    return spark.createDataFrame([(*r, 1, 1, 1, "x", "y") for r in data], CHATS).repartition(partitions)


def chat_rows():
    rng = random.Random(4)
    data = []
    for c in [*range(0, 130), 205, -3, -40, 1000]:
        for turn in range(rng.randint(1, 6)):
            data.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["hi", "hello there", "a b\tc", "ü d"])))
    data += [(300, k, "user", f"turn {k}") for k in range(400)] + [(301, k, "user", f"turn {k}") for k in range(300)]   # long, shared
    data += [(400 + k, t, "user", f"copy {t}") for k in range(60) for t in range(5)]                                    # copies
    data += [(7, None, None, "first"), (9, 0, "user", None), (None, 1, "user", "nobody"), (11, 1, "user", "same"), (11, 1, "user", "same")]
    data += [(610, 2, "bot", "word " * 200_000), (609, 2, "bot", "word " * 200_000)]
    return data


@pytest.mark.parametrize("light,limit", [(trie.LIGHT, 1000), (2, 1)])
def test_prefix_trie(spark, light, limit):
    data = chat_rows()
    # equal turn numbers follow their hashes, which the plain version does not know
    data = [r for k, r in enumerate(data) if (r[0], r[1]) not in {(x[0], x[1]) for x in data[:k]} or r[0] == 11 and r[3] == "same"]
    data = [r for r in data if not (r[0] == 11 and r[1] == 1 and r[3] != "same")]
    given = trie.sequences(chats(spark, data))
    assert Counter(map(tuple, trie.prefix_trie(trie.rebuilt(given), light, limit).collect())) == plain_trie(plain_rebuilt(data))


def test_prefix_trie_of_plain_conversations(spark):
    data = [(c, t, "user", f"{c % (t + 1)}") for c in range(40) for t in range(c % 7 + 1)]
    convs = defaultdict(list)
    for c, _, role, text in data:
        convs[c].append((role, text))
    assert Counter(map(tuple, trie.prefix_trie(trie.sequences(chats(spark, data)), 1, 2).collect())) == plain_trie(convs)


def test_prefix_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(chats(spark, [(None, 1, "user", "x")])))).count() == 0
    conv = next(c for c in range(1, 500) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    alone = [(conv, 0, "user", "x")]
    assert Counter(map(tuple, trie.prefix_trie(trie.rebuilt(trie.sequences(chats(spark, alone)))).collect())) == plain_trie({conv: []})


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_spilling_queue(limit):
    rng = random.Random(limit)
    queue, plain = trie.SpillingQueue(2, 3, limit), defaultdict(list)
    for k in range(3000):
        key = (rng.randint(0, 40), rng.randint(0, 3))
        queue.push((*key, k))
        plain[key].append((k,))
    assert (queue.spilled > 0) == (limit < 3000) and len(queue.runs) <= trie.FAN + 1
    for key in sorted(plain):
        assert sorted(queue.take(key)) == plain[key]
    assert len(queue) == 0 and list(queue.take((1, 1))) == []
