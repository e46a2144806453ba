"""Suffix-array dedup by external induced sorting.

A byte is removed if a string of ``length`` bytes covers it that also starts earlier (smaller id, or earlier in the same
document). Suffixes can only share that many bytes if they share an anchor, the least hash of the ``GRAM``-byte strings of
their first ``length`` bytes. Anchors therefore cut the corpus into shards that can be sorted apart: stretches of text with
an anchor of their own drop out, equal stretches are one, and only anchors with several different stretches are sorted.

An anchor may have any number of different stretches (a passage in many documents, with other text around it), or a very
long one (a text that repeats itself). Beyond ``ANCHOR_BYTES`` its windows are split by a second key that equal windows
share: the half of the anchor's possible offsets in the window, with the bytes that all windows of that half cover. Parts
that are still too large are halved again; at a single offset the key is the window itself, so every part gets small.

A shard is sorted by induction: the substrings between S* suffixes (those after a fall and before a rise) are sorted and
named, the names are ordered in pairs, fours and so on, then all falling (L) suffixes are induced from left to right and all
rising (S) suffixes from right to left. The sorter's priority queue keeps one first-in-first-out run of (suffix, common
prefix) tuples for each leading byte; runs move to disk when they outgrow their share of memory. The text and the finished
order of a shard are in memory, which the bounds on shards and anchors limit. Neighbours in the suffix order whose common
prefix has ``length`` bytes are repeats of each other.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard
from .common import KEY, TEXT, bucketed_stage, document_key, keyed, stored
from .substrings import BASES, Roller, least_of
from .tiles import shuffle_partitions

LENGTH = 100
GRAM = 32
SHARD_BYTES = 8 << 20     # text sorted at a time, but for the last anchor of a shard
ANCHOR_BYTES = 1 << 20    # different stretches of an anchor beyond this are split by a second key
QUEUE_BYTES = 8 << 20     # of a sorter's queue that stay in memory


class RunQueue:
    """Priority queue of suffixes by leading byte: a first-in-first-out run for each, on disk beyond a bound."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.runs: dict[int, list] = {}
        self.limit, self.held, self.file = limit, 0, None

    def push(self, byte: int, items: np.ndarray) -> None:
        self.held += items.nbytes
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()  # private to the task and gone with it
            at = self.file.seek(0, 2)
            self.file.write(items.tobytes())
            self.held -= items.nbytes
            self.runs.setdefault(byte, []).append((at, len(items)))
        else:
            self.runs.setdefault(byte, []).append(items)

    def push_all(self, bytes_: np.ndarray, items: np.ndarray) -> None:
        """Append each item to the run of its byte, in the order given."""
        if not len(items):
            return
        order = np.argsort(bytes_, kind="stable")
        b, items = bytes_[order], items[order]
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(b)]]).tolist()):
            self.push(int(b[lo]), items[lo:hi])

    def pop(self, byte: int) -> np.ndarray:
        """Everything in the run of a byte, in order."""
        parts = []
        for run in self.runs.pop(byte, ()):
            if isinstance(run, tuple):
                self.file.seek(run[0])
                parts.append(np.frombuffer(self.file.read(8 * run[1]), np.int64))
            else:
                self.held -= run.nbytes
                parts.append(run)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S); the last one is not."""
    n = len(text)
    rises = np.zeros(n, bool)
    # Equal neighbours take the type of the end of their stretch; one that reaches the end of the text falls.
    end = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    end = np.minimum.accumulate(end[::-1])[::-1]
    rises[:-1] = np.append(text[1:] > text[:-1], False)[end]
    return rises


def _fours(symbols: np.ndarray, order: str) -> np.ndarray:
    """For each place its symbol and the next three as one number, the first one in the lowest (``<``) or highest (``>``) bits.

    A view of two bytes a symbol: written out, the numbers of a shard would be the most of a sorter's memory.
    """
    held = symbols.astype(f"{order}u2")
    return np.ndarray((len(held) - 3,), f"{order}u8", held, strides=(2,))


def _common(text: np.ndarray, one: np.ndarray, other: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes, at most ``depth``."""
    out, todo = np.full(len(one), depth, np.int32), np.arange(len(one), dtype=np.int32)
    # Four symbols at a time, the first one in the lowest bits.
    words = _fours(np.concatenate([text, np.zeros(depth + 8, text.dtype)]), "<")
    for at in range(0, depth, 4):
        differ = (words[one[todo] + at] ^ words[other[todo] + at]).astype(np.uint64)
        ended = differ != 0
        bits = differ[ended]
        equal = sum((bits & np.uint64((1 << 16 * k) - 1) == 0).astype(np.int32) for k in (1, 2, 3))
        out[todo[ended]] = np.minimum(at + equal, depth)
        todo = todo[~ended]
        if not len(todo):
            break
    return out


def _ties(group: np.ndarray) -> np.ndarray:
    """Places that share their group with a neighbour."""
    tied = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    return tied


def _regrouped(todo: np.ndarray, new: np.ndarray) -> np.ndarray:
    return todo[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]


def _sort_stars(text: np.ndarray, rises: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """S* suffixes in the order of their first ``depth`` symbols, tied ones side by side.

    The substrings from each star to the next one are sorted and named; then the names are, in pairs, fours and so on,
    until ``depth`` symbols have a name.
    """
    n, m = len(text), len(stars)
    if m < 2:
        return stars
    # A symbol that falls is less than the same symbol that rises, so equal substrings end together; 0 stands beyond them.
    words = _fours(np.concatenate([text * 2 + rises + 1, np.zeros(depth + 8, text.dtype)]), ">")
    size = (np.append(stars[1:], n) + 1 - stars).astype(np.int32)   # the last one ends in the 0 behind the text
    order, group, todo = np.arange(m, dtype=np.int32), np.zeros(m, np.int32), np.arange(m, dtype=np.int32)
    for at in range(0, depth, 4):
        star = order[todo]
        over = np.clip(4 - (size[star] - at), 0, 3).astype(np.uint64) * np.uint64(16)
        word = words[stars[star] + at].astype(np.uint64) >> over << over
        by = np.lexsort((word, group[todo])) if at else np.argsort(word, kind="stable")
        star, word, g = star[by], word[by], group[todo][by]
        order[todo] = star
        group[todo] = _regrouped(todo, np.concatenate([[True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])]))
        todo = todo[_ties(group[todo]) & (size[star] - at > 4)]
        if not len(todo):
            break
    name = np.empty(m, np.int32)
    name[order] = group
    todo, named = np.flatnonzero(_ties(group)), 1
    while len(todo) and 2 * named < depth:   # a substring goes two symbols ahead at least
        star = order[todo]
        second = np.where(star + named < m, name[np.minimum(star + named, m - 1)] + 1, 0)
        pair = group[todo].astype(np.int64) * (m + 1) + second
        by = np.argsort(pair, kind="stable")
        star, pair = star[by], pair[by]
        order[todo] = star
        group[todo] = _regrouped(todo, np.concatenate([[True], pair[1:] != pair[:-1]]))
        name[star] = group[todo]
        todo, named = todo[_ties(group[todo])], 2 * named
    return stars[order]


SUFFIX = 1 << 24   # a tuple in the queue: the suffix times this, plus the length it shares with the one before it


def induced(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols below 32,767) ordered by their first ``depth`` symbols, and the number of symbols, at most
    ``depth``, that each shares with the one before it."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32)
    rises = _rising(text)
    stars = _sort_stars(text, rises, np.flatnonzero(rises[1:] & ~rises[:-1]) + 1, depth + 4)
    shared = np.zeros(len(stars), np.int64)
    shared[1:] = _common(text, stars[1:], stars[:-1], depth)
    symbols = np.unique(text).tolist()
    seeds, falling, found = RunQueue(limit), RunQueue(limit), {}
    seeds.push_all(text[stars], stars * SUFFIX + shared)

    def induce(queue: RunQueue, least: np.ndarray, items: np.ndarray, want: bool) -> None:
        """Queue the suffixes before these; two of one symbol share a symbol more than the least that is shared between their
        sources. ``least`` holds that for each symbol since its last suffix, -1 before its first."""
        if not len(items):
            return
        suffixes, common = items // SUFFIX, items % SUFFIX
        at = np.flatnonzero((suffixes > 0) & (rises[suffixes - 1] == want))
        before = suffixes[at] - 1
        by = np.argsort(text[before], kind="stable")
        at, before = at[by], before[by]
        symbol = text[before]
        to_end = np.minimum.accumulate(np.append(common, depth)[::-1])[::-1]
        running = np.where(least < 0, -1, np.minimum(least, to_end[0]))
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            since = np.concatenate([[0], at[:-1] + 1])
            since[first] = 0
            between = np.minimum.reduceat(np.append(common, depth), np.stack([since, at + 1], axis=1).ravel())[::2]
            own = symbol[first]
            between[first] = np.minimum(between[first], np.where(least[own] < 0, depth, least[own]))
            value = np.minimum(between + 1, depth)
            value[first[least[own] < 0]] = 0
            queue.push_all(symbol, before * SUFFIX + value)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            running[own] = to_end[at[last] + 1]
        least[:] = running

    def joined(items: np.ndarray, previous: int | None) -> np.ndarray:
        """The items, the first one with what it shares with the suffix before."""
        if len(items):
            one = int(items[0] // SUFFIX)
            items = items.copy()
            items[0] = one * SUFFIX
            if previous is not None:
                a, b = text[one:one + depth], text[previous:previous + depth]
                k = min(len(a), len(b))
                differ = np.flatnonzero(a[:k] != b[:k])
                items[0] += int(differ[0]) if len(differ) else k
        return items

    # Left to right: the last suffix starts it, then each byte's falling suffixes and its S* suffixes.
    least = np.full(max(symbols) + 1, -1, np.int64)
    falling.push(int(text[n - 1]), np.array([(n - 1) * SUFFIX]))
    least[text[n - 1]] = 0
    for symbol in symbols:
        parts = []
        while len(part := falling.pop(symbol)):
            parts.append(part)
            induce(falling, least, part, False)
        found[symbol] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        previous = int(found[symbol][-1] // SUFFIX) if parts else None
        induce(falling, least, joined(seeds.pop(symbol), previous), False)
    # Right to left: each byte's rising suffixes, largest first, then its falling ones.
    rising, out = RunQueue(limit), []
    least = np.full(max(symbols) + 1, -1, np.int64)
    for symbol in reversed(symbols):
        parts = []
        while len(part := rising.pop(symbol)):
            parts.append(part)
            induce(rising, least, part, True)
        down = found.pop(symbol)[::-1]
        # Backwards, each one shares with the one before it what that one shared with it.
        down = down - down % SUFFIX + np.concatenate([[0], down[:-1] % SUFFIX])[:len(down)]
        down = joined(down, int(parts[-1][-1] // SUFFIX) if parts else None)
        induce(rising, least, down, True)
        out += parts + [down]
    # The parts are in reverse: each suffix comes before the one whose shared length it holds. They go as they are copied.
    order, common, at = np.empty(n, np.int32), np.zeros(n + 1, np.int32), n
    out.reverse()
    while out:
        part = out.pop()[::-1]
        order[at - len(part):at] = part // SUFFIX
        common[at - len(part) + 1:at + 1] = part % SUFFIX
        at -= len(part)
    return order, common[:n]


def induced_order(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    return induced(text, depth, limit)[0]


def repeated_starts(texts: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch the offsets whose ``length`` bytes also start earlier, by (owner, start), in any stretch.

    Owners are ranks, starts below 2 ** 40.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    first = ends - sizes - 1
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    text[first + sizes] = 0
    order, common = induced(text, length)
    total = len(text)
    del text
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    whole = ((first + sizes).astype(np.int32)[piece] - np.arange(total, dtype=np.int32) >= length)[order]
    order, common = order[whole], common[whole]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in texts]
    # Suffixes between two equal windows are equal too, so a window's neighbour is never left out.
    lead = common < length
    lead[0] = True
    place = (owners.astype(np.int64) * (1 << 40) + starts - first)[piece[order]]
    place += order
    del piece, whole, common
    lead = np.flatnonzero(lead)
    earliest = np.repeat(np.minimum.reduceat(place, lead), np.diff(np.append(lead, len(order))))
    hit = np.sort(order[place != earliest])
    cuts = np.searchsorted(hit, np.append(first, total))
    return [hit[a:b] - f for a, b, f in zip(cuts, cuts[1:], first)]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Anchorer:
    """Anchors of a text: hashes of its grams, the least one of each window, and where least ones stand."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.span = length - self.gram + 1
        self.roll, self.second = Roller(BASES[0]), Roller(BASES[1])
        rng = np.random.default_rng(9)
        self.codes = rng.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64)

    def grams(self, raw: bytes) -> np.ndarray:
        return self.roll(self.codes[0][np.frombuffer(raw, np.uint8)], self.gram)

    def least(self, grams: np.ndarray) -> np.ndarray:
        return least_of(grams, self.span)

    def places(self, grams: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Positions of grams that are least in some window."""
        edge = np.zeros(self.span - 1, np.uint64)
        most = ~least_of(~np.concatenate([edge, least, edge]), self.span)
        return np.flatnonzero(grams == most)

    def runs(self, raw: bytes, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Stretches of windows with one shared anchor: anchor, start, windows, whether the anchor stands there twice, and
        two hashes of the stretch's bytes."""
        g = self.grams(raw)
        low = self.least(g)
        new = np.concatenate([[True], low[1:] != low[:-1]])
        start = np.flatnonzero(new)
        count = np.diff(np.concatenate([start, [len(low)]]))
        value = low[start]
        keep = np.isin(value, shared)
        start, count, value = start[keep], count[keep], value[keep]
        at = self.places(g, low)
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + count + self.span - 1)
        width = hi - lo
        idx = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        equal = (g[at[idx]] == np.repeat(value, width)).astype(np.int64)
        owner = np.repeat(np.arange(len(start)), width)
        twice = np.bincount(owner, equal, minlength=len(start)) > 1
        codes = np.frombuffer(raw, np.uint8)
        stop = start + count + self.length - 1
        return (value, start, count, twice, _span_hash(self.roll, self.codes[0][codes], start, stop),
                _span_hash(self.second, self.codes[1][codes], start, stop))


def _span_hash(roller: Roller, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if len(roller.up) < len(values):
        roller(values, 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * roller.up[:len(values)], out=sums[1:])
    return (sums[stop] - sums[start]) * roller.down[start]


def _summary(source: DataFrame, length: int) -> DataFrame:
    """Per row: bytes, digest of the text, and the anchors as often as they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Anchorer(length)
        for batch in batches:
            sizes, digests, lists = [], [], []
            for text in batch.column(1):
                raw = _raw(text.as_py())
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                if len(raw) >= length:
                    g = worker.grams(raw)
                    lists.append(g[worker.places(g, worker.least(g))].view(np.int64))
                else:
                    lists.append(np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[KEY, "n_bytes", "digest", "anchors"])

    kind = source.schema[KEY].dataType.simpleString()
    return source.mapInArrow(run, f"{KEY} {kind}, n_bytes long, digest string, anchors array<long>")


def _stretches(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Anchorer(length)
        for batch in batches:
            rows, parts = [], []
            for k in range(batch.num_rows):
                raw = _raw(batch.column(1)[k].as_py())
                if len(raw) < length:
                    continue
                found = worker.runs(raw, np.asarray(batch.column(2)[k].values).view(np.uint64))
                rows.append(np.full(len(found[0]), k))
                parts.append(found)
            if rows and sum(map(len, rows)):
                value, start, count, twice, a, b = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(value.view(np.int64)), pa.array(start),
                     pa.array(count), pa.array(twice), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    names=[KEY, "anchor", "start", "windows", "twice", "h1", "h2"])

    kind = texts.schema[KEY].dataType.simpleString()
    return texts.mapInArrow(run, f"{KEY} {kind}, anchor long, start long, windows long, twice boolean, h1 long, h2 long")


def _sorted_shards(stretches: DataFrame, length: int) -> DataFrame:
    """(key, start, windows) of repeated windows found by sorting the stretches of each anchor."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(KEY).combine_chunks()
        owner = pd.DataFrame({"i": keys.field("id").to_pandas(), "h": keys.field("hash").to_pandas()})
        owners = owner.sort_values(["i", "h"], na_position="first", kind="stable")
        new = (owners["i"].ne(owners["i"].shift()) & ~(owners["i"].isna() & owners["i"].shift().isna())
               | owners["h"].ne(owners["h"].shift()))
        rank = np.empty(len(owner), np.int64)
        rank[owners.index.to_numpy()] = new.cumsum().to_numpy()
        starts = table.column("start").to_numpy()
        found = repeated_starts([x.as_py() for x in table.column("text")], rank, starts, length)
        rows, first, windows = [], [], []
        for k, at in enumerate(found):
            if len(at):
                cut = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1, [len(at)]])
                rows += [k] * (len(cut) - 1)
                first.append(starts[k] + at[cut[:-1]])
                windows.append(np.diff(cut))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(np.concatenate(first)),
                                           pa.array(np.concatenate(windows))], names=[KEY, "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Cut only between anchors: the first rows of a batch may belong to the last anchor.
            anchor = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), batch.num_rows]
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(3)).to_numpy())])
            lo = 0
            for a, b in zip(cuts, cuts[1:]):
                if size > SHARD_BYTES and anchor[a] != last:
                    if a > lo:
                        held.append(batch.slice(lo, a - lo))
                    out = work(held)
                    if out is not None:
                        yield out
                    held, size, lo = [], 0, a
                size += int(upto[b] - upto[a])
                last = anchor[a]
            held.append(batch.slice(lo))
        if held:
            out = work(held)
            if out is not None:
                yield out

    kind = stretches.schema[KEY].dataType.simpleString()
    dealt = stretches.repartition(shuffle_partitions(stretches), "anchor").sortWithinPartitions("anchor")
    return dealt.select(KEY, "anchor", "start", "text").mapInArrow(run, f"{KEY} {kind}, start long, windows long")


def _cut_out(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """Bytes of the chosen stretches (anchor, key, start, windows)."""
    picked = chosen.groupBy(KEY).agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchor, start, text = [], [], [], []
            for k in range(batch.num_rows):
                raw = _raw(batch.column(1)[k].as_py())
                for p in batch.column(2)[k].as_py():
                    rows.append(k)
                    anchor.append(p["anchor"])
                    start.append(p["start"])
                    text.append(raw[p["start"]:p["start"] + p["windows"] + length - 1])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(anchor, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(text, pa.binary())], names=[KEY, "anchor", "start", "text"])

    kind = texts.schema[KEY].dataType.simpleString()
    return texts.select(KEY, TEXT).join(picked, KEY).mapInArrow(run, f"{KEY} {kind}, anchor long, start long, text binary")


PIECE = ["anchor", "start", "at", "lo", "hi", "text"]


def _units(stretches: DataFrame, length: int) -> DataFrame:
    """The windows of each stretch by the place where their anchor first stands: ``at`` is its offset in the first window,
    ``lo`` and ``hi`` (exclusive) bound the offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Anchorer(length)
        for batch in batches:
            for k in range(batch.num_rows):
                raw, anchor, start = batch.column(3)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                places = np.flatnonzero(worker.grams(raw).view(np.int64) == anchor)
                windows = np.arange(len(raw) - length + 1)
                where = np.searchsorted(places, windows)
                cuts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(windows)]])
                for first in range(0, len(cuts) - 1, 10_000):  # a long text has many
                    lo, hi = cuts[:-1][first:first + 10_000], cuts[1:][first:first + 10_000]
                    n = len(lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(n, k))), pa.array(np.full(n, anchor)), pa.array(start + lo),
                         pa.array(places[where[lo]] - lo), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, worker.span)),
                         pa.array([raw[a:b + length - 1] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())],
                        names=[KEY, *PIECE])

    kind = stretches.schema[KEY].dataType.simpleString()
    return stretches.mapInArrow(run, f"{KEY} {kind}, anchor long, start long, at long, lo long, hi long, text binary")


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece's windows by the half of its offsets they belong to.

    ``anchor`` becomes a hash of the anchor, the half and the bytes that all windows of that half cover; ``h1`` and ``h2``
    hash the piece's bytes.
    """
    gram = min(GRAM, length)
    span = length - gram + 1

    def digest_of(raw: bytes, *numbers: int) -> hashlib.blake2b:
        return hashlib.blake2b(b"".join(n.to_bytes(8, "little", signed=True) for n in numbers) + raw, digest_size=16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in PIECE]
            for k, (anchor, start, at, lo, hi, raw) in enumerate(zip(*cols)):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid, hi)):
                    first, last = max(0, at - b + 1), min(len(raw) - length, at - a)
                    if first > last:
                        continue
                    shared = digest_of(raw[at - a:at + gram + span - b], anchor, a, b).digest()
                    part = raw[first:last + length]
                    own = digest_of(part).digest()
                    rows.append(k)
                    out.append((int.from_bytes(shared[:8], "little", signed=True), start + first, at - first, a, b, part,
                                int.from_bytes(own[:8], "little", signed=True), int.from_bytes(own[8:], "little", signed=True)))
            if rows:
                *numbers, text, h1, h2 = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(x, pa.int64()) for x in numbers], pa.array(text, pa.binary()),
                     pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=[KEY, *PIECE, "h1", "h2"])

    kind = pieces.schema[KEY].dataType.simpleString()
    return pieces.select(KEY, *PIECE).mapInArrow(
        run, f"{KEY} {kind}, anchor long, start long, at long, lo long, hi long, text binary, h1 long, h2 long")


def _split_anchors(stretches: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Large anchors' stretches as pieces (key, anchor, start, text) of bounded anchors, and (key, start, windows) of pieces
    that are copies of earlier ones."""
    rows, small, copied = _halved(_units(stretches, length), length), [], []
    span = length - min(GRAM, length) + 1
    for _ in range(max(1, (span - 1).bit_length())):
        rows = stored(rows, "suffix-pieces")
        same = stored(rows.groupBy("anchor", "h1", "h2").agg(
            F.min(F.struct(KEY, "start", "at", "lo", "hi", "text")).alias("first")), "suffix-piece-classes")
        lead = same.select("anchor", "h1", "h2", F.struct(f"first.{KEY}", "first.start").alias("lead"))
        copied.append(rows.join(lead, ["anchor", "h1", "h2"]).where(F.struct(KEY, "start") != F.col("lead")).select(
            KEY, "start", (F.octet_length("text") - (length - 1)).cast("long").alias("windows")))
        firsts = same.select("anchor", "first.*")
        groups = stored(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
                       .where("n > 1"), "suffix-piece-groups")
        small.append(firsts.join(groups.where(F.col("bytes") <= ANCHOR_BYTES), "anchor").select(KEY, "anchor", "start", "text"))
        large = groups.where(F.col("bytes") > ANCHOR_BYTES).select("anchor")
        if large.isEmpty():
            break
        rows = _halved(firsts.join(large, "anchor"), length)
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, copied)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document row: key, ``n_bytes``, ``spans`` (removed bytes, end exclusive), ``n_removed``, ``kept_sha256``.

    Texts are UTF-8 bytes and never run into each other; a null text is empty; texts shorter than ``length`` lose nothing.
    Documents are ordered by id (null first), rows of equal id by a hash of the text; repeated rows are one document.
    """
    source = keyed(docs, id_col, text_col)
    kind = source.schema[KEY].dataType.simpleString()
    summary = stored(_summary(source, length), "suffix-anchors")
    # A whole copy goes whole; only first copies are looked into.
    firsts = summary.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min(KEY).alias("first"))
    marked = stored(summary.drop("anchors").join(firsts, "digest", "left"), "suffix-copies")
    originals = firsts.select(F.col("first").alias(KEY))
    marks = summary.join(originals, KEY).select(KEY, F.explode("anchors").alias("anchor"))
    shared = marks.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = stored(marks.join(shared, "anchor").groupBy(KEY).agg(F.collect_set("anchor").alias("shared")), "suffix-shared")
    discard(summary)
    # Later steps join the texts by key again and again: in buckets they are shuffled once.
    texts, bucketed = bucketed_stage(source.join(wanted, KEY).select(KEY, TEXT, "shared").dropDuplicates([KEY]), "suffix-texts", KEY)
    discard(wanted)
    runs = stored(_stretches(texts, length), "suffix-stretches")
    place = F.struct(KEY, "start")
    same = stored(runs.groupBy("anchor", "h1", "h2").agg(
        F.min(place).alias("first"), F.max("twice").alias("twice"), F.max("windows").alias("windows")), "suffix-classes")
    copied = runs.join(same.drop("windows"), ["anchor", "h1", "h2"]).where(place != F.col("first")).select(KEY, "start", "windows")
    several = stored(same.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.sum(F.col("windows") + (length - 1)).alias("bytes")).where(
        "n > 1 or twice").select("anchor", "bytes"), "suffix-several")
    chosen = same.join(several, "anchor").select(
        "anchor", "bytes", F.col(f"first.{KEY}").alias(KEY), F.col("first.start").alias("start"), "windows")
    stretches = _cut_out(texts, chosen.where(F.col("bytes") <= ANCHOR_BYTES), length)
    if not several.where(F.col("bytes") > ANCHOR_BYTES).isEmpty():
        pieces, again = _split_anchors(_cut_out(texts, chosen.where(F.col("bytes") > ANCHOR_BYTES), length), length)
        stretches, copied = stretches.unionByName(pieces), copied.unionByName(again)
    repeats = _sorted_shards(stretches, length).unionByName(copied)
    removed = stored(repeats.groupBy(KEY).agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "suffix-removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts, digests = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = _raw(text.as_py())
                ends = sorted((r["start"], r["start"] + r["windows"] + length - 1) for r in found.as_py())
                merged: list[list[int]] = []
                for a, b in ends:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                spans.append([{"start": a, "end": b} for a, b in merged])
                counts.append(sum(b - a for a, b in merged))
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=[KEY, "spans", "n_removed", "kept"])

    span_type = "array<struct<start:bigint,end:bigint>>"
    cuts = stored(texts.select(KEY, TEXT).join(removed, KEY).mapInArrow(
        cut, f"{KEY} {kind}, spans {span_type}, n_removed long, kept string"), "suffix-cuts")
    discard(runs, texts, same, removed)
    docs.sparkSession.sql(f"drop table {bucketed}")
    whole = F.coalesce(F.col("first") != F.col(KEY), F.lit(False))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return marked.join(cuts, KEY, "left").select(
        KEY, "n_bytes",
        F.when(whole, everything).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {span_type})"))).alias("spans"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"))


def digest(repeats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return repeats.select(F.col(KEY)["id"].alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                          "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with all their columns, repeated bytes cut out; characters that were cut in two are replaced by U+FFFD."""
    spans = find_repeats(docs, id_col, text_col, length).where("n_removed > 0").select(KEY, F.col("spans").alias("__spans"))

    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, parts in zip(texts, found):
            raw, kept, at = _raw(text), [], 0
            for p in parts:
                kept.append(raw[at:p["start"]])
                at = p["end"]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(KEY, document_key(id_col, text_col)).join(spans.dropDuplicates([KEY]), KEY, "left")
    parts = F.coalesce("__spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.pandas_udf(cut, "string")(F.col(text_col), parts))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
