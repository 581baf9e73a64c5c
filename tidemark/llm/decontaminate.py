"""Benchmark decontamination by edit distance, through CGK embeddings and bit-sampling LSH.

Texts are words (ASCII letters, digits and all other alphabets; lower-cased A-Z). An item leaks into a document
where some stretch of the document is within `SHARE` of the item's length in word edits; items of fewer than
five words allow no edit, so they leak where they stand word for word.

The CGK embedding walks a string with shared random bits: at each step it emits the current word and then,
by the bit for that step and word, moves on or stays. Strings a few edits apart emit sequences that
differ in few places, so edit distance becomes Hamming distance, and sampled places of the sequences are
an LSH key. A walk of `STEPS` steps (fewer for items of fewer words) is made from every word of an item and from every
word of a document that could lie in a copy; `REPEATS` walks give `KEYS` samples each. Since walks start
all over an item, wherever its edits are some walks lie between them: see `recall()`. A shared key names an item and where it
would begin; around each such place the exact edit distance of every stretch is worked out.

Before the walk, words are dropped that cannot lie in a copy, by the q-gram lemma: a stretch within k edits of an
item of w words shares at least w - 1 - 2k of its word pairs. That bound is exact, so it loses nothing.

Words are found and hashed in numpy, over all bytes of some texts at once; the words of places that get a verdict are
compared as bytes, so a collision of hashes makes no leak. `AT_ONCE` bytes of texts bound what a worker holds.

Items are a stated query set. They go to the workers in blocks of at most `BLOCK_WORDS` words; more items
than one block holds mean more passes, one block on the driver at a time, not larger broadcasts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SHARE = 0.2
STEPS, REPEATS, KEYS, SAMPLES, SEED = 8, 2, 4, 3, 5
BLOCK_WORDS = 200_000
#: Bytes of text that a task looks at together, or one text if that is longer.
AT_ONCE = 1 << 20
#: Item sizes in words from which a class starts: the q-gram bound is tried for a class before its sizes.
CLASSES = (1, 2, 3, 4, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450)
SPLIT = bytes(x if 48 <= x < 58 or 97 <= x < 123 or x >= 128 else x + 32 if 65 <= x < 91 else 32 for x in range(256))
#: Odd, so that its powers have inverses modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15


def plain(text: str | None) -> bytes:
    """The text's bytes, lower-cased, with spaces for whatever isn't in a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(SPLIT)


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


def allowed(size: int) -> int:
    """Word edits within which a stretch counts as an item of so many words."""
    return int(SHARE * size)


def least(size: int) -> int:
    """Word pairs that whatever is within the allowed edits of an item of so many words shares with it."""
    return size - 1 - 2 * allowed(size)


def edit_distance(a: list, b: list, most: int) -> tuple[int, int]:
    """The least edits from a to a prefix of b, and that prefix's length; more than `most` where there is none within it."""
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        first, until = max(1, i - most), min(len(b), i + most)
        if first - 1 > len(b):
            return far, 0
        last, left = row[first - 1], far  # only this band can hold distances of up to `most`
        row[first - 1] = left = i if first == 1 and i <= most else far
        low = left
        for j in range(first, until + 1):
            up = row[j] if j < i + most else far
            cost = last if x == b[j - 1] else 1 + (last if last <= up and last <= left else up if up <= left else left)
            last, row[j], left = row[j], cost, cost
            if cost < low:
                low = cost
        if low > most:
            return far, 0
    until = range(max(0, len(a) - most), min(len(b), len(a) + most) + 1)
    best = min(until, key=lambda j: (row[j], abs(j - len(a)), j))
    return row[best], best


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least edits between the item and any stretch of words, and the first place where such a stretch starts."""
    unit = len(words) + 1  # a cell is edits * unit + start
    row = np.arange(unit, dtype=np.int64)
    steps = row * unit
    for x in item:
        new = row + unit
        np.minimum(new[1:], row[:-1] + np.where(words == x, 0, unit), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return divmod(int(row.min()), unit)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer, for random bits and keys that all workers share."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of FACTOR and of its inverse modulo 2 ** 64, the first n and more; kept for the usual size, made anew beyond."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * AT_ONCE)
        up, down = (np.full(size, f, np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 2 * AT_ONCE:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in plain bytes, and its hash: a polynomial of its bytes, from running sums over all."""
    x = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(x) + 2, bool)
    np.not_equal(x, 32, out=inside[1:-1])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts], 17)


def walks(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, step): words that walks from each start emit, and where those stand. Past the end of its text a walk emits -1."""
    words, places = np.empty((len(starts), steps), np.int64), np.empty((len(starts), steps), np.int64)
    at, last = starts.copy(), len(ids) - 1
    for k in range(steps):
        words[:, k] = own = np.where(at < ends, ids[np.minimum(at, last)], -1)
        places[:, k] = at
        at += (mix(own.astype(np.uint64), SEED + 1 + repeat * 1_000_003 + k) & np.uint64(1)).astype(np.int64)
    return words, places


def keys_of(words: np.ndarray, places: np.ndarray, steps: int, repeat: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """KEYS times: the walks whose sampled places tell something, and hashes of those places. Samples of unknown words, or
    of one word alone where longer walks are made, tell nothing."""
    rng = np.random.default_rng((SEED, steps, repeat))
    for k in range(KEYS):
        at = np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))
        own = np.nonzero((words[:, at] >= 0).all(axis=1) & ((steps < 5) | (places[:, at[-1]] > places[:, at[0]])))[0]
        key = np.full(len(own), k, np.uint64)
        for p in at:
            key = mix(key ^ words[own, p].astype(np.uint64), 77)
        yield own, key


def merged(item: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, from, to) of spans of one item in one text, those that overlap joined."""
    order = np.argsort((item << 40) | low, kind="stable")
    item, end, low, high = (x[order] for x in (item, end, low, high))
    group = np.cumsum(np.r_[False, (item[1:] != item[:-1]) | (end[1:] != end[:-1])])
    reach = np.maximum.accumulate(high + (group << 40)) - (group << 40)  # the furthest end so far in the group
    new = np.r_[True, (group[1:] != group[:-1]) | (low[1:] > reach[:-1])]
    first = np.nonzero(new)[0]
    return item[first], low[first], np.maximum.reduceat(high, first)


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts: dict[tuple[bytes, ...], list[int]] = {}
        for item, text in rows:
            if w := words_of(text):
                texts.setdefault(tuple(w), []).append(item)
        self.names = list(texts.values())  # items with the same words are one
        vocabulary = sorted({w for t in texts for w in t})
        found = word_hashes(b" ".join(vocabulary))[2] if vocabulary else np.zeros(0, np.uint64)
        self.hashes = np.unique(found)
        self.vocabulary = dict(zip(vocabulary, np.searchsorted(self.hashes, found).tolist(), strict=True))
        self.known = np.zeros(1 << 18, bool)  # few other words are marked; who is marked is looked up
        self.known[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        self.exact = [list(t) for t in texts]
        self.words = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.allowed = np.array([allowed(n) for n in self.sizes.tolist()], np.int64)
        self.base = len(self.hashes) + 1
        self.pairs = np.unique(np.concatenate([w[:-1] * self.base + w[1:] for w in self.words])) if self.words else np.zeros(0, np.int64)
        self.marked = np.zeros(1 << 20, bool)
        self.marked[self.mark(self.pairs)] = True
        # pairs by item; ids of words and items are below 2 ** 18, so this fits 64 bits
        self.own_pairs = np.unique(np.concatenate([(w[:-1] * self.base + w[1:]) * len(self.words) + k for k, w in enumerate(self.words)])) if self.words else np.zeros(0, np.int64)
        self.bound = np.array([least(n) for n in self.sizes.tolist()], np.int64)
        self.singles = np.unique([int(w[0]) for w in self.words if len(w) == 1]).astype(np.int64)
        self.classes: dict[int, list[int]] = {}  # steps of walks -> sizes of items
        for n in sorted(set(self.sizes.tolist())):
            self.classes.setdefault(min(STEPS, n), []).append(n)
        self.tables: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}  # (steps, repeat) -> of each sample: keys in order, items, offsets
        for steps, sizes in self.classes.items():
            own = np.nonzero(np.isin(self.sizes, sizes))[0]
            flat = np.concatenate([self.words[k] for k in own])
            ends = np.repeat(np.cumsum(self.sizes[own]), self.sizes[own])
            item, offset = np.repeat(own, self.sizes[own]), np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes[own]) - self.sizes[own], self.sizes[own])
            for repeat in range(REPEATS):
                made = []
                for at, key in keys_of(*walks(flat, np.arange(len(flat)), ends, steps, repeat), steps, repeat):
                    order = np.argsort(key, kind="stable")
                    made.append((key[order], item[at[order]], offset[at[order]]))
                self.tables[steps, repeat] = made

    @staticmethod
    def mark(pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64), 3) >> np.uint64(44)).astype(np.int64)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words of no item."""
        ids = np.full(len(hashes), -1, np.int64)
        some = np.nonzero(self.known[(hashes >> np.uint64(46)).astype(np.int64)])[0]
        at = np.searchsorted(self.hashes, hashes[some]).clip(0, len(self.hashes) - 1)
        ids[some] = np.where(self.hashes[at] == hashes[some], at, -1)
        return ids

    def shared_pairs(self, ids: np.ndarray) -> np.ndarray:
        """hits[j] - hits[i]: the pairs of neighbours from place i to before j that some item has."""
        at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
        pair = ids[at] * self.base + ids[at + 1]
        some = self.marked[self.mark(pair)]
        at, pair = at[some], pair[some]
        flags = np.zeros(len(ids) + 1, np.int32)
        if len(self.pairs):
            near = np.searchsorted(self.pairs, pair).clip(0, len(self.pairs) - 1)
            flags[at[self.pairs[near] == pair] + 1] = 1
        return np.cumsum(flags, dtype=np.int32)

    def places(self, ids: np.ndarray, ends: np.ndarray, hits: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Places that could lie in a copy of an item of these sizes, by the q-gram lemma: first with the weakest bound of a class, then size by size."""
        span = lambda at, w: hits[np.maximum(np.minimum(at + w + allowed(w), ends[at]) - 1, at)] - hits[at]
        change = np.zeros(len(ids) + 1, np.int32)
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
            own = [w for w in sizes if low <= w < high]
            if not own:
                continue
            if own == [1]:
                at = np.nonzero(np.isin(ids, self.singles))[0]
            else:
                at = np.nonzero(hits[np.minimum(np.arange(len(ids)) + max(own) + allowed(max(own)) - 1, len(ids))] - hits[:-1] >= min(map(least, own)))[0]
            for w in own:
                starts = at if w == 1 else at[span(at, w) >= least(w)]
                np.add.at(change, starts, 1)
                np.add.at(change, np.minimum(starts + w + allowed(w), ends[starts]), -1)
        return np.nonzero(np.cumsum(change[:-1]) > 0)[0]

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): parts of texts in which a stretch that shares a key with an item would lie, edits included,
        but for those that the q-gram lemma rules out for that item."""
        hits = self.shared_pairs(ids)
        spans: list[tuple[np.ndarray, ...]] = []
        for steps, sizes in self.classes.items():
            at = self.places(ids, ends, hits, sizes)
            for part in (at[k : k + 20_000] for k in range(0, len(at), 20_000)):
                for repeat in range(REPEATS):
                    for (own, key), (known, items, offsets) in zip(keys_of(*walks(ids, part, ends[part], steps, repeat), steps, repeat), self.tables[steps, repeat], strict=True):
                        low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                        times = high - low
                        which = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                        at_words = np.repeat(part[own], times)
                        spans.append((items[which], ends[at_words], at_words - offsets[which]))
        if not spans or not sum(len(s[0]) for s in spans):
            return
        item, end, around = (np.concatenate([s[c] for s in spans]) for c in range(3))
        begin, most = np.searchsorted(ends, end, "left"), self.allowed[item]
        item, low, high = merged(item, end, np.maximum(begin, around - most), np.minimum(end, around + self.sizes[item] + 2 * most))
        size = np.maximum(high - low - 1, 0)  # pairs
        pair = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        first, second = ids[pair], ids[np.minimum(pair + 1, len(ids) - 1)]
        code = np.where((first >= 0) & (second >= 0), (first * self.base + second) * len(self.words) + np.repeat(item, size), -1)
        shared = np.r_[0, np.cumsum(self.own_pairs[np.searchsorted(self.own_pairs, code).clip(0, len(self.own_pairs) - 1)] == code)] if len(self.own_pairs) else np.zeros(len(code) + 1, np.int64)
        upto = np.cumsum(size)
        ok = shared[upto] - shared[upto - size] >= self.bound[item]
        yield from zip(item[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True)

    def find(self, ids: np.ndarray, ends: np.ndarray, word) -> list[tuple[int, int, int, int]]:
        """(item's place, start, stop, edits) of whatever matches in word ids of texts that end at `ends`; word(k) gives a word's bytes."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}  # by item and text, told by its end
        for k, low, high in self.candidates(ids, ends):
            most, key = int(self.allowed[k]), (k, int(ends[low]))
            edits, start = best_stretch(self.words[k], ids[low:high])
            start += low
            old = best.get(key)
            if edits > most or (old and old[:2] <= (edits, start)):
                continue
            cut = min(key[1], start + len(self.exact[k]) + edits)
            same, length = edit_distance(self.exact[k], [word(j) for j in range(start, cut)], edits)
            if same == edits:  # else words of the same hash differ
                best[key] = (edits, start, start + length)
        return [(k, a, b, e) for (k, _), (e, a, b) in best.items()]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start, stop, edits) over the words of each whole text."""
        out: list[list] = [[] for _ in texts]
        if not self.words:
            return out
        held, size, first = [], 0, 0
        for n, text in enumerate(texts):
            held.append(plain(text))
            size += len(held[-1])
            if size >= AT_ONCE or n + 1 == len(texts):
                for doc, row in self.part(held):
                    out[first + doc].append(row)
                held, size, first = [], 0, n + 1
        return [sorted(m, key=lambda r: (r[0] is not None, r)) for m in out]

    def part(self, held: list[bytes]) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        raw = b" ".join(held)
        starts, ends, hashes = word_hashes(raw)
        if not len(starts):
            return
        byte_ends = np.cumsum([len(t) + 1 for t in held])
        last = np.searchsorted(starts, byte_ends, "left")  # of each text, the place after its last word
        of = np.searchsorted(byte_ends, starts, "right")
        for k, a, b, e in self.find(self.ids_of(hashes), last[of], lambda j: raw[starts[j] : ends[j]]):
            doc = int(of[a])
            before = int(last[doc - 1]) if doc else 0
            for item in self.names[k]:
                yield doc, (item, a - before, b - before, e)


def recall(size: int, edits: int, trials: int = 200, seed: int = 1, layout: str = "random") -> float:
    """Share of random items of `size` words that share a key with a copy that has so many word edits: anywhere, in the
    first part ("first"), or as far apart as can be ("apart")."""
    rng = np.random.default_rng(seed)
    steps, found = min(STEPS, size), 0

    def keys(x: np.ndarray) -> set:
        out = set()
        for r in range(REPEATS):
            for k, (_, key) in enumerate(keys_of(*walks(x, np.arange(len(x)), np.full(len(x), len(x)), steps, r), steps, r)):
                out |= {(r, k, v) for v in key.tolist()}
        return out

    for _ in range(trials):
        a = rng.integers(0, 5000, size)
        b = a.tolist()
        for n in range(edits):
            if layout == "random":
                p, kind = int(rng.integers(0, len(b))), int(rng.integers(0, 3))
                b[p : p + (kind != 0)] = [] if kind == 1 else [int(rng.integers(5000, 10_000))]
            else:
                b[n if layout == "first" else int((n + 0.5) * size / edits)] = 5000 + n
        found += not keys(a).isdisjoint(keys(np.array(b)))
    return found / trials


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_WORDS words, by a hash of their id and text; each is read when it's asked for."""
    own = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = own.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_WORDS))
    for k in range(n):
        part = (own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else own).toArrow()
        yield sorted(zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


_items: dict[str, Items] = {}


def items_of(shared) -> Items:
    """One block of items for each worker at a time."""
    if (key := shared.value[0]) not in _items:
        _items.clear()
        _items[key] = Items(shared.value[1])
    return _items[key]


def each_block(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple]:
    """(broadcast block, whether it's the last): a block is made only after the one before was worked through."""
    scratch.long_rows(docs.sparkSession)
    waiting = None
    for rows in blocks(benchmark):
        if waiting:
            yield waiting, False
            waiting.unpersist()
        waiting = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    yield waiting, True


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop, edits): each item's best stretch, in words, in each row of docs(doc_id, text) that holds it.

    Null and empty texts hold none. Items without words, null ones included, are never reported. Items with the same
    words are each reported. Of equally good stretches the first counts. Repeated rows of docs are each looked at.
    Other columns are not read; empty tables give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    done = []
    for shared, last in each_block(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = items_of(shared)
            for batch in batches:
                rows = [(d, *m) for d, found in zip(batch.column(0).to_pylist(), items.matches(batch.column(1).to_pylist()), strict=True) for m in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "start", "stop", "edits"])

        part = own.mapInArrow(run, "doc_id long, item_id long, start long, stop long, edits long")
        done.append(part if last else scratch.keep(part, "leaks"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows that hold no item, with all their columns, whatever those are called.

    Null and empty texts hold none and stay; repeated rows are judged each; an empty benchmark drops nothing.
    """
    at, schema = docs.columns.index(text), docs.schema
    before = None
    for shared, last in each_block(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = items_of(shared)
            for batch in batches:
                clean = [not found for found in items.matches(batch.column(at).to_pylist())]
                yield batch if all(clean) else batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = scratch.keep(docs, "clean")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
