"""Pseudo-likelihood of texts under a bidirectional window network, trained in numpy over the whole corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import _FACTORS, discard, fresh, mix, store

CLASSES, HIDDEN, REACH, BATCH = 64, 16, 2, 4096
SUBS = 32  # parts of each class
LEAST = 256  # tokens of a group of words, below which counts tell its words apart
NEVER = -30.0  # bias of what has no words
LISTED = 131_072  # most frequent words, whose counts every worker holds; the counts of all others stay in a table
OWN, SHARED = 16_384, 2_048  # rows of the network's input for the most frequent words, and for all others by hash
PAD = OWN + SHARED  # what stands beyond either end of a text
RARE = 1 << 16  # codes of words that aren't listed, by hash
ROWS = 32_768  # rows of a table that are averaged together
SCALE = 1 << 24


@dataclass
class Tree:
    """How each class is divided down to single codes: into ``SUBS`` parts, then in two again and again.

    Each division has about equally many tokens on its sides. Codes that have fewer than ``LEAST`` tokens together stay together.
    """

    part: np.ndarray  # of its class, for each code
    first: np.ndarray  # where in ``path`` the branches of each code begin
    depth: np.ndarray  # how many they are
    path: np.ndarray  # twice the number of a node, and 1 for its second side
    parts: np.ndarray  # CLASSES, SUBS: ln of the share of each part in its class
    nodes: np.ndarray  # ln of the second side's tokens by the first's
    left: np.ndarray  # for each code the tokens of what the last branch leaves

    @staticmethod
    def of(cls: np.ndarray, counts: np.ndarray) -> Tree:
        order = np.argsort(cls, kind="stable")
        k, c, n = cls[order], counts[order].astype(float), len(cls)
        cum = np.append(0.0, np.cumsum(c))
        begin, end = (np.searchsorted(k, np.arange(CLASSES), side) for side in ("left", "right"))
        mass = cum[end] - cum[begin]
        middle = cum[:-1] + c / 2 - cum[begin][k]
        part = np.where(mass[k] >= LEAST, np.minimum(SUBS - 1, middle * SUBS / np.maximum(1.0, mass[k])), 0).astype(np.int64)
        lo, hi = (np.searchsorted(k * SUBS + part, np.arange(CLASSES * SUBS), side) for side in ("left", "right"))
        share = (cum[hi] - cum[lo]) / np.repeat(np.maximum(1.0, mass), SUBS)
        parts = np.log(share, out=np.full(CLASSES * SUBS, NEVER), where=share > 0).reshape(CLASSES, SUBS)
        left, nodes, levels, known = np.zeros(n), [], [], 0
        while True:
            both = cum[hi] - cum[lo]
            go = (hi - lo > 1) & (both >= LEAST)
            at = _stretches(lo[~go], hi[~go])
            left[at] = np.repeat(both[~go], (hi - lo)[~go])
            lo, hi = lo[go], hi[go]
            if not len(lo):
                break
            half = (cum[lo] + cum[hi]) / 2
            mid = np.searchsorted(cum, half)
            mid = np.clip(mid - (half - cum[mid - 1] < cum[mid] - half), lo + 1, hi - 1)
            second, level = cum[hi] - cum[mid], np.full(n, -1, np.int32)
            node = known + np.arange(len(lo))
            level[_stretches(lo, mid)] = np.repeat(2 * node, mid - lo)
            level[_stretches(mid, hi)] = np.repeat(2 * node + 1, hi - mid)
            nodes.append(np.clip(np.log(np.maximum(1e-30, second)) - np.log(np.maximum(1e-30, both[go] - second)), NEVER, -NEVER))
            levels.append(level)
            known += len(lo)
            lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        path = np.array(levels, np.int32).reshape(len(levels), n).T
        depth = (path >= 0).sum(axis=1).astype(np.int32)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first = (np.cumsum(depth) - depth).astype(np.int32)
        return Tree(part[place].astype(np.int32), first[place], depth[place], path[path >= 0], parts, np.concatenate([*nodes, np.empty(0)]), left[place])

    def branches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all branches of all codes in order: number in ``codes``, node, and whether it takes the second side; and their counts."""
        depth = self.depth[codes]
        owner = np.repeat(np.arange(len(codes)), depth)
        at = self.path.take(np.arange(len(owner)) + np.repeat(self.first[codes] - (np.cumsum(depth) - depth), depth))
        return owner, at >> 1, at & 1, depth


def _stretches(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each ``lo`` up to its ``hi``, without it."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


@dataclass
class Lexicon:
    """Listed words by 64-bit hash, and for each code of a word its row of the input, its class, part of the class, and branches.

    A listed word's code is its rank; other words' codes follow, by hash. ``within`` is ln of a word's share of what the last
    branch leaves: 0 where that is one listed word. For words not listed it lacks ln of their own count.
    """

    hashes: np.ndarray  # uint64, sorted
    ranks: np.ndarray
    row: np.ndarray
    cls: np.ndarray
    within: np.ndarray
    mass: np.ndarray  # tokens of each class
    tree: Tree

    @property
    def listed(self) -> int:
        return len(self.cls) - RARE

    def code_of(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        at = int(self.hashes.searchsorted(np.uint64(h)))
        return int(self.ranks[at]) if at < len(self.hashes) and int(self.hashes[at]) == h else self.listed + (h & (RARE - 1))

    def codes_of(self, h: np.ndarray) -> np.ndarray:
        """The same for many hashes."""
        other = self.listed + (h & np.uint64(RARE - 1)).astype(np.int32)
        if not len(self.hashes):
            return other
        at = np.minimum(self.hashes.searchsorted(h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], other).astype(np.int32)


class Codes:
    """Codes of words (lower case) and their hashes, remembered for some in a table of slots; a word's own hash tells where."""

    SLOTS, MOST, PROBES = 1 << 20, 400_000, 16

    def __init__(self, lexicon: Lexicon | None):
        self.lexicon = lexicon  # without one only hashes are given
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.keys, self.hashes, self.codes = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)

    def __getitem__(self, word: bytes) -> int:
        return self.lexicon.code_of(word)

    def of(self, text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and 64-bit hash of each word, given where it begins and ends."""
        keys = word_keys(text, start, end)
        code, h = np.empty(len(keys), np.int32), np.empty(len(keys), np.uint64)
        found, todo, slot = np.zeros(len(keys), bool), np.arange(len(keys)), (keys >> np.uint64(44)).astype(np.int64)
        for _ in range(self.PROBES):
            there = self.keys.take(slot)
            hit = there == keys.take(todo)
            some = todo[hit]
            code[some], h[some], found[some] = self.codes.take(slot[hit]), self.hashes.take(slot[hit]), True
            more = ~hit & (there != 0)
            todo, slot = todo[more], (slot[more] + 1) % self.SLOTS
            if not len(todo):
                break
        rest = np.flatnonzero(~found)
        if len(rest):
            new, first, which = np.unique(keys[rest], return_index=True, return_inverse=True)
            one = rest[first]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist())), np.uint64, len(one))
            codes = np.zeros(len(hashes), np.int32) if self.lexicon is None else self.lexicon.codes_of(hashes)
            code[rest], h[rest] = codes[which], hashes[which]
            self.remember(new[: self.MOST], codes, hashes)
        return code, h

    def remember(self, keys: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> None:
        if self.known + len(keys) > self.MOST:
            self.clear()
        self.known += len(keys)
        left, slot = np.arange(len(keys)), (keys >> np.uint64(44)).astype(np.int64)
        for _ in range(self.PROBES):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            there = self.keys[slot] == keys[left]
            self.codes[slot[there]], self.hashes[slot[there]] = codes[left[there]], hashes[left[there]]
            left, slot = left[~there], (slot[~there] + 1) % self.SLOTS
            if not len(left):
                break


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def lower_case(texts: list[bytes | None]) -> bytes:
    return b"\n".join([t or b"" for t in texts]).lower()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def word_keys(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, other than 0, made for all words at once; words over 64 bytes are hashed one by one."""
    bytes8 = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    size = end - start
    keys = mix((bytes8[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _FACTORS[0])
    some = np.flatnonzero(size > 8)
    for k in range(8, 64, 8):
        keys[some] = mix((keys[some] ^ (bytes8[start[some] + k] & _FIRST[np.minimum(size[some] - k, 8)])) * _FACTORS[1])
        some = some[size[some] > k + 8]
        if not len(some):
            break
    for i in some.tolist():
        keys[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    keys[keys == 0] = 1
    return keys


def classes_of(counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each listed word, of each code of other words, and the tokens of each class.

    ``counts`` are those of listed words in order, ``others`` the tokens of other words by code. Listed words are cut into
    stretches of about equal numbers of tokens, so the most frequent are classes by themselves, and those of one
    class are about equally frequent; other words are dealt to classes by hash, as many as their tokens are worth.
    """
    total = max(1.0, counts.sum() + others.sum())
    for_others = min(CLASSES - 1, max(1, round(CLASSES * others.sum() / total)))
    for_listed = CLASSES - for_others
    middle = np.cumsum(counts) - counts / 2
    cls = np.minimum(for_listed - 1, (middle * for_listed / max(1.0, counts.sum())).astype(np.int64))
    other = for_listed + np.arange(RARE) % for_others
    mass = np.bincount(cls, weights=counts, minlength=CLASSES) + np.bincount(other, weights=others, minlength=CLASSES)
    return cls, other, mass


@dataclass
class Network:
    """h = tanh(sum of one vector for each neighbour and place + b); p(word) = p(class | h) p(part | class, h) p(each branch | h),

    times the word's share of what the branches leave. The word itself is masked: only the ``REACH`` words before and after it are seen.
    """

    places: np.ndarray  # 2 * REACH, PAD + 1, HIDDEN
    b: np.ndarray
    out: np.ndarray  # HIDDEN + 1, CLASSES; the last row is the bias
    inner: np.ndarray  # CLASSES, HIDDEN + 1, SUBS: the parts of each class
    nodes: np.ndarray  # nodes, HIDDEN + 1: that a branch takes the second side

    @staticmethod
    def start(mass: np.ndarray, tree: Tree | None = None, seed: int = 6) -> Network:
        """Small random vectors; biases give the frequency in the corpus of each class, part and side."""
        rng = np.random.default_rng(seed)
        places = rng.standard_normal((2 * REACH, PAD + 1, HIDDEN), dtype=np.float32) * np.float32(0.1)
        out = np.vstack([rng.normal(0, 0.1, (HIDDEN, CLASSES)), np.log((mass + 1.0) / (mass.sum() + CLASSES))])
        inner, nodes = np.zeros((CLASSES, HIDDEN + 1, SUBS), np.float32), np.zeros((0 if tree is None else len(tree.nodes), HIDDEN + 1), np.float32)
        if tree is not None:
            inner[:, -1], nodes[:, -1] = tree.parts, tree.nodes
        return Network(places, np.zeros(HIDDEN, np.float32), out.astype(np.float32), inner, nodes)

    def tables(self) -> list[np.ndarray]:
        """Views on the parameters whose rows are averaged each by itself."""
        return [self.places.reshape(-1, HIDDEN), self.b.reshape(1, -1), self.out.reshape(1, -1), self.inner.reshape(len(self.inner), -1), self.nodes]

    def log_likelihood(self, around: np.ndarray, target: np.ndarray, step: tuple | None = None, words: tuple[Tree, np.ndarray] | None = None) -> np.ndarray:
        """ln p of each target class given rows of the neighbours; with ``step`` (state and rate) also one AdaGrad step on their mean.

        With ``words`` (a tree, and the code of each target, whose classes must be in order) p is that of the code, or of the codes left with it.
        """
        n = len(target)
        h = self.places[0].take(around[0], axis=0)
        for k in range(1, 2 * REACH):
            h += self.places[k].take(around[k], axis=0)
        h += self.b
        seen = np.ones((n, len(self.out)), h.dtype)  # the last column is that of the bias
        h = np.tanh(h, out=seen[:, :-1])
        z = seen @ self.out
        if np.abs(self.out).sum(axis=0).max() > 60:  # else no exponential can overflow, as h lies between -1 and 1
            z -= z.max(axis=1, keepdims=True)
        rows = np.arange(n)
        chosen = z[rows, target]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        value = chosen - np.log(total)
        down = None if words is None else self._inside(seen, target, *words, value, step)
        if step is not None:
            sums, rate = step
            z /= (total * n)[:, None]
            z[rows, target] -= 1 / n
            dh = z @ self.out[:-1].T
            if down is not None:
                dh += down
            _adagrad(self.out, seen.T @ z, sums.out, rate)
            dh *= 1 - h * h
            _adagrad(self.b, dh.sum(axis=0), sums.b, rate)
            found = [_groups(x) for x in around]
            at = np.concatenate([x.take(order.take(first)) + k * self.places.shape[1] for k, (x, (order, first)) in enumerate(zip(around, found))])
            g = _sums(dh, np.concatenate([order for order, _ in found]), np.concatenate([first + k * n for k, (_, first) in enumerate(found)]))
            _adagrad_rows(self.places.reshape(-1, HIDDEN), at, g, sums.places.reshape(-1), rate)
            for hits, some in zip(sums.hits, (at, 0, 0)):
                hits[some] += 1
        return value

    def _inside(self, seen: np.ndarray, target: np.ndarray, tree: Tree, codes: np.ndarray, value: np.ndarray, step: tuple | None) -> np.ndarray | None:
        """Adds ln p of each code within its class to ``value``; with ``step`` also moves what gives it, and returns its part of the slope by h."""
        n, rows = len(target), np.arange(len(target))
        bounds = np.searchsorted(target, np.arange(len(self.inner) + 1)).tolist()
        classes = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        z, part = np.empty((n, self.inner.shape[2]), seen.dtype), tree.part[codes]
        for c, some in classes:
            np.dot(seen[some], self.inner[c], out=z[some])
        if np.abs(self.inner).sum(axis=1).max() > 80:
            z -= z.max(axis=1, keepdims=True)
        chosen = z[rows, part]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        value += chosen - np.log(total)
        owner, node, side, depth = tree.branches(codes)
        h, w = seen.take(owner, axis=0), self.nodes.take(node, axis=0)
        s = np.einsum("ij,ij->i", h, w)
        one = np.exp(np.clip(np.where(side, -s, s), -80, 80)) + 1  # 1 / p of the side taken
        value -= np.bincount(owner, weights=np.log(one), minlength=n)
        if step is None:
            return None
        sums, rate = step
        z /= (total * n)[:, None]
        z[rows, part] -= 1 / n
        down = np.empty((n, HIDDEN), seen.dtype)
        held = [c for c, _ in classes]
        g = np.empty((len(held), *self.inner.shape[1:]), seen.dtype)
        for k, (c, some) in enumerate(classes):
            np.dot(z[some], self.inner[c, :-1].T, out=down[some])
            np.dot(seen[some].T, z[some], out=g[k])
        square = sums.inner[held] + g * g
        sums.inner[held] = square
        self.inner[held] -= rate * g / np.sqrt(square)
        sums.hits[3][held] += 1
        if len(owner):
            slope = ((1 - 1 / one) * (1 - 2 * side) / n).astype(seen.dtype)[:, None]
            w *= slope
            some = np.flatnonzero(depth)
            down[some] += _sums(w, np.arange(len(w)), (np.cumsum(depth) - depth)[some])[:, :-1]
            h *= slope
            order, first = _groups(node)
            at = node.take(order.take(first))
            _adagrad_rows(self.nodes, at, _sums(h, order, first), sums.nodes, rate)
            sums.hits[4][at] += 1
        return down


class State:
    """Sums of squared gradients, one for a row of the input and for a node; and in how many steps each row took part."""

    def __init__(self, net: Network):
        self.places = np.full((*net.places.shape[:2], 1), 1e-6, np.float32)
        self.b, self.out, self.inner = (np.full_like(x, 1e-6) for x in (net.b, net.out, net.inner))
        self.nodes = np.full(len(net.nodes), 1e-6, np.float32)
        self.hits = [np.zeros(len(x), np.int32) for x in net.tables()]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key (a row of the input, or a node), and where in it each key begins."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16 bits at a time, for which numpy has a radix sort
    if len(keys) and keys.max() >= 1 << 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    k = keys[order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1]))


def _sums(dh: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the rows of each group. Most groups are small, so it goes by places in a group, largest groups first; reduceat sums large ones only."""
    size = np.diff(first, append=len(order))
    by = np.argsort((9 - np.minimum(size, 9)).astype(np.uint8), kind="stable")
    size, first = size[by], first[by]
    g = dh.take(order.take(first), axis=0)
    *above, large = np.searchsorted(-np.minimum(size, 9), -np.arange(1, 9)).tolist()  # how many have more than 1 to 8 rows
    for k, end in enumerate(above, 1):
        g[large:end] += dh.take(order.take(first[large:end] + k), axis=0)
    if large:
        ends = np.cumsum(size[:large])
        g[:large] = np.add.reduceat(dh.take(order.take(_stretches(first[:large], first[:large] + size[:large])), axis=0), ends - size[:large], axis=0)
    out = np.empty_like(g)
    out[by] = g
    return out


def _adagrad_rows(w: np.ndarray, at: np.ndarray, g: np.ndarray, s: np.ndarray, rate: float) -> None:
    """A step on the rows ``at``, each with one sum of squares."""
    square = s.take(at) + np.einsum("ij,ij->i", g, g) / g.shape[1]
    s[at] = square
    g *= (rate / np.sqrt(square))[:, None]
    w[at] = w.take(at, axis=0) - g


def _adagrad(w: np.ndarray, g: np.ndarray, s: np.ndarray, rate: float) -> None:
    s += g * g
    w -= rate * g / np.sqrt(s)


def windows(texts: list[bytes | None], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of words with -1 around each text, positions of words, number of the text of each position, hash of each word)."""
    size = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    joined = lower_case(texts)
    start, end = word_bounds(joined)
    code, h = codes.of(joined, start, end)
    owner = np.searchsorted(np.cumsum(size), start, "right")
    at = np.arange(len(start)) + REACH * (owner + 1)
    found = np.full(len(start) + REACH * (len(texts) + 1), -1, np.int32)
    found[at] = code
    return found, at, owner, h


def _rows(found: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Rows of the input of each code; ``lexicon.row`` ends with that of what stands beyond a text."""
    return lexicon.row[found]


def _by_class(at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return at[np.argsort(cls[at].astype(np.uint16), kind="stable")]


def _around(rows: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [rows[at + k] for k in (*range(-REACH, 0), *range(1, REACH + 1))]


_HELD: dict[str, object] = {}


def _held(key: str, make):
    """What a worker makes, once for all tasks of a stage."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``h`` and ``c``: every lower-cased word of all documents, by 64-bit hash, and its count; summed in each task first."""

    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _held(key, lambda: Codes(None)), []

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

        for batch in batches:
            for part in slices(batch, 0, 2_000_000):
                texts = lower_case(part.column(0).to_pylist())
                held.append(known.of(texts, *word_bounds(texts))[1])
                if sum(map(len, held)) > 2_000_000:
                    yield out()
        if held:
            yield out()

    source = docs.select(F.col(f"`{text}`").cast("string").cast("binary"))
    return store(source.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))


def lexicon_of(counts: DataFrame) -> Lexicon:
    """The ``LISTED`` most frequent words of ``word_counts``, and what is left to the others."""
    every = np.zeros(RARE)
    for r in counts.groupBy(F.col("h").bitwiseAND(RARE - 1).alias("code")).agg(F.sum("c").alias("c")).collect():  # RARE rows at most
        every[r.code] = r.c
    top = counts.orderBy(F.desc("c"), "h").limit(LISTED).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(float)
    others = every - np.bincount((h & np.uint64(RARE - 1)).astype(np.int64), weights=c, minlength=RARE)
    cls, other, mass = classes_of(c, others)
    rank = np.arange(len(h))
    row = np.full(LISTED + RARE + 1, PAD, np.int32)
    row[: len(h)] = np.where(rank < OWN, rank, OWN + rank % SHARED)
    row[LISTED:-1] = OWN + np.arange(RARE) % SHARED
    of, within = np.zeros(LISTED + RARE, np.int32), np.zeros(LISTED + RARE)
    of[: len(h)], of[LISTED:] = cls, other
    tree = Tree.of(of, np.concatenate([c, np.zeros(LISTED - len(h)), others]))
    within[: len(h)] = np.log(c)
    within -= np.log(np.maximum(1, tree.left))
    order = np.argsort(h)
    return Lexicon(h[order], rank[order].astype(np.int32), row, of, within, mass, tree)


def train(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", rounds: int = 1, rate: float = 0.15) -> Network:
    """The network, from all words of all documents.

    In each round every task runs through its documents from the current network, with a step for each
    ``BATCH`` words. The changes are then averaged row by row over the tasks that had the row, weighted by the
    steps it took part in, so that a word of few tasks keeps what they learnt. Changes travel as integers,
    so that their order doesn't matter.
    """
    net = Network.start(lexicon.mass, lexicon.tree)
    sizes = [len(x) for x in net.tables()]
    source = docs.select(F.col(f"`{text}`").cast("string").cast("binary"))
    for _ in range(rounds):
        sent, key = docs.sparkSession.sparkContext.broadcast((lexicon, net)), uuid.uuid4().hex

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            codes, before = _held(key, lambda: (Codes(sent.value[0]), sent.value[1]))
            own, sums = None, None
            for batch in batches:
                for part in slices(batch, 0, 2_000_000):
                    found, at, *_ = windows(part.column(0).to_pylist(), codes)
                    at, rows, cls = np.random.default_rng(len(at)).permutation(at), _rows(found, codes.lexicon), codes.lexicon.cls[found]
                    if own is None and len(at):
                        own = Network(*(x.copy() for x in vars(before).values()))
                        sums = State(own)
                    for k in range(0, len(at), BATCH):
                        some = _by_class(at[k : k + BATCH], cls)
                        own.log_likelihood(_around(rows, some), cls[some], (sums, rate * np.sqrt(len(some) / BATCH)), (codes.lexicon.tree, found[some]))
            if own is None:
                return
            for k, (new, old, hits) in enumerate(zip(own.tables(), before.tables(), sums.hits)):
                for start in range(0, len(new), ROWS):
                    rows = np.flatnonzero(hits[start : start + ROWS])
                    if len(rows):
                        change = np.rint((new[start + rows].astype(np.float64) - old[start + rows]) * SCALE).astype("<i4")
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([start], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype("<i4"), hits[start + rows].astype("<i4"), change))], ["k", "start", "rows", "hits", "p"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, tuple] = {}
            for batch in batches:
                for k, start, rows, hits, p in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    rows, hits = np.frombuffer(rows, "<i4"), np.frombuffer(hits, "<i4").astype(np.int64)
                    p = np.frombuffer(p, "<i4").reshape(len(rows), -1)
                    if (k, start) not in held:
                        size = min(ROWS, sizes[k] - start)
                        held[k, start] = np.zeros((size, p.shape[1]), np.int64), np.zeros(size, np.int64)
                    change, weight = held[k, start]
                    change[rows] += p * hits[:, None]
                    weight[rows] += hits
            for (k, start), (change, weight) in held.items():
                rows = np.flatnonzero(weight)
                p = (change[rows] / (weight[rows, None] * float(SCALE))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], ["k", "start", "rows", "p"])

        parts = store(source.mapInArrow(learn, "k int, start bigint, rows binary, hits binary, p binary").repartition("k", "start").mapInArrow(add, "k int, start bigint, rows binary, p binary"))
        tables = net.tables()
        for r in parts.toLocalIterator():
            rows = r.start + np.frombuffer(r.rows, "<i4")
            tables[r.k][rows] += np.frombuffer(r.p, "<f4").reshape(len(rows), -1)
        sent.unpersist()
        discard(parts)
    return net


def score_texts(texts: list[bytes | None], codes: Codes, net: Network) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of each text, the sum of their conditional log-probabilities without the ln of counts that aren't listed, and for

    each such word of each text the number of the text, the hash and how often it occurs; texts in order.
    """
    lexicon = codes.lexicon
    found, at, owner, h = windows(texts, codes)
    rows, cls, got = _rows(found, lexicon), lexicon.cls[found], np.empty(len(found))
    every = _by_class(at, cls)
    for k in range(0, len(at), BATCH):
        some = every[k : k + BATCH]
        got[some] = net.log_likelihood(_around(rows, some), cls[some], words=(lexicon.tree, found[some]))
    value = got[at] + lexicon.within[found[at]]
    n, unlisted = np.bincount(owner, minlength=len(texts)), np.flatnonzero(found[at] >= lexicon.listed)
    who, h = owner[unlisted], h[unlisted]
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (h[1:] != h[:-1])) if len(h) else [])
    return n, np.bincount(owner, weights=value, minlength=len(texts)), (who[first], h[first], np.diff(first, append=len(h)))


def pseudo_likelihood(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, rounds: int = 1) -> DataFrame:
    """``keep`` (default: all other columns), ``n_tokens``, ``log_likelihood`` (sum over words of ln p given both sides)

    and ``mean_log_likelihood``. Every word of every whole text is predicted from its neighbours on both sides: the network
    gives the probability of its class, of the part of the class, and of each branch down to the word's code. Only words that share a code
    by hash (none of the ``LISTED``), and those that together occur less than ``LEAST`` times, are told apart by their
    counts in the corpus. Counts of the ``LISTED`` most frequent words go to every task; those of the others, however many, are joined
    with the texts' words, none of which is frequent, and the documents' sums come back by row.

    Null and empty texts have no words, a sum of 0 and a null mean. Repeated rows are trained on as often as they
    occur and get equal scores, up to the rounding of sums. An empty table gives no rows. Columns of the names made here are replaced.
    """
    counts = word_counts(docs, text)
    lexicon = lexicon_of(counts)
    sent, key = docs.sparkSession.sparkContext.broadcast((lexicon, train(docs, lexicon, text=text, rounds=rounds))), uuid.uuid4().hex
    made = ("n_tokens", "log_likelihood", "mean_log_likelihood")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    types = dict(docs.dtypes)
    row, rest = fresh(names, "row", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, net = _held(key, lambda: (Codes(sent.value[0]), sent.value[1]))
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 2_000_000):
                n, total, (who, h, times) = score_texts(part.column(part.num_columns - 1).to_pylist(), codes, net)
                ends = pa.array(np.searchsorted(who, np.arange(len(n) + 1)).astype(np.int32))
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names) + 1)), pa.array(n, pa.int64()), pa.array(total), found], [*names, row, "n_tokens", "log_likelihood", rest])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), f"{row} bigint, n_tokens bigint, log_likelihood double, {rest} array<struct<h: bigint, n: int>>"])
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id().alias(row), F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    scored = store(source.mapInArrow(run, schema))
    more = scored.select(F.col(row).alias("r"), F.explode(rest).alias("x")).select("r", "x.*").join(counts.filter("c > 1"), "h")
    more = more.groupBy("r").agg(F.sum(F.col("n") * F.log("c")).alias("more"))
    out = scored.drop(rest).join(more, F.col(row) == F.col("r"), "left")
    total = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return out.select(*(F.col(f"`{c}`") for c in names), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
