"""Context-tree weighting of byte streams, trained on a corpus.

A byte is eight binary decisions; each decision (one of 255 nodes of the byte's bit tree) has a context
tree over the DEPTH bytes before it. Every node s of a context tree keeps the zeros and ones seen there, and

    Pe(s) = the Krichevsky-Trofimov probability of those counts,
    Pw(s) = Pe(s) / 2 + product of Pw(children of s) / 2        (at DEPTH: Pw = Pe)

mixes all prunings of the tree below s. A text is scored by the posterior mixture over all depths: going
down the path of its context, depth d stops with the share Pe(s) / 2 / Pw(s) of what came so far and adds
its Krichevsky-Trofimov estimate; the deepest node that training met takes the rest.

Counts are gathered for the longest contexts only, the shorter ones being their sums. They are held in
shards by the last two bytes, so a shard has whole trees from depth 2 down; depths 0 and 1 (at most 65,536
nodes, whatever the corpus) are put together from sums over the shards.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

DEPTH = 5
LN10 = math.log(10)


def stream(text: bytes) -> bytes:
    """What is scored: the lower-cased words with one space between them, and an end."""
    return b" ".join(text.lower().split()) + b"\n"


def codes(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte of each stream in turn, number of bytes of each stream).

    A code has the ``depth`` bytes before in its higher bytes; before a stream stand ends.
    """
    pad = b"\n" * depth
    flat = np.frombuffer(b"".join([x for s in streams for x in (pad, s)]), np.uint8)
    code = np.zeros(len(flat) - depth, np.int64)
    for k in range(depth + 1):
        code <<= 8
        code |= flat[k : k + len(code)]
    sizes = np.array([len(s) for s in streams], np.int64)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(sizes + depth)[:-1]
    for k in range(depth):  # codes of the bytes that pad the next stream
        keep[ends - depth + k] = False
    return code[keep] if len(ends) else code, sizes


@cache
def _table() -> np.ndarray:
    """ln(Gamma(k + 1/2) / Gamma(1/2)) for small k."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 16) + 0.5))])


def _half(k: np.ndarray) -> np.ndarray:
    """ln(Gamma(k + 1/2) / Gamma(1/2)): the table, and Stirling's series beyond it."""
    table, x = _table(), np.maximum(k, 2).astype(np.float64) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - math.lgamma(0.5)
    return np.where(k < len(table), table[np.minimum(k, len(table) - 1)], series)


def _whole(k: np.ndarray) -> np.ndarray:
    """ln(k!)."""
    x = np.maximum(k, 1).astype(np.float64)
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 12)))])
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k < len(small), small[np.minimum(k, len(small) - 1)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _half(zeros) + _half(ones) - _whole(zeros + ones)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln Pw, share that stops) from ln Pe and the sum of the children's ln Pw."""
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _group(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of values by key; keys ascending, and each row's place among them."""
    unique, place = np.unique(keys, return_inverse=True)
    return unique, place, *(np.bincount(place, weights=v, minlength=len(unique)) for v in values)


class Shard:
    """The trees from depth 2 down of the contexts in ``grams`` (codes) with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth, self.grams = depth, grams
        context, byte = grams >> 8, grams & 255
        keys, zeros, ones = [], [], []
        for b in range(8):
            bit = (byte >> (7 - b)) & 1
            keys.append((context << 8) | (1 << b) | (byte >> (8 - b)))
            zeros.append(np.where(bit == 0, counts, 0))
            ones.append(np.where(bit == 1, counts, 0))
        key, _, z, o = _group(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
        self.levels = {depth: (key, z.astype(np.int64), o.astype(np.int64))}
        pw = log_kt(*self.levels[depth][1:])
        self.stop = {depth: np.ones(len(key))}
        self.up = {}
        for d in range(depth - 1, 1, -1):
            # The oldest byte of the context is the highest.
            key = self.levels[d + 1][0] & ((1 << (8 * d + 8)) - 1)
            key, self.up[d + 1], z, o, below = _group(key, self.levels[d + 1][1], self.levels[d + 1][2], pw)
            self.levels[d] = (key, z.astype(np.int64), o.astype(np.int64))
            pw, self.stop[d] = weigh(log_kt(*self.levels[d][1:]), below)
        self.top = (*self.levels[2], pw)

    def estimates(self, rest: np.ndarray, done: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By depth, keys and P(1) where that node is the deepest; from each depth-2 node's ``rest`` and ``done``."""
        out = {}
        for d in range(2, self.depth + 1):
            if d > 2:
                place = self.up[d]
                rest, done = below_rest[place], below_done[place]
            key, z, o = self.levels[d]
            kt = (o + 0.5) / (z + o + 1)
            out[d] = (key, done + rest * kt)
            below_done, below_rest = done + rest * self.stop[d] * kt, rest * (1 - self.stop[d])
        return out

    def symbols(self, deepest: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of each gram's last byte given its context."""
        key, one = deepest
        context, byte, total = self.grams >> 8, self.grams & 255, np.zeros(len(self.grams))
        for b in range(8):
            p = one[np.searchsorted(key, (context << 8) | (1 << b) | (byte >> (8 - b)))]
            total += np.log(np.where((byte >> (7 - b)) & 1 == 1, p, 1 - p))
        return total / LN10


class Top:
    """Depths 0 and 1, from sums over the shards' depth-2 nodes: key (last byte << 8 | bit node), zeros, ones, ln Pw."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        own = log_kt(zeros, ones)
        pw, stop = weigh(own, below)
        node, place, z, o, under = _group(key & 255, zeros, ones, pw)
        z, o = z.astype(np.int64), o.astype(np.int64)
        _, stop0 = weigh(log_kt(z, o), under)
        kt0 = (o + 0.5) / (z + o + 1)
        self.root = np.full(256, 0.5)
        self.root[node] = kt0
        kt1 = (ones + 0.5) / (zeros + ones + 1)
        done, rest = (stop0 * kt0)[place], (1 - stop0)[place]
        #: P(1) where depth 1 is the deepest node; NaN where training never met it.
        self.one = np.full(1 << 16, np.nan)
        self.one[key] = done + rest * kt1
        self.done, self.rest = np.zeros(1 << 16), np.zeros(1 << 16)
        self.done[key], self.rest[key] = done + rest * stop * kt1, rest * (1 - stop)


def build_hash(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table, at most half full, with -1 in empty places."""
    bits = max(4, int(2 * len(keys)).bit_length())
    place, left = _slot(keys, bits), np.arange(len(keys))
    table, out = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
    while len(left):
        free = table[place] == -1
        at, who = place[free], left[free]
        table[at] = keys[who]  # of several, one stays
        won = np.zeros(len(left), bool)
        won[free] = table[at] == keys[who]
        out[place[won]] = values[left[won]]
        left, place = left[~won], (place[~won] + 1) & ((1 << bits) - 1)
    return table, out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Symbols:
    """log10 of bytes after contexts that training met with them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.table, self.values = build_hash(keys, values)
        self.bits = len(self.table).bit_length() - 1

    def log10(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for those not met; places of those not met)."""
        place = _slot(code, self.bits)
        out = self.values[place].astype(np.float64)
        left = np.flatnonzero(self.table[place] != code)
        out[left] = 0
        place, missing = place[left], []
        while len(left):
            at = self.table[place]
            end = at == -1
            missing.append(left[end])
            hit = at == code[left]
            out[left[hit]] = self.values[place[hit]]
            go = ~(end | hit)
            left, place = left[go], (place[go] + 1) & (len(self.table) - 1)
        return out, np.sort(np.concatenate(missing)) if missing else np.zeros(0, np.int64)


def unseen(code: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]], top: Top) -> np.ndarray:
    """log10 of bytes that training never met after their longest context: bit by bit, by the deepest node met.

    ``levels``: a shard's ``estimates``.
    """
    context, byte, total = code >> 8, code & 255, np.zeros(len(code))
    for b in range(8):
        node = (1 << b) | (byte >> (8 - b))
        one = top.one[((context & 255) << 8) | node]
        p = np.where(np.isnan(one), top.root[node], one)
        for d, (keys, ones) in sorted(levels.items()):
            if len(keys):
                key = ((context & ((1 << (8 * d)) - 1)) << 8) | node
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                p = np.where(keys[at] == key, ones[at], p)
        total += np.log(np.where((byte >> (7 - b)) & 1 == 1, p, 1 - p))
    return total / LN10
