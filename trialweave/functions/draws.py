"""Reproducible draws: the first 32 bits of an MD5 over a text key, the same in any engine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

ARM_COUNTS = StructType().add("o", LongType()).add("o1", LongType()).add("c1", LongType())


def u32(*parts: Column) -> Column:
    """A number in [0, 2^32) from the parts joined by ``|``."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def index(n: Column | int, *parts: Column) -> Column:
    """A draw with replacement from 0..n−1."""
    return F.pmod(u32(*parts), n if isinstance(n, Column) else F.lit(n))


def units(count: int, *parts: Column) -> list[Column]:
    """``count`` (at most four) independent numbers in [0, 1), 32 bits each, from one hash of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for k in range(count)]


_FOUR = np.frombuffer("".join(f"{k:04d}" for k in range(10_000)).encode(), "<u4")
_POWERS = 10 ** np.arange(1, 19, dtype=np.int64)
_SINES = [int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64)]
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
#: So many texts are hashed at once: their words stay in a core's cache.
AT_ONCE = 1 << 16


class Texts:
    """Texts of one length, from left to right as little-endian words of four bytes: a word is an array, or a number where all are alike."""

    def __init__(self, start: bytes = b""):
        self.words, self.size = [], 0
        self.same(start)

    def put(self, word: int | np.ndarray, size: int) -> Texts:
        """Add the first ``size`` (at most four) bytes of ``word``; its other bytes are zero."""
        at, shift = divmod(8 * self.size, 32)
        self.words += [0] * (-(-(self.size + size) // 4) - len(self.words))
        many = isinstance(word, np.ndarray)
        self.words[at] = self.words[at] | (word << np.uint32(shift) if many else (word << shift) & 0xFFFFFFFF)
        if shift + 8 * size > 32:
            self.words[at + 1] = word >> (np.uint32(32 - shift) if many else 32 - shift)
        self.size += size
        return self

    def same(self, text: bytes) -> Texts:
        for k in range(0, len(text), 4):
            self.put(int.from_bytes(text[k : k + 4], "little"), len(text[k : k + 4]))
        return self

    def number(self, x: np.ndarray, digits: int) -> Texts:
        """Add whole numbers that all have so many digits."""
        for left in range(digits - 1 - (digits - 1) % 4, -1, -4):
            size = min(4, digits - left)
            self.put(_FOUR[(x // 10**left if left else x) % 10_000] >> np.uint32(8 * (4 - size)), size)
        return self

    def take(self, rows) -> Texts:
        out = Texts()
        out.words, out.size = [w[rows] if isinstance(w, np.ndarray) else w for w in self.words], self.size
        return out

    def hashes(self, n: int, count: int = 1) -> list[np.ndarray]:
        """The first ``count`` (at most four) numbers of 32 bits of the MD5 of each of the ``n`` texts, as ``u32`` has them."""
        return _hash_all(self.padded(), n, count)

    def padded(self) -> list:
        whole = self.take(slice(None)).put(0x80, 1).words
        return whole + [0] * (-(len(whole) + 2) % 16) + [(8 * self.size) & 0xFFFFFFFF, (8 * self.size) >> 32]


def _hash_all(whole: list, n: int, count: int) -> list[np.ndarray]:
    out = [np.empty(n, np.uint32) for _ in range(count)]
    if n:
        edges = np.linspace(0, n, -(-n // AT_ONCE) + 1).astype(int).tolist()
        room = np.empty((6, -(-n // (len(edges) - 1))), np.uint32)
        for a, b in zip(edges, edges[1:], strict=False):
            found = _md5([w[a:b] if isinstance(w, np.ndarray) else w for w in whole], room[:, : b - a], count)
            for x, y in zip(out, found, strict=False):
                y.byteswap(inplace=True)
                x[a:b] = y
    return out


def _md5(words: list, room: np.ndarray, count: int) -> list[np.ndarray]:
    """The four words of the MD5 of padded texts, all texts at once (RFC 1321), in ``room``; the first alone if ``count`` is 1."""
    state = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d, f, t = room
    for at in range(0, len(words), 16):
        for x, y in zip((a, b, c, d), state, strict=True):
            x[:] = y
        last = count == 1 and at + 16 == len(words)
        for k in range(61 if last else 64):  # the first word is there after 61 steps
            if k < 16:
                place = k
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif k < 32:
                place = (5 * k + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif k < 48:
                place = (3 * k + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                place = 7 * k % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            word = words[at + place]
            if isinstance(word, np.ndarray):
                np.add(f, word, out=f)
                word = 0
            np.add(f, np.uint32((_SINES[k] + word) & 0xFFFFFFFF), out=f)
            np.left_shift(f, np.uint32(_TURNS[k]), out=t)
            np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            b += state[0] if isinstance(state[0], np.ndarray) else np.uint32(state[0])
            return [b]
        for x, y in zip((a, b, c, d), state, strict=True):
            x += y if isinstance(y, np.ndarray) else np.uint32(y)
        if at + 16 < len(words):
            state = [x.copy() for x in (a, b, c, d)]
    return [a, b, c, d]


def digits(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POWERS, x, side="right") + 1


def alike(*numbers: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Rows whose numbers have the same digit counts, and these counts."""
    sizes = [digits(x) for x in numbers]
    code = np.zeros(len(numbers[0]), np.int64)
    for s in sizes:
        code = code * 20 + s
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(rows):
            yield rows, [int(s[rows[0]]) for s in sizes]


def hashes(count: int, n: int, *parts: bytes | np.ndarray) -> list[np.ndarray]:
    """``u32`` (and the next 32 bits) of ``n`` rows of parts: bytes are the same in all rows, arrays hold numbers from 0."""
    out = [np.empty(n, np.uint32) for _ in range(count)]
    few: list[tuple[np.ndarray, list]] = []
    for rows, sizes in alike(*[p for p in parts if isinstance(p, np.ndarray)]):
        t, size = Texts(), iter(sizes)
        for k, p in enumerate(parts):
            t.same(b"|" if k else b"")
            if isinstance(p, np.ndarray):
                t.number(p[rows], next(size))
            else:
                t.same(p)
        if len(rows) < AT_ONCE // 4 and t.size < 56:  # texts of other lengths join them
            few.append((rows, t.padded()))
            continue
        for x, y in zip(out, t.hashes(len(rows), count), strict=False):
            x[rows] = y
    if few:
        rows = np.concatenate([r for r, _ in few])
        words = [np.concatenate([np.full(len(r), w[k], np.uint32) if not isinstance(w[k], np.ndarray) else w[k] for r, w in few]) if any(isinstance(w[k], np.ndarray) or w[k] for _, w in few) else 0 for k in range(16)]
        for x, y in zip(out, _hash_all(words, len(rows), count), strict=False):
            x[rows] = y
    return out


def trial_counts(tag: bytes, places: tuple[np.ndarray, ...], o: np.ndarray, o1: np.ndarray, c: np.ndarray, c1: np.ndarray) -> list[np.ndarray]:
    """Of each session's trials, all drawn again by a hash of its place and the trial's number: stimulated ones, right ones of these, right ones of the rest."""
    out = [np.zeros(len(o), np.int64) for _ in range(3)]
    for rows, sizes in alike(*places):
        t = Texts(tag)
        for x, size in zip(places, sizes, strict=True):
            t.same(b"|").number(x[rows], size)
        t.same(b"|")
        n = (o + c)[rows]
        for length in range(1, int(digits(np.array([max(n.max() - 1, 0)]))[0]) + 1):
            first = 10 ** (length - 1) if length > 1 else 0
            at = np.flatnonzero(n > first)
            many = np.minimum(n[at], 10**length) - first
            ends = np.cumsum(many)
            for a in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                b = min(a + AT_ONCE, int(ends[-1]))
                s, z = np.searchsorted(ends, [a, b - 1], side="right").tolist()
                begin = ends[s : z + 1] - many[s : z + 1]
                here = np.minimum(ends[s : z + 1], b) - np.maximum(begin, a)
                k = np.arange(first + a, first + b) - np.repeat(begin, here)
                local = np.repeat(np.arange(z + 1 - s), here)
                own = at[s : z + 1]
                mine = rows[own]
                u = t.take(own).take(local).number(k, length).hashes(b - a)[0].astype(np.int64) % n[own][local]
                on = u < o[mine][local]
                off = u - o[mine][local]
                for x, hit in zip(out, (on, u < o1[mine][local], ~on & (off < c1[mine][local])), strict=True):
                    x[mine] += np.bincount(local[hit], minlength=len(own))
    return out


@lru_cache(maxsize=50_000)
def binomial_table(n: int, a: int, b: int) -> tuple[int, np.ndarray]:
    """The first count that is tabled and the cumulative probabilities from there, for ``n`` draws of ``a`` in ``b``.

    Only counts within 12 standard deviations of the mode are tabled: the others have far less than the 2^-32 grain of a draw. The
    table grows with the root of ``n``.
    """
    if n <= 0 or a <= 0 or a >= b:
        return (n if 0 < b <= a else 0), np.ones(1)
    p = a / b
    reach, mode = 12 * (n * p * (1 - p)) ** 0.5 + 20, (n + 1) * p
    low, high = max(0, int(np.floor(mode - reach))), min(n, int(np.ceil(mode + reach)))
    k = np.arange(low + 1, high + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) * a / (k * (b - a))))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low, mass / mass[-1]


def binomial_quantiles(n: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of ``n`` draws with chance ``a`` / ``b`` hit, for each uniform ``u``."""
    if len(n) and max(n.max(), a.max(), b.max()) < 1 << 21 and min(n.min(), a.min(), b.min()) >= 0:  # one number is sorted faster than three
        packed, which = np.unique((n << 42) | (a << 21) | b, return_inverse=True)
        sizes = np.stack([packed >> 42, (packed >> 21) & 0x1FFFFF, packed & 0x1FFFFF], axis=1)
    else:
        sizes, which = np.unique(np.stack([n, a, b], axis=1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(sizes)))
    out = np.zeros(len(n), dtype=np.int64)
    for size, rows in zip(sizes.tolist(), np.split(order, ends[:-1]), strict=False):
        low, upto = binomial_table(*size)
        out[rows] = low + np.minimum(np.searchsorted(upto, u[rows], side="right"), len(upto) - 1)
    return out


class Binomials:
    """Tables of the distinct sizes (``n`` draws of ``a`` in ``b``) of some rows: any of them is inverted for a draw of 32 bits."""

    def __init__(self, n: np.ndarray, a: np.ndarray, b: np.ndarray):
        sizes, which = np.unique(np.stack([n, a, b], axis=1), axis=0, return_inverse=True)
        tables = [binomial_table(*x) for x in sizes.tolist()]
        self.which, self.low = which.ravel(), np.array([low for low, _ in tables], dtype=np.int64)
        self.size = np.array([len(upto) for _, upto in tables], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.upto = np.concatenate([(k << 33) + np.ceil(upto * float(1 << 32)).astype(np.int64) for k, (_, upto) in enumerate(tables)])

    def draw(self, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        """How many hit, for the sizes of ``rows`` and their numbers from 0 to 2^32 − 1."""
        k = self.which[rows]
        return self.low[k] + np.minimum(np.searchsorted(self.upto, (k << 33) + u, side="right") - self.first[k], self.size[k] - 1)


@F.pandas_udf(LongType())
def binomial(n: pd.Series, a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
    """A binomial count per row, inverted from the uniform ``u``; rows are independent and nothing is shuffled."""
    return pd.Series(binomial_quantiles(*(x.to_numpy(dtype=np.int64) for x in (n, a, b)), u.to_numpy(dtype=float)))


def arm_quantiles(o: np.ndarray, o1: np.ndarray, c: np.ndarray, c1: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    on = binomial_quantiles(o + c, o, o + c, u)
    return [on, binomial_quantiles(on, o1, o, v), binomial_quantiles(o + c - on, c1, c, w)]


@F.pandas_udf(ARM_COUNTS)
def arm_counts(o: pd.Series, o1: pd.Series, c: pd.Series, c1: pd.Series, u: pd.Series, v: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Counts of a session whose trials are drawn again with their labels: stimulated trials, right ones of these, right ones of the rest."""
    counts = arm_quantiles(*(x.to_numpy(dtype=np.int64) for x in (o, o1, c, c1)), *(x.to_numpy(dtype=float) for x in (u, v, w)))
    return pd.DataFrame(dict(zip(("o", "o1", "c1"), counts, strict=True)))
