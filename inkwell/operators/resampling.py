"""Statistics of resamples of series, block by block of replicates.

A resample is the numbers of times that its points were drawn: with the points' places by x and by y known, ranks are running sums of
those numbers, and concordant pairs running sums within each bit of the x. So a resample costs one pass over its points, or one
per bit, without a sort and without rows of its own. A task has one series and some of its replicates; what is shuffled are the
points, once for each block. Draws are those of ``trends.replicates``: MD5 of the same text, for many points at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.global_sort import partitions

#: Draws of a block of replicates, blocks of a series at most, and draws that a task makes at a time.
BLOCK_DRAWS, MOST_BLOCKS, AT_ONCE = 500_000, 24, 1 << 20
#: Texts hashed in one go: the arrays of a round stay in the cache.
HASHED = 1 << 14

_K = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_48(words: list, n: int) -> np.ndarray:
    """The first 48 bits of the MD5 of ``n`` padded texts, given as 16 little-endian words a block, each one number or an array."""
    word = lambda v: np.full(n, v, np.uint32)
    state = [word(v) for v in _START]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = 7 * i % 16
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            m = words[at + g]
            np.add(f, a, out=f)
            if isinstance(m, np.ndarray):
                np.add(f, m, out=f)
                np.add(f, np.uint32(_K[i]), out=f)
            else:
                np.add(f, np.uint32((int(m) + _K[i]) & 0xFFFFFFFF), out=f)
            np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=a)  # a's place takes the new b
            a, b, c, d = d, a, b, c
        state = [np.add(s, v) for s, v in zip(state, (a, b, c, d), strict=True)]
    high = state[0].byteswap().astype(np.int64)
    return (high << 16) | (state[1].byteswap() >> np.uint32(16)).astype(np.int64)


def _classes(lo: int, hi: int) -> list[tuple[int, int, int]]:
    """[lo, hi) cut where the number of digits changes: from, to, digits."""
    out = []
    while lo < hi:
        digits = len(str(lo))
        out.append((lo, min(hi, 10**digits), digits))
        lo = out[-1][1]
    return out


def draws(prefix: str, replicates: tuple[int, int], n: int) -> np.ndarray:
    """For each replicate r of [from, to) and each place i below n, the first 48 bits of the MD5 of ``prefix|r|i`` as a whole number."""
    out = np.empty((replicates[1] - replicates[0], n), np.int64)
    head = prefix.encode() + b"|"
    for r0, r1, rd in _classes(*replicates):
        for i0, i1, digits in _classes(0, n):
            length = len(head) + rd + 1 + digits
            padded = bytearray(-(-(length + 9) // 64) * 64)
            padded[: len(head)] = head
            padded[len(head) + rd], padded[length] = ord("|"), 0x80
            padded[-8:] = (8 * length).to_bytes(8, "little")
            fixed = np.frombuffer(bytes(padded), "<u4")
            wide = i1 - i0
            some = max(1, HASHED // wide)
            for r in range(r0, r1, some):
                upto = min(r1, r + some)
                for i in range(i0, i1, HASHED):
                    last = min(i1, i + HASHED)
                    rs, places = np.repeat(np.arange(r, upto, dtype=np.uint32), last - i), np.tile(np.arange(i, last, dtype=np.uint32), upto - r)
                    words: list = [int(w) for w in fixed]
                    for value, count, end in ((rs, rd, len(head) + rd), (places, digits, length)):
                        for k in range(count):
                            byte = end - 1 - k
                            digit = (value // np.uint32(10**k) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (byte % 4))
                            words[byte // 4] = digit + (words[byte // 4] if isinstance(words[byte // 4], np.ndarray) else np.uint32(words[byte // 4]))
                    out[r - replicates[0] : upto - replicates[0], i:last] = _md5_48(words, len(rs)).reshape(upto - r, last - i)
    return out


class Series:
    """Points in the order of x, then y, as places 0.. of their x (``xs``) and y (``ys``) among the different ones."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray) -> None:
        self.xs, self.ys, self.n = xs.astype(np.int64), ys.astype(np.int64), len(xs)
        self.kinds_x, self.kinds_y = int(self.xs.max()) + 1, int(self.ys.max()) + 1
        self._levels: list | None = None

    def rho(self, count: np.ndarray) -> float | None:
        """The rank correlation where each point counts ``count`` times."""
        sides = []
        for ids, kinds in ((self.xs, self.kinds_x), (self.ys, self.kinds_y)):
            c = np.bincount(ids, count, kinds)
            upto = np.cumsum(c)
            sides.append((upto - (c - 1) / 2.0 - (upto[-1] + 1) / 2.0, c))
        (rx, cx), (ry, cy) = sides
        vx, vy = float(cx @ (rx * rx)), float(cy @ (ry * ry))
        return float((count * rx[self.xs]) @ ry[self.ys]) / float(np.sqrt(vx * vy)) if vx > 0 and vy > 0 else None

    def _ties(self, count: np.ndarray, ids: np.ndarray) -> int:
        c = np.bincount(ids, count).astype(np.int64)
        return int((c * (c - 1) // 2).sum())

    def _told(self, n: int, concordant: int, tx: int, ty: int, both: int) -> tuple:
        return concordant, n * (n - 1) // 2 - tx - ty + both - concordant, tx - both, ty - both, both

    def levels(self) -> list:
        """Per bit of the x: the points by what is above the bit, then y, then 1 before 0; which have a 0; where each part starts."""
        if self._levels is None:
            self._levels = []
            for b in range(max(1, (self.kinds_x - 1).bit_length())):
                high, one = self.xs >> (b + 1), (self.xs >> b) & 1
                order = np.argsort((high * self.kinds_y + self.ys) * 2 + 1 - one, kind="stable")
                high = high[order]
                self._levels.append((order.astype(np.int32), (1 - one[order]).astype(float), np.flatnonzero(np.append(True, high[1:] != high[:-1]))))
        return self._levels

    def pairs(self, count: np.ndarray) -> tuple:
        """Concordant, discordant, tied_x, tied_y and tied_both pairs where each point counts ``count`` times. Two x differ first in one
        bit; a point with a 1 there counts those with a 0 and a smaller y, among the points that agree above the bit."""
        count = count.astype(float)
        concordant = 0
        for order, zero, starts in self.levels():
            c = count[order]
            below = c * zero
            upto = np.cumsum(below)
            above = c - below
            concordant += int(above @ upto) - int(np.add.reduceat(above, starts) @ (upto[starts] - below[starts]))
        n = int(count.sum())
        return self._told(n, concordant, self._ties(count, self.xs), self._ties(count, self.ys), self._ties(count, np.cumsum(np.append(0, (np.diff(self.xs) != 0) | (np.diff(self.ys) != 0)))))

    def moved_pairs(self, order: np.ndarray) -> tuple:
        """The same where the xs stay and the ys take the order ``order``. Parts that agree above a bit are the same stretches of the
        xs each time, so that sorting their ys tells how many of those with a 0 lie below those with a 1."""
        ys, concordant = self.ys[order], 0
        for b in range((self.kinds_x - 1).bit_length()):
            high, zero = self.xs >> (b + 1), 1 - ((self.xs >> b) & 1)
            key = np.sort((high * self.kinds_y + ys) * 2 + zero)  # 1 before 0 among equal ys
            zero_sorted = key & 1
            upto = np.cumsum(zero_sorted)
            zeros, ones = np.bincount(high, zero), np.bincount(high, 1 - zero)
            concordant += int((upto * (1 - zero_sorted)).sum()) - int((np.cumsum(zeros) - zeros) @ ones)
        same = np.sort(self.xs * self.kinds_y + ys)
        c = np.diff(np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1], [True]])))
        one = np.ones(self.n)
        return self._told(self.n, concordant, self._ties(one, self.xs), self._ties(one, self.ys), int((c * (c - 1) // 2).sum()))


PAIRS = ("concordant", "discordant", "tied_x", "tied_y", "tied_both")


def resampled(df: DataFrame, group: str, tag: str, times: int, rho: bool = False, pairs: bool = False, shuffled: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """(group, r, n, rho, concordant, discordant, tied_x, tied_y, tied_both): the statistics of each series (r = 0, always both) and, for
    series of three points or more, of its ``times`` resamples (r from 1) as ``trends.replicates`` draws them: with ``rho`` the rank
    correlation, with ``pairs`` the counts of pairs. A series' points are one task's for some of its replicates, in some 40 bytes
    a point and bit of the x."""
    w = Window.partitionBy(group)
    ids = lambda *by: (F.dense_rank().over(w.orderBy(*by)) - 1).cast("int")
    p = df.select(F.col(group), ids(x).alias("__x"), ids(y).alias("__y"), F.count(F.lit(1)).over(w).alias("__n"))
    blocks = F.least(F.lit(min(times, MOST_BLOCKS)), F.greatest(F.lit(1), F.ceil(F.col("__n") * times / BLOCK_DRAWS))).cast("int")
    each = p.select(group, F.col(group).cast("string").alias("__key"), "__x", "__y", blocks.alias("__of"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__block"))
    # a fixed number of partitions: they hold few bytes but much work
    spread = each.repartition(max(partitions(df), MOST_BLOCKS), group, "__block")

    def run(t: pa.Table) -> pa.Table:
        xs, ys = (t.column(c).to_numpy() for c in ("__x", "__y"))
        order = np.lexsort((ys, xs))
        s = Series(xs[order], ys[order])
        block, of, key = (t.column(c)[0].as_py() for c in ("__block", "__of", "__key"))
        prefix = tag if key is None else f"{tag}|{key}"
        rows = []
        if block == 0:
            one = np.ones(s.n)
            rows.append((0, s.rho(one), *s.pairs(one)))
        if s.n >= 3:
            first, end = (1 + times * k // of for k in (block, block + 1))
            step = max(1, AT_ONCE // s.n)
            for r in range(first, end, step):
                for k, drawn in enumerate(draws(prefix, (r, min(end, r + step)), s.n)):
                    if shuffled:
                        moved = np.argsort(drawn, kind="stable")
                        rows.append((r + k, None, *s.moved_pairs(moved)))
                        continue
                    count = np.bincount(drawn % s.n, minlength=s.n)
                    rows.append((r + k, s.rho(count) if rho else None, *(s.pairs(count) if pairs else [None] * 5)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int32(), pa.float64(), *[pa.int64()] * 5]
        r, v, *counts = (pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))
        keys = pa.chunked_array([t.column(group).combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))], t.schema.field(group).type)
        return pa.Table.from_arrays([keys, r, pa.array(np.full(len(rows), s.n)), v, *counts], names=[group, "r", "n", "rho", *PAIRS])

    kind = df.schema[group].dataType.simpleString()
    return spread.groupBy(group, "__block").applyInArrow(run, f"`{group}` {kind}, r int, n bigint, rho double, " + ", ".join(f"{c} bigint" for c in PAIRS))
