"""A context-mixing range coder for token ids, in independent checksummed blocks.

A block's ids are coded in epochs of growing size. Within an epoch the model is fixed: of every context (the last two ids:
order 2; the last id: order 1; none: order 0) it has the ids that followed it so far and how often. An id's chance is a
mixture of the three distributions. Its weights depend on what orders 1 and 2 know of their contexts (how often seen, how
many different ids followed), and are learned from how well each order has predicted in that joint state so far. When an
epoch ends, its ids are added to all counts. An arithmetic coder codes each id by its order's part of the mixture: order 2
where its context has been followed by the id before, else order 1 likewise, else order 0, which knows every id.

The ids of an epoch are dealt to up to 2 ** `LANE_BITS` coders, each a run of neighbours, so that a step of all coders is
one array operation; the first two ids of a run have shorter contexts. All arithmetic is on whole numbers, so any machine decodes
what another wrote.

Format of a block (little-endian): magic `DLB2`, crc32 of the rest, then number of ids, lanes, id bound, length of the
deflated word counts of the lanes, these, and the lanes' 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"DLB2"
TOTAL_BITS = 28
TOTAL = 1 << TOTAL_BITS
LEAST = 1 << 21  # the least part of the total that an order gets, and the most that counts add up to
FIRST_EPOCH, GROWTH = 1 << 12, 3  # an epoch is a 1/GROWTH of what precedes it, and not less than the first
LANE_BITS, STEPS = 10, 32  # a lane gets STEPS ids of an epoch at least
CONTEXT_BITS = 19
MAX_IDS = MAX_BOUND = 1 << 20
U = np.uint64
LOW32, WORD = U(0xFFFFFFFF), U(1 << 32)
#: Whole logarithm of a count.
SIZE = np.repeat(np.arange(16, dtype=np.int32), [2, *(1 << np.arange(1, 16))])
STATES = 64


def epochs(n: int) -> list[int]:
    """Where the epochs of n ids end."""
    out, at = [], 0
    while at < n:
        at = min(n, at + max(FIRST_EPOCH, at // GROWTH))
        out.append(at)
    return out


def _runs(key: np.ndarray) -> np.ndarray:
    """First places of runs of equal entries."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


class Order:
    """What followed the contexts of one order: entries (context, id), sorted, with counts; and a table of the contexts.

    A row of the table has a context's first entry, how often it was seen, its state (below STATES: how often seen, how many
    different ids) and a mark of the context. Contexts of two ids share slots by hash; of several the last one is known.
    """

    def __init__(self, bits: int, slots: int, hashed: bool):
        self.bits, self.hashed = bits, hashed
        self.entry, self.count, self.total = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int32)
        self.rows = np.zeros((slots, 4), np.int32)
        self.found = None

    def _place(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
        if not self.hashed:
            return context, 0
        h = context.astype(U) * U(0x9E3779B97F4A7C15)
        return (h >> U(64 - CONTEXT_BITS)).astype(np.int64), (h & U(0x7FFFFFFF)).astype(np.int32) | np.int32(1)

    def look(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry, number and state of each context; 0 of an unknown one."""
        slot, mark = self._place(context)
        rows = self.rows.take(slot, axis=0)
        if not self.hashed:
            return rows[:, 0], rows[:, 1], rows[:, 2]
        known = rows[:, 3] == mark
        return rows[:, 0], rows[:, 1] * known, rows[:, 2] * known

    def find(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each (context, id), and whether there is one; kept for add()."""
        key = (context << self.bits) | ids
        order = np.argsort(key)
        key = key[order]
        place = np.searchsorted(self.entry, key)
        held = self.entry[np.minimum(place, len(self.entry) - 1)] == key if len(self.entry) else np.zeros(len(key), bool)
        self.found = key, place, held
        at, ok = np.empty(len(key), np.int64), np.empty(len(key), bool)
        at[order], ok[order] = place, held
        return at, ok

    def add(self, context: np.ndarray, ids: np.ndarray) -> None:
        if self.found is None:
            key = np.sort((context << self.bits) | ids)
            place = np.searchsorted(self.entry, key)
            held = self.entry[np.minimum(place, len(self.entry) - 1)] == key if len(self.entry) else np.zeros(len(key), bool)
        else:
            key, place, held = self.found
            self.found = None
        at = _runs(key)
        n = np.diff(np.r_[at, len(key)]).astype(np.int32)
        place, held = place[at], held[at]
        self.count[place[held]] += n[held]
        new = ~held
        spot = place[new] + np.arange(int(new.sum()))
        old = np.ones(len(self.entry) + len(spot), bool)
        old[spot] = False
        entry, count = np.empty(len(old), np.int64), np.empty(len(old), np.int32)
        entry[spot], count[spot] = key[at][new], n[new]
        entry[old], count[old] = self.entry, self.count
        self.entry, self.count = entry, count
        self.total = np.zeros(len(entry) + 1, np.int32)
        np.cumsum(count, out=self.total[1:])
        owner = entry >> self.bits
        first = _runs(owner)
        seen, kinds = np.diff(self.total[np.r_[first, len(owner)]]), np.diff(np.r_[first, len(owner)])
        size = SIZE[np.minimum(seen, 65535)]
        slot, mark = self._place(owner[first])
        rows = np.empty((len(first), 4), np.int32)
        rows[:, 0], rows[:, 1], rows[:, 3] = first, seen, mark
        step = size if self.hashed else size >> 1  # contexts of two ids are seen less often
        rows[:, 2] = np.minimum(step, 7) * 8 + np.minimum(2 * (size - SIZE[np.minimum(kinds, 65535)]) + (4 * kinds < 3 << SIZE[np.minimum(kinds, 65535)]), 7)
        self.rows[slot] = rows


class Model:
    """What both sides know; fixed within an epoch. Contexts are made of ids below bound, or of bound for none."""

    def __init__(self, bound: int):
        self.bound, self.bits = bound, bound.bit_length()
        self.two, self.one = Order(self.bits, 1 << CONTEXT_BITS, True), Order(self.bits, bound + 1, False)
        self.counts = np.zeros(bound, np.int64)
        # how often each order was used by joint state; at first order 2 and order 1 are trusted alike
        self.used = np.zeros((STATES * STATES, 3), np.int64) + np.array([2, 2, 1])
        self._fix()

    def _fix(self) -> None:
        weight = min(32, (1 << 20) // max(1, int(self.counts.sum())))
        self.zero = np.r_[0, np.cumsum(1 + self.counts * weight)]
        share = self.used * (TOTAL - 3 * LEAST) // self.used.sum(1, keepdims=True) + LEAST
        self.part = share[:, :2].astype(U)

    def mix(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """First entries and numbers of orders 2 and 1, the joint state, and the parts of orders 2 and 1."""
        lo2, n2, s2 = self.two.look((before << self.bits) | last)
        lo1, n1, s1 = self.one.look(last)
        state = s2 * STATES + s1
        part = self.part.take(state, axis=0)
        # an order that knows nothing leaves its part to order 0
        return lo2, n2, lo1, n1, state, part[:, 0] * (n2 > 0), part[:, 1] * (n1 > 0)

    def learn(self, before: np.ndarray, last: np.ndarray, ids: np.ndarray, state: np.ndarray, level: np.ndarray) -> None:
        """Adds a finished epoch; level: the order that coded each id, as 0 for order 2 up to 2 for order 0."""
        self.counts += np.bincount(ids, minlength=self.bound)
        self.two.add((before << self.bits) | last, ids)
        self.one.add(last, ids)
        self.used += np.bincount(state * 3 + level, minlength=3 * STATES * STATES).reshape(-1, 3)
        self._fix()


class Grid:
    """How an epoch's ids are dealt to lanes: runs of neighbours, laid out step by step."""

    def __init__(self, n: int, lanes: int):
        self.steps = max(min(STEPS, n), -(-n // lanes))
        self.size, self.n = -(-n // self.steps), n

    def laid(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(self.steps * self.size, U)
        out[: self.n] = x
        return np.ascontiguousarray(out.reshape(self.size, self.steps).T)

    def back(self, x: np.ndarray) -> np.ndarray:
        return x.T.reshape(-1)[: self.n]

    def lanes_at(self, step: int) -> int:
        """Lanes with an id at a step: all, but for the last one beyond its end."""
        return self.size - (step >= self.n - (self.size - 1) * self.steps)

    def before(self, ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The two ids before each; those of another lane count as none."""
        last, before = np.r_[bound, ids[:-1]], np.r_[bound, bound, ids[:-2]][: len(ids)]
        last[:: self.steps] = before[:: self.steps] = before[1 :: self.steps] = bound
        return before, last


def _lanes(n: int) -> int:
    return 1 << max(0, min(LANE_BITS, max(1, n).bit_length() - 9))


def _thin(low: np.ndarray, span: np.ndarray, k: int) -> np.ndarray:
    """Lanes whose interval has got narrow; one across a boundary of the upper word is cut there, so no carry is ever due."""
    thin = np.flatnonzero(span[:k] < WORD)
    span[thin] = np.minimum(span[thin], WORD - (low[thin] & LOW32))
    return thin


def encode(ids: np.ndarray) -> bytes:
    """A block of at most MAX_IDS ids (whole numbers from 0, below MAX_BOUND)."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    bound = int(ids.max()) + 1 if n else 1
    if bound > MAX_BOUND or n > MAX_IDS:
        raise ValueError("too many ids, or too large ones")
    lanes, model, start = _lanes(n), Model(bound), 0
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    out, size = np.zeros((lanes, -(-n // lanes) + 64), np.uint32), np.zeros(lanes, np.int64)
    for end in epochs(n):
        x = ids[start:end]
        g = Grid(len(x), lanes)
        before, last = g.before(x, bound)
        lo2, n2, lo1, n1, state, w2, w1 = model.mix(before, last)
        i2, ok2 = model.two.find((before << model.bits) | last, x)
        i1, ok1 = model.one.find(last, x)
        # of the orders that know the id, the one whose part of the mixture gives it most
        share = np.stack([np.where(ok, w, 0) * (order.count[np.minimum(i, len(order.count) - 1)] if len(order.count) else 0) / np.maximum(m, 1) for order, i, ok, w, m in ((model.two, i2, ok2, w2, n2), (model.one, i1, ok1, w1, n1))])
        share = np.vstack([share, (TOTAL - w2 - w1) * (model.zero[x + 1] - model.zero[x]) / model.zero[-1]])
        level = share.argmax(axis=0)
        base, w, total, c, f = w2 + w1, U(TOTAL) - w2 - w1, np.full(len(x), model.zero[-1]), model.zero[x], model.zero[x + 1] - model.zero[x]
        for lev, order, i, lo, m, left, width in ((0, model.two, i2, lo2, n2, None, w2), (1, model.one, i1, lo1, n1, w2, w1)):
            me = np.flatnonzero(level == lev)
            at = i[me]
            base[me], w[me], total[me] = U(0) if left is None else left[me], width[me], m[me]
            c[me], f[me] = order.total[at] - order.total[lo[me]], order.count[at] if len(order.count) else 0
        base, w, total, c, f = map(g.laid, (base, w, total.astype(U), c.astype(U), f.astype(U)))
        for t in range(g.steps):
            k = g.lanes_at(t)
            r = span[:k] >> U(TOTAL_BITS)
            low[:k] += r * base[t, :k]
            r = r * w[t, :k] // total[t, :k]
            low[:k] += r * c[t, :k]
            span[:k] = r * f[t, :k]
            thin = _thin(low, span, k)
            if len(thin):
                out[thin, size[thin]] = low[thin] >> U(32)
                size[thin] += 1
                low[thin] <<= U(32)
                span[thin] <<= U(32)
                if int(size[thin].max()) + 1 >= out.shape[1]:
                    out = np.concatenate([out, np.zeros_like(out)], axis=1)
        model.learn(before, last, x, state, level)
        start = end
    # the next multiple of a word lies in the interval; what follows it is read as zeros
    out[np.arange(lanes), size] = (low + LOW32) >> U(32)
    sizes = zlib.compress(size.astype("<u4").tobytes(), 9)
    body = struct.pack("<QIII", n, lanes, bound, len(sizes)) + sizes + np.concatenate([o[: m + 1] for o, m in zip(out, size)]).astype("<u4").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; a damaged block raises ValueError."""
    body = memoryview(block)[8:]
    if block[:4] != MAGIC or struct.unpack("<I", block[4:8])[0] != zlib.crc32(body):
        raise ValueError("the block is damaged")
    n, lanes, bound, deflated = struct.unpack("<QIII", body[:20])
    size = np.frombuffer(zlib.decompress(body[20 : 20 + deflated]), "<u4").astype(np.int64) + 1
    words = np.append(np.frombuffer(body[20 + deflated :], "<u4"), np.uint32(0)).astype(U)
    until = np.cumsum(size)
    at = until - size + 1
    model, start, ids = Model(bound), 0, np.zeros(n, np.int64)
    mask, none = (1 << model.bits) - 1, len(words) - 1
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    code = (words[at - 1] << U(32)) | words[np.where(at < until, at, none)]
    at += 1
    for end in epochs(n):
        g = Grid(end - start, lanes)
        grid, states, levels = (np.zeros((g.steps, g.size), np.int64) for _ in range(3))
        before = last = np.full(g.size, bound, np.int64)
        zero_total = U(model.zero[-1])
        for t in range(g.steps):
            k = g.lanes_at(t)
            before, last = before[:k], last[:k]
            lo2, n2, lo1, n1, state, w2, w1 = model.mix(before, last)
            r = span[:k] >> U(TOTAL_BITS)
            d = code[:k] - low[:k]
            both = w2 + w1
            not2, not1 = d >= r * w2, d >= r * both
            level = not2.astype(np.int64) + not1
            x, skip, wide = np.empty(k, np.int64), np.empty(k, U), np.empty(k, U)
            for lev, order, lo, m, left, width in ((0, model.two, lo2, n2, None, w2), (1, model.one, lo1, n1, w2, w1), (2, None, None, None, both, None)):
                me = np.flatnonzero(level == lev)
                if not len(me):
                    continue
                rr = r[me]
                off = U(0) if left is None else rr * left[me]
                one = rr * (U(TOTAL) - left[me] if width is None else width[me]) // (zero_total if m is None else m[me].astype(U))
                v = ((d[me] - off) // one).astype(np.int64)
                if order is None:
                    v = np.searchsorted(model.zero, v, side="right") - 1
                    x[me], c, f = v, model.zero[v], model.zero[v + 1] - model.zero[v]
                else:
                    first = order.total[lo[me]]
                    i = np.searchsorted(order.total, first + v.astype(np.int32), side="right") - 1
                    x[me], c, f = order.entry[i] & mask, order.total[i] - first, order.count[i]
                skip[me], wide[me] = off + one * c.astype(U), one * f.astype(U)
            low[:k] += skip
            span[:k] = wide
            thin = _thin(low, span, k)
            if len(thin):
                code[thin] = (code[thin] << U(32)) | words[np.where(at[thin] < until[thin], at[thin], none)]
                at[thin] += 1
                low[thin] <<= U(32)
                span[thin] <<= U(32)
            grid[t, :k], states[t, :k], levels[t, :k] = x, state, level
            before, last = last, x
        x = g.back(grid)
        model.learn(*g.before(x, bound), x, g.back(states), g.back(levels))
        ids[start:end] = x
        start = end
    return ids
