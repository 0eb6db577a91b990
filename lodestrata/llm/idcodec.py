"""Adaptive context-mixing range coder for token ids.

Each id is coded in one step from a mixture of three adaptive predictions: the id that followed the last two ids (order
2), the id that followed the last one (order 1), and the counts of the block's ids so far (order 0).  A fourth share
stands for ids without a count, which are written plainly beside the coded words.  The shares are learnt for every pair of
order-1 and order-2 confidences, so each order weighs as much as it has predicted well; they and the counts are taken
anew at set places.  Where both orders predict the same id their shares add up.  The mixture drives a carry-less range
coder.

A segment holds many blocks, each coded from a reset model and with its own CRC-32.  Blocks are coded side by side, one
NumPy lane each, in integer arithmetic only, so any machine reads what another wrote.  Most ids are coded by their counts:
a step does that for all lanes, and then goes over the others.

Segment: ``LSID`` | version u8 | spare u8 | ids u64 | highest id u32 | block size u32 | blocks u32 | per block: ids u32,
32-bit words u32, plain ids u32, CRC-32 of the ids as little-endian u32 | the blocks' words, little-endian u32 | the
blocks' plain ids, little-endian u16, or u32 if the highest id needs it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"LSID", 3
_HEAD, _BLOCK = struct.Struct("<4sBBQIII"), struct.Struct("<IIII")
_U = np.uint64
_BITS = _U(15)  # shares add up to 2 ** 15
_SLOTS = 9  # log2 of the contexts that each order keeps
_SHIFT = _U(64 - _SLOTS)
_HASH, _OLDER = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_TOP, _WORD, _MASK, _NEXT = _U(2**64 - 1), _U(32), _U(2**32 - 1), _U(2**32)
_LARGEST = 1 << 15  # ids in a block: the first place and the number of an id take 16 bits each
_COUNT, _NEW, _TWO, _ONE = range(4)
_FIELD, _PLACE = _U(2**16 - 1), _U(16)
_STEPS = 64  # ids of each lane that are prepared at once


def _retake(t: int) -> bool:
    """Whether counts and shares are taken anew before id ``t`` of a block: at powers of two, then half-way between too."""
    return t >= 16 and (t & (t - 1) == 0 or t > 256 and t == 3 << (t.bit_length() - 2))


def _spans(most: int) -> list[tuple[int, int]]:
    places = [0, *(t for t in range(1, most) if _retake(t)), most]
    return list(zip(places, places[1:]))


class _Counts:
    """Order 0: for each place among a lane's sorted ids so far, the id << 32 | its first place << 16 | its number."""

    def __init__(self, lanes: int, kind: str):
        self.have, self.ids = 0, np.zeros((lanes, 0), kind)
        self._set(np.zeros((lanes, 1), kind))

    def take(self, new: np.ndarray) -> None:
        """Count ``new`` ids too, given by place and lane."""
        self.have += len(new)
        self.ids = np.concatenate([self.ids[: new.shape[1]], new.T], axis=1)
        self.ids.sort(axis=1)
        self._set(self.ids)

    def _set(self, ids: np.ndarray) -> None:
        lanes, self.n = ids.shape
        flat, new = ids.ravel(), np.ones(ids.shape, bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        at = np.flatnonzero(new)
        number = np.diff(at, append=ids.size)
        self.row = np.repeat((flat[at].astype(np.uint64) << _WORD) | (((at % self.n) << 16) | number).astype(np.uint64), number)
        self.base = np.arange(lanes, dtype=np.uint64) * _U(self.n)


def _ranks(ids: np.ndarray) -> np.ndarray:
    """The rank of each id among the distinct ids of its lane, by place and lane."""
    lanes, most = ids.shape
    kind = np.uint32 if ids.max(initial=0) < 2**16 else np.uint64
    out = np.empty((most, lanes), np.int32)
    for lo in range(0, lanes, 128):
        key = (ids[lo : lo + 128].astype(kind) << kind(16)) | np.arange(most, dtype=kind)
        key.sort(axis=1)
        high = key >> kind(16)
        new = np.zeros(key.shape, np.int32)
        np.not_equal(high[:, 1:], high[:, :-1], out=new[:, 1:], casting="unsafe")
        key &= kind(2**16 - 1)
        part = np.empty(key.size, np.int32)
        part[(key + np.arange(0, key.size, most, dtype=kind)[:, None]).ravel()] = np.cumsum(new, axis=1, dtype=np.int32).ravel()
        out[:, lo : lo + 128] = part.reshape(key.shape).T
    return out


class _Shares:
    """Bounds between the shares (ids without a count, order 2, order 1, counts) of each lane and pair of confidences."""

    def __init__(self, lanes: int):
        self.times = np.tile(np.array([64, 128, 32, 32], np.int64), (lanes * 16, 1))
        self._set()

    def take(self, times: np.ndarray) -> None:
        """Learn from how often each share was right since the last place; what was learnt before weighs half."""
        self.times = (self.times[: len(times) // 4] >> 1) + 32 * times.reshape(-1, 4) + 1
        self._set()

    def _set(self) -> None:
        part = np.cumsum(self.times[:, 1:], axis=1)
        bounds = part * ((1 << 15) - 128) // (part[:, 2:] + self.times[:, :1]) + [32, 64, 96]  # none below 1 / 1024
        self.b1, self.b2, self.b3 = (np.ascontiguousarray(bounds[:, i]).astype(np.uint64) for i in range(3))

    def intervals(self) -> np.ndarray:
        """Start << 16 | width of what each of eight cases takes: the kinds, and order 2 where order 1 agrees."""
        b1, b2, b3 = self.b1, self.b2, self.b3
        out = np.zeros((len(b1), 8), np.uint32)
        for case, (low, high) in {_COUNT: (b3, _U(1 << 15)), _NEW: (_U(0), b1), _TWO: (b1, b2), _ONE: (b2, b3), _TWO + 4: (b1, b3)}.items():
            out[:, case] = (low << _PLACE) | (high - low)
        return out.ravel()


class _Tables:
    """What lanes have learnt for orders 1 and 2: id << 4 | confidence (of order 2 two bits higher) by context."""

    def __init__(self, lanes: int, highest: int):
        self.kind = np.uint32 if highest < 2**28 else np.uint64
        self.one, self.two = (np.zeros(lanes << _SLOTS, self.kind) for _ in range(2))
        self.slot, self.row = np.arange(lanes, dtype=np.uint64) << _U(_SLOTS), np.arange(lanes, dtype=np.int64) * 16
        self.steps = [tuple(map(self.kind, x)) for x in ((4, 1, 3), (16, 4, 12))]

    def learn(self, at1, at2, seen1, seen2, ids, hit1, hit2) -> None:
        """Put in ``ids`` (id << 4); one that was predicted gains confidence, up to 3."""
        for table, at, seen, hit, (end, more, most) in zip((self.one, self.two), (at1, at2), (seen1, seen2), (hit1, hit2), self.steps):
            own = seen ^ ids  # the confidence alone, if the id was predicted
            np.less(own, end, out=hit)
            own += more
            np.minimum(own, most, out=own)
            own *= hit
            own |= ids
            table[at] = own


def _settled(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes whose size fell under 2 ** 32, their low end, and that size cut to where the first word is settled."""
    todo = np.flatnonzero(size < _NEXT)
    a = low[todo]
    return todo, a, np.minimum(size[todo], _NEXT - (a & _MASK))


class _Writer:
    def __init__(self, lanes: int, most: int):
        self.width = most + 2
        self.words, self.at = np.zeros(lanes * self.width, np.uint32), np.arange(lanes, dtype=np.int64) * self.width
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, _TOP)

    def put(self, share: np.ndarray, width: np.ndarray, n: np.uint64, first: np.ndarray, number: np.ndarray) -> None:
        """Narrow the first lanes to ``number`` of ``n`` parts, from part ``first``, of ``width`` from ``share``."""
        low, size = self.low[: len(share)], self.size[: len(share)]
        step = size >> _BITS
        low += step * share
        step *= width
        step //= n
        low += step * first
        np.multiply(step, number, out=size)
        todo, a, s = _settled(low, size)
        at = self.at[todo]
        self.words[at] = a >> _WORD
        self.at[todo] = at + 1
        low[todo], size[todo] = a << _WORD, s << _WORD

    def end(self) -> list[np.ndarray]:
        for word in (self.low >> _WORD, self.low & _MASK):
            self.words[self.at] = word
            self.at += 1
        return [self.words[i * self.width : n].copy() for i, n in enumerate(self.at.tolist())]


def _falling(counts: np.ndarray) -> np.ndarray:
    """How many lanes have more than t ids, for each t; counts falls from lane to lane."""
    return np.searchsorted(-counts, -np.arange(int(counts.max(initial=0))), "left")


def _encode_lanes(ids: np.ndarray, counts: np.ndarray, highest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of each lane, and which ids are written plainly."""
    lanes, most = ids.shape
    out, tables, shares = _Writer(lanes, most), _Tables(lanes, highest), _Shares(lanes)
    kind, one, two, ends = tables.kind, tables.one, tables.two, _falling(counts)
    rank = _ranks(ids)
    distinct = int(rank.max(initial=0)) + 1
    rank += np.arange(0, lanes * distinct, distinct, dtype=np.int32)
    number = np.zeros((lanes, distinct), np.uint32)
    plain = np.zeros((most, lanes), bool)
    last, before = np.zeros((2, lanes), np.uint64)
    four = kind(4)
    for begin, end in _spans(most):
        n = _U(max(begin, 1))
        live = int(ends[begin])
        if begin:
            number += np.bincount(rank[was:begin].ravel(), minlength=number.size).reshape(number.shape).astype(np.uint32)
            row = np.cumsum(number, axis=1, dtype=np.uint32)
            row -= number
            row <<= np.uint32(16)
            row |= number
            row = row.ravel()
            shares.take(np.bincount(kinds[: begin - was].ravel(), minlength=lanes * 64)[: live * 64])
        was, cases, kinds = begin, shares.intervals(), np.full((end - begin, live), lanes * 64, np.int32)
        for lo in range(begin, end, _STEPS):
            hi = min(lo + _STEPS, end)
            live = int(ends[lo])
            until = ends[lo:hi]
            x = ids[:live, lo:hi].T.astype(kind, order="C")
            rows = row[rank[lo:hi, :live]] if begin else (x == 0).astype(np.uint32)  # what _Counts starts from
            hashed = np.empty((hi - lo + 2, live), np.uint64)
            hashed[0], hashed[1] = before[:live], last[:live]
            np.multiply(x, _HASH, out=hashed[2:])
            before, last = hashed[-2], hashed[-1]
            at1 = (hashed[1:-1] >> _SHIFT) + tables.slot[:live]
            at2 = ((hashed[:-2] * _OLDER + hashed[1:-1]) >> _SHIFT) + tables.slot[:live]
            at1, at2 = at1.view(np.int64), at2.view(np.int64)
            new = x << four
            seen1, seen2 = np.empty((2, *x.shape), kind)
            hit1, hit2 = np.empty((2, *x.shape), bool)
            for i, some in enumerate(until.tolist()):
                a1, a2, v = at1[i, :some], at2[i, :some], new[i, :some]
                p1, p2 = one.take(a1, out=seen1[i, :some], mode="clip"), two.take(a2, out=seen2[i, :some], mode="clip")
                tables.learn(a1, a2, p1, p2, v, hit1[i, :some], hit2[i, :some])
            ctx = ((seen1 | seen2) & kind(15)).astype(np.int64) + tables.row[:live]
            number_ = rows & np.uint32(0xFFFF)
            right = (number_ == 0).astype(np.int64)  # _COUNT or _NEW
            right[hit1] = _ONE
            right[hit2] = _TWO
            plain[lo:hi, :live] = right == _NEW
            kinds[lo - begin : hi - begin, :live] = (ctx << 2) + right
            other = right != _COUNT
            right[hit1 & hit2] += 4
            ctx <<= 3
            ctx += right
            case = cases[ctx]
            rows[other] = n
            first_, number_ = (rows >> np.uint32(16)).astype(np.uint64), (rows & np.uint32(0xFFFF)).astype(np.uint64)
            share, width = (case >> np.uint32(16)).astype(np.uint64), (case & np.uint32(0xFFFF)).astype(np.uint64)
            for i, some in enumerate(until.tolist()):
                out.put(share[i, :some], width[i, :some], n, first_[i, :some], number_[i, :some])
            if until[-1] < live:  # a lane ends within
                gone = np.arange(live) >= until[:, None]
                plain[lo:hi, :live][gone] = False
    return out.end(), plain


def _decode_lanes(words: np.ndarray, plain: np.ndarray, ends_plain: np.ndarray, counts: np.ndarray, highest: int) -> np.ndarray:
    lanes, most = len(counts), int(counts.max(initial=0))
    tables, shares, order0, ends = _Tables(lanes, highest), _Shares(lanes), _Counts(lanes, plain.dtype), _falling(counts)
    kind, one, two, four = tables.kind, tables.one, tables.two, tables.kind(4)
    ids = np.zeros((most, lanes), plain.dtype)
    width, last_word, flat = words.shape[1], words.size - 1, words.ravel()
    side = np.append(plain, np.zeros(1, plain.dtype))  # damaged blocks may ask for more
    at_side = np.append(0, ends_plain[:-1])
    code = (words[:, 0].astype(np.uint64) << _WORD) | words[:, 1]  # less the low end from here on
    at_word = np.arange(lanes, dtype=np.int64) * width + 2
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, _TOP)
    older, last = np.zeros((2, lanes), np.uint64)
    live, slot, lane_row = lanes, tables.slot, tables.row
    bufs = None
    for begin, end in _spans(most):
        if begin:
            some = int(ends[begin])
            order0.take(ids[order0.have : begin, :some])
            shares.take(times[: some * 64])
        n, top, row, base, b3s = _U(order0.n), _U(order0.n - 1), order0.row, order0.base, shares.b3
        times = np.zeros(int(ends[begin]) * 64, np.int64)
        for lo in range(begin, end, _STEPS):
            hi = min(lo + _STEPS, end)
            kinds = []
            for t in range(lo, hi):
                if ends[t] < live or bufs is None or len(base) > ends[t]:
                    live = int(ends[t])
                    code, low, size, older, last, slot, lane_row, base = (v[:live] for v in (code, low, size, older, last, slot, lane_row, base))
                    bufs = p1, p2 = np.empty((2, live), kind)
                    u1, u2, e3, q, place, got = np.empty((6, live), np.uint64)
                    less = np.empty(live, bool)
                np.right_shift(last, _SHIFT, out=u1)
                u1 += slot
                np.multiply(older, _OLDER, out=u2)
                u2 += last
                u2 >>= _SHIFT
                u2 += slot
                a1, a2 = u1.view(np.int64), u2.view(np.int64)
                one.take(a1, out=p1, mode="clip")
                two.take(a2, out=p2, mode="clip")
                ctx = p1 | p2
                ctx &= kind(15)
                at = ctx.astype(np.int64)
                at += lane_row
                # as if all lanes were coded by counts
                step = size >> _BITS
                np.multiply(step, b3s.take(at, mode="clip"), out=e3)
                np.less(code, e3, out=less)
                others = np.flatnonzero(less)
                np.left_shift(step, _BITS, out=q)
                q -= e3
                q //= n
                if len(others):
                    code_, low_ = code[others], low[others]
                code -= e3
                np.floor_divide(code, q, out=place)
                np.minimum(place, top, out=place)
                place += base
                row.take(place.view(np.int64), out=got, mode="clip")
                low += e3
                np.right_shift(got, _PLACE, out=place)
                place &= _FIELD
                place *= q
                code -= place
                low += place
                np.bitwise_and(got, _FIELD, out=place)
                np.multiply(place, q, out=size)
                got >>= _WORD
                if len(others):
                    step, o1, o2, pair = step[others], p1[others], p2[others], at[others]
                    c1, c2, c3 = shares.b1[pair], shares.b2[pair], shares.b3[pair]
                    part = code_ // step
                    new, id1, id2 = part < c1, o1 >> four, o2 >> four
                    same = id1 == id2
                    c2 = np.where(same, c3, c2)
                    is1 = part >= c2
                    start = np.where(new, _U(0), np.where(is1, c2, c1))
                    q_ = np.where(new, c1, np.where(is1, c3, c2)) - start
                    q_ *= step
                    q_ //= n
                    start *= step
                    code[others], low[others], size[others] = code_ - start, low_ + start, q_ * n
                    x = np.where(is1, id1, id2).astype(np.uint64)
                    fresh = np.flatnonzero(new)
                    if len(fresh):
                        which = others[fresh]
                        from_ = at_side[which]
                        x[fresh] = side[np.minimum(from_, len(side) - 1)]
                        at_side[which] = from_ + 1
                    got[others] = x
                    right = np.where(is1, _ONE, _TWO)
                    right[fresh] = _NEW
                at <<= 2
                if len(others):
                    at[others] += right
                kinds.append(at)
                ids[t, :live] = got
                v = (got << _U(4)).astype(kind)
                tables.learn(a1, a2, p1, p2, v, less, less)
                older, last = last, np.multiply(got, _HASH, out=older)
                todo, a, s = _settled(low, size)
                if len(todo):
                    at_ = at_word[todo]
                    code[todo] = (code[todo] << _WORD) | flat[np.minimum(at_, last_word)]
                    at_word[todo] = at_ + 1
                    low[todo], size[todo] = a << _WORD, s << _WORD
            times += np.bincount(np.concatenate(kinds), minlength=len(times))
    return ids


def block_size(n: int, most: int = 4096) -> int:
    """Small segments get small blocks, so that enough of them run side by side: 2048 down to blocks of 2048 ids, then 512."""
    return int(min(most, max(512, -(-n // 2048), min(2048, -(-n // 512)))))


def encode(ids: np.ndarray, block: int | None = None, lanes: int = 2048) -> bytes:
    """One segment with all ``ids`` (unsigned, below 2**32)."""
    ids = np.ascontiguousarray(ids, "<u4")
    n, block = len(ids), block or block_size(len(ids))
    if block > _LARGEST:
        raise ValueError(f"a block holds at most {_LARGEST} ids")
    highest = int(ids.max(initial=0))
    blocks = -(-n // block)
    counts = np.full(blocks, block, np.int64)
    if n:
        counts[-1] = n - (blocks - 1) * block
    coded, plain, table = [], [], []
    for lo in range(0, blocks, lanes):
        own = counts[lo : lo + lanes]
        grid = ids[lo * block : lo * block + int(own.sum())]
        if len(grid) < len(own) * own[0]:
            grid = np.append(grid, np.zeros(len(own) * own[0] - len(grid), "<u4"))
        grid = grid.reshape(len(own), own[0])
        words, plainly = _encode_lanes(grid, own, highest)
        plainly = np.ascontiguousarray(plainly.T)
        plain.append(grid[plainly].astype(_plain_kind(highest)).tobytes())
        table += [_BLOCK.pack(int(c), len(w), int(p), zlib.crc32(g[:c])) for c, w, p, g in zip(own, words, plainly.sum(axis=1), grid)]
        coded += [w.astype("<u4").tobytes() for w in words]
    return b"".join([_HEAD.pack(MAGIC, VERSION, 0, n, highest, block, blocks), *table, *coded, *plain])


def _plain_kind(highest: int) -> str:
    return "<u2" if highest < 2**16 else "<u4"


def decode(segment: bytes, lanes: int = 2048) -> np.ndarray:
    """All ids of a segment; ``ValueError`` if a block does not match its checksum."""
    magic, version, _, n, highest, block, blocks = _HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token id segment")
    table = np.frombuffer(segment, "<u4", 4 * blocks, _HEAD.size).reshape(blocks, 4).astype(np.int64)
    kind = np.dtype(_plain_kind(highest))
    at = _HEAD.size + _BLOCK.size * blocks + 4 * np.concatenate([[0], np.cumsum(table[:, 1])]).astype(np.int64)
    beside = np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int64)
    if at[-1] + kind.itemsize * beside[-1] != len(segment) or table[:, 0].sum() != n:
        raise ValueError("the segment is cut short")
    plain = np.frombuffer(segment, kind, int(beside[-1]), int(at[-1]))
    out, done = np.empty(n, "<u4"), 0
    for lo in range(0, blocks, lanes):
        part = table[lo : lo + lanes]
        words = np.zeros((len(part), max(2, int(part[:, 1].max()) + 1)), np.uint32)
        for i, length in enumerate(part[:, 1].tolist()):
            words[i, :length] = np.frombuffer(segment, "<u4", length, at[lo + i])
        side = beside[lo : lo + len(part) + 1]
        grid = _decode_lanes(words, plain[side[0] : side[-1]], side[1:] - side[0], part[:, 0], highest).T.astype("<u4", order="C")
        for i, (count, crc) in enumerate(part[:, [0, 3]].tolist()):
            out[done : done + count] = ids = grid[i, :count]
            if zlib.crc32(ids) != crc:
                raise ValueError(f"block {lo + i} does not match its checksum")
            done += count
    return out
