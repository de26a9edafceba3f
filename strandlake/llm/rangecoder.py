"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from nothing, so each can be read alone. In a
block, the last id seen after the two ids before (order 2) and after the one
before (order 1) are candidates, each with a record of how often it was right in
a row. The chances of both candidates follow from how often candidates of their
records were right in the block so far, mixed in the logistic domain: one set of
weights where they agree, others where they differ. An id that is neither is
coded by order 0: the counts of its class so far (classes are as wide as their
ids are high) and its place in the class.

The three chances of an id are nested into one interval, so the range coder
takes one step for each id. Chances and weights learn at the end of each stretch
of ``STRETCH`` ids, which a numpy pass does for many blocks at once; candidates
and the coder move id by id. All arithmetic is on whole numbers, so that encoder
and decoder agree everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 4096
#: Blocks that one pass codes side by side, about: passes are made equal, since a small one takes nearly as long.
LANES = 1024
STRETCH = 256
#: Places of a stretch that are worked on together, so that what they take stays in the cache.
_SOME = 16
MAGIC = b"SLB3"

_ORDER1, _ORDER2 = 512, 1024  # slots of the candidates' tables
_FLAG = 10  # bits of a candidate's chance
_COUNTED = 11  # bits of order 0's total
_TAIL = 10  # bits of a place in the widest class
_BITS = _FLAG + _COUNTED + _TAIL  # of the total of an id's nested chances
_DEEP = _COUNTED + _TAIL
_REST = (1 << 32) - 1
_TOTAL = float(1 << _BITS)
_CODE = 48  # bits of the code in hand; the range keeps 32 of them at least, one more than the total has
_FLOOR = 4
_RENEWED = 512
_CLASSES = 256
_CASES = 32  # whether the candidates differ, and either one's record (0 to 3)
#: Ids below the first number of a pair are in classes of as many bits as the second.
_WIDTHS = [(256, 2), (1024, 3), (8192, 8), (1 << 17, _TAIL)]

_X = np.arange((1 << 12) + 1)
#: 256 times the logit of a chance of so many 4096ths, and back to 1024ths.
_LOGIT = np.round(256 * np.log(np.clip(_X, 1, 4095) / (4096 - np.clip(_X, 1, 4095)))).astype(np.int64)
_CHANCE = np.clip(np.round((1 << _FLAG) / (1 + np.exp(-np.arange(-2048, 2048) / 256))), _FLOOR, (1 << _FLAG) - _FLOOR).astype(np.int64)
#: The next record of a candidate that held 1, 2 or 3 and was right (places 1 to 3), or of a new one.
_RECORD = np.array([1, 2, 3, 3, 1], np.int32)
_S1, _S2, _SAME = np.arange(_CASES) >> 2 & 3, np.arange(_CASES) & 3, np.arange(_CASES) < 16


def _by_record() -> np.ndarray:
    """Sums what was seen by case to how often candidates of order 1 and order 2 of each record were right, and how often there were such."""
    out = np.zeros((_CASES, 3, 2, 2, 4))
    for case in range(_CASES):
        out[case, :, 0, 1, _S1[case]] = out[case, :, 1, 1, _S2[case]] = 1
        out[case, 0 if _SAME[case] else 1, 0, 0, _S1[case]] = out[case, 0, 1, 0, _S2[case]] = 1
    return out.reshape(3 * _CASES, -1)


_BY_RECORD = _by_record()


def _class_table(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, and each class's first id and bits."""
    of, base, bits = np.zeros(vocabulary, np.int64), [], []
    at = 0
    for upto, width in _WIDTHS:
        while at < min(upto, vocabulary):
            of[at : at + (1 << width)] = len(base)
            base.append(at)
            bits.append(width)
            at += 1 << width
    if len(base) > _CLASSES or at < vocabulary:
        raise ValueError(f"a vocabulary of {vocabulary} is too large for this format")
    return of, np.array(base, np.int64), np.array(bits, np.int64)


class _Model:
    """What the blocks of a pass have learnt, as of their last stretch."""

    def __init__(self, lanes: int, bits: np.ndarray, reading: bool) -> None:
        classes = len(bits)
        self.lanes, self.classes, self.bits, self.reading = lanes, classes, bits, reading
        self.seen = np.zeros((lanes, _CASES, 3))  # by case: candidate of order 2 right, that of order 1, neither
        self.weights = np.tile(np.array([[20_000, 50_000, -5_000, 65_000, 65_000, -5_000]], np.int64), (lanes, 1))
        self.counts = np.zeros((lanes, classes + 1), np.int64)  # the last stands for candidates
        self.codes, self.found = np.zeros((STRETCH, lanes), np.int32), np.zeros((STRETCH, lanes), np.int32)
        self.lane_code, self.lane_class = np.arange(lanes) * (3 * _CASES), np.arange(lanes) * (classes + 1)
        self._mix()
        self.renew()

    def _mix(self) -> None:
        """For each block and case: where the shares of the candidates of order 2 and order 1 end, of all ``_TOTAL``."""
        half = _CASES // 2
        by_record = (self.seen.reshape(self.lanes, -1) @ _BY_RECORD).astype(np.int64).reshape(self.lanes, 2, 2, 4)
        x1, x2 = (_LOGIT[((4 * by_record[:, i, 0] + 2) << 12) // (4 * by_record[:, i, 1] + 5)] for i in (0, 1))
        x1[:, 0] = x2[:, 0] = 0
        x1, x2 = x1.take(_S1[:half], axis=1), x2.take(_S2[:half], axis=1)  # the same whether the candidates differ or not
        w = self.weights[:, :, None]
        chance = lambda a, b: _CHANCE.take(np.clip((a * x1 + b * x2) >> 16, -2048, 2047) + 2048)
        one = 1 << _FLAG
        self.p2 = np.concatenate([chance(w[:, 0], w[:, 1]), chance(w[:, 2], w[:, 3])], 1)
        self.p1 = chance(w[:, 4], w[:, 5])  # only where they differ
        f2 = self.p2 * (_S2 > 0)
        upto = f2.copy()
        upto[:, half:] += np.maximum(1, ((one - f2[:, half:]) * self.p1) >> _FLAG) * (_S1[half:] > 0)
        self.x1, self.x2 = x1, x2
        self.end2, self.end1 = (f2 << _DEEP).astype(float).ravel(), (upto << _DEEP).astype(float).ravel()

    def renew(self) -> None:
        """Take up the classes' counts: begin and size of each class in order 0's total, and the class of each place of it."""
        total = 1 << _COUNTED
        room = total - self.classes
        counts = self.counts[:, : self.classes]
        n = counts.sum(1, keepdims=True)
        # whole numbers in floating point; quotients of such small ones are far enough from the next one to be rounded down
        size = counts * float(room)
        size /= np.maximum(n, 1)
        size[(n == 0).ravel()] = room // self.classes
        np.floor(size, out=size)
        size += 1
        size[:, 0] += total - size.sum(1)
        begin = np.cumsum(size, 1)
        begin -= size
        #: Begin of each class and size of each place in it, side by side, which one look-up brings.
        pair = np.empty((*size.shape, 2), np.float32)
        np.multiply(begin, 1 << _TAIL, out=pair[:, :, 0], casting="same_kind")
        np.multiply(size, 1 << (_TAIL - self.bits), out=pair[:, :, 1], casting="same_kind")
        self.pair = pair.ravel().view(np.float64)
        if self.reading:
            self.of = np.repeat(np.tile(np.arange(self.classes, dtype=np.uint8), self.lanes), size.astype(np.int64).ravel())

    def learn(self, upto: int, first: int, sizes: np.ndarray) -> None:
        """Take in the stretch from place ``first`` to ``upto``; ``sizes`` are the blocks' own."""
        n = upto - first
        codes, found = (self.codes[:n] + self.lane_code).ravel(), (self.found[:n] + self.lane_class).ravel()
        if sizes[-1] < upto:
            inside = (np.arange(first, upto)[:, None] < sizes[None, :]).ravel()
            codes, found = codes[inside], found[inside]
        now = np.bincount(codes, minlength=self.lanes * 3 * _CASES).reshape(self.lanes, _CASES, 3)
        self.seen += now
        self.counts += np.bincount(found, minlength=self.counts.size).reshape(self.counts.shape)
        half = _CASES // 2
        first2, total = now[:, :, 0], now.sum(2)
        error2 = (first2 << _FLAG) - total * self.p2
        error1 = (now[:, half:, 1] << _FLAG) - (total - first2)[:, half:] * self.p1
        # a record of 0 has a logit of 0 itself; the other candidate's pull is left out there too
        error2 *= _S2 > 0
        error1 *= _S1[half:] > 0
        for i, (error, x) in enumerate((e, x) for e in (error2[:, :half], error2[:, half:], error1) for x in (self.x1, self.x2)):
            self.weights[:, i] += np.einsum("lc,lc->l", error, x) >> 10
        np.clip(self.weights, -131_072, 131_072, out=self.weights)
        self._mix()
        if upto % _RENEWED == 0 or upto in (STRETCH, 3 * STRETCH):
            self.renew()


def _slots(before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the contexts of an id: the one before, and the two before."""
    return (last * 40_503 >> 4) & (_ORDER1 - 1), ((before * 50_021 + last * 30_011) >> 3) & (_ORDER2 - 1)


def _written(sizes: np.ndarray, vocabulary: int, ids: np.ndarray) -> list[bytes]:
    """Code blocks of the given sizes side by side; ``ids`` is (places, blocks)."""
    lanes, longest = len(sizes), len(ids)
    of, base, bits = _class_table(vocabulary)
    model = _Model(lanes, bits, False)
    lane = np.arange(lanes)
    held = np.zeros(lanes * (_ORDER1 + _ORDER2), np.int32)  # (id + 1) * 4 + record, all blocks' slots of order 1 first
    now = (ids + 1).astype(np.int64)
    low, span, at = np.zeros(lanes, np.int64), np.full(lanes, 1 << _CODE, np.int64), lane.copy()
    words = np.zeros((2 * longest + 8) * lanes, np.uint32)  # a block's words stand below each other
    e, slots, old = np.zeros((STRETCH, 2, lanes), np.int32), np.zeros((STRETCH, 2, lanes), np.int64), np.zeros((2, lanes), np.int32)
    start, size = np.zeros((STRETCH, lanes), np.int64), np.zeros((STRETCH, lanes), np.int64)
    lane_slot = np.array([lane * _ORDER1, lane * _ORDER2 + lanes * _ORDER1])
    lane_case, lane_class = lane * _CASES, lane * model.classes
    zero, sixteen, every = np.zeros((1, lanes), np.int64), np.full(lanes, 16, np.int64), np.full(lanes, lanes, np.int64)
    for first in range(0, longest, STRETCH):
        upto = min(first + STRETCH, longest)
        n = upto - first
        own = now[first:upto]
        last = np.concatenate([now[first - 1 : first] if first else zero, own[:-1]])
        before = np.concatenate([now[first - 2 : first - 1] if first else zero, last[:-1]])
        slots[:n, 0], slots[:n, 1] = _slots(before, last)
        slots[:n] += lane_slot
        whole = (own << 2).astype(np.int32)
        for t in range(n):
            held.take(slots[t], out=e[t], mode="clip")
            np.subtract(e[t], whole[t], out=old)
            np.minimum(old.view(np.uint32), 4, out=old.view(np.uint32))
            held[slots[t]] = _RECORD.take(old) + whole[t]
        for x in range(0, n, _SOME):
            y = min(x + _SOME, n)
            a, b = e[x:y, 0], e[x:y, 1]
            case = ((a & 3) << 2) + (b & 3)
            case += ((a ^ b) > 3).astype(np.int32) << 4
            at_case = case + lane_case
            end2, end1 = model.end2.take(at_case), model.end1.take(at_case)
            hit2 = ((b >> 2) == own[x:y]) & (end2 > 0)
            hit1 = ((a >> 2) == own[x:y]) & ~hit2 & (end1 > end2)
            hit = hit2 | hit1
            kind = of.take(own[x:y] - 1)
            model.codes[x:y] = case * 3 + np.where(hit2, 0, np.where(hit1, 1, 2))
            model.found[x:y] = np.where(hit, model.classes, kind)
            pair = model.pair.take(kind + lane_class).view(np.float32)
            begin, step = pair[:, ::2], pair[:, 1::2]
            none = (_TOTAL - end1) * (1.0 / (1 << _DEEP))
            start[x:y] = np.where(hit, end2 * ~hit2, end1 + none * (begin + (own[x:y] - 1 - base.take(kind)) * step.astype(float)))
            size[x:y] = np.where(hit, np.where(hit2, end2, end1 - end2), none * step)
        for t in range(n):
            k = int(np.searchsorted(-sizes, -(first + t), "left")) if sizes[-1] <= first + t else lanes  # blocks longer than this place
            unit = span[:k] >> _BITS
            code = low[:k] + unit * start[t, :k]
            wide = unit * size[t, :k]
            small = wide < 1 << 32
            words[at[:k]] = code >> (_CODE - 16)  # written over where it isn't left behind
            code = np.where(small, (code & _REST) << 16, code)
            wide <<= small * sixteen[:k]
            at[:k] += small * every[:k]
            again = np.flatnonzero(wide < 1 << 32)
            while len(again):
                words[at[again]] = code[again] >> (_CODE - 16)
                code[again] = (code[again] & _REST) << 16
                wide[again] <<= 16
                at[again] += lanes
                again = again[wide[again] < 1 << 32]
            low[:k], span[:k] = code, wide
        model.learn(upto, first, sizes)
    for shift in range(_CODE - 16, -1, -16):
        words[at] = (low >> shift) & (0xFFFF if shift < _CODE - 16 else 0x1FFFF)
        at += lanes
    n = at // lanes
    words = words.reshape(-1, lanes)[: int(n.max())]
    for j in range(len(words) - 1, 0, -1):  # carries run back through the words only now
        words[j - 1] += words[j] >> 16
        words[j] &= 0xFFFF
    words = np.ascontiguousarray(words.T.astype("<u2"))
    return [words[i, : n[i]].tobytes() for i in range(lanes)]


def _read(sizes: np.ndarray, vocabulary: int, words: np.ndarray) -> np.ndarray:
    """The ids (places, blocks) of blocks of the given sizes, longest first; ``words`` is (words, blocks)."""
    lanes, longest = len(sizes), int(sizes.max())
    _, base, bits = _class_table(vocabulary)
    first_of = base + 1.0
    model = _Model(lanes, bits, True)
    lane = np.arange(lanes)
    lane_case, lane_class, lane_of = lane * _CASES, lane * model.classes, (lane << _COUNTED).astype(float)
    lane_slot = np.array([lane * _ORDER1, lane * _ORDER2 + lanes * _ORDER1])
    held = np.zeros(lanes * (_ORDER1 + _ORDER2), np.int32)  # as the writer has them
    ids = np.zeros((longest, lanes), np.int32)
    # whole numbers below 2**53 in floating point: their sums, products and rounded quotients are exact
    low, span = np.zeros(lanes), np.full(lanes, float(1 << _CODE))
    for j in range(_CODE // 16):
        low = low * 65_536 + words[j]
    flat = words.ravel()
    at = lane + _CODE // 16 * lanes
    most = flat.size - lanes + lane
    seen, kinds = np.zeros((STRETCH, lanes), np.int32), np.zeros((STRETCH, lanes), np.uint8)
    right2, neither = np.zeros((STRETCH, lanes), bool), np.zeros((STRETCH, lanes), bool)
    part, one, wide = 1.0 / (1 << _BITS), 1.0 / (1 << _DEEP), 1.0 / (1 << _TAIL)
    # every step writes to the same arrays, which stay in the cache
    e, old, slot = np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32), lane_slot.copy()
    unsigned = old.view(np.uint32)
    whole, other, before = (np.zeros(lanes, np.int32) for _ in range(3))
    words_now = np.zeros(lanes, np.uint32)
    end2, end1, unit, place, none, inner, tail, begun, pair, word = (np.zeros(lanes) for _ in range(10))
    where, step_at, small, differ = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, bool), np.zeros(lanes, bool)
    begin, step = pair.view(np.float32)[::2], pair.view(np.float32)[1::2]
    for first in range(0, longest, STRETCH):
        upto = min(first + STRETCH, longest)
        for t in range(upto - first):
            case, hit2, escape, kind = seen[t], right2[t], neither[t], kinds[t]
            held.take(slot, out=e, mode="clip")
            np.bitwise_and(e, 3, out=old)
            np.left_shift(old[0], 2, out=case)
            case += old[1]
            np.bitwise_xor(e[0], e[1], out=other)
            np.greater(other, 3, out=differ)
            np.left_shift(differ, 4, out=other, dtype=np.int32)
            case += other
            np.add(case, lane_case, out=where)
            model.end2.take(where, out=end2, mode="clip")
            model.end1.take(where, out=end1, mode="clip")
            np.multiply(span, part, out=unit)
            np.floor(unit, out=unit)
            np.divide(low, unit, out=place)
            np.floor(place, out=place)
            np.minimum(place, _TOTAL - 1, out=place)
            np.less(place, end2, out=hit2)
            np.greater_equal(place, end1, out=escape)
            np.subtract(_TOTAL, end1, out=none)
            none *= one
            np.subtract(place, end1, out=inner)
            inner /= none
            np.floor(inner, out=inner)
            # below 0 where a candidate is right, and then of no use
            np.multiply(inner, wide, out=tail)
            tail += lane_of
            np.copyto(where, tail, casting="unsafe")
            model.of.take(where, out=kind, mode="clip")
            np.add(kind, lane_class, out=where)
            model.pair.take(where, out=pair, mode="clip")
            np.subtract(inner, begin, out=tail)
            tail /= step
            np.floor(tail, out=tail)
            first_of.take(kind, out=begun, mode="clip")
            begun += tail
            now = np.where(hit2, e[1], e[0])
            now >>= 2
            np.copyto(now, begun, where=escape, casting="unsafe")
            # where the id's share begins, and how large it is
            tail *= step
            tail += begin
            tail *= none
            tail += end1
            np.logical_not(hit2, out=differ)
            np.multiply(end2, differ, out=begun)
            moved = np.where(escape, tail, begun)
            moved *= unit
            low -= moved
            none *= step
            np.subtract(end1, begun, out=end1)  # of the candidate of order 1, whose share follows that of order 2
            moved = np.where(escape, none, np.where(hit2, end2, end1))
            np.multiply(unit, moved, out=span)
            np.less(span, 4_294_967_296.0, out=small)
            flat.take(at, out=words_now, mode="clip")  # a damaged block may ask for more words than there are
            np.multiply(small, 65_535.0, out=moved)
            moved += 1.0
            low *= moved
            span *= moved
            np.multiply(words_now, small, out=word)
            low += word
            np.multiply(small, lanes, out=step_at)
            at += step_at
            np.less(span, 4_294_967_296.0, out=small)
            again = np.flatnonzero(small)
            while len(again):
                low[again] = low[again] * 65_536.0 + flat.take(np.minimum(at[again], most[again]))
                span[again] = np.maximum(span[again], 1.0) * 65_536.0
                at[again] += lanes
                again = again[span[again] < 4_294_967_296.0]
            np.subtract(now, 1, out=ids[first + t])
            np.left_shift(now, 2, out=whole)
            np.subtract(e, whole, out=old)
            np.minimum(unsigned, 4, out=unsigned)
            _RECORD.take(old, out=e, mode="clip")
            e += whole
            held[slot] = e
            # only low bits of the products count, so that they may run over
            np.multiply(now, 40_503, out=old[0])
            old[0] >>= 4
            old[0] &= _ORDER1 - 1
            np.multiply(now, 30_011, out=old[1])
            old[1] += before
            old[1] >>= 3
            old[1] &= _ORDER2 - 1
            np.add(old, lane_slot, out=slot)
            np.multiply(now, 50_021, out=before)
        n = upto - first
        model.codes[:n] = seen[:n] * 3 + np.where(neither[:n], 2, ~right2[:n])
        model.found[:n] = np.where(neither[:n], kinds[:n], model.classes)
        model.learn(upto, first, sizes)
    return ids


def _passes(n: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, n, max(1, round(n / LANES)) + 1).astype(int).tolist()
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Payload of each block of ids: magic, number of ids, their CRC-32, vocabulary, then the coder's words."""
    done: list[bytes] = [b""] * len(blocks)
    for s, e in _passes(len(blocks)):
        order = sorted(range(s, e), key=lambda i: -len(blocks[i]))
        sizes = np.array([len(blocks[i]) for i in order], np.int64)
        coded: list[bytes] = [b""] * len(order)
        if sizes.max():
            ids = np.zeros((len(order), int(sizes.max())), np.int32)
            for j, i in enumerate(order):
                ids[j, : sizes[j]] = blocks[i]
            coded = _written(sizes, vocabulary, np.ascontiguousarray(ids.T))
        for j, i in enumerate(order):
            done[i] = MAGIC + struct.pack("<III", len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()), vocabulary) + coded[j]
    return done


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload; a wrong magic or checksum raises ValueError."""
    done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    heads = []
    for p in payloads:
        if p[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        heads.append(struct.unpack("<III", p[4:16]))
    groups: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h[2], []).append(i)
    for vocabulary, members in groups.items():
        for s, e in _passes(len(members)):
            order = sorted(members[s:e], key=lambda i: -heads[i][0])
            sizes = np.array([heads[i][0] for i in order], np.int64)
            if not sizes.max():
                continue
            words = np.zeros((len(order), max(len(payloads[i]) for i in order) // 2 + 4), np.uint32)
            for j, i in enumerate(order):
                own = np.frombuffer(payloads[i], "<u2", offset=16)
                words[j, : len(own)] = own
            with np.errstate(all="ignore"):  # a damaged block's numbers may grow out of range
                ids = _read(sizes, vocabulary, np.ascontiguousarray(words.T)).T
            for j, i in enumerate(order):
                done[i] = ids[j, : sizes[j]]
    for i, (n, crc, _) in enumerate(heads):
        if len(done[i]) != n or zlib.crc32(np.ascontiguousarray(done[i]).astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids fails its checksum")
    return done
