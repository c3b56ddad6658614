"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks that start from nothing and carry a checksum of their own. Within
a block three orders predict the next id: the id that last followed the two ids before
it, the one that last followed the id before it, and the shares of size classes seen so
far. How far the first two are trusted is a mixed probability with weights learned on
the way. One range-coder step codes "the order-2 id", "the order-1 id" or a literal
(class, then the bits below it).

All blocks of a file move in step, one id each, so every operation is one numpy call
over the blocks. Only +, -, *, / touch floating numbers, which makes encoder and
decoder agree bit by bit.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"ctxmix02"
#: Ids in a block. All blocks of a file but the last have as many.
BLOCK = 2048
#: Ids must lie below; an id plus one then has at most 20 bits, as the classes assume.
ID_LIMIT = (1 << 20) - 1

_SLOTS = 2048
_CLASSES = 80
#: Columns of a row of class bounds; those after the last class are never reached.
_BOUNDS = 128
_SURE = 15
_U = np.uint64
_TOP = _U(1 << 48)
_WHOLE = 1 << 16
_CLASS_WHOLE = 4096
_REFRESH = 64
_MASK16 = _U(0xFFFF)
_SHARE_BITS = 12


def _stretches() -> np.ndarray:
    u = np.clip(2.0 * np.arange(1 << _SHARE_BITS) / (1 << _SHARE_BITS) - 1.0, -0.97, 0.97)
    return (u / (1.0 - np.abs(u))).astype(np.float32)


#: A share of hits, in 1/4096, on the scale on which shares are mixed.
_STRETCH = _stretches()


def _class_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, bits below the class, value of those bits) of ids."""
    v = ids.astype(np.int64) + 1
    top = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    extra = np.maximum(top - 2, 0)
    kept = np.where(top >= 2, 2, top)
    cls = 4 * top + ((v >> extra) & ((1 << kept) - 1))
    return cls, extra, v & ((1 << extra) - 1)


_TOPS = np.arange(_CLASSES) // 4
_CLASS_EXTRA = np.maximum(_TOPS - 2, 0)
_CLASS_FIRST = ((1 << np.minimum(_TOPS, 2)) | (np.arange(_CLASSES) % 4)) << _CLASS_EXTRA


class _Model:
    """Predictions of all blocks at their present position.

    A slot holds a predicted id above four bits that say how sure it is; 0 is empty.
    Row 0 of ``slots`` belongs to order 2, row 1 to order 1.
    """

    def __init__(self, blocks: int):
        n = blocks
        self.lane = np.arange(n)
        self.row = self.lane * _SLOTS
        self.slots = np.zeros(2 * n * _SLOTS, dtype=np.int32)
        self.at = np.zeros((2, n), dtype=np.int64)
        self.before1 = np.zeros(n, dtype=np.int64)
        self.before2 = np.zeros(n, dtype=np.int64)
        # Shares of hits: of order 2 and 1 by how sure they are, then of the block.
        middle = 1 << (_SHARE_BITS - 1)
        self.shares = np.full(n * (3 * _SURE + 4), middle, dtype=np.int64)
        self.key = np.zeros((3, n), dtype=np.int64)
        self.key_row = np.stack(
            [
                self.lane * (_SURE + 1),
                n * (_SURE + 1) + self.lane * 2 * (_SURE + 1),
                n * 3 * (_SURE + 1) + self.lane,
            ]
        )
        self.second = np.full(n * (_SURE + 1), 1200, dtype=np.int64)
        self.weights = np.repeat(np.array([[0.5], [0.4], [0.2]], dtype=np.float32), n, axis=1)
        self.freq = np.ones((n, _CLASSES), dtype=np.int64)
        self.cum = np.full((n, _BOUNDS), _CLASS_WHOLE, dtype=np.int64)
        self.cum[:, 0] = 0
        self.steps = 0

    def predict(self) -> None:
        if self.steps % _REFRESH == 0:
            total = np.cumsum(self.freq, axis=1)
            scaled = total * (_CLASS_WHOLE - _CLASSES) // total[:, -1:]
            self.cum[:, 1 : _CLASSES + 1] = scaled + np.arange(1, _CLASSES + 1)
        self.steps += 1
        spread = self.before1 * 40503
        np.add(self.row, ((spread + self.before2 * 30011) >> 3) & (_SLOTS - 1), out=self.at[0])
        np.add(self.row + len(self.lane) * _SLOTS, (spread >> 4) & (_SLOTS - 1), out=self.at[1])
        self.slot = slot = self.slots.take(self.at)
        self.sure = sure = slot & 15
        known = slot >> 4
        self.known = known
        has2, has1 = slot[0] != 0, slot[1] != 0
        self.first = np.where(has2, known[0], known[1])
        self.has_first = has2 | has1
        differ = known[1] != self.first
        self.has_second = has1 & differ
        key = self.key
        np.add(self.key_row[0], sure[0], out=key[0])
        np.add(self.key_row[1], 2 * sure[1] + differ, out=key[1])
        key[2] = self.key_row[2]
        self.second_key = self.key_row[0] + sure[1]
        self.share = self.shares.take(key)
        self.x = _STRETCH.take(self.share)
        parts = self.weights * self.x
        z = parts[0] + parts[1] + parts[2]
        self.p = np.float32(0.5) + np.float32(0.5) * z / (np.float32(1.0) + np.abs(z))
        a = (self.p * np.float32(60000.0)).astype(np.int64) + 64
        self.a = a * self.has_first
        self.second_share = self.second.take(self.second_key)
        # A share below 1 - 1/16 of what is left.
        b = ((_WHOLE - self.a) * self.second_share * 15 >> (_SHARE_BITS + 4)) + 16
        self.b = b * self.has_second

    def learn(
        self, ids: np.ndarray, hit_first: np.ndarray, hit_second: np.ndarray,
        literal: np.ndarray, cls: np.ndarray,
    ) -> None:
        """``cls`` are the classes of the blocks ``literal``, which had no hit."""
        error = (hit_first - self.p) * self.has_first * np.float32(0.02)
        self.weights += error * self.x
        moved = ((hit_first.astype(np.int64) << _SHARE_BITS) - hit_first - self.share) >> 4
        self.shares[self.key] = self.share + moved * self.has_first
        tried = self.has_second & ~hit_first
        moved = ((hit_second.astype(np.int64) << _SHARE_BITS) - hit_second - self.second_share) >> 4
        self.second[self.second_key] = self.second_share + moved * tried
        self.freq.reshape(-1)[literal * _CLASSES + cls] += 24
        slot, sure = self.slot, self.sure
        fresh = ((ids << 4) | 1).astype(np.int32)
        kept = np.where(sure > 1, slot - ((sure + 1) >> 1), fresh)
        # An empty slot of id 0 counts as right and becomes what ``fresh`` is.
        self.slots[self.at] = np.where(self.known == ids, slot + (sure < _SURE), kept)
        self.before2, self.before1 = self.before1, ids.astype(np.int64)


def _unsettled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Where a word is decided, or the span has become too small to go on."""
    return ((low ^ (low + span)) < _TOP) | (span < _TOP)


def _shortened(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The spans of unsettled blocks, cut where that decides the next word."""
    return np.where((low ^ (low + span)) < _TOP, span, (_U(0) - low) & (_TOP - _U(1)))


def _encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Payloads of the rows of ``ids``, all of one length."""
    n, steps = ids.shape
    model = _Model(n)
    low, span = np.zeros(n, dtype=_U), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=_U)
    # A step narrows the span by less than 49 bits, so by at most four words of 16 bits.
    words = np.zeros((n, steps * 4 + 8), dtype="<u2")
    flat, at = words.reshape(-1), model.lane * words.shape[1]
    # Turned, so that the ids of one step lie together.
    turned = np.ascontiguousarray(ids.T)
    for t in range(steps):
        now = turned[t]
        model.predict()
        first = (now == model.first) & model.has_first
        second = (now == model.known[1]) & model.has_second & ~first
        a, b = model.a, model.b
        cum = np.where(first, 0, np.where(second, a, a + b))
        freq = np.where(first, a, np.where(second, b, _WHOLE - a - b))
        span >>= _U(16)
        low += cum.view(_U) * span
        span *= freq.view(_U)
        which = np.flatnonzero(~(first | second))
        cls, extra, bits = _class_of(now.take(which))
        bound = which * _BOUNDS + cls
        start, end = model.cum.take(bound), model.cum.take(bound + 1)
        inner = span.take(which) >> _U(12)
        low[which] += start.view(_U) * inner
        inner = (inner * (end - start).view(_U)) >> extra.view(_U)
        low[which] += bits.view(_U) * inner
        span[which] = inner
        out = np.flatnonzero(_unsettled(low, span))
        while len(out):
            l, place = low.take(out), at.take(out)
            s = _shortened(l, span.take(out)) << _U(16)
            flat[place] = l >> _U(48)
            at[out] = place + 1
            l <<= _U(16)
            low[out], span[out] = l, s
            out = out[_unsettled(l, s)]
        model.learn(now, first, second, which, cls)
    for _ in range(4):
        flat[at] = (low >> _U(48)).astype(np.uint16)
        at += 1
        low <<= _U(16)
    used = at - model.lane * words.shape[1]
    return [words[i, :k].tobytes() for i, k in enumerate(used.tolist())]


def _decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    n = len(payloads)
    model = _Model(n)
    sizes = np.array([len(p) // 2 for p in payloads])
    starts = np.cumsum(sizes) - sizes
    # Words beyond a block's end are never decisive; zeros keep the reads in range.
    source = np.concatenate([np.frombuffer(b"".join(payloads), dtype="<u2"), np.zeros(8, "<u2")])
    last = len(source) - 1
    at = starts.copy()
    low, span, code = np.zeros(n, dtype=_U), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=_U), np.zeros(n, dtype=_U)
    for _ in range(4):
        code = (code << _U(16)) | source[np.minimum(at, last)].astype(_U)
        at += 1
    turned = np.zeros((steps, n), dtype=np.int32)
    for t in range(steps):
        model.predict()
        a, b = model.a, model.b
        span >>= _U(16)
        v = np.minimum((code - low) // np.maximum(span, _U(1)), _MASK16).view(np.int64)
        first = v < a
        second = ~first & (v < a + b)
        cum = np.where(first, 0, np.where(second, a, a + b))
        freq = np.where(first, a, np.where(second, b, _WHOLE - a - b))
        low += cum.view(_U) * span
        span *= freq.view(_U)
        now = np.where(first, model.first, model.known[1])
        which = np.flatnonzero(~(first | second))
        inner = span.take(which) >> _U(12)
        v = (code.take(which) - low.take(which)) // np.maximum(inner, _U(1))
        v = np.minimum(v, _U(_CLASS_WHOLE - 1)).view(np.int64)
        row = which * _BOUNDS
        bound = row.copy()
        for half in (64, 32, 16, 8, 4, 2, 1):
            bound += half * (model.cum.take(bound + half) <= v)
        cls = bound - row
        start, end = model.cum.take(bound), model.cum.take(bound + 1)
        less = low.take(which) + start.view(_U) * inner
        extra = _CLASS_EXTRA.take(cls)
        inner = (inner * (end - start).view(_U)) >> extra.view(_U)
        top = (1 << extra) - 1
        bits = np.minimum((code.take(which) - less) // np.maximum(inner, _U(1)), top.view(_U))
        low[which] = less + bits * inner
        span[which] = inner
        now[which] = _CLASS_FIRST.take(cls) + bits.view(np.int64) - 1
        move = np.flatnonzero(_unsettled(low, span))
        while len(move):
            l, place = low.take(move), at.take(move)
            s = _shortened(l, span.take(move)) << _U(16)
            code[move] = (code.take(move) << _U(16)) | source.take(place)
            at[move] = np.minimum(place + 1, last)
            l <<= _U(16)
            low[move], span[move] = l, s
            move = move[_unsettled(l, s)]
        model.learn(now, first, second, which, cls)
        turned[t] = now
    return np.ascontiguousarray(turned.T)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of ``ids`` (whole numbers from 0, below ID_LIMIT).

    Layout, little-endian: magic, number of ids (u64), ids per block (u32), number of
    blocks (u32), then for each block its size in bytes and the crc32 of its ids as u32
    (u32 each), then the payloads.
    """
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= ID_LIMIT):
        raise ValueError(f"ids must lie in [0, {ID_LIMIT})")
    steps = max(1, min(block, len(ids)))
    blocks = -(-len(ids) // steps)
    padded = np.zeros(blocks * steps, dtype=np.int64)
    padded[: len(ids)] = ids
    payloads = _encode_blocks(padded.reshape(blocks, steps)) if blocks else []
    raw = ids.astype("<u4")
    heads = [
        struct.pack("<II", len(p), zlib.crc32(raw[i * steps : (i + 1) * steps].tobytes()))
        for i, p in enumerate(payloads)
    ]
    return b"".join([MAGIC, struct.pack("<QII", len(ids), steps, blocks), *heads, *payloads])


def decode(file: bytes) -> np.ndarray:
    """The ids of a file as uint32; raises ValueError where a block is damaged."""
    if file[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n, steps, blocks = struct.unpack_from("<QII", file, 8)
    heads = np.frombuffer(file, dtype="<u4", count=2 * blocks, offset=24).reshape(blocks, 2)
    ends = 24 + 8 * blocks + np.cumsum(heads[:, 0].astype(np.int64))
    if blocks == 0:
        return np.zeros(0, dtype="<u4")
    if len(file) != ends[-1]:
        raise ValueError(f"file of {len(file)} bytes; its blocks end at {ends[-1]}")
    payloads = [file[e - s : e] for e, s in zip(ends.tolist(), heads[:, 0].tolist(), strict=True)]
    ids = _decode_blocks(payloads, steps).reshape(-1)[:n].astype("<u4")
    for i, crc in enumerate(heads[:, 1].tolist()):
        if zlib.crc32(ids[i * steps : (i + 1) * steps].tobytes()) != crc:
            raise ValueError(f"checksum of block {i} differs")
    return ids
