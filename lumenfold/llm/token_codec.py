"""Adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

A block holds up to BLOCK_TOKENS ids and starts from a fresh model, so any block decodes alone. Its header carries the
sorted distinct ids (delta varints) and the CRC-32 of the ids; ids are coded as ranks in that list. Three models predict
each id: the last id seen after the previous two (order 2, hashed), after the previous one (order 1), and running
frequencies (order 0). They are mixed into one distribution of 2^24: an order's point prediction weighs as much as its
predictions of that confidence (was the context's last one right?) have been right so far in the block, order 1 shares
what order 2 leaves (both together where they agree), and order 0 spreads the rest over all ids of the block. Weights and
frequencies are taken anew after FIRST_REFRESH ids and then each time the number of ids has doubled. The distribution
drives a range coder with a 64-bit range, 32-bit digits and carries. All lanes of a batch advance one id per step in
NumPy; the encoder knows all ids, so all but the two memories of contexts and the range is computed for many steps at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_TOKENS = 2048
HEADER = struct.Struct("<4sIIIII")  # magic, tokens, distinct ids, bytes of the id list, digits, CRC-32 of the ids
MAGIC = b"CMX2"
#: Weights and frequencies have 12 bits each.
_PART, _CONTEXTS, _FIRST_REFRESH, _GAIN = 12, 2048, 32, 4
_SLOTS = 1 << _PART
_S12, _S24, _S32 = np.uint64(12), np.uint64(24), np.uint64(32)
_LEAST_RANGE, _LAST_SLOT = np.uint64(1 << 32), np.uint64((1 << 12) - 1)


class BadBlock(ValueError):
    """A block whose header, digits or checksum don't agree."""


def _varints(lists: list[np.ndarray]) -> list[bytes]:
    """Ascending ids of each list as delta varints."""
    ends = np.cumsum([len(x) for x in lists])
    v = np.concatenate(lists).astype(np.int64)
    v[1:] -= v[:-1].copy()
    v[ends[:-1]] = [x[0] for x in lists[1:]]
    n = 1 + sum((v >= (1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    stops = np.cumsum(n)
    out = np.zeros(int(stops[-1]), np.uint8)
    for k in range(5):
        on = np.flatnonzero(n > k)
        out[(stops - n)[on] + k] = (v[on] >> 7 * k) & 127 | np.where(n[on] > k + 1, 128, 0)
    raw, cuts = out.tobytes(), np.concatenate([[0], stops])[np.concatenate([[0], ends])].tolist()
    return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def _unvarints(lists: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    b = np.frombuffer(b"".join(lists), np.uint8)
    last = np.flatnonzero(b < 128)
    if len(last) != sum(sizes) or not len(last) or last[-1] != len(b) - 1:
        raise BadBlock("list of ids")
    starts = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    place = np.minimum(np.arange(len(b)) - np.repeat(starts, last - starts + 1), 5)
    v = np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)
    run, ends = np.cumsum(v), np.cumsum(sizes)
    before = np.concatenate([[0], run])[ends - sizes]
    ids = (run - np.repeat(before, sizes)).astype("<u4")
    return [ids[y - n : y] for y, n in zip(ends.tolist(), sizes, strict=True)]


class _Models:
    """State of all lanes. Lanes are sorted by length, longest first, so the live ones are always a prefix."""

    def __init__(self, distinct: np.ndarray, steps: int):
        lanes = len(distinct)
        self.k, self.width = distinct.astype(np.int64), int(distinct.max())
        row = np.arange(lanes, dtype=np.int64)
        self.row1, self.row2, self.row8, self.row_inv = row * self.width, row * _CONTEXTS, row * 8, row * _SLOTS
        self.count = np.zeros((lanes, self.width), np.int32)
        #: id's first slot << 13 | its number of slots
        self.slots = np.zeros((lanes, self.width), np.uint32)
        #: by context: guess << 1 | whether the last guess was right
        self.guess1, self.guess2 = np.zeros(lanes * self.width, np.uint16), np.zeros(lanes * _CONTEXTS, np.uint16)
        #: what each step has read from them
        self.read1, self.read2 = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint16)
        #: predictions made and right, by lane and confidence
        self.made = np.zeros((2, 2, lanes), np.int64)
        self.right = np.zeros((2, 2, lanes), np.int64)
        #: by lane, confidence of order 2 and of order 1, and whether they agree: ends of the shares of order 2 and 1
        self.upto2, self.upto1, self.rest = (np.zeros((lanes, 8), np.uint64) for _ in range(3))

    def refresh(self, seen: int, step: int, live: int, ranks: np.ndarray) -> None:
        """Takes in the ids of steps from seen to step (those lanes that are still live)."""
        if step > seen:
            new = ranks[seen:step, :live]
            self.count[:live] += np.bincount((new + self.row1[None, :live]).ravel(), minlength=live * self.width).reshape(live, self.width).astype(np.int32)
            for k, read in enumerate((self.read1, self.read2)):
                e = read[seen:step, :live]
                sure, hit = (e & 1).astype(bool), (e >> 1) == new
                for c, on in enumerate((~sure, sure)):
                    self.made[k, c, :live] += on.sum(axis=0)
                    self.right[k, c, :live] += (on & hit).sum(axis=0)
        k = self.k[:live, None]
        own = np.minimum(np.arange(1, self.width + 1)[None, :], k).astype(np.int32)
        run = np.cumsum(self.count[:live], axis=1, dtype=np.int32) * _GAIN + own
        ends = (run * ((_SLOTS - self.k[:live]) / run[:, -1])[:, None]).astype(np.int32) + own
        ends[np.arange(self.width)[None, :] >= k - 1] = _SLOTS
        sizes = np.diff(ends, axis=1, prepend=np.int32(0))
        self.slots[:live] = ((ends - sizes) << 13) | sizes
        # weights of 12 bits; no share is ever 0
        odds = (_SLOTS - 64) * (self.right[:, :, :live] * 4 + 1) // (self.made[:, :, :live] * 4 + 12) + 1
        for c2 in range(2):
            for c1 in range(2):
                w2 = odds[1, c2]
                both = w2 + ((_SLOTS - w2) * odds[0, c1] >> _PART) + 1
                for same in range(2):
                    at = 4 * c2 + 2 * c1 + same
                    self.upto2[:live, at], self.upto1[:live, at] = (both if same else w2) << _PART, both << _PART
                    self.rest[:live, at] = _SLOTS - both
        self.sizes = sizes

    def inverse(self, out: np.ndarray, live: int) -> None:
        """The id of each slot."""
        out[:live] = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), live), self.sizes.ravel()).reshape(live, _SLOTS)


def _context2(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (before * 30011 + last * 40503 >> 3) & (_CONTEXTS - 1)


def _live(lengths: np.ndarray) -> np.ndarray:
    """Lanes still running at each step; lengths descend."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")


def _segments(steps: int) -> list[tuple[int, int]]:
    cuts = [0]
    while cuts[-1] < steps:
        cuts.append(min(max(2 * cuts[-1], _FIRST_REFRESH), steps))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _ranked(blocks: list[np.ndarray], order: list[int], lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct ids of each lane, and each step's ranks in them."""
    n, flat = len(order), np.concatenate([blocks[i] for i in order]).astype(np.int64)
    lane, ends = np.repeat(np.arange(n), lengths), np.cumsum(lengths)
    seen = np.zeros(int(flat.max()) + 1, bool) if flat.max() < 1 << 22 else None
    if seen is not None:
        seen[flat] = True
        names = np.flatnonzero(seen)
    if seen is None or n * len(names) > 8 * len(flat):
        distinct, place = np.unique(flat | (lane << 32), return_inverse=True)
        first = np.searchsorted(distinct, np.arange(n + 1) << 32)
        ids, rank = [distinct[a:b] & 0xFFFFFFFF for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], place - np.repeat(first[:-1], lengths)
    else:  # few distinct ids: a table of lanes and ids
        number = np.zeros(len(seen), np.int32)
        number[names] = np.arange(len(names))
        at = number[flat] + lane * len(names)
        there = np.zeros(n * len(names), bool)
        there[at] = True
        there = there.reshape(n, -1)
        rank = (np.cumsum(there, axis=1, dtype=np.int16) - 1).ravel().take(at)
        ids = [names[row] for row in there]
    ranks = np.zeros((int(lengths[0]), n), np.uint16)
    ranks[np.arange(len(flat)) - np.repeat(ends - lengths, lengths), lane] = rank
    return ids, ranks


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One coded block for each array of ids (unsigned 32-bit, from 1 to 4096 of them)."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths, n = np.array([len(blocks[i]) for i in order], np.int64), len(order)
    steps = int(lengths[0])
    ids, ranks = _ranked(blocks, order, lengths)
    m = _Models(np.array([len(u) for u in ids]), steps)
    low, rng = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    # an id takes 24 bits at most
    out, used = np.zeros((n, steps * 3 // 4 + 8), np.uint32), np.arange(n) * (steps * 3 // 4 + 8)
    digits, first, live = out.ravel(), used.copy(), _live(lengths).tolist()
    for seen, stop in _segments(steps):
        m.refresh(seen // 2 if seen > _FIRST_REFRESH else 0, seen, live[seen], ranks)
        a = live[seen]
        wide = ranks[max(seen - 2, 0) : stop, :a].astype(np.int64)
        wide = np.concatenate([np.zeros((max(2 - seen, 0), a), np.int64), wide])
        at1, at2 = wide[1:-1] + m.row1[:a], _context2(wide[:-2], wide[1:-1]) + m.row2[:a]
        named = ranks[seen:stop, :a] << 1
        for step in range(seen, stop):
            b, k = live[step], step - seen
            x, i1, i2 = named[k, :b], at1[k, :b], at2[k, :b]
            e1 = m.read1[step, :b] = m.guess1.take(i1)
            e2 = m.read2[step, :b] = m.guess2.take(i2)
            m.guess1[i1] = x | ((e1 ^ x) < 2)
            m.guess2[i2] = x | ((e2 ^ x) < 2)
        e1, e2 = m.read1[seen:stop, :a], m.read2[seen:stop, :a]
        hit1, hit2 = (e1 ^ named) < 2, (e2 ^ named) < 2
        at = ((e2 & 1) << 2) + ((e1 & 1) << 1) + ((e1 ^ e2) < 2) + m.row8[:a]
        upto2, upto1, slots = m.upto2.ravel().take(at), m.upto1.ravel().take(at), m.slots.ravel().take(wide[2:] + m.row1[:a])
        rest = m.rest.ravel().take(at)
        below = np.where(hit1, upto2, upto1 + rest * (slots >> 13))
        size = np.where(hit1, upto1 - upto2, rest * (slots & 8191))
        below[hit2], size[hit2] = 0, upto2[hit2]
        for step in range(seen, stop):
            b, k = live[step], step - seen
            was, r = low[:b], rng[:b] >> _S24
            now, rg = was + r * below[k, :b], r * size[k, :b]
            over = np.flatnonzero(now < was)
            if len(over):  # a carry: one more in the last digit, and in those before it that wrap
                spot = used[over] - 1
                while len(spot):
                    digits[spot] += np.uint32(1)
                    spot = spot[digits[spot] == 0] - 1
            idx = np.flatnonzero(rg < _LEAST_RANGE)
            if len(idx):
                lo, spot = now[idx], used[idx]
                digits[spot] = lo >> _S32
                used[idx] = spot + 1
                now[idx] = lo << _S32
                rg[idx] <<= _S32
            low[:b], rng[:b] = now, rg
    digits[used], digits[used + 1] = low >> _S32, low & np.uint64(0xFFFFFFFF)
    coded: list[bytes] = [b""] * n
    for lane, (i, named) in enumerate(zip(order, _varints(ids), strict=True)):
        body = digits[first[lane] : used[lane] + 2].astype("<u4").tobytes()
        crc = zlib.crc32(np.ascontiguousarray(blocks[i], "<u4"))
        coded[i] = HEADER.pack(MAGIC, len(blocks[i]), len(ids[lane]), len(named), len(body) // 4, crc) + named + body
    return coded


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises BadBlock when a checksum fails."""
    if not coded:
        return []
    heads = []
    for b in coded:
        if len(b) < HEADER.size or b[:4] != MAGIC:
            raise BadBlock("not a block")
        h = HEADER.unpack_from(b)
        if len(b) != HEADER.size + h[3] + 4 * h[4] or not 0 < h[2] <= h[1] <= _SLOTS or h[4] < 2:
            raise BadBlock("truncated block")
        heads.append(h)
    order = sorted(range(len(coded)), key=lambda i: -heads[i][1])
    lengths, n = np.array([heads[i][1] for i in order], np.int64), len(order)
    ids = _unvarints([coded[i][HEADER.size : HEADER.size + heads[i][3]] for i in order], [heads[i][2] for i in order])
    body = np.zeros((n, max(h[4] for h in heads) + 2), np.uint32)
    for lane, i in enumerate(order):
        body[lane, : heads[i][4]] = np.frombuffer(coded[i], "<u4", offset=HEADER.size + heads[i][3])
    steps = int(lengths[0])
    m = _Models(np.array([len(u) for u in ids]), steps)
    digits, most = body.ravel(), body.size - 1
    code, rng = (body[:, 0].astype(np.uint64) << _S32) | body[:, 1], np.full(n, 2**64 - 1, np.uint64)
    spots = np.arange(n) * body.shape[1] + 2
    ranks, by_slot, live = np.zeros((steps, n), np.uint16), np.zeros((n, _SLOTS), np.uint16), _live(lengths).tolist()
    at1, at2, mark = m.row1.copy(), m.row2.copy(), np.zeros(n, np.int64)
    tables = [x.ravel() for x in (m.upto2, m.upto1, m.rest, m.slots, by_slot)]
    for seen, stop in _segments(steps):
        m.refresh(seen // 2 if seen > _FIRST_REFRESH else 0, seen, live[seen], ranks)
        m.inverse(by_slot, live[seen])
        t2, t1, t0, slots, names = tables
        for step in range(seen, stop):
            a = live[step]
            i1, i2, here, r = at1[:a], at2[:a], code[:a], rng[:a] >> _S24
            e1 = m.read1[step, :a] = m.guess1.take(i1)
            e2 = m.read2[step, :a] = m.guess2.take(i2)
            g1, g2 = e1 >> 1, e2 >> 1
            w = m.row8[:a] + (((e2 & 1) << 2) + ((e1 & 1) << 1) + (g1 == g2))
            upto2, upto1, r0 = r * t2.take(w), r * t1.take(w), r * t0.take(w)
            in2, in1 = here < upto2, here < upto1
            rest = here - upto1  # wraps where a guess is hit; then unused
            slot = np.minimum(rest // r0, _LAST_SLOT).view(np.int64)
            slot += m.row_inv[:a]
            x = names.take(slot)
            found = slots.take(m.row1[:a] + x)
            now, rg = rest - r0 * (found >> 13), r0 * (found & 8191)
            hits = np.flatnonzero(in1)
            second = in2[hits]
            one, two = hits[~second], hits[second]
            x[one], now[one], rg[one] = g1[one], here[one] - upto2[one], upto1[one] - upto2[one]
            x[two], now[two], rg[two] = g2[two], here[two], upto2[two]
            idx = np.flatnonzero(rg < _LEAST_RANGE)
            if len(idx):
                spot = spots[idx]
                now[idx] = (now[idx] << _S32) | digits.take(np.minimum(spot, most))
                spots[idx] = spot + 1
                rg[idx] = np.maximum(rg[idx] << _S32, _LEAST_RANGE)  # less only in a damaged block
            code[:a], rng[:a], ranks[step, :a] = now, rg, x
            named = x << 1
            m.guess1[i1] = named | (g1 == x)
            m.guess2[i2] = named | (g2 == x)
            wide = x.astype(np.int64)
            np.add(m.row1[:a], wide, out=at1[:a])
            np.add(m.row2[:a], (mark[:a] + wide * 40503 >> 3) & (_CONTEXTS - 1), out=at2[:a])
            np.multiply(wide, 30011, out=mark[:a])
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * n
    ranks = np.ascontiguousarray(ranks.T)
    for lane, i in enumerate(order):
        got = ids[lane].take(ranks[lane, : lengths[lane]], mode="clip")
        if zlib.crc32(got) != heads[i][5]:
            raise BadBlock("checksum mismatch")
        out[i] = got
    return out
