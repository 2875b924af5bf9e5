"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded apart from all others: its model starts empty, and a checksum covers its ids. Inside a block the ids
are cut into equal lanes that are coded side by side, so that each step works on vectors; all lanes share the model. The
ids that a block uses are listed in its head, most frequent first, and stand for themselves by their places in that list.

Predictions of three orders are mixed for every id:

- order 0: how often each id occurred so far;
- order 1: how often each id followed the last one, for each of the ``CLASSES`` - 1 most frequent last ids apart and for
  all others together. The counts of order 0 count as ``PRIOR`` occurrences in every one of these distributions, so
  that rare contexts lean on order 0 and frequent ones on their own successors;
- order 2: the id that followed the last two ids before, with a confidence of 0 to 7. Its share in the mixture is how often
  such a guess was right so far, by confidence and by how frequent the last id is.

The mixture is a distribution over ids, whose cumulative sums drive a range coder with 16-bit digits. Counts are folded in
at steps that lie ever farther apart, up to a tenth of the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"idb2"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, distinct ids, crc32 of the ids, bytes of the list of ids, of the lanes' lengths
_BITS1, _BITS_WEIGHT = 18, 12  # of the order-1 distributions, of the mixing weights
_BITS = _BITS1 + _BITS_WEIGHT
_LEAST, _DIGIT = 32, 16  # a lane puts out a digit once its range is under 2**_LEAST
_BUCKET = 8  # bits of a distribution that a bucket of the reader's index leaves open
_WEIGH_EVERY = 4
CLASSES, PRIOR, _TABLE = 256, 60, 1 << 20


class _Model:
    """What encoder and decoder know before each step. A context's entry in order 2 is 8 * predicted symbol + confidence."""

    def __init__(self, n: int, lanes: int, steps: int, symbols: int, lookup: bool) -> None:
        if symbols + 1 >= 1 << (_BITS1 - 1):
            raise ValueError("a block has too many distinct ids for this coder")
        self.symbols, self.steps, self._lookup = symbols, steps, lookup
        self.classes = max(1, min(CLASSES, symbols, _TABLE // symbols))
        self.counts = np.zeros((self.classes, symbols), np.int32)
        # a reader's jumps may pass the end of a distribution, by two buckets at most
        self.stride = symbols + 1 + (2 << _BUCKET) * lookup
        self._own, self._parts = np.empty(self.counts.shape, np.float32), np.empty(self.counts.shape, np.int32)
        self._buckets = np.empty((self.classes, symbols - 1) if lookup else 0, np.int64)
        self._starts = np.zeros((self.classes, self.stride), np.int32)
        self._starts[:, symbols:] = 1 << _BITS1
        self.cum = self._starts.reshape(-1)
        self.pending: list[np.ndarray] = []
        self.due = 1
        self.slots = 1 << min(20, max(10, n.bit_length() - 2))
        self.after2 = np.zeros(self.slots, np.uint16 if symbols < 1 << 13 else np.int32)  # the smaller, the more of it stays in the processor's cache
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.rank = np.minimum(np.log2(1 + np.arange(symbols) / 16).astype(np.int64) // 2, 3)
        self.seen = np.tile(np.array([4, 1], np.int64), (32, 1))  # by state: wrong and right guesses
        self._spread()
        self._weigh()

    def _spread(self) -> None:
        """Order 1 as frequencies of at least 1 that sum to 2**_BITS1 in each class."""
        zero = self.counts.sum(0, dtype=np.int32).astype(np.int64)
        # every operation is elementwise on single floats, so that it rounds alike everywhere
        prior = ((zero + 0.1) * (PRIOR / (zero.sum() + 0.1 * self.symbols))).astype(np.float32)
        scale = (((1 << _BITS1) - self.symbols - 1) / (self.counts.sum(1, dtype=np.int32).astype(np.int64) + PRIOR)).astype(np.float32)
        np.add(self.counts, prior, out=self._own, dtype=np.float32)
        self._own *= scale[:, None]
        np.copyto(self._parts, self._own, casting="unsafe")  # rounds down
        self._parts += 1
        np.cumsum(self._parts[:, :-1], axis=1, out=self._starts[:, 1 : self.symbols])
        if self._lookup:
            # for each bucket the last symbol that starts before it, with one bucket more in front of each class; the first symbol starts at 0
            wide = (1 << (_BITS1 - _BUCKET)) + 1
            np.right_shift(self._starts[:, 1 : self.symbols], _BUCKET, out=self._buckets)
            self._buckets += (np.arange(self.classes) * wide + 1)[:, None]
            counts = np.bincount(self._buckets.reshape(-1), minlength=self.classes * wide).reshape(self.classes, wide)
            self.index = np.cumsum(counts, 1, dtype=np.int32).ravel()

    def _weigh(self) -> None:
        # 32 of the weight at least are order 1's, so that every id can be coded
        share2 = self.seen[:, 1] * ((1 << _BITS_WEIGHT) - 32) // self.seen.sum(1)
        # all frequencies are under 2**31, and vectors of single integers take half the time
        self.mass2, self.w1 = (share2 << _BITS1).astype(np.int32), ((1 << _BITS_WEIGHT) - share2).astype(np.int32)

    def predict(self) -> None:
        # all places are there: "clip" only saves the checks
        self.kind = np.minimum(self.last, self.classes - 1)
        self.row = self.kind * self.stride
        self.slot = ((self.before * 50_021 + self.last * 7) * 2_654_435_761 >> 9) & (self.slots - 1)
        self.e2 = self.after2.take(self.slot, mode="clip").astype(np.int64)
        self.p2, self.k2 = self.e2 >> 3, self.e2 & 7
        self.state = self.k2 * 4 + self.rank.take(self.last, mode="clip")
        self.w, self.m2 = self.w1.take(self.state, mode="clip"), self.mass2.take(self.state, mode="clip")

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative and own frequency of symbols in the mixture."""
        self.hit2 = self.p2 == ids
        at = self.row + ids
        start = self.cum.take(at, mode="clip")
        low = self.w * start + self.m2 * (self.p2 < ids)
        return low, self.w * (self.cum.take(at + 1, mode="clip") - start) + self.m2 * self.hit2

    def find(self, value: np.ndarray) -> np.ndarray:
        """The symbols whose spans hold the values."""
        at = self.row + self.p2
        low = self.w * self.cum.take(at)
        high = self.w * self.cum.take(at + 1) + self.m2
        over = value >= high
        open_ = (value < low) | over  # the others are the guessed symbols
        # true division is exact enough to round down: the numbers are under 2**30 and 2**12
        part = ((value - self.m2 * over) * open_ / self.w).astype(np.int32)
        bucket = self.kind * ((1 << (_BITS1 - _BUCKET)) + 1) + (part >> _BUCKET)
        # a bucket's first symbol may have started before it
        first, most = self.index.take(bucket), self.index.take(bucket + 1)
        ids = np.where(open_, first, self.p2)
        todo = ((most > first) & open_).nonzero()[0]
        if len(todo):
            row, part = self.row[todo], part[todo]
            place = row + first[todo]
            for bit in range(int((most - first)[todo].max()).bit_length() - 1, -1, -1):
                further = place + (1 << bit)
                place = np.where(self.cum.take(further) <= part, further, place)
            ids[todo] = place - row
        return ids

    def learn(self, ids: np.ndarray, step: int) -> None:
        if step % _WEIGH_EVERY == 0:
            self.seen += np.bincount(self.state * 2 + self.hit2, minlength=64).reshape(32, 2)
            if self.seen.max() > 1 << 20:
                self.seen = (self.seen + 1) >> 1
            self._weigh()
        # of lanes in the same context the last one counts, in the encoder as in the decoder
        self.after2[self.slot] = np.where(self.hit2, self.e2 + (self.k2 < 7), np.where(self.k2 > 1, self.e2 - 1, ids * 8 + 1))
        self.before, self.last = self.last, ids
        self.pending.append(self.kind * self.symbols + ids)
        if step + 1 >= self.due:
            np.add.at(self.counts.reshape(-1), np.concatenate(self.pending), np.int32(1))  # of the counts' own kind: others take ten times as long
            self.pending = []
            self.due = step + 1 + max(1, min(step // 3, self.steps // 10))
            self._spread()


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: many for large blocks, one for small ones."""
    return max(1, min(4096, n // 512))


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """Ids (below ``vocabulary``) as one block."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes = lanes_for(n)
    head = lambda symbols, listed, size: _HEAD.pack(MAGIC, n, lanes, symbols, zlib.crc32(ids), listed, size)
    if not n:
        return head(0, 0, 0)
    if int(ids.max()) >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    often = np.bincount(ids)
    used = np.flatnonzero(often)
    used = used[np.argsort(-often[used], kind="stable")]
    place = np.zeros(len(often), np.int32)
    place[used] = np.arange(len(used))
    steps = -(-n // lanes)
    padded = np.zeros(steps * lanes, np.int32)  # the padding at the end is coded too, as the first symbol
    padded[:n] = place.take(ids)
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(n, lanes, steps, len(used), lookup=False)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << (_LEAST + _DIGIT), np.int64)
    lane_of: list[np.ndarray] = []  # of the digits, which come out by steps
    digits: list[np.ndarray] = []
    for step in range(steps):
        now = columns[step].astype(np.int64)
        model.predict()
        start, own = model.span(now)
        unit = rng >> _BITS
        low += unit * start
        rng = unit * own
        full = (rng < 1 << _LEAST).nonzero()[0]
        while len(full):
            part, wider = low[full], rng[full] << _DIGIT
            lane_of.append(full.astype(np.uint16))
            digits.append((part >> _LEAST).astype(np.int32))  # a carry stays in the digit until the end
            low[full] = (part & ((1 << _LEAST) - 1)) << _DIGIT
            rng[full] = wider
            full = full[wider < 1 << _LEAST]
        model.learn(now, step)
    # as few digits as tell the final range: the lane's range is at least 2**_LEAST
    lane_of.append(np.arange(lanes, dtype=np.uint16))
    digits.append(((low + ((1 << _LEAST) - 1)) >> _LEAST).astype(np.int32))
    lane = np.concatenate(lane_of)
    at = np.bincount(lane, minlength=lanes)
    ordered = np.concatenate(digits)[np.argsort(lane, kind="stable")]  # by lanes, within a lane by steps
    while (over := np.flatnonzero(ordered >= 1 << _DIGIT)).size:
        ordered[over] -= 1 << _DIGIT
        ordered[over - 1] += 1
    listed, lengths = zlib.compress(used.astype("<u4").tobytes()), zlib.compress(at.astype("<u4").tobytes())
    return head(len(used), len(listed), len(lengths)) + listed + lengths + ordered.astype("<u2").tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it is damaged."""
    if len(block) < _HEAD.size or block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    _, n, lanes, symbols, crc, listed, size = _HEAD.unpack_from(block)
    if not n:
        return np.zeros(0, np.uint32)
    try:
        at_lengths = _HEAD.size + listed
        used = np.frombuffer(zlib.decompress(block[_HEAD.size : at_lengths]), "<u4")
        lengths = np.frombuffer(zlib.decompress(block[at_lengths : at_lengths + size]), "<u4").astype(np.int64)
        digits = np.frombuffer(block, "<u2", offset=at_lengths + size).astype(np.int64)
        if len(used) != symbols or not 0 < symbols <= n or lanes != lanes_for(n) or len(lengths) != lanes or lengths.sum() != len(digits):
            raise ValueError("damaged block: its parts don't fit")
        # the reader is two digits ahead: zeros follow each lane's own
        padded = np.zeros(len(digits) + 2 * lanes, np.int64)
        padded[np.arange(len(digits)) + np.repeat(2 * np.arange(lanes), lengths)] = digits
        at = np.cumsum(lengths + 2) - lengths - 2  # where the next digits are
        code = np.zeros(lanes, np.int64)  # less the encoder's low
        for _ in range(3):
            code = code << _DIGIT | padded[at]
            at += 1
        steps = -(-n // lanes)
        model = _Model(n, lanes, steps, symbols, lookup=True)
        rng = np.full(lanes, 1 << (_LEAST + _DIGIT), np.int64)
        out = np.zeros((steps, lanes), np.uint32)
        for step in range(steps):
            model.predict()
            unit = rng >> _BITS
            # exact, too: the quotient is under 2**31 and the divisor under 2**19
            ids = model.find(np.clip(code / unit, 0, (1 << _BITS) - 1).astype(np.int32))
            start, own = model.span(ids)
            code -= unit * start
            rng = unit * own
            full = (rng < 1 << _LEAST).nonzero()[0]
            while len(full):
                where, wider = at[full], rng[full] << _DIGIT
                code[full] = code[full] << _DIGIT | padded[where]
                at[full] = where + 1
                rng[full] = wider
                full = full[wider < 1 << _LEAST]
            out[step] = used.take(ids)
            model.learn(ids, step)
    except (zlib.error, IndexError, ValueError) as why:
        raise ValueError(f"damaged block: {why}") from why
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n].astype("<u4", copy=False)
    if zlib.crc32(ids) != crc:
        raise ValueError("damaged block: the checksum differs")
    return ids
