"""An adaptive context-mixing range coder of token ids, many blocks in lockstep.

Ids are coded in blocks of BLOCK that are independent: models start anew, and each block
has its checksum. Three orders predict the next id: the id that last followed the two ids
before it (order 2), the one that last followed the id before it (order 1), and adaptive
counts of the block's ids (order 0), as a tree of three 16-way choices over the block's
own alphabet. Their mixing weights are adaptive counts of which order was right, kept for
each pair of confidences of orders 2 and 1; the mixed prediction drives a 64-bit carryless
range coder that emits 16-bit words. All blocks of a frame advance together, one id at a
time, as NumPy vectors.

Frame layout (little-endian; varints are 7 bits a byte, low bits first):
magic; varints: documents, ids, blocks; document lengths; flags of null keys, a byte each;
keys as zigzag differences; CRC-32 of each block's ids; alphabet sizes; alphabets as
differences; words of each block; the words.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block; at most 16**3, so that three choices name an id of its alphabet.
BLOCK = 4096
MAGIC = b"PLCM1\n"
_STEP = 12
_NONE = 0xFFFF
_SLOTS = 4096
_TOP, _BOTTOM, _WORD = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)
_LOW_MASK = np.uint64((1 << 32) - 1)
_RAISED = np.zeros((16, 17), np.uint16)
for _k in range(16):
    _RAISED[_k, _k + 1 :] = _STEP


class CorruptBlock(ValueError):
    """A frame or block doesn't hold what its header or checksum says."""


def varints(values: np.ndarray) -> bytes:
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(10):
        here = size > k
        if not here.any():
            break
        part = (v[here] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][here] + k] = part.astype(np.uint8) | np.where(size[here] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def read_varints(data: np.ndarray, at: int, count: int) -> tuple[np.ndarray, int]:
    if not count:
        return np.zeros(0, np.uint64), at
    window = data[at : at + 10 * count]
    ends = np.flatnonzero(window < 128)[:count]
    if len(ends) < count:
        raise CorruptBlock("a frame ends early")
    begins = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(count, np.uint64)
    for k in range(int((ends - begins).max()) + 1):
        here = begins + k <= ends
        out[here] |= (window[begins[here] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out, at + int(ends[-1]) + 1


class _Model:
    """Predictions and adaptive counts of ``n`` blocks."""

    def __init__(self, n: int):
        self.one = np.full(n * (BLOCK + 1), _NONE, np.uint16)
        self.one_sure = np.zeros(n * (BLOCK + 1), np.uint8)
        self.two = np.full(n * _SLOTS, _NONE, np.uint16)
        self.two_sure = np.zeros(n * _SLOTS, np.uint8)
        self.right = np.ones((n * 32, 3), np.uint16)
        self.tree = np.tile(np.arange(17, dtype=np.uint16), (n * 273, 1))
        lanes = np.arange(n, dtype=np.int64)
        self.base_one, self.base_two = lanes * (BLOCK + 1), lanes * _SLOTS
        self.base_right, self.base_tree = lanes * 32, lanes * 273
        self.last, self.before = np.full(n, BLOCK, np.int64), np.full(n, BLOCK, np.int64)

    def predict(self, m: int) -> None:
        last, before = self.last[:m], self.before[:m]
        self.at_one = self.base_one[:m] + last
        self.at_two = self.base_two[:m] + ((before * 40503 + last * 31) & (_SLOTS - 1))
        self.guess_one, self.sure_one = self.one[self.at_one], self.one_sure[self.at_one]
        self.guess_two, self.sure_two = self.two[self.at_two], self.two_sure[self.at_two]
        same = self.guess_one == self.guess_two
        self.row = self.base_right[:m] + (self.sure_two * 8 + self.sure_one * 2 + same)
        counts = self.right[self.row].astype(np.uint64)
        self.first = counts[:, 0]
        self.second = self.first + counts[:, 1]
        self.total = self.second + counts[:, 2]

    def learn(self, event: np.ndarray, symbol: np.ndarray) -> None:
        m = len(symbol)
        self.right[self.row, event] += np.uint16(_STEP)
        for table, sures, at, guess, sure in (
            (self.one, self.one_sure, self.at_one, self.guess_one, self.sure_one),
            (self.two, self.two_sure, self.at_two, self.guess_two, self.sure_two),
        ):
            hit = guess == symbol
            weak = ~hit & (sure <= 1)
            table[at] = np.where(weak, symbol, guess)
            sures[at] = np.where(hit, np.minimum(sure + 1, 3), np.where(weak, 1, sure - 1))
        self.before[:m] = self.last[:m]
        self.last[:m] = symbol


def _emit(low: np.ndarray, wide: np.ndarray, out: np.ndarray, place: np.ndarray) -> None:
    """Shifts out settled words of each lane; ``place``: the next free word of each in ``out``."""
    near = (low ^ (low + wide)) < _TOP
    slim = wide < _BOTTOM
    todo = np.flatnonzero(near | slim)
    while len(todo):
        a, b = low[todo], wide[todo]
        b = np.where((a ^ (a + b)) < _TOP, b, (~a + np.uint64(1)) & _LOW_MASK)
        out[place[todo]] = (a >> np.uint64(48)).astype(np.uint16)
        place[todo] += 1
        a, b = a << _WORD, b << _WORD
        low[todo], wide[todo] = a, b
        todo = todo[((a ^ (a + b)) < _TOP) | (b < _BOTTOM)]


def _encode_blocks(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, one after another, and how many each has. symbols: [block, place]."""
    n, steps = symbols.shape
    model = _Model(n)
    room = 4 * steps + 8
    out = np.zeros(n * room, np.uint16)
    place = np.arange(n, dtype=np.int64) * room
    begin = place.copy()
    low, wide = np.zeros(n, np.uint64), np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for t in range(steps):
        m = n if t < lengths[-1] else n - 1
        if not m:
            break
        symbol = symbols[:m, t].astype(np.int64)
        model.predict(m)
        event = np.where(symbol == model.guess_two, 0, np.where(symbol == model.guess_one, 1, 2))
        start = np.where(event == 0, 0, np.where(event == 1, model.first, model.second)).astype(np.uint64)
        stop = np.where(event == 0, model.first, np.where(event == 1, model.second, model.total))
        a, b = low[:m], wide[:m]
        unit = b // model.total
        a += start * unit
        b[:] = (stop - start) * unit
        _emit(a, b, out, place[:m])
        new = np.flatnonzero(event == 2)
        if len(new):
            own = symbol[new]
            base = model.base_tree[new]
            a, b, p = low[new], wide[new], place[new]
            for node, choice in ((0, own >> 8), (1 + (own >> 8), (own >> 4) & 15), (17 + (own >> 4), own & 15)):
                row = base + node
                counts = model.tree[row]
                index = np.arange(len(row))
                unit = b // counts[:, 16]
                x = counts[index, choice]
                a += x * unit
                b = (counts[index, choice + 1] - x) * unit
                _emit(a, b, out, p)
                counts += _RAISED[choice]
                model.tree[row] = counts
            low[new], wide[new], place[new] = a, b, p
        model.learn(event, symbol)
    for k in range(4):
        out[place + k] = ((low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.uint16)
    place += 4
    used = place - begin
    keep = np.arange(room)[None, :] < used[:, None]
    return out.reshape(n, room)[keep], used


def _take(low: np.ndarray, wide: np.ndarray, code: np.ndarray, words: np.ndarray, place: np.ndarray) -> None:
    todo = np.flatnonzero(((low ^ (low + wide)) < _TOP) | (wide < _BOTTOM))
    while len(todo):
        a, b = low[todo], wide[todo]
        b = np.where((a ^ (a + b)) < _TOP, b, (~a + np.uint64(1)) & _LOW_MASK)
        code[todo] = (code[todo] << _WORD) | words[place[todo]]
        place[todo] += 1
        a, b = a << _WORD, b << _WORD
        low[todo], wide[todo] = a, b
        todo = todo[((a ^ (a + b)) < _TOP) | (b < _BOTTOM)]


def _decode_blocks(words: np.ndarray, used: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n, steps = len(lengths), int(lengths[0]) if len(lengths) else 0
    model = _Model(n)
    words = np.concatenate([words, np.zeros(8, np.uint16)]).astype(np.uint64)
    place = np.concatenate([[0], np.cumsum(used)[:-1]]).astype(np.int64)
    low, wide, code = np.zeros(n, np.uint64), np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
    for _ in range(4):
        code = (code << _WORD) | words[place]
        place += 1
    symbols = np.zeros((n, steps), np.uint16)
    limit = len(words) - 8
    for t in range(steps):
        m = n if t < lengths[-1] else n - 1
        if not m:
            break
        model.predict(m)
        a, b, c = low[:m], wide[:m], code[:m]
        unit = b // model.total
        value = (c - a) // unit
        event = (value >= model.first).astype(np.int64) + (value >= model.second)
        start = np.where(event == 0, 0, np.where(event == 1, model.first, model.second)).astype(np.uint64)
        stop = np.where(event == 0, model.first, np.where(event == 1, model.second, model.total))
        a += start * unit
        b[:] = (stop - start) * unit
        _take(a, b, c, words, place[:m])
        symbol = np.where(event == 0, model.guess_two, model.guess_one).astype(np.int64)
        new = np.flatnonzero(event == 2)
        if len(new):
            base = model.base_tree[new]
            a, b, c, p = low[new], wide[new], code[new], place[new]
            own = np.zeros(len(new), np.int64)
            for node in (0, 1, 17):
                row = base + node + own
                counts = model.tree[row]
                index = np.arange(len(row))
                unit = b // counts[:, 16]
                value = np.minimum((c - a) // unit, counts[:, 16] - np.uint64(1))
                choice = (counts[:, 1:] <= value[:, None]).sum(axis=1)
                x = counts[index, choice]
                a += x * unit
                b = (counts[index, choice + 1] - x) * unit
                _take(a, b, c, words, p)
                counts += _RAISED[choice]
                model.tree[row] = counts
                own = own * 16 + choice
            low[new], wide[new], code[new], place[new] = a, b, c, p
            symbol[new] = own
        # what corrupt words lead to is told by the checksum
        np.minimum(place, limit, out=place)
        np.minimum(symbol, BLOCK - 1, out=symbol)
        symbols[:m, t] = symbol
        model.learn(event, symbol)
    return symbols


def encode(ids: np.ndarray, lengths: np.ndarray, keys: list[int | None]) -> bytes:
    """A frame of documents: all their ids (unsigned 32-bit), how many each has, and their keys."""
    n = -(-len(ids) // BLOCK)
    sizes = np.full(n, BLOCK, np.int64)
    if n:
        sizes[-1] = len(ids) - (n - 1) * BLOCK
    symbols = np.zeros((n, min(BLOCK, len(ids))), np.uint16)
    alphabets, crcs = [], np.zeros(n, "<u4")
    for k in range(n):
        own = ids[k * BLOCK : (k + 1) * BLOCK]
        crcs[k] = zlib.crc32(own.astype("<u4").tobytes())
        alphabet, place = np.unique(own, return_inverse=True)
        symbols[k, : len(own)] = place
        alphabets.append(np.diff(alphabet, prepend=0))
    words, used = _encode_blocks(symbols, sizes) if n else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    whole = np.array([0 if k is None else k for k in keys], np.int64)
    step = np.diff(whole, prepend=0)
    zigzag = (step.astype(np.uint64) << np.uint64(1)) ^ (step >> 63).astype(np.uint64)
    return b"".join(
        [
            MAGIC,
            varints(np.array([len(lengths), len(ids), n])),
            varints(lengths),
            bytes(k is None for k in keys),
            varints(zigzag),
            crcs.tobytes(),
            varints(np.array([len(a) for a in alphabets])),
            varints(np.concatenate(alphabets)) if n else b"",
            varints(used),
            words.astype("<u2").tobytes(),
        ]
    )


def decode(frame: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """What ``encode`` was given; raises CorruptBlock where a checksum disagrees."""
    if frame[: len(MAGIC)] != MAGIC:
        raise CorruptBlock("not a frame")
    data = np.frombuffer(frame, np.uint8)
    (docs, total, n), at = read_varints(data, len(MAGIC), 3)
    docs, total, n = int(docs), int(total), int(n)
    lengths, at = read_varints(data, at, docs)
    nulls = data[at : at + docs]
    zigzag, at = read_varints(data, at + docs, docs)
    step = (zigzag >> np.uint64(1)).astype(np.int64) ^ -(zigzag & np.uint64(1)).astype(np.int64)
    whole = np.cumsum(step)
    keys = [None if z else int(k) for z, k in zip(nulls, whole, strict=True)]
    crcs = np.frombuffer(frame, "<u4", n, at)
    sizes, at = read_varints(data, at + 4 * n, n)
    letters, at = read_varints(data, at, int(sizes.sum()))
    used, at = read_varints(data, at, n)
    words = np.frombuffer(frame, "<u2", int(used.sum()), at)
    ids = np.zeros(total, np.uint32)
    if n:
        blocks = np.full(n, BLOCK, np.int64)
        blocks[-1] = total - (n - 1) * BLOCK
        symbols = _decode_blocks(words, used.astype(np.int64), blocks)
        edges = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        for k in range(n):
            alphabet = np.cumsum(letters[edges[k] : edges[k + 1]]).astype(np.uint32)
            place = symbols[k, : blocks[k]]
            if len(place) and place.max() >= len(alphabet):
                raise CorruptBlock(f"block {k} names an id outside its alphabet")
            own = alphabet[place]
            if zlib.crc32(own.astype("<u4").tobytes()) != crcs[k]:
                raise CorruptBlock(f"block {k} fails its checksum")
            ids[k * BLOCK : k * BLOCK + len(own)] = own
    return ids, lengths.astype(np.int64), keys
