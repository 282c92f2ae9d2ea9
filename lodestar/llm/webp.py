"""Lossless WebP: a complete VP8L decoder and an encoder, for many small images at a time.

All images of a batch are lanes that advance together: one numpy step decodes the next pixel of
every lane (prefix codes, back-references, colour cache), and headers are read the same way. The
predictor, cross-colour, subtract-green and palette transforms are then inverted image by image.

Pixels are 32-bit ARGB numbers. ``encode_images`` writes literals and back-references, and as its
caller says a colour cache and any of the four transforms; ``encode_best`` chooses for each image what
makes it smallest by the entropy of its channels.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from lodestar.llm import huffman

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed by the format: the order in which code lengths of code lengths are stored, and the hash factor of the cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = np.uint32(0x1E35A7BD)
#: Neighbours by distance code: nearest first, then by |x|, the right one before the left one.
NEAR = np.array(sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])), dtype=np.int64)
MAX_LANES = 2048
_U = np.uint64


# ---------------------------------------------------------------- decoding


class _Bits:
    """Bit positions of all lanes in one buffer."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) // 8 + 3 for s in streams], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        raw = np.zeros(int(sizes.sum()) * 8, dtype=np.uint8)
        for at, s in zip(first * 8, streams):
            raw[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
        self.words = raw.view("<u8").astype(np.uint64)
        self.pos = first * 64
        self.end = self.pos + np.array([len(s) for s in streams], dtype=np.int64) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The next 64 bits at each position."""
        at = np.minimum(pos >> 6, len(self.words) - 2)
        s = (pos & 63).astype(np.uint64)
        return self.words[at] >> s | self.words[at + 1] << _U(1) << (_U(63) - s)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), lanes.shape)
        got = self.window(self.pos[lanes]) & ((_U(1) << n.astype(np.uint64)) - _U(1))
        self.pos[lanes] += n
        return got.astype(np.int64)


def _reverse(top: int) -> np.ndarray:
    out = np.zeros(1 << top, dtype=np.int64)
    for b in range(top):
        out |= (np.arange(1 << top) >> b & 1) << (top - 1 - b)
    return out


def _tables(lengths: np.ndarray, top: int) -> np.ndarray:
    """(codes, 2^top): symbol << 4 | length by the next bits, from (codes, symbols) lengths; one symbol takes no bits."""
    n, size = lengths.shape
    only = (lengths > 0).sum(axis=1)
    key = np.where(lengths > 0, lengths, 99).astype(np.int64) * 4096 + np.arange(size)
    key.sort(axis=1)
    symbol, ln = key & 4095, key >> 12
    span = np.where(ln <= 15, np.left_shift(1, np.maximum(top - ln, 0)), 0)
    total = span.sum(axis=1)
    whole = only > 1
    if np.any(whole & (total != 1 << top)):
        raise ValueError("a prefix code is not complete")
    entry = symbol << 4 | ln
    out = np.zeros((n, 1 << top), dtype=np.uint32)
    if whole.any():
        out[whole] = np.repeat(entry[whole].ravel(), span[whole].ravel()).reshape(-1, 1 << top)[:, _reverse(top)]
    single = ~whole
    out[single] = (np.where(only[single] > 0, symbol[single, 0], 0) << 4)[:, None]
    return out


def _read_lengths(bits: _Bits, lanes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The code lengths of one prefix code of every lane: (lanes, widest alphabet)."""
    out = np.zeros((len(lanes), int(alphabet.max())), dtype=np.uint8)
    simple = bits.read(lanes, 1) == 1
    at = np.nonzero(simple)[0]
    if len(at):
        two = bits.read(lanes[at], 1)
        wide = bits.read(lanes[at], 1)
        out[at, bits.read(lanes[at], 1 + 7 * wide)] = 1
        more = at[two == 1]
        out[more, bits.read(lanes[more], 8)] = 1
    at = np.nonzero(~simple)[0]
    if not len(at):
        return out
    own = lanes[at]
    used = 4 + bits.read(own, 4)
    of_lengths = np.zeros((len(at), 19), dtype=np.uint8)
    for k, symbol in enumerate(LENGTH_ORDER):
        here = np.nonzero(used > k)[0]
        if not len(here):
            break
        of_lengths[here, symbol] = bits.read(own[here], 3)
    limited = bits.read(own, 1) == 1
    left = alphabet[at].copy()
    here = np.nonzero(limited)[0]
    if len(here):
        left[here] = 2 + bits.read(own[here], 2 + 2 * bits.read(own[here], 3))
    table = _tables(of_lengths, 7).ravel()
    filled, previous = np.zeros(len(at), dtype=np.int64), np.full(len(at), 8)
    row = np.arange(len(at))
    while len(row):
        row = row[(filled[row] < alphabet[at[row]]) & (left[row] > 0)]
        if not len(row):
            break
        left[row] -= 1
        window = bits.window(bits.pos[own[row]])
        got = table[row << 7 | (window & _U(127)).astype(np.int64)]
        symbol, used_bits = (got >> 4).astype(np.int64), (got & 15).astype(np.int64)
        plain = symbol < 16
        to = row[plain]
        out[at[to], filled[to]] = symbol[plain]
        previous[to] = np.where(symbol[plain] > 0, symbol[plain], previous[to])
        filled[to] += 1
        bits.pos[own[row]] += used_bits
        runs = ~plain
        if runs.any():
            to, kind = row[runs], symbol[runs]
            extra = np.select([kind == 16, kind == 17], [2, 3], 7)
            count = bits.read(own[to], extra) + np.where(kind == 18, 11, 3)
            count = np.minimum(count, alphabet[at[to]] - filled[to])
            again = kind == 16
            if again.any():
                n = count[again]
                lane = np.repeat(to[again], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(filled[to[again]], n)
                out[at[lane], place] = previous[lane]
            filled[to] += count
    return out


def _prefix_value(bits: _Bits, lanes: np.ndarray, code: np.ndarray) -> np.ndarray:
    extra = np.where(code < 4, 0, (code - 2) >> 1)
    return np.where(code < 4, code, (2 + (code & 1)) << extra) + bits.read(lanes, extra) + 1


def _entropy(bits: _Bits, lanes: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """The pixels (flat) of one entropy-coded image of every lane."""
    order = np.argsort(-(width * height), kind="stable")
    lanes, width, height = lanes[order], width[order], height[order]
    pixels, n = width * height, len(lanes)
    cache_bits = bits.read(lanes, 1)
    with_cache = np.nonzero(cache_bits)[0]
    cache_bits[with_cache] = bits.read(lanes[with_cache], 4)
    meta: dict[int, tuple[int, int, np.ndarray]] = {}
    groups = np.ones(n, dtype=np.int64)
    if main:
        at = np.nonzero(bits.read(lanes, 1))[0]
        if len(at):
            size = bits.read(lanes[at], 3) + 2
            w, h = (width[at] + (1 << size) - 1) >> size, (height[at] + (1 << size) - 1) >> size
            for i, s, wide, image in zip(at, size, w, _entropy(bits, lanes[at], w, h, False)):
                of = (image >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
                meta[int(i)] = (int(s), int(wide), of)
                groups[i] = of.max() + 1
    base = np.cumsum(groups) - groups
    total = int(groups.sum())
    alphabet = [280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(n, 256)] * 3, np.full(n, 40)]
    lengths = [np.zeros((total, int(a.max())), dtype=np.uint8) for a in alphabet]
    for g in range(int(groups.max())):
        has = np.nonzero(groups > g)[0]
        for k in range(5):
            got = _read_lengths(bits, lanes[has], alphabet[k][has])
            lengths[k][base[has] + g, : got.shape[1]] = got
    tops = [max(1, int(x.max(initial=0))) for x in lengths]
    tables = [_tables(x, t).ravel() for x, t in zip(lengths, tops)]
    masks = [_U((1 << t) - 1) for t in tops]
    still = [not (x > 0).sum(axis=1).max(initial=0) > 1 for x in lengths]
    most = int(pixels[0])
    out = np.zeros((n, most), dtype=np.uint32)
    caches = np.zeros((n, 1 << int(cache_bits.max(initial=0))), dtype=np.uint32) if len(with_cache) else None
    copy_left, distance = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    pos = bits.pos[lanes]
    row, copying, u4, u15 = np.arange(n), 0, np.uint32(4), np.uint32(15)
    live_at = np.searchsorted(-pixels, -np.arange(most), side="left")
    single = [t[base << top] for t, top in zip(tables, tops)]

    def symbol(k: int, group: np.ndarray, window: np.ndarray) -> np.ndarray:
        return tables[k][group << tops[k] | (window & masks[k]).astype(np.int64)]

    for k in range(most):
        live = int(live_at[k])
        busy = row[:live] if not copying else np.nonzero(copy_left[:live] == 0)[0]
        if copying:
            from_ = np.nonzero(copy_left[:live])[0]
            out[from_, k] = out[from_, k - distance[from_]]
            copy_left[from_] -= 1
            copying = int(np.count_nonzero(copy_left[:live]))
        if len(busy):
            group = base[busy]
            if meta:
                group = group.copy()
                for j, i in enumerate(busy):
                    if int(i) in meta:
                        s, wide, of = meta[int(i)]
                        y, x = divmod(k, int(width[i]))
                        group[j] += of[(y >> s) * wide + (x >> s)]
            here = pos[busy]
            window = bits.window(here)
            got = symbol(0, group, window)
            green, used = got >> u4, got & u15
            literal = green < 256
            if not literal.all():
                odd = np.nonzero(~literal)[0]
                lane, g, bits_used = busy[odd], green[odd].astype(np.int64), used[odd].astype(np.int64)
                pos[lane] += bits_used
                ref = g < 280
                if ref.any():
                    who, code = lane[ref], g[ref] - 256
                    bits.pos[lanes[who]] = pos[who]
                    length = _prefix_value(bits, lanes[who], code)
                    d = symbol(4, group[odd[ref]], bits.window(bits.pos[lanes[who]]))
                    bits.pos[lanes[who]] += (d & u15).astype(np.int64)
                    far = _prefix_value(bits, lanes[who], (d >> u4).astype(np.int64))
                    near = np.minimum(far, 120) - 1
                    far = np.where(far > 120, far - 120, np.maximum(NEAR[near, 0] + NEAR[near, 1] * width[who], 1))
                    if np.any(far > k):
                        raise ValueError("a back-reference reaches before the image")
                    pos[who] = bits.pos[lanes[who]]
                    distance[who], copy_left[who] = far, np.minimum(length, pixels[who] - k) - 1
                    out[who, k] = out[who, k - far]
                    copying = int(np.count_nonzero(copy_left[:live]))
                if not ref.all():
                    who = lane[~ref]
                    out[who, k] = caches[who, g[~ref] - 280]
                keep = np.nonzero(literal)[0]
                busy, group, window, green, used, here = busy[keep], group[keep], window[keep], green[keep], used[keep], here[keep]
            if len(busy):
                argb = green << np.uint32(8)
                for which, shift in ((1, 16), (2, 0), (3, 24)):
                    if still[which] and not meta:
                        value = single[which][busy] >> u4
                    else:
                        part = symbol(which, group, window >> used.astype(np.uint64))
                        value = part >> u4
                        used = used + (part & u15)
                    argb |= value << np.uint32(shift)
                out[busy, k] = argb
                pos[busy] = here + used
        if caches is not None:
            who = with_cache[with_cache < live]
            argb = out[who, k]
            caches[who, (argb * CACHE_HASH) >> (32 - cache_bits[who]).astype(np.uint32)] = argb
    bits.pos[lanes] = pos
    if np.any(pos > bits.end[lanes] + 7):
        raise ValueError("an image ends early")
    result: list = [None] * n
    for i, at in enumerate(order):
        result[at] = out[i, : pixels[i]]
    return result


def _bytes4(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def _argb(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4").reshape(parts.shape[:-1]).astype(np.uint32)


def _predicted(mode: int, left, top, right, corner):
    """What one mode makes of the neighbours, as (…, 4) integers: left, above, above right, above left."""
    average = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.zeros_like(top) + np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode <= 9:
        return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        by_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        by_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = average(left, top)
    half = mean - corner
    return np.clip(mean + np.where(half < 0, -((-half) >> 1), half >> 1), 0, 255)


def _undo_predictor(argb: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    h, w = argb.shape
    v = _bytes4(argb).astype(np.int64)
    v[0, 0] = (v[0, 0] + [0, 0, 0, 255]) & 255
    v[:, 0] = np.cumsum(v[:, 0], axis=0) & 255
    used = np.unique(modes >> np.uint32(8) & np.uint32(15))
    if len(used) == 1 and used[0] in (1, 2):  # all from the left, or all from above: running sums
        axis = 2 - int(used[0])
        if axis == 1:
            return _argb(np.cumsum(v, axis=1) & 255)
        v[0] = np.cumsum(v[0], axis=0) & 255
        v[:, 1:] = np.cumsum(v[:, 1:], axis=0) & 255
        return _argb(v)
    v[0] = np.cumsum(v[0], axis=0) & 255
    for y in range(1, h):
        for x in range(1, w):
            mode = int(modes[y >> bits, x >> bits] >> np.uint32(8) & np.uint32(15))
            right = v[y - 1, x + 1] if x + 1 < w else v[y, 0]
            v[y, x] = (v[y, x] + _predicted(mode, v[y, x - 1], v[y - 1, x], right, v[y - 1, x - 1])) & 255
    return _argb(v)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int64)


def _spread(blocks: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << bits, axis=0), 1 << bits, axis=1)[:h, :w]


def _undo_cross(argb: np.ndarray, bits: int, elements: np.ndarray) -> np.ndarray:
    v = _bytes4(argb).astype(np.int64)  # blue, green, red, alpha
    e = _bytes4(_spread(elements, bits, *argb.shape))
    green = _signed(v[..., 1])
    red = (v[..., 2] + (_signed(e[..., 0]) * green >> 5)) & 255
    blue = v[..., 0] + (_signed(e[..., 1]) * green >> 5) + (_signed(e[..., 2]) * _signed(red) >> 5)
    v[..., 2], v[..., 0] = red, blue & 255
    return _argb(v)


def _undo_palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    index = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    each, size = 1 << packed, 8 >> packed
    index = (index[:, :, None] >> (np.arange(each) * size) & ((1 << size) - 1)).reshape(index.shape[0], -1)[:, :width]
    return np.concatenate([table, np.zeros(256, dtype=np.uint32)])[index]


def decode_images(streams: list[bytes]) -> list[np.ndarray]:
    """The (height, width) ARGB pixels of every VP8L bit stream."""
    out: list[np.ndarray] = []
    for at in range(0, len(streams), MAX_LANES):
        out += _decode_lanes(streams[at : at + MAX_LANES])
    return out


def _decode_lanes(streams: list[bytes]) -> list[np.ndarray]:
    if not streams:
        return []
    bits, every = _Bits(streams), np.arange(len(streams))
    if np.any(bits.read(every, 8) != 0x2F):
        raise ValueError("not a VP8L stream")
    width, height = bits.read(every, 14) + 1, bits.read(every, 14) + 1
    bits.read(every, 1)
    if np.any(bits.read(every, 3)):
        raise ValueError("unknown VP8L version")
    now = width.copy()
    todo: list[list[tuple]] = [[] for _ in streams]
    open_ = every
    while len(open_ := open_[bits.read(open_, 1) == 1]):
        kind = bits.read(open_, 2)
        for lane in open_[kind == SUBTRACT_GREEN]:
            todo[lane].append((SUBTRACT_GREEN,))
        for k in (PREDICTOR, CROSS_COLOUR):
            who = open_[kind == k]
            if len(who):
                size = bits.read(who, 3) + 2
                w, h = (now[who] + (1 << size) - 1) >> size, (height[who] + (1 << size) - 1) >> size
                for lane, s, a, b, image in zip(who, size, w, h, _entropy(bits, who, w, h, False)):
                    todo[lane].append((k, int(s), image.reshape(b, a)))
        who = open_[kind == PALETTE]
        if len(who):
            n = bits.read(who, 8) + 1
            for lane, image in zip(who, _entropy(bits, who, n, np.ones_like(n), False)):
                table = _argb(np.cumsum(_bytes4(image), axis=0) & 255)
                todo[lane].append((PALETTE, table, int(now[lane])))
                packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
                now[lane] = (now[lane] + (1 << packed) - 1) >> packed
    found = []
    for lane, flat in enumerate(_entropy(bits, every, now, height, True)):
        argb = flat.reshape(height[lane], -1)
        for step in reversed(todo[lane]):
            if step[0] == SUBTRACT_GREEN:
                v = _bytes4(argb).copy()
                v[..., 0] += v[..., 1]
                v[..., 2] += v[..., 1]
                argb = _argb(v)
            elif step[0] == PREDICTOR:
                argb = _undo_predictor(argb, *step[1:])
            elif step[0] == CROSS_COLOUR:
                argb = _undo_cross(argb, *step[1:])
            else:
                argb = _undo_palette(argb, *step[1:])
        found.append(argb)
    return found


# ---------------------------------------------------------------- encoding

CODE_LIMIT = 11
_LENGTH_WEIGHTS = np.array([60, 1, 1, 2, 6, 14, 26, 30, 30, 24, 20, 12, 1, 1, 1, 1, 8, 40, 30])
_LENGTH_LENGTHS = huffman.code_lengths(_LENGTH_WEIGHTS, 7)


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    codes, out = huffman.canonical(lengths), np.zeros(len(lengths), dtype=np.uint64)
    for s in np.nonzero(lengths)[0]:
        out[s] = int(f"{codes[s]:0{lengths[s]}b}"[::-1], 2)
    return out


_LENGTH_CODES = [int(x) for x in _reversed_codes(_LENGTH_LENGTHS)]
_LENGTH_BITS = [int(x) for x in _LENGTH_LENGTHS]


def _huffman(counts: np.ndarray, limit: int = CODE_LIMIT) -> np.ndarray:
    """Code lengths of a complete code; small counts are raised until none is longer than ``limit``."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.nonzero(counts)[0].tolist()
    if len(used) <= 1:
        out[used] = 1
        return out
    weights, floor = counts[used].tolist(), 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        n, parent = len(used), [0] * (2 * len(used) - 1)
        for node in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        floor = floor * 2 + 1


class _Writer:
    """Bits, least significant first, in one growing number."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, lengths: np.ndarray) -> None:
        used = np.nonzero(lengths)[0]
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            first = int(used[0]) if len(used) else 0
            self.put(1, 1)
            self.put(int(len(used) == 2), 1)
            self.put(1, 1)
            self.put(first, 8)
            if len(used) == 2:
                self.put(int(used[1]), 8)
            return
        self.put(0, 1)
        self.put(15, 4)
        value, n = 0, 0
        for s in LENGTH_ORDER:
            value |= _LENGTH_BITS[s] << n
            n += 3
        self.put(value, n)
        self.put(0, 1)
        value, n, at = 0, 0, 0
        codes, sizes = _LENGTH_CODES, _LENGTH_BITS
        listed = lengths[used].tolist()
        for s, ln in zip(used.tolist() + [len(lengths)], listed + [0]):
            gap = s - at
            while gap >= 11:
                k = min(gap, 138)
                value |= (codes[18] | k - 11 << sizes[18]) << n
                n += sizes[18] + 7
                gap -= k
            if gap >= 3:
                value |= (codes[17] | gap - 3 << sizes[17]) << n
                n += sizes[17] + 3
                gap = 0
            for _ in range(gap):
                value |= codes[0] << n
                n += sizes[0]
            if ln:
                value |= codes[ln] << n
                n += sizes[ln]
            at = s + 1
        self.put(value, n)


def _value_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of values from 1."""
    v = value.astype(np.int64) - 1
    high = np.where(v >= 4, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 0)
    extra = np.maximum(high - 1, 0)
    code = np.where(v < 4, v, 2 * high + (v >> extra & 1))
    return code, v & ((1 << extra) - 1), extra


MIN_MATCH = 8


def _matches(pixels: np.ndarray, image: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, distance, length) of repeats worth a back-reference, not overlapping, in order."""
    n = len(pixels)
    if n < MIN_MATCH:
        return []
    p = pixels.astype(np.uint64)
    h = p[:-3] * _U(0x9E3779B97F4A7C15) ^ p[1:-2] * _U(0xC2B2AE3D27D4EB4F) ^ p[2:-1] * _U(0x165667B19E3779F9) ^ p[3:] * _U(0x27D4EB2F165667C5)
    h = (h ^ h >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    low = max(1, int(n - 1).bit_length())
    key = np.sort(h >> _U(low) << _U(low) | np.arange(n - 3, dtype=np.uint64))
    at = (key & _U((1 << low) - 1)).astype(np.int64)
    same = np.nonzero((key[1:] >> _U(low)) == (key[:-1] >> _U(low)))[0]
    now, was = at[same + 1], at[same]
    ok = (image[now] == image[was]) & (image[now] == image[np.minimum(now + 3, n - 1)])
    for k in range(4):
        ok &= pixels[now + k] == pixels[was + k]
    back = np.zeros(n, dtype=np.int64)
    back[now[ok]] = (now - was)[ok]
    heads = np.nonzero((back[1:] != back[:-1]))[0] + 1
    heads = np.concatenate([[0], heads])
    sizes = np.diff(np.concatenate([heads, [n]]))
    pick = (back[heads] > 0) & (sizes >= MIN_MATCH - 3)
    out, free = [], 0
    for at_, size, d in zip(heads[pick].tolist(), (sizes[pick] + 3).tolist(), back[heads[pick]].tolist()):
        begin = max(at_, free)
        size -= begin - at_
        while size >= MIN_MATCH:
            k = min(size, 4096)
            out.append((begin, d, k))
            begin, size = begin + k, size - k
            free = begin
    return out


def _entropy_bits(images: list[np.ndarray], widths: list[int], cache_bits: int, writers: list[_Writer], main: bool) -> list[tuple[bytes, int]]:
    """Each image's stream and its bits: what its writer holds, then its codes and pixels."""
    sizes = np.array([len(x) for x in images], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    pixels = np.concatenate(images) if images else np.zeros(0, dtype=np.uint32)
    image = np.repeat(np.arange(len(images)), sizes)
    found = _matches(pixels, image, start)
    covered = np.zeros(len(pixels) + 1, dtype=np.int32)
    m_at = np.array([x[0] for x in found], dtype=np.int64)
    m_far = np.array([x[1] for x in found], dtype=np.int64)
    m_len = np.array([x[2] for x in found], dtype=np.int64)
    np.add.at(covered, m_at, 1)
    np.add.at(covered, m_at + m_len, -1)
    plain = np.nonzero(np.cumsum(covered[:-1]) == 0)[0]
    green = (pixels[plain] >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    hit = np.zeros(len(plain), dtype=bool)
    alphabet = 280
    if cache_bits:
        alphabet += 1 << cache_bits
        slot = ((pixels * CACHE_HASH) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.lexsort((np.arange(len(pixels)), slot, image))
        same = (image[order][1:] == image[order][:-1]) & (slot[order][1:] == slot[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
        cached = np.zeros(len(pixels), dtype=bool)
        cached[order[1:]] = same
        hit = cached[plain]
        green = np.where(hit, 280 + slot[plain], green)
    of = image[plain]
    red, blue, alpha = ((pixels[plain] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24))
    l_code, l_extra, l_bits = _value_prefix(m_len)
    width = np.array(widths, dtype=np.int64)
    d_code, d_extra, d_bits = _value_prefix(np.where(m_far == 1, 2, np.where(m_far == width[image[m_at]], 1, m_far + 120)))
    m_of = image[m_at]
    n = len(images)
    counts = [np.bincount(np.concatenate([of * alphabet + green, m_of * alphabet + 256 + l_code]), minlength=n * alphabet).reshape(n, alphabet)]
    for v in (red, blue, alpha):
        counts.append(np.bincount((of * 256 + v)[~hit], minlength=n * 256).reshape(n, 256))
    counts.append(np.bincount(m_of * 40 + d_code, minlength=n * 40).reshape(n, 40))
    lengths = [np.zeros(c.shape, dtype=np.uint8) for c in counts]
    for i in range(n):
        w = writers[i]
        w.put(1 if cache_bits else 0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        if main:
            w.put(0, 1)
        for k in range(5):
            lengths[k][i] = _huffman(counts[k][i])
            w.code(lengths[k][i])
    codes = []
    for x in lengths:  # canonical codes of all images at once, bits reversed, one symbol without bits
        top = CODE_LIMIT
        key = np.where(x > 0, x, 99).astype(np.int64) * 4096 + np.arange(x.shape[1])
        key.sort(axis=1)
        symbol, ln = key & 4095, key >> 12
        span = np.where(ln <= top, np.left_shift(1, np.maximum(top - ln, 0)), 0)
        first = np.cumsum(span, axis=1) - span
        code = np.zeros(x.shape, dtype=np.int64)
        np.put_along_axis(code, symbol, _reverse(top)[np.minimum(first, (1 << top) - 1)], axis=1)
        x[(x > 0).sum(axis=1) <= 1] = 0
        codes.append(code.astype(np.uint64))

    def bits(k: int, who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes[k][who, what], lengths[k][who, what].astype(np.uint64)

    def joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, size = parts[0][0].copy(), parts[0][1].copy()
        for v, s in parts[1:]:
            value |= v << size
            size += s
        return value, size

    off = hit.astype(np.uint64) ^ _U(1)
    value, size = joined(bits(0, of, green), *[(v * off, s * off) for v, s in (bits(1, of, red), bits(2, of, blue), bits(3, of, alpha))])
    m_value, m_size = joined(bits(0, m_of, 256 + l_code), (l_extra.astype(np.uint64), l_bits.astype(np.uint64)), bits(4, m_of, d_code), (d_extra.astype(np.uint64), d_bits.astype(np.uint64)))
    at = np.concatenate([plain, m_at])
    order = np.argsort(at, kind="stable") if len(m_at) else slice(None)
    value, size, owner = np.concatenate([value, m_value])[order], np.concatenate([size, m_size])[order].astype(np.int64), np.concatenate([of, m_of])[order]
    body = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
    head = np.array([w.n for w in writers], dtype=np.int64)
    room = (head + body + 63) // 64 + 1
    base = np.cumsum(room) - room
    words = np.zeros(int(room.sum()) + 1, dtype=np.uint64)
    raw = words.view(np.uint8)
    for w, b in zip(writers, base.tolist()):
        data = w.value.to_bytes((w.n + 7) // 8, "little")
        raw[8 * b : 8 * b + len(data)] = np.frombuffer(data, dtype=np.uint8)
    if len(value):
        before = np.cumsum(size) - size
        first = np.concatenate([[0], np.cumsum(body)])[:-1]
        pos = before - first[owner] + head[owner] + 64 * base[owner]
        word, shift = pos >> 6, (pos & 63).astype(np.uint64)
        heads = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        words[word[heads]] |= np.bitwise_or.reduceat(value << shift, heads)
        words[word[heads] + 1] |= np.bitwise_or.reduceat(value >> _U(1) >> (_U(63) - shift), heads)
    return [(raw[8 * b : 8 * b + (k + 7) // 8].tobytes(), k) for b, k in zip(base.tolist(), (head + body).tolist())]


def _block_image(argb: np.ndarray, bits: int, value: int) -> np.ndarray:
    h, w = argb.shape
    return np.full(((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits), value, dtype=np.uint32)


def _transformed(writer: _Writer, argb: np.ndarray, step: tuple) -> tuple[_Writer, np.ndarray]:
    """One transform written and applied: (SUBTRACT_GREEN,), (PREDICTOR, mode), (CROSS_COLOUR, element) or (PALETTE,)."""
    writer.put(1, 1)
    writer.put(step[0], 2)
    v = _bytes4(argb).astype(np.int64)
    if step[0] == SUBTRACT_GREEN:
        v[..., 0] -= v[..., 1]
        v[..., 2] -= v[..., 1]
        return writer, _argb(v & 255)
    if step[0] == PALETTE:
        table, index = np.unique(argb, return_inverse=True)
        if len(table) > 256:
            raise ValueError("more than 256 colours")
        writer.put(len(table) - 1, 8)
        sub = _argb(np.diff(_bytes4(table).astype(np.int64), axis=0, prepend=0) & 255)[None, :]
        packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        each, size = 1 << packed, 8 >> packed
        index = index.reshape(argb.shape)
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % each))).reshape(index.shape[0], -1, each)
        out = np.uint32(0xFF000000) | ((index << (np.arange(each) * size)).sum(axis=2).astype(np.uint32) << np.uint32(8))
    else:
        bits = 3
        writer.put(bits - 2, 3)
        if step[0] == PREDICTOR:
            sub = _block_image(argb, bits, 0xFF000000 | step[1] << 8)
            right = np.concatenate([v[:-1, 1:], v[1:, :1]], axis=1)
            out = v.copy()
            out[1:, 1:] -= _predicted(step[1], v[1:, :-1], v[:-1, 1:], right[:, 1:], v[:-1, :-1])
            out[1:, 0] -= v[:-1, 0]
            out[0, 1:] -= v[0, :-1]
            out[0, 0] -= [0, 0, 0, 255]
        else:
            sub = _block_image(argb, bits, step[1])
            e, out = _bytes4(_spread(sub, bits, *argb.shape)), v.copy()
            out[..., 2] -= _signed(e[..., 0]) * _signed(v[..., 1]) >> 5
            out[..., 0] -= (_signed(e[..., 1]) * _signed(v[..., 1]) >> 5) + (_signed(e[..., 2]) * _signed(v[..., 2]) >> 5)
        out = _argb(out & 255)
    data, n = _entropy_bits([sub.ravel()], [sub.shape[1]], 0, [writer], False)[0]
    writer = _Writer()
    writer.put(int.from_bytes(data, "little"), n)
    return writer, out


def encode_images(images: list[np.ndarray], cache_bits: int = 0, transforms: tuple[tuple, ...] = ()) -> list[bytes]:
    """VP8L streams of (height, width) ARGB images: literals and back-references, on request a colour cache and transforms."""
    writers, changed = [], []
    for argb in images:
        h, w = argb.shape
        if not (1 <= w <= 16384 and 1 <= h <= 16384):
            raise ValueError("an image has 1 to 16384 pixels a side")
        writer = _Writer()
        writer.put(0x2F, 8)
        writer.put(w - 1, 14)
        writer.put(h - 1, 14)
        writer.put(int(bool(np.any(argb >> np.uint32(24) != 255))) if transforms else 0, 4)
        for step in transforms:
            writer, argb = _transformed(writer, argb, step)
        writer.put(0, 1)
        writers.append(writer)
        changed.append(argb)
    return [data for data, _ in _entropy_bits([x.ravel() for x in changed], [x.shape[1] for x in changed], cache_bits, writers, True)]


#: What an image may be written with: the bits of its colour cache and its transforms.
CACHE = 6
PLANS = ((0, ()), (CACHE, ()), (0, ((PALETTE,),)), (0, ((SUBTRACT_GREEN,),)), (0, ((PREDICTOR, 1),)), (0, ((PREDICTOR, 2),)), (0, ((CROSS_COLOUR, 0xFF202020),)))
#: A plan must promise to save such a share and so many bits, as its estimate and its own data have a cost.
GAIN, LEAST_GAIN = 0.03, 256.0
#: Of every so many rows one is looked at; a palette is counted where such a share of pixels is in the cache.
EVERY, PALETTE_REPEATS = 8, 0.3


def _entropies(of: np.ndarray, value: np.ndarray, n: int, size: int) -> np.ndarray:
    """The bits that each image's values take at least."""
    counts = np.bincount(of * size + value, minlength=n * size).reshape(n, size).astype(np.float64)
    total = counts.sum(axis=1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)


def plan_costs(images: list[np.ndarray]) -> np.ndarray:
    """(images, PLANS): the estimated bits of each image of one width by each plan, from every EVERY-th row."""
    rows = [np.arange(len(x)) % EVERY == len(x) // 2 % EVERY if len(x) > EVERY else np.ones(len(x), dtype=bool) for x in images]
    above = [np.concatenate([np.full((1, x.shape[1]), 0xFF000000, dtype=np.uint32), x[:-1]])[r] for x, r in zip(images, rows)]
    some = [x[r] for x, r in zip(images, rows)]
    n = len(images)
    of = np.repeat(np.arange(n), [x.size for x in some])
    grow = np.array([x.size / max(y.size, 1) for x, y in zip(images, some)])
    now, top = np.concatenate(some), np.concatenate(above)
    left = np.concatenate([top[:, :1], now[:, :-1]], axis=1)
    now, top, left = now.ravel(), top.ravel(), left.ravel()
    red, green, blue = ((now >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 8, 0))
    out = np.full((n, len(PLANS)), np.inf)
    bits = lambda *channels: sum(_entropies(of, c & 255, n, 256) for c in channels)
    out[:, 0] = bits(red, green, blue)
    slot = ((now * CACHE_HASH) >> np.uint32(32 - CACHE)).astype(np.int64)
    order = np.argsort(of << CACHE | slot, kind="stable")
    hit = np.zeros(len(now), dtype=bool)
    hit[order[1:]] = (of[order][1:] == of[order][:-1]) & (now[order][1:] == now[order][:-1]) & (slot[order][1:] == slot[order][:-1])
    miss = ~hit
    out[:, 1] = _entropies(of, np.where(hit, 256 + slot, green), n, 256 + (1 << CACHE)) + sum(_entropies(of[miss], c[miss], n, 256) for c in (red, blue))
    repeats = np.bincount(of, weights=hit, minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    for i in np.nonzero(repeats >= PALETTE_REPEATS)[0]:
        x = images[i]
        if x.size >= 64:
            colours, count = np.unique(x, return_counts=True)
            if len(colours) <= 256:
                out[i, 2] = (24.0 * len(colours) + x.size * np.log2(x.size) - (count * np.log2(count)).sum()) / grow[i]
    out[:, 3] = bits(red - green, green, blue - green)
    for k, near in ((4, left), (5, top)):
        out[:, k] = bits(*(c - (near >> np.uint32(s) & np.uint32(255)).astype(np.int64) for c, s in ((red, 16), (green, 8), (blue, 0))))
    turn = lambda x: _signed(x) * 32 >> 5
    out[:, 6] = bits(red - turn(green), green, blue - turn(green) - turn(red))
    return out * grow[:, None]


def chosen_plans(images: list[np.ndarray]) -> np.ndarray:
    """The plan of each image of one width."""
    cost = plan_costs(images)
    best = cost.argmin(axis=1)
    save = cost[:, 0] - cost[np.arange(len(images)), best]
    best[save < np.maximum(GAIN * cost[:, 0], LEAST_GAIN)] = 0
    return best


def encode_best(images: list[np.ndarray]) -> list[bytes]:
    """VP8L streams of images of one width, each by the plan that its pixels ask for."""
    if not images:
        return []
    best = chosen_plans(images)
    out: list[bytes] = [b""] * len(images)
    for k in np.unique(best):
        own = np.nonzero(best == k)[0]
        for i, data in zip(own, encode_images([images[i] for i in own], *PLANS[k])):
            out[i] = data
    return out


# ---------------------------------------------------------------- files


def _chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def wrap(streams: list[bytes], width: int, heights: list[int]) -> bytes:
    """A WebP file: one image, or an animation whose frames are the strips of one canvas."""
    if len(streams) == 1:
        body = b"WEBP" + _chunk(b"VP8L", streams[0])
    else:
        u24 = lambda x: struct.pack("<I", x)[:3]
        parts, y = [b"WEBP", _chunk(b"VP8X", b"\x02\0\0\0" + u24(width - 1) + u24(sum(heights) - 1)), _chunk(b"ANIM", b"\0" * 6)], 0
        for stream, h in zip(streams, heights):
            parts.append(_chunk(b"ANMF", u24(0) + u24(y // 2) + u24(width - 1) + u24(h - 1) + u24(0) + b"\x02" + _chunk(b"VP8L", stream)))
            y += h
        body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(file: bytes) -> list[bytes]:
    """The VP8L streams of a file, in frame order."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = [], 12
    while at + 8 <= len(file):
        tag, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if tag == b"VP8L":
            out.append(file[at + 8 : at + 8 + size])
        elif tag == b"ANMF":
            at += 24
            continue
        at += 8 + size + (size & 1)
    return out
