"""Canonical length-limited Huffman codes over small integers, packed and unpacked with numpy.

Codes are written most significant bit first. A stream is cut into blocks of ``BLOCK`` symbols;
the bit offset of every block is kept, so blocks decode independently: all blocks of a stream
advance together, one table probe a symbol.
"""

from __future__ import annotations

import numpy as np

LIMIT = 18
BLOCK = 512
_PACK = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for symbols that never occur."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_flags = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        leaf_flags.append(np.cumsum(rank < len(weights)))
        ordered = merged[rank]
        even = ordered[: len(ordered) // 2 * 2]
        packages = even[0::2] + even[1::2]
    take = 2 * len(order) - 2
    lengths = np.zeros(len(order), dtype=np.uint8)
    for flags in reversed(leaf_flags):
        if take == 0:
            break
        leaves = int(flags[take - 1])
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that go with ``lengths``: shorter first, then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        ln = lengths[order].astype(np.int64)
        top = int(ln.max())
        spans = np.left_shift(1, top - ln)
        starts = np.cumsum(spans) - spans
        codes[order] = starts >> (top - ln)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): ``bits`` bits of a stream index symbol << 8 | length."""
    top = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, top - lengths[order].astype(np.int64))
    table = np.zeros(1 << top, dtype=np.uint32)
    filled = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order], spans)
    table[: len(filled)] = filled
    return table, top


def encode(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, bit offset of every block)."""
    ln = lengths[symbols].astype(np.int64)
    if len(ln) == 0:
        return b"", np.zeros(0, dtype=np.uint64)
    if ln.min() == 0:
        raise ValueError("a symbol has no code")
    ends = np.cumsum(ln)
    begins = ends - ln
    words = np.zeros(int(ends[-1]) // 64 + 2, dtype=np.uint64)
    for at in range(0, len(symbols), _PACK):
        value, pos = codes[symbols[at : at + _PACK]].astype(np.uint64), begins[at : at + _PACK]
        free = 64 - (pos & 63) - ln[at : at + _PACK]
        word = pos >> 6
        heads = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        fits = free >= 0
        here = np.where(fits, value << np.maximum(free, 0).astype(np.uint64), value >> np.maximum(-free, 0).astype(np.uint64))
        words[word[heads]] |= np.bitwise_or.reduceat(here, heads)
        over = np.nonzero(~fits)[0]
        words[word[over] + 1] |= value[over] << (64 + free[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::BLOCK].astype(np.uint64)


def decode(data: bytes, offsets: np.ndarray, n: int, table: np.ndarray, top: int) -> np.ndarray:
    """The ``n`` symbols of a stream."""
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((len(offsets), BLOCK), dtype=np.uint32)
    drop, most = np.uint32(32 - top), len(window) - 1
    for k in range(min(BLOCK, n)):
        live = len(at) if k < n - (len(at) - 1) * BLOCK else len(at) - 1
        pos = at[:live]
        got = table[(window[np.minimum(pos >> 3, most)] << (pos & 7).astype(np.uint32)) >> drop]
        out[:live, k] = got >> np.uint32(8)
        at[:live] = pos + (got & np.uint32(255))
    return out.ravel()[:n]
