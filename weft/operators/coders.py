"""Terminal coders of a chunk: entropy codes, packed alphabets and matches of earlier fields, as bytes to bytes with numpy.

A chunk is a binary column, one row each, so Spark deals and moves chunks and a coder only ever holds one. Every coder has its
inverse; names lead to both in CODERS.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

# -- bits ----------------------------------------------------------------------------------------------------------------


def bits_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low `sizes` bits of each value, high bits first, one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    return (np.repeat(values.astype("u8"), sizes) >> shift.astype("u8") & np.uint64(1)).astype("u1")


def from_bits(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values again from their bits and sizes."""
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(bits[: len(shift)].astype("u8") << shift.astype("u8"), dtype="u8")])
    return total[ends] - total[ends - sizes] if len(sizes) else total[:0]


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def numbers(raw: bytes, width: int) -> np.ndarray:
    if len(raw) % width:
        raise ValueError(f"{len(raw)} bytes are no whole number of fields of {width}")
    return np.frombuffer(raw, f"<u{width}")


# -- prefix codes --------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = 20) -> np.ndarray:
    """Lengths of a best prefix code for positive counts; where a length passes `most`, counts are halved until none does."""
    counts = np.asarray(counts, "int64")
    if len(counts) < 2:
        return np.ones(len(counts), "int64")
    while True:
        heap = [(int(c), i, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        made = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], made, (a, b)))
            made += 1
        out, stack = np.zeros(len(counts), "int64"), [(heap[0], 0)]
        while stack:
            (_, i, parts), depth = stack.pop()
            if parts is None:
                out[i] = depth
            else:
                stack += [(p, depth + 1) for p in parts]
        if out.max() <= most:
            return out
        counts = (counts + 1) // 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by place."""
    codes, code, last = np.zeros(len(lengths), "int64"), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def huffman_encode(raw: bytes, width: int = 1) -> bytes:
    """n, symbols, their code lengths, codes. Fields of 1 or 2 bytes."""
    if width > 2:
        raise ValueError("prefix codes take fields of 1 or 2 bytes")
    symbols, at, counts = np.unique(numbers(raw, width), return_inverse=True, return_counts=True)
    lengths = code_lengths(counts)
    head = struct.pack("<II", len(at), len(symbols)) + symbols.tobytes() + lengths.astype("u1").tobytes()
    return head + packed(bits_of(canonical(lengths)[at], lengths[at]))


def huffman_decode(data: bytes, width: int = 1) -> bytes:
    n, k = struct.unpack_from("<II", data)
    symbols = np.frombuffer(data, f"<u{width}", k, 8)
    lengths = np.frombuffer(data, "u1", k, 8 + k * width).astype("int64")
    if not n:
        return b""
    most, body = int(lengths.max()), data[8 + k * (width + 1) :] + bytes(4)
    table = np.zeros(1 << most, "int64")
    for s, (code, size) in enumerate(zip(canonical(lengths).tolist(), lengths.tolist())):
        table[code << most - size : code + 1 << most - size] = s << 5 | size
    table, mask, at, out = table.tolist(), (1 << most) - 1, 0, []
    for _ in range(n):
        found = table[int.from_bytes(body[at >> 3 : (at >> 3) + 4], "big") >> 32 - most - (at & 7) & mask]
        out.append(found >> 5)
        at += found & 31
    return symbols[np.asarray(out)].tobytes()


# -- table-driven asymmetric codes ---------------------------------------------------------------------------------------

FSE_LOG = 11


def normalised(counts: np.ndarray, log: int = FSE_LOG) -> np.ndarray:
    """Counts scaled to add up to 2 ** log, at least 1 each: shares rounded down, the rest to the largest remainders."""
    size = 1 << log
    share = counts * size / counts.sum()
    out = np.maximum(1, np.floor(share)).astype("int64")
    while (gap := size - int(out.sum())) != 0:
        rank = np.argsort(out - share if gap > 0 else share - out, kind="stable")
        rank = rank if gap > 0 else rank[out[rank] > 1]
        out[rank[: abs(gap)]] += 1 if gap > 0 else -1
    return out


def spread(counts: np.ndarray, log: int) -> np.ndarray:
    """Symbol of each state: an odd stride visits every state once."""
    size = 1 << log
    order = np.arange(size) * ((size >> 1) + (size >> 3) + 3) % size
    out = np.zeros(size, "int64")
    out[order] = np.repeat(np.arange(len(counts)), counts)
    return out


def states(counts: np.ndarray, log: int) -> tuple[list, list, list]:
    """(symbol, bits to read, base of the next state) of each state."""
    symbol = spread(counts, log)
    rank = np.zeros(len(symbol), "int64")
    for s in range(len(counts)):
        rank[symbol == s] = counts[s] + np.arange(counts[s])
    bits = log - (np.frexp(rank.astype(float))[1] - 1)
    return symbol.tolist(), bits.tolist(), ((rank << bits) - (1 << log)).tolist()


def fse_encode(raw: bytes, width: int = 1) -> bytes:
    """n, symbols, normalised counts, last state, bits; the decoder reads symbols in order. Fields of 1 byte."""
    if width != 1:
        raise ValueError("fields of 1 byte")
    symbols, at, counts = np.unique(numbers(raw, 1), return_inverse=True, return_counts=True)
    head = struct.pack("<II", len(at), len(symbols)) + symbols.tobytes()
    if len(symbols) < 2:
        return head
    norm = normalised(counts)
    symbol, bits, base = states(norm, FSE_LOG)
    # by symbol and state to come: the state that leads there
    arrive: list[dict[int, tuple[int, int, int]]] = [{} for _ in symbols]
    for state, (s, n, low) in enumerate(zip(symbol, bits, base)):
        for more in range(1 << n):
            arrive[s][low + more] = (state, more, n)
    state, values, sizes = 0, [], []
    for s in at[::-1].tolist():
        state, more, n = arrive[s][state]
        values.append(more)
        sizes.append(n)
    return head + norm.astype("<u2").tobytes() + struct.pack("<H", state) + packed(bits_of(np.asarray(values[::-1]), np.asarray(sizes[::-1])))


def fse_decode(data: bytes, width: int = 1) -> bytes:
    n, k = struct.unpack_from("<II", data)
    symbols = np.frombuffer(data, "u1", k, 8)
    if k < 2:
        return symbols.tobytes() * n
    symbol, bits, base = states(np.frombuffer(data, "<u2", k, 8 + k).astype("int64"), FSE_LOG)
    (state,) = struct.unpack_from("<H", data, 8 + 3 * k)
    body, at, out = data[10 + 3 * k :] + bytes(4), 0, []
    for _ in range(n):
        out.append(symbol[state])
        size = bits[state]
        state = base[state] + (int.from_bytes(body[at >> 3 : (at >> 3) + 4], "big") >> 32 - size - (at & 7) & (1 << size) - 1)
        at += size
    return symbols[np.asarray(out, "int64")].tobytes()


# -- packed fields -------------------------------------------------------------------------------------------------------


def pack_numbers(values: np.ndarray) -> bytes:
    """n, bits, values in as many bits as the largest needs."""
    bits = max(1, int(values.max()).bit_length()) if len(values) else 1
    return struct.pack("<IB", len(values), bits) + packed(bits_of(values, np.full(len(values), bits)))


def unpack_numbers(data: bytes) -> np.ndarray:
    n, bits = struct.unpack_from("<IB", data)
    return from_bits(np.unpackbits(np.frombuffer(data, "u1", offset=5)), np.full(n, bits))


def flatpack_encode(raw: bytes, width: int = 1) -> bytes:
    """Number of symbols less one, the symbols, their indices in as few bits as number them, a one and zeros. Fields of 1 byte."""
    symbols, at = np.unique(numbers(raw, 1), return_inverse=True)
    bits = (len(symbols) - 1).bit_length() if len(symbols) else 0
    return bytes([max(len(symbols), 1) - 1]) + (symbols.tobytes() or b"\0") + struct.pack("<I", len(at) if bits == 0 else 0) * (bits == 0) + packed(np.concatenate([bits_of(at, np.full(len(at), bits)), [1]]).astype("u1"))


def flatpack_decode(data: bytes, width: int = 1) -> bytes:
    k = data[0] + 1
    symbols, bits = np.frombuffer(data, "u1", k, 1), data[0].bit_length()
    if not bits:
        return symbols.tobytes() * struct.unpack_from("<I", data, 1 + k)[0]
    flat = np.unpackbits(np.frombuffer(data, "u1", offset=1 + k))
    n = int(np.nonzero(flat)[0][-1]) // bits
    return symbols[from_bits(flat, np.full(n, bits)).astype("int64")].tobytes()


def bitpack_encode(raw: bytes, width: int = 1) -> bytes:
    return pack_numbers(numbers(raw, width))


def bitpack_decode(data: bytes, width: int = 1) -> bytes:
    return unpack_numbers(data).astype(f"<u{width}").tobytes()


def constant_encode(raw: bytes, width: int = 1) -> bytes:
    if not raw or raw != raw[:width] * (len(raw) // width):
        raise ValueError("not constant")
    return struct.pack("<I", len(raw) // width) + raw[:width]


def constant_decode(data: bytes, width: int = 1) -> bytes:
    return data[4:] * struct.unpack_from("<I", data)[0]


def boundaries(values: np.ndarray, fast: bool = False) -> np.ndarray:
    """Least value of each bucket, so that bucket numbers and places within buckets take few bits together.

    Candidates are quantiles of the values. fast: the best even choice among them by number of buckets; else the best of all,
    by dynamic programming over the candidates.
    """
    values = np.sort(values.astype("int64"))
    if not len(values):
        return np.zeros(1, "int64")
    top = int(values[-1]) + 1
    grid = np.unique(values[np.arange(0, len(values), max(1, len(values) // 64))])
    size = np.frompyfunc(lambda n: (int(n) - 1).bit_length(), 1, 1)
    edges = np.append(grid, top)
    rows = np.searchsorted(values, edges)
    span = edges[None, :] - edges[:, None]
    # step[i, j]: bits of the places of all values from edge i to edge j in one bucket
    step = np.where(span > 0, (rows[None, :] - rows[:, None]) * size(np.maximum(span, 1)).astype(float), np.where(span == 0, 0.0, np.inf)) if not fast else None
    best, chosen = None, grid[:1]
    for k in range(0, 7):
        count = min(1 << k, len(grid))
        if fast:
            pick = np.unique(np.linspace(0, len(grid) - 1, count).astype("int64"))
        else:
            # cost[i]: bits of places of all values below edge i in the best `used` buckets
            cost, back = np.where(np.arange(len(edges)) == 0, 0.0, np.inf), []
            for _ in range(count):
                whole = cost[:, None] + step
                back.append(whole.argmin(0))
                cost = whole.min(0)
            at, pick = len(edges) - 1, []
            for b in reversed(back):
                at = int(b[at])
                pick.append(at)
            pick = np.unique(pick)
        own = edges[np.append(pick, len(edges) - 1)]
        held = np.diff(rows[np.append(pick, len(edges) - 1)])
        bits = len(values) * max(1, (len(pick) - 1).bit_length()) + int((held * size(np.diff(own))).sum()) + 32 * len(pick)
        if best is None or bits < best:
            best, chosen = bits, grid[pick]
    return chosen


def partition_bitpack_encode(raw: bytes, width: int = 2, fast: bool = False) -> bytes:
    """Buckets that fit the values, bucket numbers packed, places in as many bits as their bucket takes."""
    values = numbers(raw, width).astype("int64")
    starts = boundaries(values, fast)
    top = int(values.max()) + 1 if len(values) else 1
    sizes = np.asarray([int(n - 1).bit_length() for n in np.diff(np.append(starts, top))], "int64")
    bucket = np.searchsorted(starts, values, side="right") - 1
    head = pack_numbers(bucket)
    return struct.pack("<HI", len(starts), len(head)) + starts.astype("<u8").tobytes() + sizes.astype("u1").tobytes() + head + packed(bits_of(values - starts[bucket], sizes[bucket]))


def partition_bitpack_decode(data: bytes, width: int = 2) -> bytes:
    k, head = struct.unpack_from("<HI", data)
    starts, sizes = np.frombuffer(data, "<u8", k, 6).astype("int64"), np.frombuffer(data, "u1", k, 6 + 8 * k).astype("int64")
    bucket = unpack_numbers(data[6 + 9 * k : 6 + 9 * k + head]).astype("int64")
    rest = np.unpackbits(np.frombuffer(data, "u1", offset=6 + 9 * k + head))
    return (starts[bucket] + from_bits(rest, sizes[bucket]).astype("int64")).astype(f"<u{width}").tobytes()


# -- matches -------------------------------------------------------------------------------------------------------------

#: Fields that a match has at least, by width.
LEAST_MATCH = {1: 4, 2: 3, 4: 2, 8: 2}


def match_lists(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(literals, literals before each match, lengths of matches, offsets) of a greedy parse.

    The last place of the same `least` fields is found for all places at once by a sort; the parse goes from match to match.
    """
    n = len(x)
    if n <= least:
        none = np.zeros(0, "int64")
        return x, none, none, none
    windows = np.lib.stride_tricks.sliding_window_view(x, least)
    key = np.zeros(len(windows), "u8")
    with np.errstate(over="ignore"):
        for j in range(least):
            key = (key ^ windows[:, j].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    prior = np.full(len(windows), -1)
    same = (key[order[1:]] == key[order[:-1]]) & (windows[order[1:]] == windows[order[:-1]]).all(1)
    prior[order[1:][same]] = order[:-1][same]
    there = np.nonzero(prior >= 0)[0]
    at, done, runs, lengths, offsets, literals = 0, 0, [], [], [], []
    while (k := int(np.searchsorted(there, at))) < len(there):
        i = int(there[k])
        j, length, step = int(prior[i]), least, 64
        while i + length < n:
            a, b = x[i + length : i + length + step], x[j + length : j + length + step]
            unlike = np.nonzero(a != b[: len(a)])[0]
            if len(unlike):
                length += int(unlike[0])
                break
            length, step = length + len(a), step * 2
        literals.append(x[done:i])
        runs.append(i - done)
        lengths.append(length)
        offsets.append(i - j)
        at = done = i + length
    literals.append(x[done:])
    return np.concatenate(literals), np.asarray(runs, "int64"), np.asarray(lengths, "int64"), np.asarray(offsets, "int64")


def from_matches(literals: np.ndarray, runs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(literals) + int(lengths.sum()), literals.dtype)
    at = taken = 0
    for run, length, offset in zip(runs.tolist(), lengths.tolist(), offsets.tolist()):
        out[at : at + run] = literals[taken : taken + run]
        at, taken = at + run, taken + run
        while length:  # a match may reach into itself
            some = min(length, offset)
            out[at : at + some] = out[at - offset : at - offset + some]
            at, length, offset = at + some, length - some, offset + some
    out[at:] = literals[taken:]
    return out


def planes(x: np.ndarray) -> bytes:
    """All first bytes of the fields, then all second ones, and so on."""
    return np.ascontiguousarray(x).view("u1").reshape(-1, x.dtype.itemsize).T.tobytes()


def entropy_encode(raw: bytes, width: int = 1) -> bytes:
    """A letter and the payload of what is smallest by the histogram: constant, flatpack, bitpack, prefix code, asymmetric code, or the bytes as they are."""
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    symbols, held, n = np.nonzero(counts)[0], counts[counts > 0], len(raw)
    if len(symbols) == 1:
        return b"c" + constant_encode(raw)
    if not n:
        return b"r"
    k, log = len(symbols), 1 << FSE_LOG
    sizes = {
        b"r": n,
        b"f": 1 + k + (n * (k - 1).bit_length() + 8) // 8,
        b"b": 5 + (n * max(1, int(symbols[-1]).bit_length()) + 7) // 8,
        b"h": 8 + 2 * k + (int((held * code_lengths(held)).sum()) + 7) // 8,
        b"a": 10 + 3 * k + int(np.ceil((held * (FSE_LOG - np.log2(normalised(held)))).sum() / 8)) + 1 if k <= log else n + 1,
    }
    letter = min(sizes, key=lambda x: sizes[x])
    return letter + {b"r": lambda x: x, b"f": flatpack_encode, b"b": bitpack_encode, b"h": huffman_encode, b"a": fse_encode}[letter](raw)


def entropy_decode(data: bytes, width: int = 1) -> bytes:
    return {b"r": lambda x: x, b"c": constant_decode, b"f": flatpack_decode, b"b": bitpack_decode, b"h": huffman_decode, b"a": fse_decode}[data[:1]](data[1:])


def joined(parts: list[bytes]) -> bytes:
    return struct.pack(f"<B{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def cut(data: bytes) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{data[0]}I", data, 1), 1 + 4 * data[0], []
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def muxed(runs: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Both lengths of a match in one byte of 4 bits each, a field of all ones goes on in the overflow."""
    low, high = np.minimum(runs, 15), np.minimum(lengths, 15)
    return [entropy_encode((low | high << 4).astype("u1").tobytes()), pack_numbers(runs[runs >= 15] - 15), pack_numbers(lengths[lengths >= 15] - 15)]


def unmuxed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    byte = np.frombuffer(entropy_decode(parts[0]), "u1").astype("int64")
    out = []
    for x, more in ((byte & 15, parts[1]), (byte >> 4, parts[2])):
        x[x == 15] += unpack_numbers(more).astype("int64")
        out.append(x)
    return out[0], out[1]


def lz_encode(raw: bytes, width: int = 1) -> bytes:
    """Matches of whole fields: literals by byte planes and entropy code, lengths muxed, offsets packed, or partitioned beyond 8 KiB."""
    literals, runs, lengths, offsets = match_lists(numbers(raw, width), LEAST_MATCH[width])
    small = len(raw) <= 8192
    where = pack_numbers(offsets) if small else partition_bitpack_encode(offsets.astype("<u4").tobytes(), 4, fast=True)
    return joined([bytes([width, small]), *(entropy_encode(planes(literals)[i * len(literals) : (i + 1) * len(literals)]) for i in range(width)), *muxed(runs, lengths), where])


def lz_decode(data: bytes, width: int = 1) -> bytes:
    head, *parts = cut(data)
    width, small = head
    literals = np.frombuffer(b"".join(map(entropy_decode, parts[:width])), "u1").reshape(width, -1).T.copy().view(f"<u{width}").ravel()
    runs, lengths = unmuxed(parts[width : width + 3])
    offsets = unpack_numbers(parts[-1]).astype("int64") if small else np.frombuffer(partition_bitpack_decode(parts[-1], 4), "<u4").astype("int64")
    return from_matches(literals, runs, lengths, offsets).tobytes()


def bytes_lz_encode(raw: bytes, width: int = 1) -> bytes:
    return lz_encode(raw, 1)


def field_lz_encode(raw: bytes, width: int = 1) -> bytes:
    if width == 1:
        raise ValueError("fields of 2, 4 or 8 bytes")
    return lz_encode(raw, width)


class Coder(NamedTuple):
    encode: Callable[..., bytes]
    decode: Callable[..., bytes]


CODERS = {
    "store": Coder(lambda raw, width=1: raw, lambda data, width=1: data),
    "constant": Coder(constant_encode, constant_decode),
    "huffman": Coder(huffman_encode, huffman_decode),
    "fse": Coder(fse_encode, fse_decode),
    "flatpack": Coder(flatpack_encode, flatpack_decode),
    "bitpack": Coder(bitpack_encode, bitpack_decode),
    "partition_bitpack": Coder(partition_bitpack_encode, partition_bitpack_decode),
    "entropy": Coder(entropy_encode, entropy_decode),
    "lz": Coder(bytes_lz_encode, lz_decode),
    "field_lz": Coder(field_lz_encode, lz_decode),
}
