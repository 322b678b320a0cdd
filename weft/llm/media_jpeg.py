"""Media columns: progressive JPEG, written and read with numpy.

Reading accumulates the scans of a progressive file (spectral selection and successive approximation) into coefficient
arrays, applies the inverse transform, brings chroma to full resolution and gives RGB tensors. Writing stores a payload of
bytes losslessly in the format's own unit, the quantised coefficient: byte b becomes the coefficient whose eight code bits in
JPEG's own signed form are b (b itself from 128 on, else b - 255), the 64 bytes of a block in zigzag order. Payload blocks
fill the luma plane, then the two chroma planes (4:2:0); a comment segment holds the number of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .coder import text_slices
from .shared import file_groups, map_rows, remove, stage, text_or_empty

TAG = b"WEFT"
#: Quantisation step of the pictures that hold payloads: any step keeps coefficients whole, but only the least one keeps
#: samples within their range, so that tensors have what the transform gives and not black and white alone.
QUANT = 1
#: Level of zstd and bytes of a page of stored tables; high levels take several times as long and make them little smaller.
LEVEL, PAGE = 3, 8 << 20
#: Rows of a file of stored media at most; bytes of media whose tensors are stored at a time at least, and how many such parts a table has at most.
FILE_ROWS, PART_BYTES, MOST_PARTS = 4096, 32 << 20, 12
HEADER = ">4sQ"
EOB_MOST = 32767
#: Rows of units of 16 samples that a picture has at most.
HIGHEST = 4095
#: Place in row order of the k-th coefficient in zigzag order.
ZIGZAG = np.asarray(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def inverse_basis() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples in row order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(one, one).T[ZIGZAG]


BASIS = inverse_basis()


#: Bits of the numbers 0 to 511, which differences of coefficients do not exceed.
WIDTH = np.asarray([n.bit_length() for n in range(512)])


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, number: int, codes: dict[int, list[int]]) -> bytes:
    """DHT segment; codes: symbols by code length."""
    return segment(0xC4, bytes([kind << 4 | number, *(len(codes.get(n, [])) for n in range(1, 17))]) + bytes(s for n in range(1, 17) for s in codes.get(n, [])))


def scan(component: int, tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def pack_bits(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, bits.dtype)])).tobytes()


def bits_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low `sizes` bits of each value, high bits first, one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    return (np.repeat(values, sizes) >> shift & 1).astype("u1")


def aligned(bits: np.ndarray, sizes: list[int]) -> list[bytes]:
    """Stretches of bits of the given sizes, one after the other, each to bytes and filled up with ones."""
    out, places, at, to = np.ones(sum(-(-n // 8) for n in sizes) * 8, "u1"), [], 0, 0
    for n in sizes:
        out[to : to + n] = bits[at : at + n]
        at, to = at + n, to - (-n // 8) * 8
        places.append(to // 8)
    packed = np.packbits(out).tobytes()
    return [packed[a:b] for a, b in zip([0, *places], places)]


#: What is made once a worker, in plain dictionaries, which functions can carry to executors.
_ENDS: dict[int, np.ndarray] = {}
_SEVEN: dict[int, np.ndarray] = {}
_ORDERS: dict[tuple[int, int, int], np.ndarray] = {}
_COLOURS: dict[str, np.ndarray] = {}


def end_of_blocks(run: int) -> np.ndarray:
    """Bits of the symbol for `run` blocks without new coefficients."""
    found = _ENDS.get(run)
    if found is None:
        extra = run.bit_length() - 1
        found = _ENDS[run] = bits_of(np.asarray([extra << extra | run - (1 << extra)]), np.asarray([4 + extra]))
    return found


JFIF = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
CODES = b"".join([
    huffman(0, 0, {4: list(range(9))}),  # DC: bits in the difference
    huffman(1, 0, {1: [7]}),  # AC, first: no zero before, seven bits
    huffman(1, 1, {4: [n << 4 for n in range(15)]}),  # AC, refined: runs of blocks without new coefficients
])


def write_payload(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG that holds payload (a multiple of 64 bytes)."""
    return write_payloads([(payload, n_bytes)])[0]


def write_payloads(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    """write_payload of each; the planes of all pictures are coded together."""
    if not payloads:
        return []
    shapes = []
    for payload, _ in payloads:
        units = -(-len(payload) // 384)
        wide = -(-units // HIGHEST)  # narrow pictures are filled but for the last row
        shapes.append((wide, -(-units // wide)))
    cells = np.frombuffer(b"".join(x.ljust(384 * w * h, b"\0") for (x, _), (w, h) in zip(payloads, shapes)), "u1").reshape(-1, 64)
    counts = [n for w, h in shapes for n in (4 * w * h, w * h, w * h)]  # blocks of each plane of each picture
    starts = np.cumsum([0, *counts])
    dc = cells[:, 0].astype("int64")
    dc = np.where(dc < 128, dc - 255, dc)
    difference = np.diff(dc >> 1, prepend=0)
    difference[starts[:-1]] = dc[starts[:-1]] >> 1
    size = WIDTH[np.abs(difference)]
    code = np.where(difference < 0, difference + (1 << size) - 1, difference)
    dc_first = aligned(bits_of(size << size | code, size + 4), np.add.reduceat(size + 4, starts[:-1]).tolist())
    dc_refined = aligned((dc & 1).astype("u1"), counts)
    low, rest = (cells[:, 1:6] >> 1).tobytes(), (cells[:, 6:] >> 1).tobytes()
    corrections, bits, sizes = ((cells[:, 1:] & 1) ^ (cells[:, 1:] < 128)).ravel(), [], []
    starts = starts.tolist()
    for at, end in zip(starts, starts[1:]):
        held = len(bits)
        for start in range(at, end, EOB_MOST):
            to = min(start + EOB_MOST, end)
            bits += [end_of_blocks(to - start), corrections[start * 63 : to * 63]]
        sizes.append(sum(map(len, bits[held:])))
    ac_refined = aligned(np.concatenate(bits), sizes)
    out = []
    for i, ((_, n_bytes), (wide, high)) in enumerate(zip(payloads, shapes)):
        first, later = [], []
        for number, k in enumerate(range(3 * i, 3 * i + 3), 1):
            at, end = starts[k], starts[k + 1]
            first += [scan(number, 0, 0, 0, 0, 1, dc_first[k]), scan(number, 0, 1, 5, 0, 1, low[5 * at : 5 * end]), scan(number, 0, 6, 63, 0, 1, rest[58 * at : 58 * end])]
            later += [scan(number, 0, 0, 0, 1, 0, dc_refined[k]), scan(number, 1, 1, 63, 1, 0, ac_refined[k])]
        head = [b"\xff\xd8", JFIF, segment(0xFE, struct.pack(HEADER, TAG, n_bytes)), segment(0xDB, bytes([0, *[QUANT] * 64])), segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
        out.append(b"".join([*head, CODES, *first, *later, b"\xff\xd9"]))
    return out


class Bits:
    """Entropy-coded data of one restart interval, bytes already freed of stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        a = self.at
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 4], "big") >> (32 - (a & 7) - n) & (1 << n) - 1

    def symbol(self, table: list[int]) -> int:
        a = self.at
        found = table[int.from_bytes(self.data[a >> 3 : (a >> 3) + 3], "big") >> (8 - (a & 7)) & 0xFFFF]
        self.at = a + (found >> 8)
        return found & 255

    def many(self, n: int) -> np.ndarray:
        a, self.at = self.at, self.at + n
        return np.unpackbits(np.frombuffer(self.data, "u1", ((a & 7) + n + 7) // 8, a >> 3))[a & 7 : (a & 7) + n]


_TABLES: dict[bytes, tuple[list[int], int | None]] = {}


def decoding_table(lengths: bytes, symbols: bytes) -> tuple[list[int], int | None]:
    """(length << 8 | symbol for each 16 bits that may come, the symbol if there is one alone, of one bit)"""
    found = _TABLES.get(lengths + symbols)
    if found is None:
        table, code, at = [1 << 8] * 65536, 0, 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                table[code << 16 - n : (code + 1) << 16 - n] = [n << 8 | symbols[at]] * (1 << 16 - n)
                code, at = code + 1, at + 1
            code <<= 1
        found = _TABLES[lengths + symbols] = (table, symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None)
    return found


def extend(value: int, size: int) -> int:
    return value if not size or value >> size - 1 else value - (1 << size) + 1


def dc_first(bits: Bits, blocks: list[tuple[np.ndarray, np.ndarray, list[int]]], low: int) -> None:
    """blocks: (coefficients, the blocks of them in the order of this scan, table) of each component, turn by turn of one block."""
    if len(blocks) == 1:
        coefficients, order, table = blocks[0]
        last, out, data, at, number = 0, [], bits.data, bits.at, int.from_bytes
        for _ in range(len(order)):  # as symbol() and take() do
            word, used = number(data[at >> 3 : (at >> 3) + 6], "big"), at & 7
            found = table[word >> (32 - used) & 0xFFFF]
            size = found & 255
            used += (found >> 8) + size
            at += (found >> 8) + size
            if size:
                value = word >> (48 - used) & (1 << size) - 1
                last += value if value >> size - 1 else value - (1 << size) + 1
            out.append(last << low)
        bits.at = at
        coefficients[stretch(order), 0] = out
        return
    last = [0] * len(blocks)
    for turn in range(len(blocks[0][1])):
        for c, (coefficients, order, table) in enumerate(blocks):
            for block in order[turn]:
                size = bits.symbol(table)
                last[c] += extend(bits.take(size), size)
                coefficients[block, 0] = last[c] << low


def stretch(order: np.ndarray) -> np.ndarray | slice:
    """Ascending places of blocks, as a slice where none is left out, which numpy reads and writes at once."""
    return slice(int(order[0]), int(order[-1]) + 1) if len(order) and order[-1] - order[0] == len(order) - 1 else order


def seven(low: int) -> np.ndarray:
    """Coefficients by the byte that holds the bit of their code, which is zero, and their own seven."""
    found = _SEVEN.get(low)
    if found is None:
        value = np.arange(256, dtype="int32")
        found = _SEVEN[low] = value - (value >> 6 == 0) * np.int32(127) << low
    return found


def ac_first(bits: Bits, rows: np.ndarray, order: np.ndarray, table: tuple[list[int], int | None], first: int, last: int, low: int) -> None:
    lookup, alone = table
    if alone is not None and alone >> 4 == 0 and alone:  # every coefficient of the band is there and has the same number of bits
        size, count = alone & 15, len(order) * (last - first + 1)
        if size == 7:  # a byte each
            value = seven(low)[np.frombuffer(bits.data, "u1", count)]
        else:
            value = (bits.many(count * (1 + size)).reshape(count, 1 + size)[:, 1:].astype("int64") @ (1 << np.arange(size)[::-1])).astype("int32")
            value -= (value >> size - 1 == 0) * np.int32((1 << size) - 1)
            value <<= low
        rows[stretch(order), first : last + 1] = value.reshape(-1, last - first + 1)
        return
    run = 0
    for block in order.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            zeros, size = divmod(bits.symbol(lookup), 16)
            if size:
                k += zeros
                rows[block, k] = extend(bits.take(size), size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def ac_refine(bits: Bits, rows: np.ndarray, order: np.ndarray, table: tuple[list[int], int | None], first: int, last: int, low: int) -> None:
    lookup, at = table[0], 0

    def correct(some: np.ndarray, a: int) -> None:
        """One bit for each coefficient that is not zero."""
        some = stretch(some)
        band = rows[some, a : last + 1]
        if band.all():
            step, sign = bits.many(band.size).astype(band.dtype).reshape(band.shape), band >> 31
            step <<= low
            step ^= sign  # the step or, for negative ones, less it
            step -= sign
            rows[some, a : last + 1] = np.add(band, step, out=step)
            return
        there = band != 0
        step = np.zeros_like(band)
        step[there] = bits.many(int(there.sum())).astype(band.dtype) << low
        rows[some, a : last + 1] = band + np.sign(band) * step

    while at < len(order):
        block, k = order[at], first
        while k <= last:
            zeros, size = divmod(bits.symbol(lookup), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                correct(order[at : at + 1], k)
                if run > 1:
                    correct(order[at + 1 : at + run], first)
                at += run - 1
                break
            value = (1 if bits.take(1) else -1) << low if size else 0
            while k <= last:
                if rows[block, k]:
                    if bits.take(1):
                        rows[block, k] += np.sign(rows[block, k]) << low
                elif zeros:
                    zeros -= 1
                else:
                    rows[block, k] = value
                    k += 1
                    break
                k += 1
        at += 1


def order_of(wide: int, tall: int, stride: int) -> np.ndarray:
    """Places of a component's own blocks, row by row; few are kept, and none of large pictures."""
    found = _ORDERS.get((wide, tall, stride))
    if found is None:
        found = (np.arange(tall)[:, None] * stride + np.arange(wide)).ravel()
        if len(_ORDERS) < 1024 and len(found) < 4096:
            _ORDERS[wide, tall, stride] = found
    return found


def read_jpeg(data: bytes) -> dict:
    """Coefficient arrays (blocks x 64, zigzag order) of a progressive JPEG after all scans, with what is needed to show them."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quants, parts, by_id, comment, restart = 2, {}, {}, [], {}, b"", 0
    info: dict = {}
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype("int64")
                body = body[1 + (128 if wide else 64) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = decoding_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, count = struct.unpack(">BHHB", body[:6])
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(count)]
            by_id = {p["id"]: p for p in reversed(parts)}
            h, v = max(p["h"] for p in parts), max(p["v"] for p in parts)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for p in parts:
                p["stride"], p["rows"] = across * p["h"], down * p["v"]
                p["own"] = -(-(-(-width * p["h"] // h)) // 8), -(-(-(-height * p["v"] // v)) // 8)
                p["c"] = np.zeros((p["stride"] * p["rows"], 64), "int32")
                p["order"] = order_of(*p["own"], p["stride"])
            info = {"height": height, "width": width, "h": h, "v": v, "parts": parts, "across": across, "down": down}
        elif marker in range(0xC0, 0xD0):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(by_id[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = at
            while True:  # to the next marker that is neither stuffing nor a restart
                end = data.index(b"\xff", end)
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            coded, at = data[at:end], end
            read_scan(coded, chosen, tables, first, last, high, low, restart, info)
    for p in parts:
        p["quant"] = quants[p["q"]]
    return info | {"comment": comment}


def read_scan(coded: bytes, chosen: list, tables: dict, first: int, last: int, high: int, low: int, restart: int, info: dict) -> None:
    if len(chosen) == 1:
        orders = [chosen[0][0]["order"]]
        turns = len(orders[0])
    else:
        turns, orders = info["across"] * info["down"], []
        y, x = np.divmod(np.arange(turns), info["across"])
        for p, _ in chosen:
            orders.append(((y[:, None, None] * p["v"] + np.arange(p["v"])[:, None]) * p["stride"] + x[:, None, None] * p["h"] + np.arange(p["h"])).reshape(turns, -1))
    if restart:
        import re

        pieces = re.split(rb"\xff[\xd0-\xd7]", coded)
    else:
        pieces = [coded]
    step = restart or turns
    for i, piece in enumerate(pieces):
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        some = [o[i * step : (i + 1) * step] for o in orders] if restart else orders
        if first == 0 and high == 0:
            dc_first(bits, [(p["c"], o, tables[t >> 4][0]) for (p, t), o in zip(chosen, some)], low)
        elif first == 0:
            if len(chosen) == 1:
                chosen[0][0]["c"][stretch(some[0]), 0] |= bits.many(len(some[0])).astype("int32") << low
            else:
                for turn in range(len(some[0])):
                    for (p, _), o in zip(chosen, some):
                        p["c"][o[turn], 0] |= bits.many(len(o[turn])).astype("int32") << low
        else:
            (ac_refine if high else ac_first)(bits, chosen[0][0]["c"], some[0], tables[16 | chosen[0][1] & 15], first, last, low)


#: Blocks that are transformed at a time: so few that the library for matrices starts no threads, which would spin for each document.
FEW = 64


#: What rounding adds before the fraction is cut off.
HALF = 0.5 + 1e-7


def colours() -> dict[str, np.ndarray]:
    """What chroma adds to luma, rounded, by Cr for red, by Cb and Cr for green, by Cb for blue: luma is whole, so sums are as if rounded themselves."""
    if not _COLOURS:
        x = np.arange(256.0) - 128
        made = {"red": 1.402 * x, "green": -0.344136 * x[:, None] - 0.714136 * x, "blue": 1.772 * x}
        _COLOURS.update({k: np.floor(v + HALF).astype("int16") for k, v in made.items()})
    return _COLOURS


def within_bytes(x: np.ndarray) -> np.ndarray:
    """x itself, from 0 to 255."""
    np.maximum(x, 0, out=x)
    return np.minimum(x, 255, out=x)


def rgb_of(info: dict) -> np.ndarray:
    """height x width x 3 bytes: inverse transform, chroma repeated to full resolution, colours by the JFIF formulas."""
    scaled = np.concatenate([p["c"] * p["quant"] for p in info["parts"]], dtype=float)
    samples = np.empty_like(scaled)
    for at in range(0, len(scaled), FEW):
        np.matmul(scaled[at : at + FEW], BASIS, out=samples[at : at + FEW])
    samples += 128 + HALF
    whole, planes, at = within_bytes(samples).astype("u1"), [], 0
    for p in info["parts"]:
        found, at = whole[at : at + len(p["c"])], at + len(p["c"])
        planes.append(found.reshape(p["rows"], p["stride"], 8, 8).swapaxes(1, 2).reshape(p["rows"] * 8, -1))

    def full(plane: np.ndarray, p: dict) -> np.ndarray:
        for times, axis in ((info["v"] // p["v"], 0), (info["h"] // p["h"], 1)):
            plane = plane.repeat(times, axis) if times > 1 else plane
        return plane[: info["height"], : info["width"]]

    parts = info["parts"]
    if len(planes) == 1:
        return np.repeat(full(planes[0], parts[0])[:, :, None], 3, 2)
    y, table = full(planes[0], parts[0]).astype("int16"), colours()
    if [parts[1][k] for k in "hv"] == [parts[2][k] for k in "hv"]:
        green = full(table["green"][planes[1], planes[2]], parts[1])
    else:
        green = table["green"][full(planes[1], parts[1]), full(planes[2], parts[2])]
    rgb = np.empty((*y.shape, 3), "u1")
    for c, more in enumerate((full(table["red"][planes[2]], parts[2]), green, full(table["blue"][planes[1]], parts[1]))):
        more = more + y
        rgb[:, :, c] = within_bytes(more)
    return rgb


def payload_of(info: dict) -> tuple[bytes, int]:
    """(payload with its padding, bytes without it) from the coefficients."""
    tag, n = struct.unpack(HEADER, info["comment"])
    if tag != TAG:
        raise ValueError("no payload")
    values = np.concatenate([p["c"] for p in info["parts"]])
    size = max(64, -(-n // 64) * 64)
    return np.where(values < 0, values + 255, values).astype("u1").tobytes()[:size], n


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean and four-bin histogram of each channel."""
    flat = rgb.reshape(-1, 3)
    bins = [np.bincount(flat[:, c] >> 6, minlength=4).tolist() for c in range(3)]
    means = [int(flat[:, c].sum(dtype="int64")) * 1000 // len(flat) for c in range(3)]
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{','.join(map(str, means))}:{','.join(str(n) for b in bins for n in b)}"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write each whole text's bytes, padded with zeros to a positive multiple of 64, as a JPEG column (doc_id, n_bytes, media) and read that table.

    Null texts count as empty: 64 zero bytes. Texts of any length are stored whole: 64 bytes a block, so the format's largest
    picture takes over 6 GB. Repeated rows each get a row, an empty table gives an empty one, other columns are not read.
    """

    def make():
        def each(part):
            raw = [t.encode() for t in part["text"].to_pylist()]
            return {"doc_id": part["doc_id"], "n_bytes": [len(t) for t in raw], "media": write_payloads([(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0"), len(t)) for t in raw])}

        return each

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    return stage(map_rows(texts, make, "doc_id long, n_bytes long, media binary", lambda batches: text_slices(batches, size=2 << 20)), "media", path, LEVEL, PAGE, FILE_ROWS)


def decode_one(media: bytes | None) -> dict:
    """payload, height, width, rgb (bytes in row order) of a file; payload is None if it holds none, all are None, and error says why, for null and broken files."""
    try:
        if media is None:
            raise ValueError("null")
        found = read_jpeg(media)
        rgb = rgb_of(found)
        payload = payload_of(found)[0] if found["comment"][:4] == TAG else None
        return {"payload": payload, "height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes(), "error": None}
    except (ValueError, KeyError, IndexError, TypeError, StopIteration, OverflowError, struct.error) as e:
        return {"payload": None, "height": None, "width": None, "rgb": None, "error": f"{type(e).__name__}: {e}"[:200]}


def decode_media(media: DataFrame) -> DataFrame:
    """media (a binary column, beside others that stay) to payload, height, width, the RGB tensor rgb (height x width x 3 bytes), error.

    Null and broken files give nulls and an error, progressive files without a payload a null payload. A column that has one
    of these names is replaced. Repeated rows each get a row; no rows, no rows.
    """
    schema = "payload binary, height int, width int, rgb binary, error string"
    made = [c.split()[0] for c in schema.split(", ")]
    others = [f for f in media.schema if f.name not in ("media", *made)]

    def make():
        def each(part):
            found = [decode_one(m) for m in part["media"].to_pylist()]
            return {f.name: part[f.name] for f in others} | {c: [x[c] for x in found] for c in made}

        return each

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return map_rows(media.select(*[f"`{f.name}`" for f in others], "media"), make, kept + schema, lambda batches: text_slices(batches, "media", 2 << 20))


def store_tensors(decoded: DataFrame, path: str | None = None) -> DataFrame:
    """Write decoded rows with their tensors and read that table."""
    return stage(decoded, "tensors", path, LEVEL, PAGE)


def with_feature(tensors: DataFrame) -> DataFrame:
    """Adds feature of the stored tensors (height, width, rgb), null where there is none, and leaves rgb out."""
    others = [f for f in tensors.schema if f.name not in ("rgb", "feature")]

    def make():
        def each(part):
            found = [None if x is None else feature_of(np.frombuffer(x, "u1").reshape(h, w, 3)) for x, h, w in zip(part["rgb"].to_pylist(), part["height"].to_pylist(), part["width"].to_pylist())]
            return {f.name: part[f.name] for f in others} | {"feature": found}

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", feature string"
    return map_rows(tensors, make, schema, lambda batches: text_slices(batches, "rgb", 8 << 20))


def features_by_parts(media: DataFrame, decoded: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """with_feature of the stored tensors of decoded(part), for parts of a staged table by its files, the one after the other.

    Tensors of all values take four times what the texts take as Parquet. Every one is stored whole and read again, but those of
    a part are deleted when its features are staged, so that disk holds one part's. Who wants to keep tensors calls
    store_tensors. A table without rows gives none.
    """
    found = []
    for part in file_groups(media, PART_BYTES, MOST_PARTS):
        tensors = store_tensors(decoded(part))
        try:
            found.append(stage(with_feature(tensors), "features"))
        finally:
            remove(media.sparkSession, tensors)
    return reduce(DataFrame.unionByName, found)
