"""Graphs over the streams of a chunk: steps with ports, selectors, functions that build graphs, terminal coders, frames.

A chunk is a row of a DataFrame with its streams as binary columns. compress() runs a graph over every row where Spark holds it
and gives a frame, which names the steps taken and so is all that decompress() needs. Steps, selectors and builders are
registered by name, the user's own like those here; a graph is a value that to_json() writes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coders
from ..spec import KINDS, StreamSpec


@dataclass(frozen=True)
class Stream:
    """Bytes of one kind: fields of `width` bytes for struct and numeric, lengths in bytes for string."""

    content: bytes
    kind: str = "serial"
    width: int = 1
    lengths: np.ndarray | None = None

    @property
    def values(self) -> np.ndarray:
        return coders.numbers(self.content, self.width)

    def __len__(self) -> int:
        return len(self.lengths) if self.kind == "string" else len(self.content) // self.width


def numeric(x: np.ndarray, width: int) -> Stream:
    return Stream(np.asarray(x).astype(f"<u{width}").tobytes(), "numeric", width)


def serial(raw: bytes) -> Stream:
    return Stream(raw)


@dataclass(frozen=True)
class Step:
    """encode(streams, params) -> (header, streams); decode(header, streams) -> streams. kinds: what each input may be, None for any number of any."""

    encode: Callable[[list[Stream], dict], tuple[bytes, list[Stream]]]
    decode: Callable[[bytes, list[Stream]], list[Stream]]
    kinds: tuple[tuple[str, ...], ...] | None = (KINDS,)


@dataclass(frozen=True)
class Graph:
    """name of a step, coder (`=coder`), selector (`?selector`) or builder (`@builder`), successors of its outputs or choices, parameters.

    hole: a name by which training finds the node and puts another graph in its place.
    """

    name: str
    successors: tuple[Graph, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    hole: str | None = None

    def with_params(self, **params) -> Graph:
        return replace(self, params=self.params | params)

    def nodes(self) -> list[Graph]:
        return [self, *(n for s in self.successors for n in s.nodes())]

    def put(self, hole: str, graph: Graph) -> Graph:
        """The graph with what is named hole replaced."""
        return graph if self.hole == hole else replace(self, successors=tuple(s.put(hole, graph) for s in self.successors))

    def to_json(self) -> str:
        def plain(g: Graph) -> dict:
            return {"name": g.name, "params": {k: {"hex": v.hex()} if isinstance(v, bytes) else v for k, v in g.params.items()}, "hole": g.hole, "successors": [plain(s) for s in g.successors]}

        return json.dumps(plain(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Graph:
        def made(d: dict) -> Graph:
            params = {k: bytes.fromhex(v["hex"]) if isinstance(v, dict) and set(v) == {"hex"} else v for k, v in d["params"].items()}
            return Graph(d["name"], tuple(map(made, d["successors"])), params, d["hole"])

        return made(json.loads(text))


STEPS: dict[str, Step] = {}
SELECTORS: dict[str, Callable[[Stream, Graph, Context], int]] = {}
BUILDERS: dict[str, Callable[[list[Stream], dict, Context], Graph]] = {}


def step(name: str, *successors: Graph, **params) -> Graph:
    return Graph(name, successors, params)


def leaf(coder: str, **params) -> Graph:
    return Graph(f"={coder}", (), params)


def select(selector: str, *choices: Graph, **params) -> Graph:
    return Graph(f"?{selector}", choices, params)


def build(builder: str, **params) -> Graph:
    return Graph(f"@{builder}", (), params)


def hole(name: str, default: Graph) -> Graph:
    """A node that behaves as default until training puts something in its place."""
    return replace(default, hole=name)


def register(name: str, encode: Callable, decode: Callable, kinds: tuple[tuple[str, ...], ...] | None = (KINDS,)) -> None:
    """Adds a step. One kinds entry an input; None for any number of inputs."""
    if name in STEPS:
        raise ValueError(f"{name} is registered")
    STEPS[name] = Step(encode, decode, kinds)


# -- running -------------------------------------------------------------------------------------------------------------


class Context:
    """What a selector or builder may do with a graph on the data at hand, and what is observed of a run."""

    def __init__(self, observed: Callable[[str, list[Stream]], None] | None = None):
        self.observed, self.kept = observed, {}

    def run(self, graph: Graph, streams: list[Stream]) -> bytes:
        """Frame of streams by graph. What fails is stored if the graph is permissive, and raised otherwise."""
        try:
            return self._run(graph, streams)
        except (ValueError, KeyError, OverflowError):
            if not graph.params.get("permissive"):
                raise
            return self._run(GENERIC_STORE, streams)

    def measure(self, graph: Graph, streams: list[Stream]) -> int | None:
        """Bytes of the frame, None if the graph fails on these streams."""
        try:
            data = Context()._run(graph, streams)
            self.kept[id(graph)] = (streams, data)  # what is chosen next need not run again
            return len(data)
        except (ValueError, KeyError, OverflowError):
            return None

    def _run(self, graph: Graph, streams: list[Stream]) -> bytes:
        if self.observed and graph.hole:
            self.observed(graph.hole, streams)
        kind, name = graph.name[0], graph.name[1:]
        if kind == "?":
            self.kept = {}
            chosen = graph.successors[SELECTORS[name](streams[0], graph, self)]
            held, data = self.kept.pop(id(chosen), (None, b""))
            self.kept = {}
            return data if held is not None and held[0] is streams[0] and not self.observed else self.run(chosen, streams)
        if kind == "@":
            return self.run(BUILDERS[name](streams, graph.params, self), streams)
        if kind == "=":
            (s,) = streams
            if s.kind == "string":
                return self._run(step("separate", graph, leaf("store")), streams)
            params = {k: v for k, v in graph.params.items() if k != "permissive"}
            return frame(graph.name, struct.pack("<BB", KINDS.index(s.kind), s.width), [TERMINAL[name].encode(s.content, s.width, **params)])
        found = STEPS[graph.name]
        if found.kinds is not None:
            if len(streams) != len(found.kinds):
                raise ValueError(f"{graph.name} takes {len(found.kinds)} streams")
            for s, accepted in zip(streams, found.kinds):
                if s.kind not in accepted:
                    raise ValueError(f"{graph.name} does not take {s.kind}")
        header, out = found.encode(streams, graph.params)
        next_ = graph.successors if len(graph.successors) == len(out) else graph.successors * len(out) if len(graph.successors) == 1 else None
        if next_ is None:
            raise ValueError(f"{graph.name} made {len(out)} streams for {len(graph.successors)} successors")
        return frame(graph.name, header, [self.run(g, [s]) for g, s in zip(next_, out)])


def frame(name: str, header: bytes, parts: list[bytes]) -> bytes:
    raw = name.encode()
    return struct.pack("<BIH", len(raw), len(header), len(parts)) + raw + header + b"".join(struct.pack("<I", len(p)) + p for p in parts)


def opened(data: bytes) -> tuple[str, bytes, list[bytes]]:
    name, header, count = struct.unpack_from("<BIH", data)
    at, parts = 7 + name + header, []
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if at != len(data):
        raise ValueError("a frame of another length")
    return data[7 : 7 + name].decode(), data[7 + name : 7 + name + header], parts


def restore(data: bytes, dictionaries: dict[int, bytes] | None = None) -> list[Stream]:
    name, header, parts = opened(data)
    if name[0] == "=":
        kind, width = struct.unpack("<BB", header)
        more = {"dictionaries": dictionaries} if name == "=zstd" else {}
        return [Stream(TERMINAL[name[1:]].decode(parts[0], width, **more), KINDS[kind], width)]
    return STEPS[name].decode(header, [s for p in parts for s in restore(p, dictionaries)])


@dataclass(frozen=True)
class Input:
    """A binary column as a stream; lengths: an array column with the lengths of strings."""

    column: str
    kind: str = "serial"
    width: int = 1
    lengths: str | None = None


def _streams(part: pa.RecordBatch, inputs: list[Input]) -> list[list[Stream]]:
    columns = [(part[i.column].to_pylist(), part[i.lengths].to_pylist() if i.lengths else None, i) for i in inputs]
    return [[Stream(raw[at] or b"", i.kind, i.width, np.asarray(sizes[at] or [], "int64") if sizes else None) for raw, sizes, i in columns] for at in range(part.num_rows)]


def _columns(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


#: Rows that a worker turns into streams at a time.
ROWS = 16


def compress(df: DataFrame, graph: Graph, inputs: list[Input], keys: list[str]) -> DataFrame:
    """(keys, raw_bytes, frame) of every row; null contents are empty. Rows stay where they are: nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = _streams(part, inputs)
                frames = [Context().run(graph, s) for s in rows]
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array([sum(len(s.content) for s in r) for r in rows], pa.int64()), pa.array(frames, pa.binary())], names=[*keys, "raw_bytes", "frame"])

    return df.mapInArrow(run, _columns(df, keys) + "raw_bytes long, frame binary")


def decompress(frames: DataFrame, outputs: list[str], keys: list[str], dictionaries: dict[int, bytes] | None = None) -> DataFrame:
    """(keys, outputs: binary, and outputs with _lengths: arrays for strings, else null) of every frame."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [restore(f, dictionaries) for f in part["frame"].to_pylist()]
                columns, names = [part[k] for k in keys], list(keys)
                for i, name in enumerate(outputs):
                    columns += [pa.array([r[i].content for r in rows], pa.binary()), pa.array([None if r[i].lengths is None else r[i].lengths.tolist() for r in rows], pa.list_(pa.int64()))]
                    names += [name, f"{name}_lengths"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.mapInArrow(run, _columns(frames, keys) + ", ".join(f"`{o}` binary, `{o}_lengths` array<long>" for o in outputs))


def frame_info(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, step, header_bytes, bytes) of every node of every frame: what was chosen and what it takes."""

    def walk(data: bytes, path: str) -> list[tuple]:
        name, header, parts = opened(data)
        own = (path, name, len(header), len(data))
        return [own] if name[0] == "=" else [own, *(x for i, p in enumerate(parts) for x in walk(p, f"{path}.{i}"))]

    def run(batches):
        for batch in batches:
            found = [walk(f, "0") for f in batch["frame"].to_pylist()]
            rows = [x for some in found for x in some]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([*(batch[k].take(at) for k in keys), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64())))], names=[*keys, "path", "step", "header_bytes", "bytes"])

    return frames.mapInArrow(run, _columns(frames, keys) + "path string, step string, header_bytes long, bytes long")


def collect_samples(df: DataFrame, graph: Graph, inputs: list[Input], keys: list[str]) -> DataFrame:
    """(keys, hole, port, kind, width, content, lengths) of the streams that reach the named nodes of a graph."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for at, streams in enumerate(_streams(batch, inputs)):
                Context(lambda name, got, at=at: out.extend((at, name, i, s.kind, s.width, s.content, None if s.lengths is None else s.lengths.tolist()) for i, s in enumerate(got))).run(graph, streams)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array([o[0] for o in out], pa.int64())) for k in keys), *(pa.array([o[i + 1] for o in out], t) for i, t in enumerate(kinds))], names=[*keys, "hole", "port", "kind", "width", "content", "lengths"])

    return df.mapInArrow(run, _columns(df, keys) + "hole string, port int, kind string, width int, content binary, lengths array<long>")


def specs(streams: list[Stream]) -> list[StreamSpec]:
    return [StreamSpec(str(i), s.kind, s.width if s.kind == "numeric" else None) for i, s in enumerate(streams)]


# -- steps ---------------------------------------------------------------------------------------------------------------

NUMERIC, FIELDS, STRING = ("numeric",), ("struct", "numeric"), ("string",)


def _one(name: str, kinds: tuple[str, ...], encode: Callable[[np.ndarray, int, dict], tuple[bytes, np.ndarray, int]], decode: Callable[[bytes, np.ndarray, int], np.ndarray]) -> None:
    """A step from one numeric stream to one; its header starts with the width it came with."""

    def enc(streams, params):
        header, x, width = encode(streams[0].values, streams[0].width, params)
        return bytes([streams[0].width]) + header, [numeric(x, width)]

    register(name, enc, lambda header, streams: [numeric(decode(header[1:], streams[0].values, header[0]), header[0])], (kinds,))


def _delta_back(header: bytes, x: np.ndarray, width: int) -> np.ndarray:
    return np.cumsum(x, dtype=f"<u{width}")


def _delta(x: np.ndarray, width: int, params: dict) -> tuple[bytes, np.ndarray, int]:
    return b"", np.diff(x, prepend=x.dtype.type(0)), width


def _zigzag(x: np.ndarray, width: int, params: dict) -> tuple[bytes, np.ndarray, int]:
    signed = x.view(f"<i{width}")
    return b"", (signed << 1 ^ signed >> 8 * width - 1).view(f"<u{width}"), width


def _zigzag_back(header: bytes, x: np.ndarray, width: int) -> np.ndarray:
    return x >> x.dtype.type(1) ^ -(x & x.dtype.type(1)).view(f"<i{width}").astype(f"<i{width}").view(f"<u{width}")


def _narrow(top: int) -> int:
    return next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)


def _range(x: np.ndarray, width: int, params: dict) -> tuple[bytes, np.ndarray, int]:
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return struct.pack("<Q", low), x - x.dtype.type(low), _narrow(high - low)


def _range_back(header: bytes, x: np.ndarray, width: int) -> np.ndarray:
    return x.astype(f"<u{width}") + np.dtype(f"<u{width}").type(struct.unpack("<Q", header)[0])


def _divide(x: np.ndarray, width: int, params: dict) -> tuple[bytes, np.ndarray, int]:
    divisor = params.get("divisor") or (int(np.gcd.reduce(x)) if len(x) else 1) or 1
    if (x % x.dtype.type(divisor)).any():
        raise ValueError("not divisible")
    return struct.pack("<Q", divisor), x // x.dtype.type(divisor), width


def _divide_back(header: bytes, x: np.ndarray, width: int) -> np.ndarray:
    return x * np.dtype(f"<u{width}").type(struct.unpack("<Q", header)[0])


_one("delta", NUMERIC, _delta, _delta_back)
_one("zigzag", NUMERIC, _zigzag, _zigzag_back)
_one("range_pack", NUMERIC, _range, _range_back)
_one("divide_by", NUMERIC, _divide, _divide_back)


def _as_kind(kind: str, width: int | None = None):
    def enc(streams, params):
        s, w = streams[0], width or streams[0].width
        if len(s.content) % w:
            raise ValueError("no whole number of fields")
        return struct.pack("<BB", KINDS.index(s.kind), s.width), [Stream(s.content, kind, w)]

    return enc


def _as_it_was(header: bytes, streams: list[Stream]) -> list[Stream]:
    kind, width = struct.unpack("<BB", header)
    return [Stream(streams[0].content, KINDS[kind], width)]


register("to_struct", _as_kind("struct"), _as_it_was, (FIELDS,))
register("to_serial", _as_kind("serial", 1), _as_it_was, (FIELDS,))
for _w in (1, 2, 4, 8):
    register(f"to_numeric{8 * _w}", _as_kind("numeric", _w), _as_it_was, (("serial", "struct"),))

register("transpose_split", lambda streams, params: (struct.pack("<BB", KINDS.index(streams[0].kind), streams[0].width), [serial(streams[0].content[i :: streams[0].width]) for i in range(streams[0].width)]),
         lambda header, streams: [Stream(np.stack([np.frombuffer(s.content, "u1") for s in streams], 1).tobytes(), KINDS[header[0]], header[1])], (FIELDS,))


def _separate_back(header: bytes, streams: list[Stream]) -> list[Stream]:
    lengths = streams[1].values.astype("int64")
    if lengths.sum() != len(streams[0].content):
        raise ValueError("lengths do not add up")
    return [Stream(streams[0].content, "string", 1, lengths)]


register("separate", lambda streams, params: (b"", [serial(streams[0].content), numeric(streams[0].lengths, 4)]), _separate_back, (STRING,))


def _tokenize(streams, params):
    symbols, first, at = np.unique(streams[0].values, return_index=True, return_inverse=True)
    if not params.get("sorted"):
        order = np.argsort(first)
        symbols, at = symbols[order], np.argsort(order)[at]
    width = streams[0].width
    return bytes([width]), [numeric(symbols, width), numeric(at, 1 if len(symbols) <= 256 else 2 if len(symbols) <= 65536 else 4)]


register("tokenize", _tokenize, lambda header, streams: [numeric(streams[0].values[streams[1].values] if len(streams[1]) else streams[0].values, header[0])], (NUMERIC,))


def _concat(streams, params):
    kinds = {(s.kind, s.width) for s in streams}
    if len(kinds) != 1 or streams[0].kind == "string":
        raise ValueError("streams of one kind and width are joined")
    kind, width = kinds.pop()
    return bytes([KINDS.index(kind)]), [numeric(np.asarray([len(s.content) for s in streams]), 4), Stream(b"".join(s.content for s in streams), kind, width)]


def _concat_back(header: bytes, streams: list[Stream]) -> list[Stream]:
    ends = np.cumsum(streams[0].values.astype("int64")).tolist()
    return [Stream(streams[1].content[a:b], streams[1].kind, streams[1].width) for a, b in zip([0, *ends], ends)]


register("concat", _concat, _concat_back, None)


def _split(streams, params):
    s = streams[0]
    sizes = list(SIZES[params["parser"]](s)) if "parser" in params else list(params["sizes"])
    if sizes and not sizes[-1] and "parser" not in params:
        sizes[-1] = len(s) - sum(sizes)
    if sum(sizes) != len(s) or min(sizes, default=0) < 0:
        raise ValueError("segments do not add up")
    ends = np.cumsum(sizes).tolist()
    return b"", [Stream(s.content[a * s.width : b * s.width], s.kind, s.width) for a, b in zip([0, *ends], ends)]


#: Parsers by name: stream -> sizes of its segments (split), (sizes, tags) (dispatch) or lengths of its strings (set_lengths).
SIZES: dict[str, Callable] = {}
register("split", _split, lambda header, streams: [Stream(b"".join(s.content for s in streams), streams[0].kind, streams[0].width)], (("serial", "struct", "numeric"),))


def _dispatch(streams, params):
    sizes, tags = (np.asarray(x, "int64") for x in SIZES[params["parser"]](streams[0]))
    count = params["outputs"]
    if sizes.sum() != len(streams[0].content) or len(sizes) != len(tags) or (len(tags) and not 0 <= tags.min() <= tags.max() < min(count, 1 << 16)):
        raise ValueError("segments do not add up, or a tag is out of range")
    ends = np.cumsum(sizes)
    parts = [streams[0].content[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return b"", [numeric(tags, 2), numeric(sizes, 4), *(serial(b"".join(p for p, t in zip(parts, tags.tolist()) if t == i)) for i in range(count))]


def _dispatch_back(header: bytes, streams: list[Stream]) -> list[Stream]:
    at, out = [0] * (len(streams) - 2), []
    for tag, size in zip(streams[0].values.tolist(), streams[1].values.tolist()):
        out.append(streams[2 + tag].content[at[tag] : at[tag] + size])
        at[tag] += size
    return [serial(b"".join(out))]


register("dispatch", _dispatch, _dispatch_back, (("serial",),))


def _set_lengths(streams, params):
    lengths = np.asarray(SIZES[params["parser"]](streams[0]), "int64")
    if lengths.sum() != len(streams[0].content):
        raise ValueError("lengths do not add up")
    return b"", [Stream(streams[0].content, "string", 1, lengths)]


register("set_lengths", _set_lengths, lambda header, streams: [serial(streams[0].content)], (("serial",),))


def _merge_sorted(streams, params):
    x = streams[0].values
    run = np.cumsum(np.concatenate([np.zeros(min(1, len(x)), "int64"), x[1:] <= x[:-1]]))
    if streams[0].width != 4 or len(run) and run[-1] >= 64:
        raise ValueError("up to 64 ascending runs of 4 bytes")
    merged, at = np.unique(x, return_inverse=True)
    bits = np.zeros(len(merged), "u8")
    np.bitwise_or.at(bits, at, np.uint64(1) << run.astype("u8"))
    return b"", [numeric(bits, 8), numeric(merged, 4)]


def _merge_back(header: bytes, streams: list[Stream]) -> list[Stream]:
    bits, merged = streams[0].values, streams[1].values
    return [numeric(np.concatenate([np.zeros(0, "<u4"), *(merged[bits >> np.uint64(r) & np.uint64(1) == 1] for r in range(64))]), 4)]


register("merge_sorted", _merge_sorted, _merge_back, (NUMERIC,))


# -- general coders --------------------------------------------------------------------------------------------------------


def _zstd(raw: bytes, width: int = 1, level: int = 3, dictionary: bytes | None = None) -> bytes:
    import zstandard

    number = dictionary_id(dictionary) if dictionary else 0
    held = zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_RAWCONTENT if not dictionary.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_FULLDICT) if dictionary else None
    return struct.pack("<I", number) + zstandard.ZstdCompressor(level=level, dict_data=held).compress(raw)


def _unzstd(data: bytes, width: int = 1, dictionaries: dict[int, bytes] | None = None) -> bytes:
    import zstandard

    (number,) = struct.unpack_from("<I", data)
    if number and number not in (dictionaries or {}):
        raise ValueError(f"dictionary {number} is not at hand")
    raw = (dictionaries or {}).get(number)
    held = zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT if not raw.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_FULLDICT) if raw else None
    return zstandard.ZstdDecompressor(dict_data=held).decompress(data[4:])


def dictionary_id(dictionary: bytes) -> int:
    import zlib

    return zlib.crc32(dictionary) or 1


def _lz4(raw: bytes, width: int = 1, level: int | None = None) -> bytes:
    codec = pa.Codec("lz4", compression_level=level) if level is not None else pa.Codec("lz4")
    return struct.pack("<I", len(raw)) + codec.compress(raw, asbytes=True)


def _unlz4(data: bytes, width: int = 1) -> bytes:
    (n,) = struct.unpack_from("<I", data)
    return pa.Codec("lz4").decompress(data[4:], decompressed_size=n, asbytes=True) if n else b""


TERMINAL = coders.CODERS | {"zstd": coders.Coder(_zstd, _unzstd), "lz4": coders.Coder(_lz4, _unlz4)}

# -- selectors and composed graphs ---------------------------------------------------------------------------------------


def by_kind(stream: Stream, graph: Graph, context: Context) -> int:
    """Choices in the order of KINDS; one byte wide numbers go with serial."""
    return 0 if stream.kind in ("struct", "numeric") and stream.width not in (2, 4, 8) else KINDS.index(stream.kind)


def constant_else(stream: Stream, graph: Graph, context: Context) -> int:
    return int(not (len(stream) and stream.kind != "string" and stream.content == stream.content[: stream.width] * len(stream)))


def smallest(stream: Stream, graph: Graph, context: Context) -> int:
    """The first of the choices with the strictly least frame, measured on the data; the last, which should store, if none is below it."""
    sizes = [context.measure(g, [stream]) for g in graph.successors]
    best = len(sizes) - 1
    for i, size in enumerate(sizes[:-1]):
        if size is not None and size < (sizes[best] or 0):
            best = i
    return best


def few_runs(stream: Stream, graph: Graph, context: Context) -> int:
    x = stream.values if stream.kind == "numeric" and stream.width == 4 else None
    return int(x is None or int((x[1:] <= x[:-1]).sum()) >= 64)


def empty_else(stream: Stream, graph: Graph, context: Context) -> int:
    return int(len(stream) > 0)


FEATURES = ("n", "width", "symbols", "range", "mean", "deviation", "skewness", "kurtosis", "delta_range", "sorted", "entropy")


def features_of(stream: Stream) -> list[float]:
    """One row of features of a numeric stream."""
    x = stream.values.astype(float)
    if len(x) < 2:
        return [float(len(x)), float(stream.width), float(len(x)), 0.0, float(x.sum()), *[0.0] * 6]
    d, sd = np.diff(x), x.std()
    z = (x - x.mean()) / sd if sd else np.zeros(len(x))
    _, counts = np.unique(stream.values, return_counts=True)
    p = counts / len(x)
    return [float(len(x)), float(stream.width), float(len(counts)), float(np.ptp(x)), float(x.mean()), float(x.std(ddof=1)), float((z**3).mean()), float((z**4).mean() - 3) if sd else 0.0, float(np.ptp(d)), float((d >= 0).mean()), float(-(p * np.log2(p)).sum())]


def by_trees(stream: Stream, graph: Graph, context: Context) -> int:
    """The class of the greatest score of trained trees over features; the first choice as long as there are none."""
    forests = graph.params.get("forests")
    if not forests or stream.kind != "numeric":
        return 0
    row = features_of(stream)

    def score(node) -> float:
        while isinstance(node, (list, tuple)):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    return int(np.argmax([sum(map(score, forest)) for forest in forests]))


SELECTORS |= {"by_kind": by_kind, "constant_else": constant_else, "smallest": smallest, "few_runs": few_runs, "empty_else": empty_else, "by_trees": by_trees}


def clustered(streams: list[Stream], params: dict, context: Context) -> Graph:
    """Streams of one cluster are joined and coded together; params: clusters (lists of positions; the rest stay alone)."""
    named = [tuple(c) for c in params.get("clusters", [])]
    if len({i for c in named for i in c}) != sum(map(len, named)):
        raise ValueError("a stream in two clusters")
    groups = named + [(i,) for i in range(len(streams)) if all(i not in c for c in named)]
    return step("group", generic(), groups=[list(g) for g in groups])


BUILDERS["clustered"] = clustered

STORE = leaf("store")
GENERIC_STORE = step("each", STORE)
FIELD_LZ = leaf("field_lz")
TRANSPOSED = step("transpose_split", leaf("entropy"))


def generic(level: int = 3) -> Graph:
    """By kind: serial bytes zstd, structs and numbers field_lz, strings by content and lengths; constants at once, nothing larger than as it is."""
    zstd = leaf("zstd", level=level)
    fields = select("smallest", FIELD_LZ, STORE)
    numbers = select("smallest", step("to_struct", FIELD_LZ), STORE)
    serial_ = select("smallest", zstd, STORE)
    one = select("by_kind", serial_, fields, numbers, step("separate", serial_, numbers))
    return select("constant_else", leaf("constant"), one)


#: Chains for numbers by name; select_numeric chooses among NUMERIC_CHOICES.
CHAINS: dict[str, Graph] = {
    "store": STORE,
    "zstd": leaf("zstd"),
    "lz4": leaf("lz4"),
    "field_lz": step("to_struct", FIELD_LZ),
    "transpose_split": step("to_struct", TRANSPOSED),
    "range_pack": step("range_pack", select("by_kind", leaf("entropy"), FIELD_LZ, step("to_struct", FIELD_LZ), STORE)),
    "range_pack_zstd": step("range_pack", leaf("zstd")),
    "delta_field_lz": step("delta", step("to_struct", FIELD_LZ)),
    "delta_zigzag_transpose": step("delta", step("zigzag", step("to_struct", TRANSPOSED))),
    "delta_bitpack": step("delta", step("zigzag", leaf("bitpack"))),
    "tokenize_delta_field_lz": step("tokenize", step("delta", step("to_struct", FIELD_LZ)), select("by_kind", leaf("entropy"), FIELD_LZ, step("to_struct", FIELD_LZ), STORE)),
    "delta_zstd": step("delta", leaf("zstd")),
    "bitpack": leaf("bitpack"),
    "partition_bitpack": leaf("partition_bitpack"),
    "divide_by_bitpack": step("divide_by", leaf("bitpack")),
}
NUMERIC_CHOICES = ("field_lz", "range_pack", "range_pack_zstd", "delta_field_lz", "tokenize_delta_field_lz", "zstd")


def select_numeric(forests: list | None = None) -> Graph:
    """The chain that trained trees expect to be smallest; forests as train.fit_selector gives them."""
    return select("by_trees", *[CHAINS[c] for c in NUMERIC_CHOICES], **({"forests": forests} if forests else {}))


def brute_force(*names: str) -> Graph:
    return select("smallest", *[CHAINS[n] for n in names], STORE)


def merge_or(backup: Graph) -> Graph:
    return select("few_runs", step("merge_sorted", leaf("zstd"), step("delta", leaf("bitpack"))), backup)


def _group(streams, params):
    """Streams by group; what a group of several joins has its own frame, so that each group is one output."""
    out = []
    for g in params["groups"]:
        some = [streams[i] for i in g]
        out.append(some[0] if len(some) == 1 else Stream(b"".join(s.content for s in some), some[0].kind, some[0].width))
        if len({(s.kind, s.width) for s in some}) != 1 or len(some) > 1 and some[0].kind == "string":
            raise ValueError("streams of one kind and width are joined")
    sizes = [[len(streams[i].content) for i in g] for g in params["groups"]]
    return json.dumps([params["groups"], sizes]).encode(), out


def _group_back(header: bytes, streams: list[Stream]) -> list[Stream]:
    groups, sizes = json.loads(header)
    out: list = [None] * sum(map(len, groups))
    for g, n, s in zip(groups, sizes, streams):
        at = 0
        for i, size in zip(g, n):
            out[i] = s if len(g) == 1 else Stream(s.content[at : at + size], s.kind, s.width)
            at += size
    return out


register("group", _group, _group_back, None)
register("each", lambda streams, params: (b"", streams), lambda header, streams: streams, None)


def chunk_values(df: DataFrame, content: str, keys: list[str], width: int) -> DataFrame:
    """(keys, place, value) of little-endian numbers in binary chunks; 8 bytes as two's complement."""

    def run(batches):
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):  # memory follows some chunks, not a task's
            found = [coders.numbers(raw or b"", width) for raw in part[content].to_pylist()]
            sizes = np.asarray([len(x) for x in found], "int64")
            at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            flat = np.concatenate([np.zeros(0, f"<u{width}"), *found]).astype("u8").view("i8")
            yield pa.RecordBatch.from_arrays([*(part[k].take(at) for k in keys), pa.array(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)), pa.array(flat)], names=[*keys, "place", "value"])

    return df.select(*keys, F.col(content)).mapInArrow(run, _columns(df, keys) + "place long, value long")
