"""Tagged binary messages as token streams: Thrift's compact and binary protocols, Protocol Buffers by a schema.

A message becomes tokens whose bytes, one after the other, are the message again. A token has the path of field numbers that
leads to it, a kind, and its value as a number or bytes, so a stream of one field is a filter on path.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Token = tuple[str, str, int | None, bytes | None, int]  # path, kind, number, bytes, end in the message


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("a number of over ten bytes")


def put_varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def signed(value: int, bits: int = 64) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> bits - 1 else value


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def zigzag(value: int) -> int:
    return (value << 1 ^ value >> 63) & (1 << 64) - 1


def float_bits(raw: bytes, order: str) -> int:
    """A double's bits as a signed number, so that no value is lost."""
    return struct.unpack(order + "q", raw)[0]


# -- Thrift --------------------------------------------------------------------------------------------------------------

#: Type numbers of both protocols.
COMPACT = {1: "true", 2: "false", 3: "i8", 4: "i16", 5: "i32", 6: "i64", 7: "double", 8: "binary", 9: "list", 10: "set", 11: "map", 12: "struct"}
BINARY = {2: "bool", 3: "i8", 4: "double", 6: "i16", 8: "i32", 10: "i64", 11: "binary", 12: "struct", 13: "map", 14: "set", 15: "list"}
SIZES = {"bool": 1, "i8": 1, "i16": 2, "i32": 4, "i64": 8}


def thrift_compact(data: bytes, at: int = 0) -> Iterator[Token]:
    """Tokens of one struct."""

    def value(kind: str, path: str, at: int, inside: bool = False):
        if kind in ("true", "false"):
            if inside:  # elements of lists and maps have a byte of their own
                yield path, "bool", int(data[at] == 1), None, at + 1
            return
        if kind == "i8":
            yield path, kind, signed(data[at], 8), None, at + 1
        elif kind in ("i16", "i32", "i64"):
            n, end = varint(data, at)
            yield path, kind, unzigzag(n), None, end
        elif kind == "double":
            yield path, kind, float_bits(data[at : at + 8], "<"), None, at + 8
        elif kind == "binary":
            n, start = varint(data, at)
            yield path, "length", n, None, start
            yield path, kind, None, data[start : start + n], start + n
        elif kind in ("list", "set"):
            head, end = data[at], at + 1
            n = head >> 4
            if n == 15:
                n, end = varint(data, end)
            yield path, "size", n, None, end
            for _ in range(n):
                for t in value(COMPACT[head & 15], f"{path}[]", end, True):
                    yield t
                    end = t[4]
        elif kind == "map":
            n, end = varint(data, at)
            types = data[end] if n else 0
            end += n > 0
            yield path, "size", n, None, end
            for _ in range(n):
                for part, t_ in (("key", types >> 4), ("value", types & 15)):
                    for t in value(COMPACT[t_], f"{path}{{{part}}}", end, True):
                        yield t
                        end = t[4]
        else:
            yield from fields(path, at)

    def fields(path: str, at: int):
        number = 0
        while data[at]:
            head, end = data[at], at + 1
            if head >> 4:
                number += head >> 4
            else:
                n, end = varint(data, end)
                number = unzigzag(n)
            kind, own = COMPACT[head & 15], f"{path}.{number}" if path else str(number)
            yield own, "bool" if kind in ("true", "false") else "field", int(kind == "true") if kind in ("true", "false") else number, None, end
            at = end
            for t in value(kind, own, at):
                yield t
                at = t[4]
        yield path, "stop", None, None, at + 1

    return fields("", at)


def thrift_binary(data: bytes, at: int = 0) -> Iterator[Token]:
    """Tokens of one struct."""

    def value(kind: str, path: str, at: int):
        if kind in SIZES:
            yield path, kind, int.from_bytes(data[at : at + SIZES[kind]], "big", signed=True), None, at + SIZES[kind]
        elif kind == "double":
            yield path, kind, float_bits(data[at : at + 8], ">"), None, at + 8
        elif kind == "binary":
            (n,) = struct.unpack_from(">i", data, at)
            yield path, "length", n, None, at + 4
            yield path, kind, None, data[at + 4 : at + 4 + n], at + 4 + n
        elif kind == "struct":
            yield from fields(path, at)
        else:
            wide = 2 if kind == "map" else 1
            types, (n,) = data[at : at + wide], struct.unpack_from(">i", data, at + wide)
            end = at + wide + 4
            yield path, "size", n, None, end
            for _ in range(n):
                for part, t_ in zip(("{key}", "{value}") if wide == 2 else ("[]",), types):
                    for t in value(BINARY[t_], path + part, end):
                        yield t
                        end = t[4]

    def fields(path: str, at: int):
        while data[at]:
            (number,) = struct.unpack_from(">h", data, at + 1)
            own = f"{path}.{number}" if path else str(number)
            kind, end = BINARY[data[at]], at + 3
            yield own, "field", number, None, end
            for t in value(kind, own, end):
                yield t
                end = t[4]
            at = end
        yield path, "stop", None, None, at + 1

    return fields("", at)


# -- Protocol Buffers ----------------------------------------------------------------------------------------------------

#: Wire type of each kind of field.
PROTO = {"int64": 0, "uint64": 0, "sint64": 0, "bool": 0, "fixed64": 1, "double": 1, "bytes": 2, "string": 2, "message": 2, "fixed32": 5, "float": 5}


def protobuf(schema: dict):
    """Function of a message to its tokens. schema: field number -> (name, kind) or (name, schema of a message); unknown fields keep their number."""

    def tokens(data: bytes) -> Iterator[Token]:
        return message(data, schema, "", 0, len(data))

    def message(data: bytes, known: dict, path: str, at: int, end: int):
        while at < end:
            head, at = varint(data, at)
            number, wire = head >> 3, head & 7
            name, kind = known.get(number, (str(number), None))
            own = f"{path}.{name}" if path else name
            yield own, "field", number, None, at
            nested = kind if isinstance(kind, dict) else None
            if wire == 0:
                n, at = varint(data, at)
                yield own, kind or "uint64", unzigzag(n) if kind == "sint64" else signed(n), None, at
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                yield own, kind or f"fixed{8 * size}", int.from_bytes(data[at : at + size], "little", signed=True), None, at + size
                at += size
            elif wire == 2:
                n, at = varint(data, at)
                if at + n > end:
                    raise ValueError("a message ends within a field")
                yield own, "length", n, None, at
                if nested:
                    yield from message(data, nested, own, at, at + n)
                elif kind in (None, "bytes", "string"):
                    yield own, kind or "bytes", None, data[at : at + n], at + n
                else:  # packed numbers
                    stop = at + n
                    while at < stop:
                        if PROTO[kind] == 0:
                            v, at = varint(data, at)
                            yield own, kind, unzigzag(v) if kind == "sint64" else signed(v), None, at
                        else:
                            size = 8 if PROTO[kind] == 1 else 4
                            yield own, kind, int.from_bytes(data[at : at + size], "little", signed=True), None, at + size
                            at += size
                    continue
                at += n
            else:
                raise ValueError(f"wire type {wire}")

    return tokens


def protobuf_bytes(schema: dict, values: dict) -> bytes:
    """A message from values by field name: numbers, bytes, str, dicts for messages, lists for repeated fields; floats as their bits."""
    out = b""
    for number, (name, kind) in sorted(schema.items()):
        for v in values.get(name) if isinstance(values.get(name), list) else [values[name]] if values.get(name) is not None else []:
            wire = 2 if isinstance(kind, dict) else PROTO[kind]
            out += put_varint(number << 3 | wire)
            if wire == 0:
                out += put_varint(zigzag(v) if kind == "sint64" else v)
            elif wire == 2:
                raw = protobuf_bytes(kind, v) if isinstance(kind, dict) else v.encode() if isinstance(v, str) else v
                out += put_varint(len(raw)) + raw
            else:
                size = 8 if wire == 1 else 4
                out += (v & (1 << 8 * size) - 1).to_bytes(size, "little")
    return out


# -- rows ----------------------------------------------------------------------------------------------------------------


TOKEN = {"pos": pa.int64(), "path": pa.string(), "kind": pa.string(), "number": pa.int64(), "bytes": pa.binary(), "raw": pa.binary()}
#: Messages that a worker turns into tokens at a time.
ROWS = 256


def token_lists(df: DataFrame, content: str, keys: list[str], read) -> DataFrame:
    """(keys, tokens: pos, path, kind, number, bytes, raw) of the message in each row, which stays where it is; null messages have an empty list."""
    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "tokens array<struct<pos: long, path: string, kind: string, number: long, bytes: binary, raw: binary>>"

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows: list[tuple] = []
            ends = [0]
            for data in batch[content].to_pylist():
                start = 0
                for pos, (path, kind, number, raw, end) in enumerate(read(data) if data is not None else ()):
                    if end > len(data):
                        raise ValueError("a message ends within a field")
                    # a number of 8 unsigned bytes wraps like the column it goes to
                    rows.append((pos, path, kind, None if number is None else signed(number), raw, data[start:end]))
                    start = end
                ends.append(len(rows))
            flat = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TOKEN.values())], list(TOKEN))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*keys, "tokens"])

    return df.select(*dict.fromkeys([*keys, content])).mapInArrow(run, schema)


def message_tokens(df: DataFrame, content: str, keys: list[str], read, name: str = "message") -> DataFrame:
    """(keys, pos, path, kind, number, bytes, raw) of the message in each row; read: thrift_compact, thrift_binary or protobuf(schema). Null messages have none."""
    return token_lists(df, content, keys, read).select(*keys, F.inline("tokens"))


def of_path(path: str | None, kind: str | None, value) -> Column:
    """Array of value(token) of the tokens in a list that have this path and kind, in order."""
    return F.transform(F.filter("tokens", lambda t: (F.lit(path is None) | (t["path"] == path)) & (F.lit(kind is None) | (t["kind"] == kind))), value)


def message_bytes() -> Column:
    """The message again from its list of tokens."""
    return F.unhex(F.array_join(F.transform("tokens", lambda t: F.hex(t["raw"])), ""))


def messages(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content) again from message_tokens."""
    parts = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("raw").alias("h")))).alias("p"))
    return parts.select(*keys, F.unhex(F.array_join(F.transform("p", lambda t: t["h"]), "")).alias("content"))
