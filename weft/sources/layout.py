"""Descriptions of binary records: a small language compiled to column expressions, or run record by record if layouts depend on data.

    Header = { magic: u32le; flag: u8; }
    Entry = { id: u32le; optional: u16le when flag; required: u64le; }
    expect id > 0

A record is a list of fields name: type, with an optional `when` condition over earlier fields; types are u8 to u64 and i8 to i64
with le or be, f32le, f64le, bytes(n) with n a number or an expression over earlier fields, another record's name, or type[n].
`expect` ends a record with a condition that must hold. Expressions have + - * / % == != < <= > >= & | ^ ~ and or not ( ).
"""

from __future__ import annotations

import ast
import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.strings import to_number

NUMBERS = re.compile(r"(?P<kind>[uif])(?P<bits>8|16|32|64)(?P<order>le|be)?\Z")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: str | None = None
    when: str | None = None


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[Field, ...]
    expects: tuple[str, ...] = ()


def parse(text: str) -> dict[str, Record]:
    """Records by name; ValueError with the place of what cannot be read."""
    text = re.sub(r"#[^\n]*", "", text)
    out: dict[str, Record] = {}
    at = 0
    for m in re.finditer(r"\s*(\w+)\s*=\s*\{(.*?)\}", text, re.S):
        if text[at : m.start()].strip():
            raise ValueError(f"cannot read {text[at:m.start()].strip()!r}")
        at = m.end()
        fields, expects = [], []
        for item in (x.strip() for x in m[2].split(";")):
            if not item:
                continue
            if item.startswith("expect "):
                expects.append(check(item[7:]))
                continue
            f = re.fullmatch(r"(\w+)\s*:\s*(\w+)\s*(?:\((.+?)\)|\[(.+?)\])?\s*(?:when\s+(.+))?", item, re.S)
            if not f:
                raise ValueError(f"cannot read {item!r} in {m[1]}")
            array = f[4] is not None
            fields.append(Field(f[1], f[2] + ("[]" if array else ""), check(f[3] or f[4]) if f[3] or f[4] else None, check(f[5]) if f[5] else None))
        if len({f.name for f in fields}) != len(fields):
            raise ValueError(f"a name twice in {m[1]}")
        out[m[1]] = Record(m[1], tuple(fields), tuple(expects))
    if text[at:].strip():
        raise ValueError(f"cannot read {text[at:].strip()!r}")
    return out


ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Name, ast.Constant, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Load)


def check(expression: str) -> str:
    tree = ast.parse(expression.strip().replace("/", "//").replace("////", "//"), mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED):
            raise ValueError(f"not allowed in {expression!r}")
    return ast.unparse(tree)


def width_of(records: dict[str, Record], type_: str, size: str | None) -> int | None:
    """Bytes of a type, None if they depend on data."""
    if type_.endswith("[]"):
        one = width_of(records, type_[:-2], None)
        return one * int(size) if one is not None and size and size.isdigit() else None
    if type_ == "bytes":
        return int(size) if size and size.isdigit() else None
    if m := NUMBERS.match(type_):
        return int(m["bits"]) // 8
    if type_ in records:
        total = 0
        for f in records[type_].fields:
            w = None if f.when else width_of(records, f.type, f.size)
            if w is None:
                return None
            total += w
        return total
    raise ValueError(f"unknown type {type_}")


def number(raw: Column, type_: str) -> Column:
    m = NUMBERS.match(type_)
    bits = int(m["bits"])
    value = to_number(raw, m["order"] == "be")
    if m["kind"] == "i" and bits < 64:
        value = F.when(value >= 1 << bits - 1, value - (1 << bits)).otherwise(value)
    return value


def expression(text: str, scope: dict[str, Column]) -> Column:
    """A checked expression over earlier fields as a column expression; comparisons are 1 or 0 in arithmetic."""
    import operator as op

    two = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Mod: op.mod, ast.FloorDiv: lambda a, b: F.floor(a / b), ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.BitXor: lambda a, b: a.bitwiseXOR(b)}
    sides = {ast.Eq: op.eq, ast.NotEq: op.ne, ast.Lt: op.lt, ast.LtE: op.le, ast.Gt: op.gt, ast.GtE: op.ge}

    def number_of(node) -> Column:
        c = build(node)
        return c.cast("long") if isinstance(node, (ast.Compare, ast.BoolOp)) else c

    def build(node) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return scope[node.id]
        if isinstance(node, ast.BinOp):
            return two[type(node.op)](number_of(node.left), number_of(node.right))
        if isinstance(node, ast.UnaryOp):
            x = number_of(node.operand)
            return ~build(node.operand).cast("boolean") if isinstance(node.op, ast.Not) else F.bitwise_not(x) if isinstance(node.op, ast.Invert) else -x
        if isinstance(node, ast.BoolOp):
            parts = [build(v).cast("boolean") for v in node.values]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole & p if isinstance(node.op, ast.And) else whole | p
            return whole
        terms = [number_of(x) for x in (node.left, *node.comparators)]
        whole = F.lit(True)
        for o, a, b in zip(node.ops, terms, terms[1:]):
            whole = whole & sides[type(o)](a, b)
        return whole

    return build(ast.parse(text, mode="eval").body)


def columns(records: dict[str, Record], name: str, raw: Column) -> list[Column]:
    """Expressions of the fields of a record of fixed layout in a binary column: unused fields cost nothing. Floats stay binary.

    Where the record expects something, reading any of its fields fails on rows that do not meet it.
    """
    return [c.alias(path) for path, c in _columns(records, name, raw, "", 0)]


def _columns(records: dict[str, Record], name: str, raw: Column, prefix: str, at: int) -> list[tuple[str, Column]]:
    out, scope = [], {}
    for f in records[name].fields:
        w = None if f.when else width_of(records, f.type, f.size)
        if w is None:
            raise ValueError(f"{f.name} depends on data")
        piece = F.substring(raw, at + 1, w)
        if f.type in records:
            out += _columns(records, f.type, raw, f"{prefix}{f.name}_", at)
        else:
            m = NUMBERS.match(f.type)
            scope[f.name] = number(piece, f.type) if m and m["kind"] != "f" else piece
            out.append((prefix + f.name, scope[f.name]))
        at += w
    if not records[name].expects:
        return out
    met = F.lit(True)
    for e in records[name].expects:
        met = met & F.coalesce(expression(e, scope).cast("boolean"), F.lit(False))
    sure = F.assert_true(met, F.lit(f"{name} is not as expected")).isNull()
    return [(path, F.when(sure, c)) for path, c in out]


def read_records(records: dict[str, Record], name: str, data: bytes) -> list[dict]:
    """All records up to the end of data, of any layout; ValueError if an expectation fails or data ends within a record."""
    at, out = 0, []

    def one(record: str, outer: dict) -> dict:
        nonlocal at
        values: dict = {}
        for f in records[record].fields:
            scope = outer | values
            if f.when and not evaluate(f.when, scope):
                values[f.name] = None
                continue
            size = evaluate(f.size, scope) if f.size else None
            if f.type.endswith("[]"):
                values[f.name] = [value(f.type[:-2], None, scope) for _ in range(size)]
            else:
                values[f.name] = value(f.type, size, scope)
        for e in records[record].expects:
            if not evaluate(e, outer | values):
                raise ValueError(f"expected {e}")
        return values

    def value(type_: str, size: int | None, scope: dict):
        nonlocal at
        if type_ in records:
            return one(type_, scope)
        n = size if type_ == "bytes" else int(NUMBERS.match(type_)["bits"]) // 8
        raw = data[at : at + n]
        if len(raw) != n:
            raise ValueError("data ends within a record")
        at += n
        if type_ == "bytes":
            return raw
        m = NUMBERS.match(type_)
        order = "big" if m["order"] == "be" else "little"
        if m["kind"] == "f":
            return struct.unpack((">" if order == "big" else "<") + {2: "e", 4: "f", 8: "d"}[n], raw)[0]
        return int.from_bytes(raw, order, signed=m["kind"] == "i")

    while at < len(data):
        out.append(one(name, {}))
    return out


class Compiled(dict):
    """Code of expressions; goes to workers empty, since code objects cannot."""

    def __missing__(self, expression: str):
        code = self[expression] = compile(ast.parse(expression, mode="eval"), "layout", "eval")
        return code

    def __reduce__(self):
        return Compiled, ()


COMPILED = Compiled()


def evaluate(expression: str, scope: dict) -> int:
    found = eval(COMPILED[expression], {"__builtins__": {}}, scope)  # noqa: S307  checked by check()
    if isinstance(found, int) and not -(1 << 63) <= found < 1 << 63:
        raise ValueError(f"{expression} does not fit 64 bits")
    return found


def scan(files: DataFrame, content: str, keys: list[str], description: str, record: str) -> DataFrame:
    """(keys, pos, fields as JSON) of binary contents of a layout that depends on data; each file is one task's work."""
    import base64
    import json

    import pandas as pd

    kept = [f for f in files.schema if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", pos long, fields string"

    def plain(x):
        return base64.b64encode(x).decode() if isinstance(x, bytes) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    def run(batches):
        records = parse(description)
        for rows in batches:
            found = [read_records(records, record, bytes(raw)) for raw in rows[content]]
            times = [len(x) for x in found]
            out = {f.name: rows[f.name].repeat(times).to_numpy() for f in kept}
            yield pd.DataFrame({**out, "pos": [i for n in times for i in range(n)], "fields": [json.dumps(plain(x)) for some in found for x in some]})

    return files.mapInPandas(run, schema)
