"""Messages, files and training on small inputs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.plans import graph as g
from weft.plans import search, train
from weft.sources import files, text, wire

SCHEMA = {1: ("id", "int64"), 2: ("name", "string"), 3: ("score", "sint64"), 4: ("packed", "uint64"), 5: ("inner", {1: ("x", "fixed32"), 2: ("more", "bytes")}), 6: ("d", "double")}


def whole(tokens, data):
    """Tokens whose ends lead through the message."""
    found, at = list(tokens), 0
    for t in found:
        assert t[4] >= at
        at = t[4]
    assert at == len(data)
    return found


def test_protobuf():
    bits = struct.unpack("<q", struct.pack("<d", -1.5))[0]
    data = wire.protobuf_bytes(SCHEMA, {"id": -7, "name": "héllo", "score": -3, "inner": [{"x": 9, "more": b"\0\1"}, {"x": -1}], "d": bits}) + wire.put_varint(4 << 3 | 2) + b"\3\1\x96\1" + wire.put_varint(99 << 3) + b"\5"
    values = [(p, k, n if b is None else b) for p, k, n, b, _ in whole(wire.protobuf(SCHEMA)(data), data) if k not in ("field", "length")]
    assert values == [("id", "int64", -7), ("name", "string", "héllo".encode()), ("score", "sint64", -3), ("inner.x", "fixed32", 9), ("inner.more", "bytes", b"\0\1"), ("inner.x", "fixed32", -1), ("d", "double", bits), ("packed", "uint64", 1), ("packed", "uint64", 150), ("99", "uint64", 5)]


COMPACT = bytes([0x15, 0x0A, 0x16, 0x80, 0x01, 0x18, 0x02]) + b"ab" + bytes([0x11, 0x12, 0x17]) + struct.pack("<d", 2.5) + bytes([0x19, 0x35, 0x02, 0x04, 0x05, 0x1B, 0x01, 0x85, 0x01]) + b"k" + bytes([0x06, 0x1C, 0x13, 0xFF, 0x00, 0x19, 0x21, 0x01, 0x02, 0x00])


def test_thrift_compact():
    found = whole(wire.thrift_compact(COMPACT), COMPACT)
    assert [(p, k, n) for p, k, n, b, _ in found if k in ("i32", "i64", "i8", "bool", "size")] == [("1", "i32", 5), ("2", "i64", 64), ("4", "bool", 1), ("5", "bool", 0), ("7", "size", 3), ("7[]", "i32", 1), ("7[]", "i32", 2), ("7[]", "i32", -3), ("8", "size", 1), ("8{value}", "i32", 3), ("9.1", "i8", -1), ("10", "size", 2), ("10[]", "bool", 1), ("10[]", "bool", 0)]
    assert [(p, b) for p, k, n, b, _ in found if k == "binary"] == [("3", b"ab"), ("8{key}", b"k")]
    assert [n for p, k, n, b, _ in found if k == "double"] == [struct.unpack("<q", struct.pack("<d", 2.5))[0]]


def test_thrift_binary():
    data = b"\x08\0\1\xff\xff\xff\xfb" + b"\x0b\0\2\0\0\0\2ab" + b"\x0f\0\3\x06\0\0\0\2\0\1\0\2" + b"\x0d\0\4\x03\x02\0\0\0\1\x05\x01" + b"\x0c\0\5\x0a\0\1" + (1 << 40).to_bytes(8, "big") + b"\0" + b"\x04\0\6" + struct.pack(">d", 1.5) + b"\0"
    found = whole(wire.thrift_binary(data), data)
    assert [(p, k, n) for p, k, n, b, _ in found if k in ("i16", "i32", "i64", "i8", "bool")] == [("1", "i32", -5), ("3[]", "i16", 1), ("3[]", "i16", 2), ("4{key}", "i8", 5), ("4{value}", "bool", 1), ("5.1", "i64", 1 << 40)]


def test_message_streams(spark):
    rows = spark.createDataFrame([(i, bytearray(wire.protobuf_bytes(SCHEMA, {"id": i, "name": "n" * i}))) for i in range(9)] + [(99, None)], "k long, m binary").repartition(3)
    tokens = wire.message_tokens(rows, "m", ["k"], wire.protobuf(SCHEMA))
    assert {r.k: bytes(r.content) for r in wire.messages(tokens, ["k"]).collect()} == {r.k: bytes(r.m) for r in rows.where("k < 99").collect()}
    assert sorted(r.number for r in tokens.where("path = 'id' and kind = 'int64'").collect()) == list(range(9))
    for bad in (b"\x08", b"\x12\x05a", b"\x0b"):
        with pytest.raises(Exception):
            wire.message_tokens(spark.createDataFrame([(0, bytearray(bad))], "k long, m binary"), "m", ["k"], wire.protobuf(SCHEMA)).collect()
    thrift = spark.createDataFrame([(0, bytearray(COMPACT))], "k long, m binary")
    assert bytes(wire.messages(wire.message_tokens(thrift, "m", ["k"], wire.thrift_compact), ["k"]).first().content) == COMPACT


def test_raw_bytes_and_chunks(spark, tmp_path):
    raw = np.random.default_rng(0).integers(0, 256, 200_000, "u1").tobytes()
    (tmp_path / "a.bin").write_bytes(raw)
    read = files.raw_bytes(spark, f"file://{tmp_path}", "*.bin").select(F.element_at(F.split("path", "/"), -1).alias("f"), "content")
    chunks = files.byte_chunks(read.union(spark.createDataFrame([("b.bin", bytearray())], "f string, content binary")), "content", ["f"], 65_536, 8).orderBy("f", "chunk").collect()
    assert b"".join(bytes(r.content) for r in chunks if r.f == "a.bin") == raw and [len(r.content) for r in chunks] == [65_536, 65_536, 65_536, 3392, 0]
    own = files.segments(spark.createDataFrame([(0, bytearray(b"abcdef"), [1, 0, 5]), (1, bytearray(b""), [])], "k long, c binary, n array<long>"), "c", ["k"], F.col("n"))
    assert [(r.chunk, bytes(r.content)) for r in own.orderBy("chunk").collect()] == [(0, b"a"), (1, b""), (2, b"bcdef")]
    with pytest.raises(Exception, match="add up"):
        files.segments(spark.createDataFrame([(0, bytearray(b"abc"))], "k long, c binary"), "c", ["k"], F.array(F.lit(2))).collect()


def test_parquet_columns(spark, tmp_path):
    spark.sql("SELECT id, if(id % 3 = 0, null, cast(id AS int)) AS a, repeat('x', cast(id AS int)) AS s, array(id) AS nested FROM range(10)").coalesce(1).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    assert [tuple(r) for r in files.column_streams(df).orderBy("tag").collect()] == [(0, "id", "numeric", 8, 10, 0, 80), (1, "a", "numeric", 4, 6, 4, 24), (2, "s", "string", 1, 10, 0, 85)]
    values, nulls = files.column_values(df, "a")
    assert {r.row: r.value for r in values.collect()} == {i: i for i in range(10) if i % 3} and sorted(r.row for r in nulls.collect()) == [0, 3, 6, 9]


def test_feature_streams(spark):
    rows = spark.sql("SELECT 1 AS k, 'r' AS other, map(7L, cast(0.5 AS float)) AS f, map(1L, array(3L, 4L), 2L, array()) AS ids, map(5L, array(array(1L))) AS ll, map(6L, array(cast(1 AS float))) AS fl, map(8L, map(9L, cast(2 AS float))) AS scores")
    found = files.feature_streams(rows, {"float": "f", "id_list": "ids", "id_list_list": "ll", "float_list": "fl", "id_score_list": "scores"}, ["k"])
    assert sorted(found) == ["float", "float_list", "id_list", "id_list_list", "id_score_list", "rest"] and sorted(found["rest"]) == ["other"]
    assert [tuple(r) for r in found["id_list"]["{value}[]"].orderBy("pos1").collect()] == [(1, 0, 0, 3), (1, 0, 1, 4)] and [r.length for r in found["id_list"]["{value}#"].orderBy("pos0").collect()] == [2, 0]
    assert found["id_score_list"]["{value}{value}"].first()["value"] == 2.0 and found["float"]["{key}"].first()["value"] == 7
    with pytest.raises(ValueError):
        files.feature_streams(rows, {"float": "ids"}, ["k"])


# -- training ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        x = [np.arange(400) * 3 + i, rng.integers(0, 1 << 31, 400), np.full(400, i), rng.choice([5, 1 << 30], 400)][i % 4]
        rows.append((i, bytearray(np.asarray(x, "<u4").tobytes()), bytearray(np.asarray(x, "<u4").tobytes()), bytearray(b"user=%d;state=ok;kind=event;" % i * 3)))
    return spark.createDataFrame(rows, "k long, a binary, b binary, t binary").repartition(4)


def test_limits(spark, chunks):
    few = train.limit_samples(chunks, "a", ["k"], most=10, most_bytes=1600, most_total=5000)
    assert [r.k for r in few.orderBy("k").collect()] == [0, 1, 2]
    assert train.limit_samples(chunks, "a", ["k"], most_bytes=1599).count() == 0


def test_selector_learns(spark, chunks):
    samples = chunks.select("k", F.lit("numeric").alias("kind"), F.lit(4).alias("width"), F.col("a").alias("content"))
    forests, report = train.fit_selector(train.measure(samples, [g.CHAINS[c] for c in g.NUMERIC_CHOICES], ["k"]), ["k"])
    assert report["held_out"] > 3 and report["accuracy"] >= 0.8 and report["best_bytes"] <= report["bytes"] <= report["first_bytes"]
    graph = g.Graph.from_json(g.select_numeric(forests).to_json())
    frames = g.compress(chunks, graph, [g.Input("a", "numeric", 4)], ["k"])
    assert {r.k: bytes(r.a) for r in g.decompress(frames, ["a"], ["k"]).collect()} == {r.k: bytes(r.a) for r in chunks.collect()}


def test_orchestration(spark, chunks):
    inputs = [g.Input("a", "numeric", 4), g.Input("b", "numeric", 4), g.Input("t")]
    graph, report = train.train(chunks, g.hole("cluster", g.build("clustered")), inputs, ["k"])
    assert report["cluster"] == [[0, 1], [2]] and graph.params == {"clusters": [[0, 1]]}
    frames = g.compress(chunks, graph, inputs, ["k"])
    assert {r.k: (bytes(r.a), bytes(r.b), bytes(r.t)) for r in g.decompress(frames, ["a", "b", "t"], ["k"]).collect()} == {r.k: (bytes(r.a), bytes(r.b), bytes(r.t)) for r in chunks.collect()}
    mixed = g.step("each", g.hole("chain", g.leaf("store")), g.hole("select", g.select_numeric()), g.hole("dictionary", g.leaf("zstd")))
    graph, report = train.train(chunks, mixed, inputs, ["k"], population=6, generations=1)
    assert set(report) == {"chain", "select", "dictionary"} and not any(n.hole for n in graph.nodes())
    frames = g.compress(chunks, graph, inputs, ["k"])
    assert {r.k: (bytes(r.a), bytes(r.t)) for r in g.decompress(frames, ["a", "b", "t"], ["k"], report["dictionary"]).collect()} == {r.k: (bytes(r.a), bytes(r.t)) for r in chunks.collect()}
    total = lambda f: f.agg(F.sum(F.octet_length("frame"))).first()[0]
    assert total(frames) < total(g.compress(chunks, mixed, inputs, ["k"]))
    with pytest.raises(ValueError, match="nothing to train"):
        train.train(chunks, g.step("each", g.leaf("store")), inputs, ["k"])


@pytest.mark.parametrize("trainer", [search.greedy_clusters, train.bottom_up])
def test_cluster_trainers(trainer):
    single, pair = {0: 10, 1: 10, 2: 5, 3: 7}, {(0, 1): 12, (0, 2): 16, (1, 2): 16, (2, 3): 11, (0, 3): 17}
    assert trainer(single, pair) == [[0, 1], [2, 3]] and train.full_split(single, pair) == [[0], [1], [2], [3]]


@pytest.mark.parametrize("header", [True, False])
def test_csv_lists(spark, header):
    """The streams of each text in its own row are those of csv_dispatch, and give the texts again without a shuffle."""
    texts = ['a,b\n1,"x,\ny"\n,\n', "one,line", 'h,"q"\n2,3', "h\n\n\n", "a,b,c\n1,2,3\n" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, content string")
    lists = text.csv_split_lists(text.csv_token_lists(df, "content", ["key"]), ["key"], header)
    back = text.csv_join_lists(lists, ["key"])
    assert dict(map(tuple, back.collect())) == dict(enumerate(texts))
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    streams = text.csv_dispatch(text.csv_lex(df, "content", ["key"]), ["key"], header)
    for name, rows in streams.items():
        assert sorted(map(tuple, lists.select("key", F.inline(name)).collect())) == sorted(map(tuple, rows.collect()))


def test_token_lists(spark):
    """The tokens of a message in its own row are those of message_tokens; fields and messages come from them without a shuffle."""
    read = wire.protobuf(SCHEMA)
    messages = [wire.protobuf_bytes(SCHEMA, {"id": i, "name": "n" * i, "packed": [1, i], "inner": {"x": i}}) for i in range(600)] + [b"", None]
    df = spark.createDataFrame(list(enumerate(messages)), "key long, message binary")
    lists = wire.token_lists(df, "message", ["key", "message"], read)
    assert sorted(map(str, lists.select("key", F.inline("tokens")).collect())) == sorted(map(str, wire.message_tokens(df, "message", ["key"], read).collect()))
    back = lists.select("key", "message", wire.message_bytes().alias("content"), wire.of_path("packed", "uint64", lambda t: t["number"]).alias("packed"))
    for r in back.collect():
        assert bytes(r.content) == (r.message or b"") and r.packed == ([1, r.key] if r.message else [])
    from weft import queries_graphs

    for query in (queries_graphs.protobuf_streams, queries_graphs.thrift_compact_streams, queries_graphs.thrift_binary_streams):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
