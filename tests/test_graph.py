"""Graphs over chunk streams: round trips of every step and chain, the user's own parts, what fails, training."""

import json

import numpy as np
import pyarrow as pa
import pytest

from weft.plans import graph as g

RNG = np.random.default_rng(4)
RUN = g.Context().run


def same(a, b):
    return a.content == b.content and a.kind == b.kind and a.width == b.width and (a.lengths is None) == (b.lengths is None) and (a.lengths is None or a.lengths.tolist() == b.lengths.tolist())


def round_trips(graph, *streams):
    back = g.restore(RUN(g.Graph.from_json(graph.to_json()), list(streams)))
    return len(back) == len(streams) and all(map(same, back, streams))


def number_streams(width):
    top = (1 << 8 * width) - 1
    for x in ([], [5], [3, 3, 3], RNG.integers(0, 200, 500), np.arange(100) * 2, [0, top, 1], np.sort(RNG.integers(0, 120, 300))):
        yield g.numeric(np.asarray(x, "u8"), width)


@pytest.mark.parametrize("name", sorted(g.CHAINS))
@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_chains(name, width):
    for s in number_streams(width):
        if width == 1 and "field_lz" in name:  # fields of one byte have no field matches
            assert g.Context().measure(g.CHAINS[name], [s]) is None or round_trips(g.CHAINS[name], s)
        else:
            assert round_trips(g.CHAINS[name], s)


KINDS = [g.serial(b""), g.serial(b"abc" * 100), g.serial(b"\0" * 40), g.Stream(b"x" * 12, "struct", 3), g.Stream(b"abcd" * 30, "struct", 4), g.Stream(b"hellox", "string", 1, np.array([5, 0, 1])), g.Stream(b"", "string", 1, np.array([], "int64")), *number_streams(4), *number_streams(1)]


@pytest.mark.parametrize("at", range(len(KINDS)))
def test_generic_takes_every_kind(at):
    assert round_trips(g.generic(), KINDS[at]) and round_trips(g.leaf("store"), KINDS[at])


def test_conversions_and_layout():
    raw = g.serial(RNG.integers(0, 256, 240, "u1").tobytes())
    for bits in (8, 16, 32, 64):
        assert round_trips(g.step(f"to_numeric{bits}", g.step("delta", g.leaf("store"))), raw)
    assert round_trips(g.step("to_numeric16", g.step("to_struct", g.step("to_serial", g.leaf("zstd")))), raw)
    assert round_trips(g.step("split", g.leaf("store"), sizes=[10, 30, 0]), raw)
    assert round_trips(g.step("concat", g.leaf("bitpack"), g.leaf("zstd")), raw, g.serial(b"x"), g.serial(b""))
    for bad in (g.step("split", g.leaf("store"), sizes=[10]), g.step("to_numeric64", g.leaf("store"))):
        with pytest.raises(ValueError):
            RUN(bad, [g.serial(b"123")])
    with pytest.raises(ValueError):
        RUN(g.step("delta", g.leaf("store")), [raw])


def test_clusters():
    streams = [g.numeric(np.arange(9), 4), g.serial(b"zz"), g.numeric(np.arange(5), 4), g.serial(b"yy")]
    assert round_trips(g.build("clustered", clusters=[[0, 2]]), *streams) and round_trips(g.build("clustered"), *streams)
    for clusters in ([[0, 1]], [[0, 2], [2]]):
        with pytest.raises(ValueError):
            RUN(g.build("clustered", clusters=clusters), streams)


def test_merge_sorted_and_backup():
    few, many = g.numeric(np.concatenate([np.arange(0, 100, 3), np.arange(0, 90, 2)]), 4), g.numeric(np.arange(100)[::-1], 4)
    for s, step in ((few, "merge_sorted"), (many, "=zstd")):
        data = RUN(g.merge_or(g.leaf("zstd")), [s])
        assert g.opened(data)[0] == step and same(g.restore(data)[0], s)
    with pytest.raises(ValueError):
        RUN(g.step("merge_sorted", g.leaf("store"), g.leaf("store")), [many])


def test_brute_force_takes_the_least_and_skips_errors():
    s = g.numeric(np.full(500, 7), 4)
    graph = g.select("smallest", g.leaf("zstd"), g.step("divide_by", g.leaf("store"), divisor=2), g.leaf("constant"), g.STORE)
    assert g.opened(RUN(graph, [s]))[0] == "=constant"
    assert g.opened(RUN(g.brute_force("zstd", "field_lz"), [g.numeric(RNG.integers(0, 1 << 60, 50), 8)]))[0] == "=store"


def test_permissive_graphs_store_what_fails():
    odd = g.step("divide_by", g.leaf("bitpack"), divisor=2)
    s = g.numeric([1, 2], 4)
    with pytest.raises(ValueError):
        RUN(odd, [s])
    assert round_trips(odd.with_params(permissive=True), s)


def test_levels_and_dictionaries():
    text = g.serial(b"".join(b"record %d of many alike; " % i for i in range(400)))
    assert all(round_trips(g.leaf("zstd", level=n), text) for n in (1, 3, 19)) and RUN(g.leaf("zstd", level=19), [text]) != RUN(g.leaf("zstd", level=1), [text])
    assert round_trips(g.leaf("lz4", level=9), text) and round_trips(g.leaf("lz4"), text)
    dictionary, small = text.content[:2000], g.serial(text.content[3000:3200])
    data = RUN(g.Graph.from_json(g.leaf("zstd", dictionary=dictionary).to_json()), [small])
    assert len(data) < len(RUN(g.leaf("zstd"), [small])) and g.restore(data, {g.dictionary_id(dictionary): dictionary})[0].content == small.content
    with pytest.raises(ValueError, match="not at hand"):
        g.restore(data)


@pytest.fixture(scope="module")
def own_parts():
    """A user's encoder with two outputs, one of n inputs, a selector, a builder and parsers."""
    g.register("test_halves", lambda s, p: (bytes([p.get("mask", 0)]), [g.serial(bytes(b >> 4 ^ p.get("mask", 0) for b in s[0].content)), g.serial(bytes(b & 15 for b in s[0].content))]), lambda h, s: [g.serial(bytes((a ^ h[0]) << 4 | b for a, b in zip(s[0].content, s[1].content)))])
    g.register("test_zip", lambda s, p: (b"", [g.serial(bytes(x for pair in zip(s[0].content, s[1].content) for x in pair))]), lambda h, s: [g.serial(s[0].content[::2]), g.serial(s[0].content[1::2])], (("serial",), ("serial",)))
    g.SELECTORS["test_even"] = lambda s, graph, c: len(s) % 2
    g.BUILDERS["test_pick"] = lambda s, p, c: min((g.leaf("zstd"), g.leaf("huffman")), key=lambda x: c.measure(x, s))
    g.SIZES |= {"test_lines": lambda s: [len(x) for x in s.content.splitlines(True)], "test_tagged": lambda s: ([len(x) for x in s.content.splitlines(True)], [x[:1] == b"#" for x in s.content.splitlines(True)])}
    yield
    for name in ("test_halves", "test_zip"):
        del g.STEPS[name]


TEXT = b"# a comment\nvalue 1\nvalue 2\n# more\nvalue 3\n"


def test_own_parts(own_parts):
    halves = g.step("test_halves", g.leaf("huffman"), g.leaf("zstd"), mask=5)
    for graph in (halves, g.select("test_even", halves, g.leaf("store")), g.build("test_pick"), g.step("split", g.leaf("store"), parser="test_lines"), g.step("dispatch", *[g.leaf("zstd")] * 4, parser="test_tagged", outputs=2), g.step("set_lengths", g.step("separate", g.leaf("zstd"), g.leaf("bitpack")), parser="test_lines")):
        assert round_trips(graph, g.serial(TEXT)) and round_trips(graph, g.serial(TEXT[:-1]))
    assert round_trips(g.step("test_zip", halves), g.serial(b"abc"), g.serial(b"xyz"))
    with pytest.raises(ValueError, match="takes 2"):
        RUN(g.step("test_zip", halves), [g.serial(b"abc")])
    with pytest.raises(ValueError, match="registered"):
        g.register("test_zip", None, None)
    with pytest.raises(ValueError, match="out of range"):
        RUN(g.step("dispatch", g.leaf("zstd"), parser="test_tagged", outputs=1), [g.serial(TEXT)])


def test_own_parts_reach_the_executors(spark, own_parts):
    rows = spark.createDataFrame([(i, bytearray(TEXT * i), None) for i in range(6)] + [(9, None, None)], "k long, content binary, frame string").repartition(3)
    graph = g.step("test_halves", g.leaf("huffman"), g.leaf("zstd"))
    frames = g.compress(rows, graph, [g.Input("content")], ["k"])
    back = g.decompress(frames, ["content"], ["k"]).collect()
    assert {r.k: bytes(r.content) for r in back} == {i: TEXT * i for i in range(6)} | {9: b""}
    info = g.frame_info(frames, ["k"]).where("k = 3").orderBy("path").collect()
    assert [(r.path, r.step) for r in info] == [("0", "test_halves"), ("0.0", "=huffman"), ("0.1", "=zstd")]
    assert g.compress(rows.limit(0), graph, [g.Input("content")], ["k"]).count() == 0


def test_frames_of_many_streams(spark):
    rows = spark.createDataFrame([(0, bytearray(b"abc"), bytearray(bytes(range(8))), [1, 0, 2]), (1, None, bytearray(4), None)], "k long, text binary, n binary, sizes array<long>")
    inputs = [g.Input("text", "string", lengths="sizes"), g.Input("n", "numeric", 4)]
    frames = g.compress(rows, g.build("clustered"), inputs, ["k"])
    back = {r.k: r for r in g.decompress(frames, ["text", "n"], ["k"]).collect()}
    assert bytes(back[0].text) == b"abc" and back[0].text_lengths == [1, 0, 2] and bytes(back[1].n) == bytes(4) and bytes(back[1].text) == b""


def test_broken_frames():
    data = RUN(g.generic(), [g.serial(b"abc" * 50)])
    with pytest.raises(Exception):
        g.restore(data[:-1])
    with pytest.raises(KeyError):
        g.restore(g.frame("nobody's", b"", []))


def test_graph_json_and_holes():
    graph = g.step("split", g.hole("left", g.leaf("store")), g.leaf("zstd", dictionary=b"\x00\xff"), sizes=[1, 0])
    again = g.Graph.from_json(graph.to_json())
    assert again == graph and json.loads(graph.to_json())["successors"][0]["hole"] == "left"
    put = graph.put("left", g.leaf("huffman"))
    assert [n.name for n in put.nodes()] == ["split", "=huffman", "=zstd"] and round_trips(g.step("split", g.leaf("huffman"), g.leaf("store"), sizes=[2, 0]), g.serial(b"abcdef"))


def test_chunk_values(spark):
    rows = spark.createDataFrame([(0, bytearray(np.asarray([1, 2, 1 << 31], "<u4").tobytes())), (1, None)], "k long, content binary")
    out = g.chunk_values(rows, "content", ["k"], 4).orderBy("k", "place").collect()
    assert [tuple(r) for r in out] == [(0, 0, 1), (0, 1, 2), (0, 2, 1 << 31)]


def test_chunk_values_by_some_chunks(spark, monkeypatch):
    """A worker holds the numbers of a few chunks at a time, however many come in a batch."""
    df, held = spark.createDataFrame([(0, b"")], "chunk_id long, content binary"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.append(run))
    g.chunk_values(df, "content", ["chunk_id"], 4)
    chunks = [RNG.integers(0, 1 << 32, n, dtype="u4") for n in RNG.integers(0, 50, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([c.tobytes() for c in chunks])], names=["chunk_id", "content"])
    out = list(held[0](iter([batch])))
    assert max(len(set(b["chunk_id"].to_pylist())) for b in out) <= g.ROWS
    rows = [r for b in out for r in zip(*(b[c].to_pylist() for c in ("chunk_id", "place", "value")))]
    assert rows == [(i, j, int(v)) for i, c in enumerate(chunks) for j, v in enumerate(c)]
