"""Round trips over edge cases, and rules that must fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import bits, numeric, strings
from weft.plans import plan, route, search
from weft.sources import layout, text

BY, ORDER = ["chunk_id"], ["ord"]


def stream(spark, values, kind="long"):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"chunk_id long, ord long, v {kind}")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("data", [[], [0], [1, 2, 3, 4, 5], [5, 5, 5], [0, 255, 0, 255], [100, 50, 25, 12]])
@pytest.mark.parametrize("width", [1, 4])
def test_delta_modular(spark, data, width):
    rows = stream(spark, data).withColumn("d", numeric.delta_modular(F.col("v"), width, BY, ORDER))
    assert values(rows.withColumn("w", numeric.delta_modular_decode(F.col("d"), width, BY, ORDER)), "w") == data
    assert all(0 <= d < 1 << 8 * width for d in values(rows, "d"))


def test_delta_u64_extremes(spark):
    data = [0, -1, 0, -(1 << 63), (1 << 63) - 1]
    rows = stream(spark, data).withColumn("d", numeric.delta_modular(F.col("v"), 8, BY, ORDER))
    back = values(rows.withColumn("w", numeric.delta_modular_decode(F.col("d"), 8, BY, ORDER)), "w")
    assert [int(x) for x in back] == [x % (1 << 64) for x in data]


@pytest.mark.parametrize("data", [[], [0, 0, 0], [1, 2, 3], [0, 0, 7], [7, 0, 0], [0, 1, 0, 0, 2, 0, 3, 0]])
def test_sparse(spark, data):
    runs = numeric.sparse(stream(spark, data), "v", BY, ORDER)
    back = numeric.sparse_decode(runs, BY).orderBy("run", "place").collect()
    assert [r["value"] for r in back] == data


@pytest.mark.parametrize("data", [[], [1, 2, 3], [1, 3, 5, 2, 4, 6], [5, 10, 1, 6], [42], [5, 3, 7, 1]])
def test_merge_sorted(spark, data):
    back = numeric.merge_sorted_decode(numeric.merge_sorted(stream(spark, data), "v", BY, ORDER), "v", BY).orderBy("run", "v").collect()
    assert [r["v"] for r in back] == data


def test_rules_that_fail(spark):
    down = stream(spark, list(range(66, 0, -1)))
    with pytest.raises(Exception, match="too many runs"):
        numeric.merge_sorted(down, "v", BY, ORDER).collect()
    with pytest.raises(Exception, match="not divisible"):
        down.select(numeric.divide_by(F.col("v"), 4)).collect()
    with pytest.raises(Exception, match="not constant"):
        numeric.constant(down, "v", BY).collect()
    with pytest.raises(Exception, match="not 0"):
        stream(spark, [0]).select(numeric.quantize_offsets(F.col("v"))[0]).collect()
    with pytest.raises(Exception, match="outside"):
        stream(spark, [9]).select(numeric.partition(F.col("v"), 0, [2, 2])[0]).collect()
    with pytest.raises(ValueError):
        numeric.partition(F.lit(1), 0, [0])


@pytest.mark.parametrize("v", [1, 2, 3, 15, 16, 17, 31, 32, 33, 255, 256, 65535, 2**31])
def test_quantize(spark, v):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate((*numeric.quantize_offsets(F.lit(v).cast("long")), *numeric.quantize_lengths(F.lit(v).cast("long"))))]).first()
    assert (1 << r[0]) + r[1] == v and r[0] == r[2]
    assert r[3] == (v if v < 16 else v.bit_length() - 1 + 12)


RANGES = {
    "constant": ([5] * 500, []),
    "one range": ([i * 37 % 100 for i in range(1000)], []),
    "ramp": (list(range(2000)), []),
    "noisy ramp": ([i * 20 + i * 7919 % 100 for i in range(2000)], []),
    "two": ([i % 10 for i in range(200)] + [5000 + i % 10 for i in range(200)], [200]),
    "two, within a block": ([i % 10 for i in range(203)] + [5000 + i % 10 for i in range(301)], [203]),
    "three, down and up": ([9000 + i % 50 for i in range(300)] + [i % 50 for i in range(310)] + [20_000 + i % 50 for i in range(300)], [300, 610]),
    "level, small gap": ([i * 37 % 100 for i in range(320)] + [130 + i * 37 % 100 for i in range(320)], [320]),
    "constants": ([1] * 256 + [2] * 256, [256]),
    "back again": ([i % 5 for i in range(256)] + [10**6 + i % 5 for i in range(256)] + [i % 5 for i in range(256)], [256, 512]),
    "far apart": ([-(1 << 63) + i % 5 for i in range(256)] + [(1 << 63) - 6 + i % 5 for i in range(256)], [256]),
    "above doubles": ([(1 << 60) + i % 3 for i in range(256)] + [(1 << 60) + 8 + i % 3 for i in range(256)], [256]),
    "one outlier": ([i % 10 for i in range(300)] + [10**9] + [i % 10 for i in range(300)], []),
    "short": ([0] * 31 + [9] * 31, []),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", sorted(RANGES))
def test_range_cuts(name):
    data, cuts = RANGES[name]
    assert numeric.range_cuts(np.asarray(data, "int64"), 32) == cuts


def test_split_byrange(spark):
    data, _ = RANGES["three, down and up"]
    out = numeric.split_byrange(stream(spark, data), "v", BY, "ord").orderBy("segment").collect()
    assert [(r.first_ord, r.last_ord, r.low, r.high) for r in out] == [(0, 299, 9000, 9049), (300, 609, 0, 49), (610, 909, 20_000, 20_049)]


@pytest.mark.parametrize("data", [[0, 0, 12, 30], [0, 0], [7], [-6, 9]])
def test_divide_by_gcd(spark, data):
    rows = numeric.divide_by_gcd(stream(spark, data), "v", BY)
    assert values(rows.withColumn("w", numeric.divide_by_decode(F.col("quotient"), F.col("divisor"))), "w") == data
    assert rows.first()["divisor"] == max(1, np.gcd.reduce(data))


def test_sentinel_num(spark):
    data = [1, 255, 300, 7, 0]
    masked, large = numeric.sentinel_num(stream(spark, data), "v", F.col("v") > 255, 255, ["chunk_id", "ord"])
    assert values(masked, "masked") == [1, 255, 255, 7, 0] and values(large) == [255, 300]
    assert values(numeric.sentinel_num_decode(masked, large, "v", ["chunk_id", "ord"])) == data


def test_dispatch_string(spark):
    data = ["a", "bb", "", "a", "c"]
    rows = stream(spark, data, "string")
    indices, streams = strings.dispatch_string(rows, "v", F.length("v") % 3, 3, BY, "ord")
    assert values(indices, "index") == [1, 2, 0, 1, 1] and [s.count() for s in streams] == [1, 3, 1]
    assert values(strings.dispatch_string_decode(indices, streams, "v", BY, "ord")) == data
    with pytest.raises(Exception, match="out of range"):
        strings.dispatch_string(rows, "v", F.length("v"), 2, BY, "ord")[0].collect()


def test_float_streams(spark):
    data = ["1.5", "2", "-0.0", "007", "1e5", "x", "", "100.0", "0.1", "123456789012345678"]
    good, bad = strings.float_streams(stream(spark, data, "string"), "v", BY, "ord")
    assert {"007", "x", ""} <= set(values(bad)) and good.count() + bad.count() == len(data)
    assert values(strings.float_texts(good, bad, "v", BY, "ord")) == data


@pytest.mark.parametrize("split", range(9))
def test_mux(spark, split):
    rows = spark.createDataFrame([(i, 3 + j) for i in (0, 1, 7, 255, 300) for j in (0, 2, 15, 400)], "l long, m long")
    byte, more, rest = bits.mux_lengths(F.col("l"), F.col("m"), split, 3)
    back = bits.mux_decode(byte, more, rest, split, 3)
    assert rows.where((back[0] != F.col("l")) | (back[1] != F.col("m")) | ~byte.between(0, 255)).count() == 0


@pytest.mark.parametrize("costs", [["a", "b"], ["a", "b", "c"]])
def test_pareto(spark, costs):
    rng = np.random.default_rng(2)
    data = [(i, int(g), *map(int, rng.integers(0, 12, 3))) for i, g in enumerate(rng.integers(0, 3, 200))]
    df = spark.createDataFrame(data, "k long, g long, a long, b long, c long").repartition(5)
    for by in ([], ["g"]):
        at = [2 + "abc".index(c) for c in costs]
        better = lambda q, r: (not by or q[1] == r[1]) and all(q[i] <= r[i] for i in at) and any(q[i] < r[i] for i in at)
        assert {r.k for r in search.pareto_front(df, costs, "k", by).collect()} == {r[0] for r in data if not any(better(q, r) for q in data)}


def test_dominant(spark):
    assert numeric.dominant_by(stream(spark, [7, 7, 1, 7, 2, 7, 7]), "v", BY, ORDER).first()["dominant"] == 7
    assert numeric.dominant_by(stream(spark, [1, 2]), "v", BY, ORDER).first()["dominant"] == 0


@pytest.mark.parametrize("data", [[""], ["", ""], ["apple", "application", "apply"], ["a", "aa", "aaa"], ["foo"] * 3, ["xfoo", "yfoo"], ["a" * 200 + c for c in "xyz"], ["é", "èa", "éa"]])
def test_prefix(spark, data):
    coded = strings.prefix_encode(stream(spark, data, "string"), "v", BY, ORDER).select("chunk_id", "ord", "shared", "suffix")
    try:
        assert values(strings.prefix_decode(coded, BY, ORDER), "value") == data
    except UnicodeDecodeError:
        pytest.fail("bytes were not rebuilt")


def test_parse_int(spark):
    good = {"0": 0, "-1": -1, "123456789": 123456789, "9223372036854775807": (1 << 63) - 1, "-9223372036854775808": -(1 << 63)}
    bad = ["", "-", "-0", "007", "+5", " 5", "9223372036854775808", "5\n", "1.0"]
    rows = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string").select("s", strings.parse_int(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in rows} == {**good, **dict.fromkeys(bad)}


def test_lengths_must_add_up(spark):
    rows = stream(spark, ["ab", "", "c"], "string")
    content, lengths = strings.separate(rows, "v", BY, ORDER)
    assert values(strings.set_lengths(content, lengths, BY, ORDER), "text") == ["ab", "", "c"]
    with pytest.raises(Exception, match="add up"):
        strings.set_lengths(content, lengths.where("ord > 0"), BY, ORDER).collect()


@pytest.mark.parametrize("layout_", ["f32", "f64", "f16", "bf16"])
def test_floats(spark, layout_):
    data = [0.0, -0.0, 1.5, -2.25, float("inf"), float("-inf"), 0.0009765625]
    rows = stream(spark, data, "double").withColumn("b", bits.float_bits(F.col("v"), layout_))
    fraction, exponent = bits.deconstruct(F.col("b"), layout_)
    back = rows.select("ord", fraction.alias("f"), exponent.alias("e")).select("ord", bits.float_from_bits(bits.reconstruct(F.col("f"), F.col("e"), layout_), layout_).alias("x"))
    assert values(back, "x") == data


def test_bitunpack():
    assert bits.bitunpack(bytes([0b00101101]), 3, 2).tolist() == [5, 5]


def test_interleave_and_tags(spark):
    a, b = stream(spark, [1, 2]), stream(spark, [3, 4])
    mixed = strings.interleave([a, b], "ord", "v")
    assert values(mixed) == [1, 3, 2, 4]
    with pytest.raises(Exception, match="tag out of range"):
        strings.dispatch(a, F.lit(5), 3).collect()
    with pytest.raises(ValueError):
        strings.concat([a, stream(spark, ["x"], "string")], "v", ["ord"])


def plain_csv(content, sep=",", null_aware=False):
    """(row, col, kind, token) one character after the other; None for texts that are errors."""
    out, row, col, at, width, field = [], 0, 0, 0, None, not null_aware
    while at < len(content):
        if field:
            end = at
            while end < len(content) and content[end] not in (sep, "\n"):
                if content[end] == '"':
                    end = content.find('"', end + 1)
                    if end < 0:
                        return None
                end += 1
            out.append((row, col, "field", content[at:end]))
            at = end
        if at < len(content) and content[at] == "\n":
            width = col + 1 if width is None else width
            if width != col + 1:
                return None
            out.append((row, col, "newline", "\n"))
            row, col, at, field = row + 1, 0, at + 1, not null_aware
        elif at < len(content) and content[at] == sep:
            end = at + 1
            while null_aware and end < len(content) and content[end] == sep:
                end += 1
            out.append((row, col, "sep", content[at:end]))
            col, at, field = col + end - at, end, True
        else:
            field = True
    return out


def csv_texts():
    import random

    rng = random.Random(5)
    fixed = ["", "a", "a,b\n", "a,b\nc,d\n", "a,b\nc,d", ",,\n,,\n", '"x,\ny",2\n3,4\n', 'p"q"r,s\n', "a,\n", "a,", "\n", "\n\n", "a\r\nb\r\n", "é,ü\n" * 30, '"' + "x," * 5000 + '",1\n']
    return fixed + ["".join(rng.choices(["a", "b", ",", ",", "\n", '"q,"', ""], k=rng.randint(1, 9))) for _ in range(150)]


@pytest.mark.parametrize("null_aware", [False, True])
def test_csv_lexer(spark, null_aware):
    texts = csv_texts()
    expected = [plain_csv(t, null_aware=null_aware) for t in texts]
    good = [(i, t) for i, (t, e) in enumerate(zip(texts, expected)) if e is not None]
    assert 30 < len(good) < len(texts)
    found = {}
    for r in text.csv_lex(spark.createDataFrame([*good, (999, None)], "k long, t string"), "t", ["k"], null_aware=null_aware).orderBy("k", "pos").collect():
        found.setdefault(r.k, []).append((r.row, r.col, r.kind, r.token))
    assert all(found.get(i, []) == expected[i] for i, _ in good) and 999 not in found


@pytest.mark.parametrize(("bad", "why"), [('a,"b', "unclosed"), ('"', "unclosed"), ("a,b\nc\n", "unequal"), ("a\nb,c\n", "unequal")])
def test_csv_errors(spark, bad, why):
    assert plain_csv(bad) is None
    with pytest.raises(Exception, match=why):
        text.csv_lex(spark.createDataFrame([(0, bad)], "k long, t string"), "t", ["k"]).collect()


def test_csv_streams(spark):
    rows = spark.createDataFrame([(0, 'h1,h2\na,"x\n,y"\n,b\n'), (1, "h1\nv"), (2, "h\n")], "k long, t string")
    for header in (True, False):
        streams = text.csv_dispatch(text.csv_lex(rows, "t", ["k"]), ["k"], header)
        assert {tuple(r) for r in text.csv_collect(streams, ["k"]).collect()} == {tuple(r) for r in rows.collect()}
    assert sorted(r.field for r in text.csv_dispatch(text.csv_lex(rows, "t", ["k"]), ["k"])["fields"].where("tag = 1").collect()) == ['"x\n,y"', "b"]


@pytest.mark.parametrize("doc", ['{"k": 87}', "[1,-2.5e3,true,false,null,\"a b\"]", "", "ABC", "é{}"])
def test_json_roundtrip(spark, doc):
    r = spark.createDataFrame([(doc,)], "t string").select(text.json_skeleton(F.col("t")).alias("s"), text.json_tokens(F.col("t")).alias("k")).select(text.json_restore(F.col("s"), F.col("k")).alias("t")).first()
    assert r.t == doc


def test_layout_language():
    r = layout.parse("H = { magic: u32le; flag: u8; } E = { id: i16be; opt: u16le when id > 0; n: u8; xs: u8[n]; tail: bytes(n - 1); h: H; expect n > 0; }")
    data = b"\x00\x05\x07\x00\x02\x01\x02zABCD\x01" + b"\xff\xfe\x01\x09ABCD\x00"
    found = layout.read_records(r, "E", data)
    assert [(x["id"], x["opt"], x["xs"], x["tail"]) for x in found] == [(5, 7, [1, 2], b"z"), (-2, None, [9], b"")]
    with pytest.raises(ValueError):
        layout.read_records(r, "E", b"\x00\x00\x00")
    with pytest.raises(ValueError):
        layout.parse("E = { x: u8 when __import__('os') }")


def test_static_layout_enforces_what_it_expects(spark):
    r = layout.parse("H = { a: u8; expect a < 200; } E = { k: i8; n: u16le; h: H; expect k > 0 and (n & 1 == 1 or n % 4 == 0); }")
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"\x05\x03\x00\x01", b"\x01\x04\x00\xc7")], "raw binary")
    assert [tuple(x) for x in rows.select(*layout.columns(r, "E", F.col("raw"))).collect()] == [(5, 3, 1), (1, 4, 199)]
    for bad in (b"\x00\x03\x00\x01", b"\xff\x03\x00\x01", b"\x01\x02\x00\x01", b"\x01\x01\x00\xc8"):
        with pytest.raises(Exception, match="not as expected"):
            spark.createDataFrame([(bytearray(bad),)], "raw binary").select(*layout.columns(r, "E", F.col("raw"))).collect()


def test_plan_permissive(spark, tmp_path):
    rows = stream(spark, [1, 2, 3])
    p = plan.Plan("v", ("chunk_id",), ("ord",), (("divide_by", {"divisor": 2}),))
    kept = plan.write_frame(rows, p, f"file://{tmp_path}/f", permissive=True)
    assert kept.steps == () and values(plan.read_frame(spark, f"file://{tmp_path}/f")) == [1, 2, 3]
    with pytest.raises(Exception, match="not divisible"):
        plan.write_frame(rows, p, f"file://{tmp_path}/g")


def test_search():
    costs = np.array([[1, 5], [2, 2], [5, 1], [3, 3], [6, 6]])
    assert search.ranks(costs).tolist() == [0, 0, 0, 1, 2]
    assert search.greedy_clusters({"a": 10, "b": 10, "c": 5}, {("a", "b"): 12, ("a", "c"): 16, ("b", "c"): 16}) == [["a", "b"], ["c"]]


def test_boosted(spark):
    model = route.fit_stumps([([float(i)], "low" if i < 5 else "high") for i in range(10)], ["low", "high"], ["x"])
    got = spark.createDataFrame([(float(i),) for i in range(10)], "x double").select("x", model.choose().alias("c")).collect()
    assert all(r.c == ("low" if r.x < 5 else "high") for r in got)


def test_numbered(spark):
    from weft.spec import numbered

    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"]).collect()
    assert all(r.ord == r.k for r in rows) and len(rows) == 1000


def test_zip_and_shred(spark):
    import io
    import zipfile

    from weft.sources import archive

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/b.txt", b"hello")
        z.writestr("c", b"")
    rows = spark.createDataFrame([("p", bytearray(held.getvalue()))], "path string, content binary")
    assert {(r.member, bytes(r.content)) for r in archive.zip_members(rows).collect()} == {("a/b.txt", b"hello"), ("c", b"")}
    nested = spark.sql("SELECT 1 AS k, named_struct('xs', array(array(1, 2), array()), 'm', map('a', 5)) AS v")
    streams = archive.shred(nested, "v", ["k"])
    assert [tuple(r) for r in streams["v.xs[][]"].orderBy("pos1").collect()] == [(1, 0, 0, 1), (1, 0, 1, 2)]
    assert [r.length for r in streams["v.xs[]#"].orderBy("pos0").collect()] == [2, 0] and streams["v.m{value}"].first()["value"] == 5


def test_coerce():
    from weft.spec import StreamSpec, coerce

    assert coerce(StreamSpec("x", "numeric", 4), {"serial", "struct"}) == ["numeric", "struct"]
    with pytest.raises(ValueError):
        coerce(StreamSpec("x", "string"), {"numeric"})
