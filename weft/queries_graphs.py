"""Queries of coders, graphs, messages, files and training."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import payload, strings
from .plans import graph as g
from .plans import search, train
from .queries import CHUNK, events, lines, orders, query, table
from .sources import archive, files, wire

# -- coders and graphs over chunks of numbers ----------------------------------------------------------------------------

CUSTOMERS = f"SELECT o_orderkey // {CHUNK} AS chunk_id, row_number() OVER (PARTITION BY o_orderkey // {CHUNK} ORDER BY o_orderkey) - 1 AS place, {{v}} AS value FROM orders"


def customer_chunks(spark, sf_dir, value: str, width: int) -> DataFrame:
    rows = orders(spark, sf_dir).select("chunk_id", "o_orderkey", F.expr(value).alias("v"))
    return payload.chunk_bytes(rows, "v", ["chunk_id"], ["o_orderkey"], width)


def number_query(name: str, graph: g.Graph, value: str = "o_custkey", width: int = 4, doc: str = "") -> None:
    """Registers a query: chunks of numbers through a graph and back."""

    def run(spark, sf_dir):
        frames = g.compress(customer_chunks(spark, sf_dir, value, width), graph, [g.Input("content", "numeric", width)], ["chunk_id"])
        return g.chunk_values(g.decompress(frames, ["content"], ["chunk_id"]), "content", ["chunk_id"], width)

    run.__name__, run.__doc__ = name, doc or f"Chunks of numbers through {graph.name} and back."
    query(CUSTOMERS.format(v=f"({value})::BIGINT"))(run)


BYTE = "o_custkey % 200"
for _name in ("huffman", "fse", "flatpack", "entropy", "store"):
    number_query(f"{_name}_roundtrip", g.leaf(_name), BYTE, 1)
number_query("huffman_struct_roundtrip", g.leaf("huffman"), "o_custkey % 3000", 2)
number_query("constant_roundtrip", g.leaf("constant"), "7", 4)
number_query("lz_roundtrip", g.leaf("lz"))
number_query("field_lz_roundtrip", g.leaf("field_lz"), "o_custkey % 5 * 1000")
number_query("partition_bitpack_roundtrip", g.leaf("partition_bitpack"), "o_custkey % 60000", 2)
number_query("partition_bitpack_fast_roundtrip", g.leaf("partition_bitpack", fast=True), "o_custkey % 60000", 2)
number_query("zstd_level_roundtrip", g.leaf("zstd", level=19))
number_query("lz4_level_roundtrip", g.leaf("lz4", level=9))
number_query("transpose_graph_roundtrip", g.CHAINS["transpose_split"])
number_query("generic_numeric_roundtrip", g.generic(), doc="Chunks of numbers through the graph for streams of any kind and back.")
number_query("brute_force_roundtrip", g.brute_force("zstd", "field_lz", "delta_bitpack", "bitpack"), doc="Each chunk by whichever chain makes the smallest frame of it, and back.")
number_query("select_numeric_roundtrip", g.select_numeric([[(0, 1e9, 0.0, 1.0)], [(3, 1e6, 1.0, 0.0)]]), doc="Each chunk by the chain that trees choose by its features, and back.")
number_query("merge_sorted_selector_roundtrip", g.merge_or(g.leaf("zstd")), "o_orderkey % 500", doc="Chunks of few ascending runs merged, others by the backup, and back.")
number_query("permissive_roundtrip", g.step("divide_by", g.leaf("bitpack"), divisor=3).with_params(permissive=True), doc="Chunks that a step cannot take are stored.")
for _name in ("delta_field_lz", "range_pack", "range_pack_zstd", "tokenize_delta_field_lz", "delta_zstd", "delta_bitpack", "delta_zigzag_transpose"):
    number_query(f"chain_{_name}_roundtrip", g.CHAINS[_name])


@query(f"SELECT o_orderkey // {CHUNK} AS chunk_id, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS content, string_agg(strlen(o_orderpriority), ',' ORDER BY o_orderkey) AS lengths FROM orders GROUP BY 1")
def generic_string_roundtrip(spark, sf_dir):
    """Strings through the graph for streams of any kind and back: contents and lengths of each chunk."""
    parts = orders(spark, sf_dir).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("p"))
    rows = parts.select("chunk_id", F.encode(F.array_join(F.transform("p", lambda x: x["o_orderpriority"]), ""), "UTF-8").alias("content"), F.transform("p", lambda x: F.octet_length(x["o_orderpriority"]).cast("long")).alias("lengths"))
    frames = g.compress(rows, g.generic(), [g.Input("content", "string", lengths="lengths")], ["chunk_id"])
    return g.decompress(frames, ["content"], ["chunk_id"]).select("chunk_id", F.decode("content", "UTF-8").alias("content"), F.array_join(F.col("content_lengths").cast("array<string>"), ",").alias("lengths"))


def even_odd(streams, params):
    """A step of one's own: bytes at even and at odd places."""
    return bytes([params.get("first", 0)]), [g.serial(streams[0].content[::2]), g.serial(streams[0].content[1::2])]


def even_odd_back(header, streams):
    out = np.zeros(len(streams[0].content) + len(streams[1].content), "u1")
    out[::2], out[1::2] = np.frombuffer(streams[0].content, "u1"), np.frombuffer(streams[1].content, "u1")
    return [g.serial(out.tobytes())]


def shorter_first(streams, params, context):
    """A graph that is built on the data: whichever of two codes is measured smaller."""
    return min((g.leaf("huffman"), g.leaf("zstd")), key=lambda x: context.measure(x, streams))


def by_lines(stream):
    return [len(x) for x in stream.content.splitlines(True)]


def lines_by_digit(stream):
    parts = stream.content.splitlines(True)
    return [len(x) for x in parts], [int(x[:1].isdigit()) for x in parts]


g.register("even_odd", even_odd, even_odd_back)
g.BUILDERS["shorter_first"] = shorter_first
g.SIZES |= {"by_lines": by_lines, "lines_by_digit": lines_by_digit}

BLOCKS = "SELECT page_id // 16 AS block, string_agg(url || chr(10) || page_id || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1"


def text_blocks(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 16).alias("block")).agg(F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("p"))
    return parts.select("block", F.encode(F.array_join(F.transform("p", lambda x: F.concat(x["url"], F.lit("\n"), x["page_id"].cast("string"), F.lit("\n"))), ""), "UTF-8").alias("content"))


def text_query(name: str, graph: g.Graph, doc: str) -> None:
    def run(spark, sf_dir):
        frames = g.compress(text_blocks(spark, sf_dir), graph, [g.Input("content")], ["block"])
        return g.decompress(frames, ["content"], ["block"]).select("block", F.decode("content", "UTF-8").alias("content"))

    run.__name__, run.__doc__ = name, doc
    query(BLOCKS)(run)


text_query("generic_serial_roundtrip", g.generic(), "Texts through the graph for streams of any kind and back.")
text_query("custom_step_roundtrip", g.step("even_odd", g.leaf("huffman"), g.build("shorter_first"), first=1), "Texts through an encoder and a graph builder of one's own, and back by the decoder.")
text_query("external_split_roundtrip", g.step("split", g.leaf("zstd"), parser="by_lines"), "Texts cut where a parser of one's own says, and back.")
text_query("external_dispatch_roundtrip", g.step("dispatch", *[g.leaf("zstd")] * 4, parser="lines_by_digit", outputs=2), "Segments of a parser of one's own by its tags, and back.")
text_query("external_lengths_roundtrip", g.step("set_lengths", g.step("separate", g.leaf("zstd"), g.leaf("bitpack")), parser="by_lines"), "Strings by a parser of one's own, and back.")
text_query("convert_numbers_roundtrip", g.step("split", g.step("to_numeric8", g.step("range_pack", g.leaf("entropy"))), g.leaf("store"), sizes=[8, 0]), "Bytes as numbers and back.")


@query(BLOCKS)
def own_segments_roundtrip(spark, sf_dir):
    """Texts as chunks of a segmenter of one's own, each coded by itself, and back."""
    ends = F.transform(F.slice(F.split(F.decode("content", "UTF-8"), "\n"), 1, F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1), lambda x: (F.octet_length(x) + 1).cast("long"))
    chunks = files.segments(text_blocks(spark, sf_dir), "content", ["block"], ends)
    frames = g.compress(chunks, g.select("smallest", g.leaf("zstd"), g.STORE), [g.Input("content")], ["block", "chunk"])
    back = g.decompress(frames, ["content"], ["block", "chunk"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("chunk", "content"))).alias("p"))
    return back.select("block", F.array_join(F.transform("p", lambda x: F.decode(x["content"], "UTF-8")), "").alias("content"))


@query(f"SELECT o_orderkey // {CHUNK} AS chunk_id, count(*) AS n, sum(o_custkey)::BIGINT AS a, sum(o_orderkey)::BIGINT AS b FROM orders GROUP BY 1")
def cluster_graph_roundtrip(spark, sf_dir):
    """Two columns of a chunk joined in one cluster, a third alone, and back."""
    one = {c: customer_chunks(spark, sf_dir, v, w).select("chunk_id", F.col("content").alias(c)) for c, v, w in (("a", "o_custkey", 4), ("b", "o_orderkey", 4), ("c", BYTE, 1))}
    rows = one["a"].join(one["b"], "chunk_id").join(one["c"], "chunk_id")
    frames = g.compress(rows, g.build("clustered", clusters=[[0, 1]]), [g.Input("a", "numeric", 4), g.Input("b", "numeric", 4), g.Input("c", "numeric", 1)], ["chunk_id"])
    back = g.decompress(frames, ["a", "b", "c"], ["chunk_id"])
    both = back.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("content")) for c in ("a", "b")])))
    of = lambda c: F.when(F.col("column") == c, F.col("value"))
    return g.chunk_values(both, "content", ["chunk_id", "column"], 4).groupBy("chunk_id").agg(F.count(of("a")).alias("n"), F.sum(of("a")).alias("a"), F.sum(of("b")).alias("b"))


@query()
def graph_frame_info(spark, sf_dir):
    """What each chunk's frame is made of: steps chosen, bytes of headers and payloads."""
    frames = g.compress(customer_chunks(spark, sf_dir, "o_custkey", 4), g.brute_force("field_lz", "delta_bitpack", "range_pack"), [g.Input("content", "numeric", 4)], ["chunk_id"])
    return g.frame_info(frames, ["chunk_id"])


@query()
def coder_sizes(spark, sf_dir):
    """Bytes of each chunk by each coder, all in one pass."""
    names = [n for n in sorted(g.TERMINAL) if n not in ("constant", "field_lz")]
    samples = customer_chunks(spark, sf_dir, BYTE, 1).select("chunk_id", F.lit("numeric").alias("kind"), F.lit(1).alias("width"), "content")
    measured = train.measure(samples, [g.leaf(n) for n in names], ["chunk_id"])
    return measured.select("chunk_id", *[F.get("sizes", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query(f"SELECT o_orderkey // {CHUNK} AS chunk_id, v, count(*) AS n FROM (SELECT *, {BYTE} AS v FROM orders) GROUP BY 1, 2")
def huffman_code_counts(spark, sf_dir):
    """Histogram of each chunk from its prefix-coded frame."""
    frames = g.compress(customer_chunks(spark, sf_dir, BYTE, 1), g.leaf("huffman"), [g.Input("content", "numeric", 1)], ["chunk_id"])
    values = g.chunk_values(g.decompress(frames, ["content"], ["chunk_id"]), "content", ["chunk_id"], 1)
    return values.groupBy("chunk_id", F.col("value").alias("v")).agg(F.count("*").alias("n"))


# -- sources -------------------------------------------------------------------------------------------------------------

PERSON = {1: ("key", "int64"), 2: ("name", "string"), 3: ("balance", "sint64"), 4: ("place", {1: ("nation", "fixed32")})}


def person_messages(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), "c_nationkey")

    def write(batches):
        for b in batches:
            found = [wire.protobuf_bytes(PERSON, {"key": k, "name": n, "balance": c, "place": {"nation": p}}) for k, n, c, p in zip(*(b[x].to_pylist() for x in ("c_custkey", "c_name", "cents", "c_nationkey")))]
            yield pa.RecordBatch.from_arrays([b["c_custkey"], pa.array(found, pa.binary())], names=["c_custkey", "message"])

    return rows.mapInArrow(write, "c_custkey long, message binary")


@query("SELECT c_custkey, c_custkey AS key, c_name AS name, round(c_acctbal * 100)::BIGINT AS balance, c_nationkey::BIGINT AS nation FROM customer")
def protobuf_streams(spark, sf_dir):
    """Messages by a schema as streams of fields, put side by side again."""
    lists = wire.token_lists(person_messages(spark, sf_dir), "message", ["c_custkey"], wire.protobuf(PERSON))
    one = lambda path, kind, value: F.array_max(wire.of_path(path, kind, value))
    number, string = lambda t: t["number"], lambda t: F.decode(t["bytes"], "UTF-8")
    return lists.select("c_custkey", one("key", "int64", number).alias("key"), one("name", "string", string).alias("name"), one("balance", "sint64", number).alias("balance"), one("place.nation", "fixed32", number).alias("nation"))


@query("SELECT count(*) AS n, true AS same FROM customer")
def protobuf_roundtrip(spark, sf_dir):
    rows = person_messages(spark, sf_dir)
    lists = wire.token_lists(rows, "message", ["c_custkey", "message"], wire.protobuf(PERSON))
    return lists.select("message", wire.message_bytes().alias("content")).agg(F.count("*").alias("n"), F.bool_and(F.col("content") == F.col("message")).alias("same"))


def thrift_messages(spark, sf_dir, compact: bool) -> DataFrame:
    """Structs of an integer, a string and a list of integers in either protocol."""

    def one(key: int, name: str) -> bytes:
        raw = name.encode()
        if compact:
            return b"\x16" + wire.put_varint(wire.zigzag(key)) + b"\x18" + wire.put_varint(len(raw)) + raw + b"\x19\x25" + wire.put_varint(wire.zigzag(key % 7)) + wire.put_varint(wire.zigzag(-key)) + b"\0"
        return b"\x0a\0\1" + key.to_bytes(8, "big", signed=True) + b"\x0b\0\2" + len(raw).to_bytes(4, "big") + raw + b"\x0f\0\3\x08\0\0\0\2" + (key % 7).to_bytes(4, "big") + (-key).to_bytes(4, "big", signed=True) + b"\0"

    def write(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["c_custkey"], pa.array([one(k, n) for k, n in zip(b["c_custkey"].to_pylist(), b["c_name"].to_pylist())], pa.binary())], names=["c_custkey", "message"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInArrow(write, "c_custkey long, message binary")


THRIFT = "SELECT c_custkey, c_custkey AS key, c_name AS name, (c_custkey % 7) || ',' || (-c_custkey) AS numbers FROM customer"


def thrift_columns(lists: DataFrame) -> DataFrame:
    return lists.select(
        "c_custkey", F.array_max(wire.of_path("1", "i64", lambda t: t["number"])).alias("key"), F.array_max(wire.of_path(None, "binary", lambda t: F.decode(t["bytes"], "UTF-8"))).alias("name"),
        F.array_join(wire.of_path("3[]", None, lambda t: t["number"].cast("string")), ",").alias("numbers"))


@query(THRIFT)
def thrift_compact_streams(spark, sf_dir):
    return thrift_columns(wire.token_lists(thrift_messages(spark, sf_dir, True), "message", ["c_custkey"], wire.thrift_compact))


@query(THRIFT)
def thrift_binary_streams(spark, sf_dir):
    return thrift_columns(wire.token_lists(thrift_messages(spark, sf_dir, False), "message", ["c_custkey"], wire.thrift_binary))


ORDER_COLUMNS = {"o_orderkey": ("numeric", 8), "o_custkey": ("numeric", 8), "o_orderstatus": ("string", 1), "o_orderpriority": ("string", 1)}


@query(" UNION ALL ".join(f"SELECT '{c}' AS stream, '{k}' AS kind, {w} AS width, count({c}) AS n, count(*) - count({c}) AS nulls, {f'sum(strlen({c}) + 4)' if k == 'string' else f'count({c}) * {w}'}::BIGINT AS bytes FROM orders" for c, (k, w) in ORDER_COLUMNS.items()))
def parquet_column_streams(spark, sf_dir):
    """Columns of a Parquet file as typed streams: kind, width, values, nulls and plain bytes of each."""
    return files.column_streams(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)).drop("tag")


@query("SELECT row_number() OVER () - 1 AS row, o_custkey AS value FROM orders")
def parquet_values_by_row(spark, sf_dir):
    """One column's values by their place in the file."""
    return files.column_values(table(spark, sf_dir, "orders"), "o_custkey")[0].select("row", "value")


@query("SELECT region.r_name AS name, 1::BIGINT AS files FROM region")
def raw_bytes_of_files(spark, sf_dir):
    """Whole files as bytes in chunks, put together again and looked up in the table that they hold."""
    raw = files.raw_bytes(spark, f"{sf_dir}", "region.parquet")
    chunks = files.byte_chunks(raw, "content", ["path"], files.LEAST_BYTES).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex("content").alias("h")))).alias("p"))
    again = chunks.select("path", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content")).join(raw.select("path", F.col("content").alias("whole")), "path")
    good = again.where(F.col("content") == F.col("whole")).agg(F.count("*").alias("files"))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).crossJoin(good)


@query("SELECT event_id, unnest([1, 2])::BIGINT AS key, unnest([user_id % 10, event_id % 10]) AS value FROM events")
def feature_id_streams(spark, sf_dir):
    """Typed feature maps as streams: the keys and single ids of id lists, side by side."""
    one, two = F.array((F.col("user_id") % 10).cast("long")), F.array((F.col("event_id") % 10).cast("long"))
    rows = events(spark, sf_dir).select("event_id", F.create_map(F.lit(1).cast("long"), one, F.lit(2).cast("long"), two).alias("ids"))
    found = files.feature_streams(rows, {"id_list": "ids"}, ["event_id"])["id_list"]
    return found["{key}"].select("event_id", "pos0", F.col("value").alias("key")).join(found["{value}[]"], ["event_id", "pos0"]).select("event_id", "key", "value")


@query("SELECT event_id, 3::BIGINT AS key, (user_id * 0.5)::FLOAT AS value FROM events")
def feature_float_streams(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.create_map(F.lit(3).cast("long"), (F.col("user_id") * 0.5).cast("float")).alias("floats"))
    found = files.feature_streams(rows, {"float": "floats"}, ["event_id"])["float"]
    return found["{key}"].select("event_id", "pos0", F.col("value").alias("key")).join(found["{value}"], ["event_id", "pos0"]).select("event_id", "key", "value")


@query("SELECT page_id // 16 AS block, page_id || '.txt' AS member, url AS content FROM pages")
def zip_members(spark, sf_dir):
    """Members of archives with a file a page."""
    rows = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 16).alias("block")).agg(F.collect_list(F.struct("page_id", "url")).alias("p"))

    def write(batches):
        for b in batches:
            found = []
            for members in b["p"].to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(f"{m['page_id']}.txt", m["url"])
                found.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b["block"].cast(pa.string()), pa.array(found, pa.binary())], names=["path", "content"])

    members = archive.zip_members(rows.mapInArrow(write, "path string, content binary"))
    return members.select(F.col("path").cast("long").alias("block"), "member", F.decode("content", "UTF-8").alias("content"))


# -- training ------------------------------------------------------------------------------------------------------------

STREAMS = ["l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"]


def line_samples(spark, sf_dir, most: int, by: list[str] = STREAMS) -> DataFrame:
    """(stream, chunk_id, kind, width, content): columns of the chunks from which limit_samples takes the first `most` streams of `by`.

    Chunks are chosen by their bytes, which tasks count without their contents, so that only lines of those are put together.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = lines(spark, sf_dir)
    sizes = rows.groupBy("chunk_id").agg(F.array(*[F.struct(F.lit(c).alias("stream"), (F.count(c) * 4).alias("bytes")) for c in by]).alias("s")).select("chunk_id", F.inline("s"))
    found = {r[0] for r in train.within_limits(sizes, F.col("bytes"), ["chunk_id", "stream"], most).select("chunk_id").collect()}
    ids = sorted(found - {None})
    chosen = F.lit(False)
    if ids:  # the range, wider by a chunk as keys are divided as doubles, is for the file's own bounds
        chosen = F.col("l_orderkey").between((ids[0] - 1) * CHUNK, (ids[-1] + 2) * CHUNK) & F.col("chunk_id").isin(ids)
    if None in found:
        chosen = chosen | F.col("chunk_id").isNull()
    parts = rows.where(chosen).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("p"))

    def one(c: str):
        return F.struct(F.lit(c).alias("stream"), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(strings.from_number(x[c].cast("long"), 4))), "")).alias("content"))

    return parts.select("chunk_id", F.explode(F.array(*map(one, STREAMS))).alias("s")).select("s.stream", "chunk_id", F.lit("numeric").alias("kind"), F.lit(4).alias("width"), "s.content")


@query()
def selector_training(spark, sf_dir):
    """Trees fitted to which chain makes a chunk smallest, on four fifths of the chunks, and how they do on the rest."""
    samples = train.limit_samples(line_samples(spark, sf_dir, 64), "content", ["chunk_id", "stream"], most=64)
    _, report = train.fit_selector(train.measure(samples, [g.CHAINS[c] for c in g.NUMERIC_CHOICES], ["stream", "chunk_id"]), ["stream", "chunk_id"])
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "figure string, value double")


@query()
def genetic_search(spark, sf_dir):
    """Chains by exact bytes and number of steps: the front of a search of population 12 over 4 generations, each measured in one pass."""
    samples = train.limit_samples(line_samples(spark, sf_dir, 4, ["l_partkey"]).where("stream = 'l_partkey'"), "content", ["chunk_id"], most=4)
    front = train.search_chains(samples.select("kind", "width", "content"), population=12, generations=4)
    return spark.createDataFrame([("+".join(c), b, s) for c, b, s in front], "chain string, bytes double, steps double")


@query()
def greedy_cluster_search(spark, sf_dir):
    """Columns grouped by what their pairs save, alone and joined, measured in one pass."""
    ports = [(i, "numeric", 4) for i in range(len(STREAMS))]
    port = F.array_position(F.array(*[F.lit(s) for s in STREAMS]), F.col("stream")) - 1
    samples = train.limit_samples(line_samples(spark, sf_dir, 32), "content", ["chunk_id", "stream"], most=32).select("chunk_id", port.cast("int").alias("port"), "kind", "width", "content", F.lit(None).cast("array<long>").alias("lengths"))
    costs = train.pair_costs(samples, ports, ["chunk_id"])
    found = [(name, i, STREAMS[c]) for name, f in (("greedy", search.greedy_clusters), ("bottom_up", train.bottom_up), ("full_split", train.full_split)) for i, members in enumerate(f(*costs)) for c in members]
    return spark.createDataFrame(found, "trainer string, cluster int, stream string")


@query()
def orchestrated_training(spark, sf_dir):
    """A graph with holes for a cluster, trained on its own inputs: what training chose."""
    wide = line_samples(spark, sf_dir, 16, STREAMS[:1]).groupBy("chunk_id").pivot("stream", STREAMS).agg(F.first("content"))
    graph, _ = train.train(wide, g.hole("cluster", g.build("clustered")), [g.Input(c, "numeric", 4) for c in STREAMS], ["chunk_id"], most=16)
    return spark.createDataFrame([(graph.to_json(),)], "graph string")


@query()
def dictionary_training(spark, sf_dir):
    """Bytes of short texts with a trained dictionary and without, and whether all came back."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("content"))
    few = train.limit_samples(rows, "content", ["page_id"], most=400)
    dictionary = train.train_dictionary([bytes(r[0]) for r in few.select("content").toLocalIterator()], 4096)
    frames = g.compress(rows, g.leaf("zstd", dictionary=dictionary), [g.Input("content")], ["page_id"])
    plain = g.compress(rows, g.leaf("zstd"), [g.Input("content")], ["page_id"]).select("page_id", F.octet_length("frame").alias("plain_bytes"))
    back = g.decompress(frames, ["content"], ["page_id"], {g.dictionary_id(dictionary): dictionary}).select("page_id", F.col("content").alias("back"))
    joined = frames.select("page_id", "raw_bytes", F.octet_length("frame").alias("bytes")).join(plain, "page_id").join(back, "page_id").join(rows, "page_id")
    return joined.agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("plain_bytes").alias("plain_bytes"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("back") == F.col("content")).alias("same"))


@query(f"SELECT 'fields' AS hole, count(DISTINCT o_orderkey // {CHUNK}) AS n, count(*) * 4 AS bytes FROM orders")
def sample_collection(spark, sf_dir):
    """What reaches a named node of a graph while it runs."""
    graph = g.step("to_struct", g.hole("fields", g.FIELD_LZ))
    samples = g.collect_samples(customer_chunks(spark, sf_dir, "o_custkey", 4), graph, [g.Input("content", "numeric", 4)], ["chunk_id"])
    return samples.groupBy("hole").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT page_id FROM (SELECT *, sum(strlen(url)) OVER (ORDER BY page_id) AS total FROM (SELECT * FROM pages WHERE strlen(url) <= 60 ORDER BY page_id LIMIT 100)) WHERE total <= 2000")
def sample_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("content"))
    return train.limit_samples(rows, "content", ["page_id"], most=100, most_bytes=60, most_total=2000).select("page_id")


@query()
def search_space(spark, sf_dir):
    """The chains that a search starts from, and the steps and coders that it puts together."""
    rows = [("start", "+".join(c)) for c in train.search_space()] + [(k, n) for k in ("steps", "coders") for n in train.SPACE[k]]
    return spark.createDataFrame(rows, "kind string, name string")
