"""Registered queries over the supplied tables: one per operator, each over its whole table.

SQL holds the DuckDB form of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats
from .operators import bits, numeric, strings
from .spec import bit_width, epoch_micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Keys a chunk; positional transforms start anew in each.
CHUNK = 4096
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_chunk(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("chunk_id", F.floor(F.col(key) / CHUNK).cast("long"))


def orders(spark, sf_dir):
    return by_chunk(table(spark, sf_dir, "orders"), "o_orderkey")


def events(spark, sf_dir):
    return by_chunk(table(spark, sf_dir, "events"), "event_id")


def lines(spark, sf_dir):
    return by_chunk(table(spark, sf_dir, "lineitem"), "l_orderkey")


def sql_chunk(key: str) -> str:
    return f"{key} // {CHUNK} AS chunk_id"


# -- differences ---------------------------------------------------------------------------------------------------------

EPOCH = "epoch_us(o_orderdate)"


@query(f"""
WITH d AS (SELECT o_orderkey, {sql_chunk('o_orderkey')}, {EPOCH} AS us FROM orders),
x AS (SELECT *, us - coalesce(lag(us) OVER (PARTITION BY chunk_id ORDER BY o_orderkey), 0) AS delta FROM d),
z AS (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS zz FROM x),
w AS (SELECT chunk_id, count(*) AS n, max(length(ltrim(bin(zz), '0'))) AS bits FROM z GROUP BY chunk_id)
SELECT chunk_id, n, bits::INT AS bits, ceil(n * bits / 8.0)::BIGINT AS packed_bytes, (n * 8)::BIGINT AS raw_bytes FROM w
""")
def delta_zigzag_orderdate(spark, sf_dir):
    """Order dates as differences, signs folded in, packed: size by chunk."""
    rows = orders(spark, sf_dir).withColumn("us", epoch_micros(F.col("o_orderdate")))
    rows = rows.withColumn("zz", numeric.zigzag(numeric.delta(F.col("us"), ["chunk_id"], ["o_orderkey"])))
    out = rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max(bit_width(F.col("zz"))).cast("int").alias("bits"))
    return out.withColumn("packed_bytes", F.ceil(F.col("n") * F.col("bits") / 8).cast("long")).withColumn("raw_bytes", F.col("n") * 8)


@query(f"SELECT o_orderkey, o_custkey - coalesce(lag(o_custkey) OVER (PARTITION BY o_orderkey // {CHUNK} ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_custkey(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", numeric.delta(F.col("o_custkey"), ["chunk_id"], ["o_orderkey"]).alias("delta"))


@query("SELECT o_orderkey, o_custkey AS decoded, true AS same FROM orders")
def delta_decode_roundtrip(spark, sf_dir):
    by, order = ["chunk_id"], ["o_orderkey"]
    rows = orders(spark, sf_dir).withColumn("delta", numeric.delta(F.col("o_custkey"), by, order))
    rows = rows.withColumn("decoded", numeric.delta_decode(F.col("delta"), by, order))
    return rows.select("o_orderkey", "decoded", (F.col("decoded") == F.col("o_custkey")).alias("same"))


MIX = 6364136223846793005 % (1 << 31)


@query(f"""
WITH v AS (SELECT event_id, event_id // {CHUNK} AS chunk_id, (user_id * {MIX}) % 4294967296 AS u FROM events)
SELECT event_id, ((u - coalesce(lag(u) OVER (PARTITION BY chunk_id ORDER BY event_id), 0)) % 4294967296 + 4294967296) % 4294967296 AS delta, u AS decoded FROM v
""")
def delta_modular_u32(spark, sf_dir):
    by, order = ["chunk_id"], ["event_id"]
    rows = events(spark, sf_dir).withColumn("u", (F.col("user_id") * MIX) % (1 << 32))
    rows = rows.withColumn("delta", numeric.delta_modular(F.col("u"), 4, by, order))
    return rows.select("event_id", "delta", numeric.delta_modular_decode(F.col("delta"), 4, by, order).alias("decoded"))


@query(f"""
WITH v AS (SELECT event_id, event_id // {CHUNK} AS chunk_id, CASE WHEN event_id % 2 = 0 THEN 9223372036854775807 - user_id ELSE -9223372036854775807 + user_id END::HUGEINT AS s FROM events),
u AS (SELECT *, CASE WHEN s < 0 THEN s + 18446744073709551616::HUGEINT ELSE s END AS u FROM v)
SELECT event_id, (((u - coalesce(lag(u) OVER (PARTITION BY chunk_id ORDER BY event_id), 0)) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS delta FROM u
""")
def delta_modular_u64(spark, sf_dir):
    top = F.lit((1 << 63) - 1)
    rows = events(spark, sf_dir).withColumn("s", F.when(F.col("event_id") % 2 == 0, top - F.col("user_id")).otherwise(-top + F.col("user_id")))
    return rows.select("event_id", numeric.delta_modular(F.col("s"), 8, ["chunk_id"], ["event_id"]).cast("string").alias("delta"))


@query("SELECT event_id, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS code, d AS decoded FROM (SELECT event_id, user_id - 500 AS d FROM events)")
def zigzag_user(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("code", numeric.zigzag(F.col("user_id") - 500))
    return rows.select("event_id", "code", numeric.unzigzag(F.col("code")).alias("decoded"))


# -- ranges, divisors, quantisation --------------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT p_partkey, p_size, min(p_size) OVER (PARTITION BY p_brand) AS low, max(p_size) OVER (PARTITION BY p_brand) AS high FROM part)
SELECT p_partkey, low::INT AS base, (p_size - low)::INT AS packed, CASE WHEN high - low < 256 THEN 1 WHEN high - low < 65536 THEN 2 WHEN high - low < 4294967296 THEN 4 ELSE 8 END::INT AS packed_width, p_size AS decoded FROM w
""")
def range_pack_size(spark, sf_dir):
    rows = numeric.range_pack(table(spark, sf_dir, "part"), "p_size", ["p_brand"])
    return rows.select("p_partkey", "base", "packed", "packed_width", numeric.range_unpack(rows).alias("decoded"))


@query("SELECT o_orderkey, o_orderkey * 12 // 4 AS quotient FROM orders")
def divide_by_const(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", numeric.divide_by(F.col("o_orderkey") * 12, 4).alias("quotient"))


@query("""
SELECT g AS p_brand, list_reduce(list(v), lambda a, b: gcd(a, b))::BIGINT AS gcd FROM (SELECT p_brand AS g, (p_size * 6)::BIGINT AS v FROM part) GROUP BY g
""")
def gcd_column(spark, sf_dir):
    return numeric.gcd_by(table(spark, sf_dir, "part").withColumn("v", F.col("p_size") * 6), "v", ["p_brand"])


@query("""
WITH v AS (SELECT p_partkey, p_brand, (p_size * 6)::BIGINT AS v FROM part), g AS (SELECT p_brand, list_reduce(list(v), lambda a, b: gcd(a, b))::BIGINT AS divisor FROM v GROUP BY 1)
SELECT p_partkey, divisor, v // divisor AS quotient, v AS decoded FROM v JOIN g USING (p_brand)
""")
def divide_by_gcd(spark, sf_dir):
    rows = numeric.divide_by_gcd(table(spark, sf_dir, "part").withColumn("v", (F.col("p_size") * 6).cast("long")), "v", ["p_brand"])
    return rows.select("p_partkey", "divisor", "quotient", numeric.divide_by_decode(F.col("quotient"), F.col("divisor")).alias("decoded"))


LOG = "(length(ltrim(bin({v}), '0')) - 1)"


@query(f"SELECT {', '.join(LINE)}, {LOG.format(v='l_partkey')}::INT AS code, l_partkey - (1::BIGINT << {LOG.format(v='l_partkey')}) AS extra FROM lineitem WHERE l_partkey > 0")
def quantize_offsets(spark, sf_dir):
    rows = lines(spark, sf_dir).where("l_partkey > 0")
    code, extra, _ = numeric.quantize_offsets(F.col("l_partkey"))
    return rows.select(*LINE, code.cast("int").alias("code"), extra.alias("extra"))


@query(f"SELECT {', '.join(LINE)}, CASE WHEN l_suppkey < 16 THEN l_suppkey ELSE {LOG.format(v='l_suppkey')} + 12 END::BIGINT AS code, CASE WHEN l_suppkey < 16 THEN 0 ELSE l_suppkey - (1::BIGINT << {LOG.format(v='l_suppkey')}) END AS extra, l_suppkey AS decoded FROM lineitem")
def quantize_lengths(spark, sf_dir):
    code, extra, _ = numeric.quantize_lengths(F.col("l_suppkey"))
    rows = lines(spark, sf_dir).withColumn("code", code.cast("long")).withColumn("extra", extra)
    return rows.select(*LINE, "code", "extra", numeric.unquantize(F.col("code"), F.col("extra"), 16, 12).alias("decoded"))


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 WHEN p_size < 15 THEN 1 WHEN p_size < 16 THEN 2 ELSE 3 END::INT AS bucket, p_size - CASE WHEN p_size < 5 THEN 0 WHEN p_size < 15 THEN 5 WHEN p_size < 16 THEN 15 ELSE 16 END AS extra, CASE WHEN p_size < 5 THEN 3 WHEN p_size < 15 THEN 4 WHEN p_size < 16 THEN 0 ELSE 6 END::INT AS bits FROM part")
def partition_custom(spark, sf_dir):
    bucket, extra, n = numeric.partition(F.col("p_size").cast("long"), 0, [5, 10, 1, 64])
    return table(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"), extra.alias("extra"), n.alias("bits"))


@query(f"SELECT event_id, CASE WHEN v < 2 THEN 0 ELSE {LOG.format(v='v')} END::INT AS bucket, v - CASE WHEN v < 2 THEN 0 ELSE 1::BIGINT << {LOG.format(v='v')} END AS extra FROM (SELECT event_id, user_id % 65536 AS v FROM events)")
def partition_varbyte16(spark, sf_dir):
    bucket, extra, _ = numeric.partition(F.col("user_id") % 65536, *numeric.preset_sizes("varbyte16"))
    return events(spark, sf_dir).select("event_id", bucket.alias("bucket"), extra.alias("extra"))


# -- exceptions, sparse values, runs -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, least(o_custkey, 255) AS small, CASE WHEN o_custkey >= 255 THEN o_custkey END AS large, o_custkey AS decoded FROM orders")
def sentinel_byte(spark, sf_dir):
    small, large = numeric.sentinel_columns(F.col("o_custkey"))
    rows = orders(spark, sf_dir).select("o_orderkey", small.alias("small"), large.alias("large"))
    return rows.withColumn("decoded", F.coalesce("large", F.col("small").cast("long")))


@query("SELECT o_orderkey, o_custkey AS decoded FROM orders")
def sentinel_byte_decode(spark, sf_dir):
    small, large = numeric.sentinel_byte(orders(spark, sf_dir), "o_custkey", ["o_orderkey"])
    return numeric.sentinel_byte_decode(small, large, "o_custkey", ["o_orderkey"]).withColumnRenamed("o_custkey", "decoded")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 4294967295 ELSE o_custkey END AS masked, o_custkey AS decoded FROM orders")
def sentinel_num(spark, sf_dir):
    masked, large = numeric.sentinel_num(orders(spark, sf_dir), "o_custkey", F.col("o_custkey") % 7 == 0, (1 << 32) - 1, ["o_orderkey"])
    return masked.join(numeric.sentinel_num_decode(masked, large, "o_custkey", ["o_orderkey"]).withColumnRenamed("o_custkey", "decoded"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0")
def sentinel_num_exceptions(spark, sf_dir):
    return numeric.sentinel_num(orders(spark, sf_dir), "o_custkey", F.col("o_custkey") % 7 == 0, (1 << 32) - 1, ["o_orderkey"])[1].select("o_orderkey")


def sparse_sql(value: str, dominant: int) -> str:
    return f"""
WITH v AS (SELECT event_id, event_id // {CHUNK} AS chunk_id, {value} AS v FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN v <> {dominant} THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM v)
SELECT chunk_id, run, (count(*) - sum(CASE WHEN v <> {dominant} THEN 1 ELSE 0 END))::BIGINT AS distance, max(CASE WHEN v <> {dominant} THEN v END) AS literal FROM r GROUP BY chunk_id, run
"""


@query(sparse_sql("CASE WHEN event_type = 'purchase' THEN user_id ELSE 0 END", 0))
def sparse_zero_runs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("user_id")).otherwise(0))
    return numeric.sparse(rows, "v", ["chunk_id"], ["event_id"])


@query(sparse_sql("user_id % 3", 2))
def sparse_dominant_given(spark, sf_dir):
    return numeric.sparse(events(spark, sf_dir).withColumn("v", F.col("user_id") % 3), "v", ["chunk_id"], ["event_id"], 2)


@query(f"SELECT event_id // {CHUNK} AS chunk_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN user_id ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1")
def sparse_decode(spark, sf_dir):
    runs = sparse_zero_runs(spark, sf_dir)
    return numeric.sparse_decode(runs, ["chunk_id"]).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""
WITH v AS (SELECT event_id // {CHUNK} AS chunk_id, event_id, user_id % 2 AS v FROM events),
l AS (SELECT chunk_id, list(v ORDER BY event_id)[1:4096] AS vs FROM v GROUP BY 1),
r AS (SELECT chunk_id, list_reduce(list_transform(vs, lambda x: {{'v': x, 'n': 1}}), lambda a, b: CASE WHEN a.n = 0 THEN b WHEN a.v = b.v THEN {{'v': a.v, 'n': a.n + 1}} ELSE {{'v': a.v, 'n': a.n - 1}} END) AS w FROM l)
SELECT chunk_id, CASE WHEN w.n > 0 THEN w.v ELSE 0 END::BIGINT AS dominant FROM r
""")
def sparse_dominant_auto(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.col("user_id") % 2)
    return numeric.dominant_by(rows, "v", ["chunk_id"], ["event_id"])


@query(f"SELECT event_id // {CHUNK} AS chunk_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 9 ELSE user_id % 2 END)::BIGINT AS total FROM events GROUP BY 1")
def sparse_auto_decode(spark, sf_dir):
    """Runs around the dominant value that each chunk's vote finds, and back."""
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "click", 9).otherwise(F.col("user_id") % 2).cast("long"))
    votes = numeric.dominant_by(rows, "v", ["chunk_id"], ["event_id"])
    runs = numeric.sparse(rows.join(votes, "chunk_id").withColumn("v", F.col("v") - F.col("dominant")), "v", ["chunk_id"], ["event_id"])
    back = numeric.sparse_decode(runs, ["chunk_id"]).join(votes, "chunk_id").withColumn("value", F.col("value") + F.col("dominant"))
    return back.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


MERGE = "event_id // 60"


@query(f"""
WITH v AS (SELECT event_id, {MERGE} AS chunk_id, user_id AS v FROM events),
s AS (SELECT *, CASE WHEN v <= lag(v) OVER (PARTITION BY chunk_id ORDER BY event_id) THEN 1 ELSE 0 END AS stop FROM v),
r AS (SELECT *, sum(stop) OVER (PARTITION BY chunk_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT chunk_id, v, bit_or(1::BIGINT << run::INT) AS runs FROM r GROUP BY chunk_id, v
""")
def merge_sorted_bitset(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("event_id") / 60).cast("long").alias("chunk_id"), F.col("user_id").alias("v"))
    return numeric.merge_sorted(rows, "v", ["chunk_id"], ["event_id"])


@query(f"SELECT {MERGE} AS chunk_id, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY 1")
def merge_sorted_decode(spark, sf_dir):
    return numeric.merge_sorted_decode(merge_sorted_bitset(spark, sf_dir), "v", ["chunk_id"]).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


JUMPS = "user_id % 50 + event_id // 1024 % 3 * 100000"


@query(f"""
SELECT chunk_id, (event_id // 1024) % 4 AS segment, min(event_id) AS first_ord, max(event_id) AS last_ord, min(v)::BIGINT AS low, max(v)::BIGINT AS high
FROM (SELECT event_id // {CHUNK} AS chunk_id, event_id, {JUMPS} AS v FROM events) GROUP BY 1, 2
""")
def split_byrange(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.expr("user_id % 50 + event_id div 1024 % 3 * 100000"))
    return numeric.split_byrange(rows, "v", ["chunk_id"], "event_id")


@query("SELECT o_orderkey, o_custkey AS v FROM orders")
def dedup_equal_columns(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + 0).alias("b"))
    return numeric.dedup(rows, ["a", "b"], "v")


@query("SELECT p_brand, min(length(p_brand))::BIGINT AS value, count(*) AS n FROM part GROUP BY p_brand")
def constant_check(spark, sf_dir):
    return numeric.constant(table(spark, sf_dir, "part").withColumn("v", F.length("p_brand").cast("long")), "v", ["p_brand"])


# -- bits ----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH w AS (SELECT {sql_chunk('o_orderkey')}, count(*) AS n, greatest(1, length(ltrim(bin(max(o_custkey)), '0')))::INT AS bits FROM orders GROUP BY 1)
SELECT *, ceil(n * bits / 8.0)::BIGINT AS packed_bytes FROM w
""")
def bitpack_size(spark, sf_dir):
    return bits.bitpack_size(orders(spark, sf_dir), "o_custkey", ["chunk_id"])


@query(f"SELECT {sql_chunk('o_orderkey')}, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def bitpack_roundtrip(spark, sf_dir):
    packed = bits.bitpack(orders(spark, sf_dir).select("chunk_id", "o_orderkey", "o_custkey"), "o_custkey", ["chunk_id"], ["o_orderkey"])
    return bits.bitunpack_rows(packed, ["chunk_id"]).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query()
def bitpack_bytes(spark, sf_dir):
    packed = bits.bitpack(orders(spark, sf_dir).select("chunk_id", "o_orderkey", "o_custkey"), "o_custkey", ["chunk_id"], ["o_orderkey"])
    return packed.select("chunk_id", "n", "bits", F.octet_length("payload").alias("packed_bytes"), F.crc32("payload").alias("crc32"))


@query("SELECT o_orderkey, o_custkey & 15 AS low, (o_custkey >> 4) & 63 AS mid, (o_custkey >> 10) & 4194303 AS high, o_custkey AS joined FROM orders")
def bitsplit_fields(spark, sf_dir):
    widths = [4, 6, 22]
    low, mid, high = bits.bit_split(F.col("o_custkey"), widths)
    rows = orders(spark, sf_dir).select("o_orderkey", low.alias("low"), mid.alias("mid"), high.alias("high"))
    return rows.withColumn("joined", bits.bit_join([F.col("low"), F.col("mid"), F.col("high")], widths))


@query(f"""
WITH w AS (SELECT o_orderkey, o_custkey AS v, greatest(length(ltrim(bin(max(o_custkey) OVER (PARTITION BY o_orderkey // {CHUNK})), '0')) - 8, 0)::INT AS s FROM orders)
SELECT o_orderkey, v - ((v >> s) << s) AS low, v >> s AS top FROM w
""")
def bitsplit_top8(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("most", F.max("o_custkey").over(Window.partitionBy("chunk_id")))
    low, top = bits.split_top8(F.col("o_custkey"), F.col("most"))
    return rows.select("o_orderkey", low.alias("low"), top.alias("top"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_orderkey & 255 AS b0, (l_orderkey >> 8) & 255 AS b1, (l_orderkey >> 16) & 255 AS b2, (l_orderkey >> 24) & 255 AS b3, l_orderkey AS joined FROM lineitem")
def transpose_bytes(spark, sf_dir):
    planes = bits.byte_planes(F.col("l_orderkey"), 4)
    rows = lines(spark, sf_dir).select(*LINE, *[p.alias(f"b{i}") for i, p in enumerate(planes)])
    return rows.withColumn("joined", bits.from_planes([F.col(f"b{i}") for i in range(4)]))


@query()
def float32_deconstruct(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("b", bits.float_bits(F.col("x")))
    fraction, exponent = bits.deconstruct(F.col("b"))
    rows = rows.select("vec_id", "pos", "x", fraction.alias("signed_fraction"), exponent.alias("exponent"))
    return rows.withColumn("same", bits.float_from_bits(bits.reconstruct(F.col("signed_fraction"), F.col("exponent"))) == F.col("x"))


@query()
def bitsplit_float64(spark, sf_dir):
    fraction, exponent, sign = bits.split_float(bits.float_bits(F.col("o_totalprice"), "f64"), "f64")
    return orders(spark, sf_dir).select("o_orderkey", fraction.alias("fraction"), exponent.alias("exponent"), sign.alias("sign"))


OVER = "(CASE WHEN l_linenumber >= (1 << {s}) - 1 THEN 1 ELSE 0 END + CASE WHEN l_quantity::BIGINT - 1 >= (1 << (8 - {s})) - 1 THEN 1 ELSE 0 END)"


@query(" UNION ALL ".join(f"SELECT {s} AS split, sum({OVER.format(s=s)})::BIGINT AS overflows FROM lineitem" for s in range(9)))
def mux_split_overflows(spark, sf_dir):
    return bits.best_mux_split(lines(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("long")), "l_linenumber", "q", 1)


@query(f"SELECT {', '.join(LINE)}, least(l_linenumber, 7) | (least(l_quantity::BIGINT - 1, 31) << 3) AS byte, CASE WHEN l_linenumber >= 7 THEN l_linenumber - 7 END::BIGINT AS more, CASE WHEN l_quantity::BIGINT - 1 >= 31 THEN l_quantity::BIGINT - 32 END AS rest, l_linenumber::BIGINT AS literals, l_quantity::BIGINT AS matches FROM lineitem")
def mux_lengths(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*LINE, F.col("l_linenumber").cast("long").alias("l"), F.col("l_quantity").cast("long").alias("m"))
    byte, more, rest = bits.mux_lengths(F.col("l"), F.col("m"), 3, 1)
    rows = rows.select(*LINE, byte.alias("byte"), more.cast("long").alias("more"), rest.cast("long").alias("rest"))
    literals, matches = bits.mux_decode(F.col("byte"), F.col("more"), F.col("rest"), 3, 1)
    return rows.withColumn("literals", literals.cast("long")).withColumn("matches", matches.cast("long"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding) AS x FROM embeddings")
def float32_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("b", bits.float_bits(F.col("x")))
    return rows.select("vec_id", "pos", bits.float_from_bits(bits.reconstruct(*bits.deconstruct(F.col("b")))).alias("x"))


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS x, (o_totalprice < 0)::INT::BIGINT AS sign FROM orders")
def bitsplit_float64_roundtrip(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("b", bits.float_bits(F.col("o_totalprice").cast("double"), "f64"))
    parts = bits.split_float(F.col("b"), "f64")
    return rows.select("o_orderkey", bits.float_from_bits(bits.bit_join(list(parts), [52, 11, 1]), "f64").alias("x"), parts[2].alias("sign"))


# -- dictionaries and strings --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS idx FROM part")
def tokenize_sorted(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return strings.tokenize(parts.select("p_partkey", "p_brand"), "p_brand", strings.alphabet_sorted(parts, "p_brand"))


FIRST = "SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS idx FROM customer GROUP BY c_mktsegment"


@query(FIRST)
def tokenize_alphabet(spark, sf_dir):
    return strings.alphabet_first(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"])


@query(f"SELECT c_custkey, idx FROM customer JOIN ({FIRST}) USING (c_mktsegment)")
def tokenize_first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return strings.tokenize(rows.select("c_custkey", "c_mktsegment"), "c_mktsegment", strings.alphabet_first(rows, "c_mktsegment", ["c_custkey"]))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def tokenize_decode_join(spark, sf_dir):
    return strings.detokenize(tokenize_first_occurrence(spark, sf_dir), tokenize_alphabet(spark, sf_dir))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY length(p_type), p_type) - 1 AS idx FROM part")
def tokenize_custom(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    order = parts.select("p_type").distinct().select("p_type", F.struct(F.length("p_type"), "p_type").alias("r"))
    return strings.tokenize(parts.select("p_partkey", "p_type"), "p_type", strings.alphabet_given(order, "p_type", "r"))


PREFIX = f"""
WITH n AS (SELECT c_custkey, c_name, lag(c_name) OVER (PARTITION BY c_custkey // {CHUNK} ORDER BY c_custkey) AS p FROM customer),
s AS (SELECT *, coalesce(len(list_filter(range(1, least(length(c_name), length(p)) + 1), lambda i: substr(c_name, 1, i) = substr(p, 1, i))), 0) AS shared FROM n)
"""


@query(PREFIX + "SELECT c_custkey, shared::BIGINT AS shared, substr(c_name, shared + 1) AS suffix FROM s")
def prefix_suffix(spark, sf_dir):
    rows = strings.prefix_encode(by_chunk(table(spark, sf_dir, "customer"), "c_custkey"), "c_name", ["chunk_id"], ["c_custkey"])
    return rows.select("c_custkey", "shared", F.decode("suffix", "UTF-8").alias("suffix"))


@query("SELECT c_custkey, c_name AS value FROM customer")
def prefix_decode(spark, sf_dir):
    rows = strings.prefix_encode(by_chunk(table(spark, sf_dir, "customer"), "c_custkey"), "c_name", ["chunk_id"], ["c_custkey"])
    return strings.prefix_decode(rows.select("chunk_id", "c_custkey", "shared", "suffix"), ["chunk_id"], ["c_custkey"]).select("c_custkey", "value")


PIECES = "SELECT event_id, unnest(string_split(regexp_replace(props, '[^-0-9a-z]+', ' ', 'g'), ' ')) AS t FROM events"


@query(f"SELECT event_id, t, CASE WHEN regexp_full_match(t, '0|-?[1-9][0-9]{{0,18}}') THEN try_cast(t AS BIGINT) END AS v, count(*) AS n FROM ({PIECES}) GROUP BY ALL")
def parse_int_strict(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.explode(F.split(F.regexp_replace("props", "[^-0-9a-z]+", " "), " ")).alias("t"))
    return rows.select("event_id", "t", strings.parse_int(F.col("t")).alias("v")).groupBy("event_id", "t", "v").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN regexp_full_match(t, '0|-?[1-9][0-9]{{0,18}}') THEN 0 ELSE 1 END::INT AS channel, count(*) AS n FROM ({PIECES}) GROUP BY 1")
def try_parse_int_split(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.explode(F.split(F.regexp_replace("props", "[^-0-9a-z]+", " "), " ")).alias("t"))
    good, bad = strings.try_parse_int(rows, "t", ["event_id"])
    return good.select(F.lit(0).alias("channel")).union(bad.select(F.lit(1))).groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, v::DOUBLE AS v FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)")
def parse_float_exact(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("t", F.col("o_totalprice").cast("string"))
    return rows.select("o_orderkey", strings.parse_float(F.col("t")).alias("v"))


@query(f"SELECT page_id // {CHUNK} AS chunk_id, string_agg(url, '' ORDER BY page_id) AS content, sum(strlen(url))::BIGINT AS length FROM pages GROUP BY 1")
def separate_lengths(spark, sf_dir):
    content, lengths = strings.separate(by_chunk(table(spark, sf_dir, "pages"), "page_id"), "url", ["chunk_id"], ["page_id"])
    return content.select("chunk_id", F.decode("content", "UTF-8").alias("content")).join(lengths.groupBy("chunk_id").agg(F.sum("length").alias("length")), "chunk_id")


@query("SELECT page_id, url AS text FROM pages")
def set_string_lengths(spark, sf_dir):
    content, lengths = strings.separate(table(spark, sf_dir, "pages").withColumn("chunk_id", F.floor(F.col("page_id") / 64)), "url", ["chunk_id"], ["page_id"])
    return strings.set_lengths(content, lengths, ["chunk_id"], ["page_id"]).select("page_id", "text")


@query("SELECT o_orderkey, o_custkey AS little, o_custkey AS big FROM orders")
def number_bytes_roundtrip(spark, sf_dir):
    little, big = strings.from_number(F.col("o_custkey"), 4), strings.from_number(F.col("o_custkey"), 4, True)
    return orders(spark, sf_dir).select("o_orderkey", strings.to_number(little).alias("little"), strings.to_number(big, True).alias("big"))


@query("SELECT event_id, CASE WHEN event_id < 100 THEN 0 WHEN event_id < 350 THEN 1 ELSE 2 END::BIGINT AS segment FROM events")
def split_by_sizes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", strings.split_segments(F.col("event_id"), [100, 250, 0]).alias("segment"))


@query("SELECT o_orderkey, unnest([0, 1, 2])::INT AS pos, unnest([o_custkey, o_orderkey, o_custkey % 7]) AS value FROM orders")
def structs_of_serial(spark, sf_dir):
    serial = F.concat(*[strings.from_number(c, 4) for c in (F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") % 7)])
    rows = orders(spark, sf_dir).select("o_orderkey", F.posexplode(strings.to_structs(serial, 4)).alias("pos", "record"))
    return rows.select("o_orderkey", "pos", strings.to_number(F.col("record")).alias("value"))


@query("SELECT o_orderkey, o_orderkey AS a, o_custkey AS b FROM orders")
def split_by_struct_fields(spark, sf_dir):
    record = F.concat(strings.from_number(F.col("o_orderkey"), 6), strings.from_number(F.col("o_custkey"), 4))
    a, b = strings.split_fields(F.col("record"), [6, 4])
    return orders(spark, sf_dir).withColumn("record", record).select("o_orderkey", strings.to_number(a).alias("a"), strings.to_number(b).alias("b"))


TAG = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"


@query(f"SELECT event_id, {TAG}::INT AS tag, event_type FROM events")
def dispatch_by_tag(spark, sf_dir):
    return strings.dispatch(events(spark, sf_dir), F.expr(TAG), 4).select("event_id", "tag", "event_type")


@query(f"SELECT {TAG}::INT AS tag, count(*) AS n, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def dispatch_counts(spark, sf_dir):
    return strings.dispatch(events(spark, sf_dir), F.expr(TAG), 4).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


@query("SELECT event_id, event_type AS text FROM events")
def dispatch_string_roundtrip(spark, sf_dir):
    rows = events(spark, sf_dir)
    indices, streams = strings.dispatch_string(rows, "event_type", F.expr(TAG), 4, ["chunk_id"], "event_id")
    return strings.dispatch_string_decode(indices, streams, "event_type", ["chunk_id"], "event_id").select("event_id", F.col("event_type").alias("text"))


@query(f"SELECT {TAG}::INT AS index, count(*) AS n, max(place) + 1 AS places FROM (SELECT *, row_number() OVER (PARTITION BY event_id // {CHUNK}, {TAG} ORDER BY event_id) - 1 AS place FROM events) GROUP BY 1")
def dispatch_string_outputs(spark, sf_dir):
    _, streams = strings.dispatch_string(events(spark, sf_dir), "event_type", F.expr(TAG), 4, ["chunk_id"], "event_id")
    whole = [s.agg(F.lit(i).alias("index"), F.count("*").alias("n"), (F.max("place") + 1).cast("long").alias("places")) for i, s in enumerate(streams)]
    return whole[0].union(whole[1]).union(whole[2]).union(whole[3]).where("n > 0")


@query(f"SELECT event_id, pos::INT AS pos, token AS text FROM (SELECT event_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT event_id, string_split(regexp_replace(props, '[^-0-9a-z.]+', ' ', 'g'), ' ') AS t FROM events))")
def float_streams_roundtrip(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.posexplode(F.split(F.regexp_replace("props", "[^-0-9a-z.]+", " "), " ")).alias("pos", "t"))
    return strings.float_texts(*strings.float_streams(rows, "t", ["event_id"], "pos"), "t", ["event_id"], "pos").withColumnRenamed("t", "text")


@query("SELECT event_id, CASE WHEN s = '' THEN 0 ELSE 1 END::INT AS channel FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS s FROM events)")
def null_aware_dispatch(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("s", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return rows.select("event_id", strings.null_aware(F.col("s")).alias("channel"))


def accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return c, s


CONCAT = "SELECT 0::BIGINT AS src, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier"


@query(CONCAT)
def concat_streams(spark, sf_dir):
    return strings.concat(list(accounts(spark, sf_dir)), "v", ["k"])


@query(f"SELECT src, count(*) AS n FROM ({CONCAT}) GROUP BY src")
def concat_sizes(spark, sf_dir):
    return concat_streams(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey * 2 + s AS ord, CASE s WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, (VALUES (0), (1)) t(s)")
def interleave_two(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return strings.interleave([rows.select("o_orderkey", F.col(c).alias("v")) for c in ("o_orderstatus", "o_orderpriority")], "o_orderkey", "v")


@query("SELECT s::BIGINT AS src, o_orderkey AS position, CASE s WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, (VALUES (0), (1)) t(s)")
def deinterleave_two(spark, sf_dir):
    return strings.deinterleave(interleave_two(spark, sf_dir), 2, "v")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ord FROM customer")
def numbered_rows(spark, sf_dir):
    from .spec import numbered

    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "ord")


@query(f"SELECT {sql_chunk('l_orderkey')}, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY 1")
def segment_chunks(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


# -- statistics ----------------------------------------------------------------------------------------------------------

HISTOGRAM = "SELECT event_type, user_id % 256 AS v, count(*) AS n FROM events GROUP BY 1, 2"


def bytes_of(spark, sf_dir):
    return events(spark, sf_dir).withColumn("v", F.col("user_id") % 256)


@query(HISTOGRAM)
def histogram_u8(spark, sf_dir):
    return stats.histogram(bytes_of(spark, sf_dir), "v", ["event_type"])


ENTROPY = f"""
h AS ({HISTOGRAM}), t AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total FROM h),
e AS (SELECT event_type, sum(n)::BIGINT AS total, count(*) AS symbols, max(n) AS largest, max(v) AS most, sum(-(n::DOUBLE / total) * log2(n::DOUBLE / total)) AS entropy FROM t GROUP BY 1)
"""


@query(f"WITH {ENTROPY} SELECT event_type, total, symbols, largest, round(entropy, 6) AS entropy FROM e")
def entropy_by_type(spark, sf_dir):
    return stats.entropy(histogram_u8(spark, sf_dir), ["event_type"]).withColumn("entropy", F.round("entropy", 6))


@query(f"""
WITH d AS (SELECT (((user_id % 256) - coalesce(lag(user_id % 256) OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id), 0)) % 256 + 256) % 256 AS v, event_id // {CHUNK} AS chunk_id FROM events),
h AS (SELECT chunk_id, v, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY chunk_id) AS total FROM h)
SELECT chunk_id, round(sum(-(n::DOUBLE / total) * log2(n::DOUBLE / total)), 6) AS entropy FROM t GROUP BY 1
""")
def delta_entropy(spark, sf_dir):
    rows = bytes_of(spark, sf_dir).withColumn("d", numeric.delta_modular(F.col("v"), 1, ["chunk_id"], ["event_id"]))
    return stats.entropy(stats.histogram(rows, "d", ["chunk_id"]), ["chunk_id"]).select("chunk_id", F.round("entropy", 6).alias("entropy"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS stream, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count({c}) AS n FROM lineitem" for c in NUMBERS))
def range_by_column(spark, sf_dir):
    return stats.ranges(lines(spark, sf_dir), NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS stream, count(DISTINCT {c}) AS cardinality FROM lineitem" for c in NUMBERS))
def cardinality_exact(spark, sf_dir):
    return stats.cardinality(lines(spark, sf_dir), NUMBERS, exact=True).select("stream", "cardinality")


@query()
def cardinality_estimate(spark, sf_dir):
    return stats.cardinality(lines(spark, sf_dir), NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS stream, count({c}) AS n, 8 AS width, count(DISTINCT {c}) AS cardinality, count(DISTINCT {c}) AS cardinality_low, count(DISTINCT {c}) AS cardinality_high, round(max({c})::DOUBLE - min({c})::DOUBLE, 6) AS range_size, round(avg({c}), 4) AS mean, round(var_samp({c}), 4) AS variance, round(stddev_samp({c}), 6) AS stddev, round(sum(power({c} - m, 3)) / count({c}) / power(stddev_pop({c}), 3), 6) AS skewness, round(sum(power({c} - m, 4)) / count({c}) / power(var_pop({c}), 2) - 3, 6) AS kurtosis FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)" for c in ["l_quantity", "l_discount"]))
def moments_features(spark, sf_dir):
    rows = stats.features(lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity").cast("double")).withColumn("l_discount", F.col("l_discount").cast("double")), ["l_quantity", "l_discount"], exact=True)
    return rows.select("stream", "n", "width", "cardinality", "cardinality_low", "cardinality_high", *[F.round(c, 4 if c in ("mean", "variance") else 6).alias(c) for c in ("range_size", "mean", "variance", "stddev", "skewness", "kurtosis")])


BITS = "CASE WHEN {v} <= 1 THEN 0 ELSE length(ltrim(bin({v} - 1), '0')) END"
ESTIMATES = f"""
{ENTROPY}, s AS (SELECT event_type, total, symbols, largest, round(entropy, 6) AS entropy, ceil(round(total * entropy / 8, 6))::BIGINT AS entropy_bytes,
    (total * {BITS.format(v='(most + 1)')} + 7) // 8 AS bitpacked_bytes, ((total * {BITS.format(v='symbols')} + 7) // 8 + symbols)::BIGINT AS flatpacked_bytes FROM e)
"""


@query(f"WITH {ESTIMATES} SELECT event_type, total, symbols, largest, entropy, entropy_bytes, bitpacked_bytes::BIGINT AS bitpacked_bytes, flatpacked_bytes FROM s")
def size_estimates(spark, sf_dir):
    return stats.size_estimates(histogram_u8(spark, sf_dir), "v", ["event_type"]).drop("constant_bytes").withColumn("entropy", F.round("entropy", 6))


@query(f"""
WITH v AS (SELECT l_orderkey // {CHUNK} AS chunk_id, l_linenumber AS v, l_orderkey * 8 + l_linenumber AS ord FROM lineitem),
d AS (SELECT chunk_id, ord - lag(ord) OVER (PARTITION BY chunk_id, v ORDER BY ord) AS distance FROM v),
c AS (SELECT chunk_id, distance, count(*) AS matches FROM d WHERE distance >= 1 GROUP BY 1, 2),
r AS (SELECT *, sum(matches) OVER (PARTITION BY chunk_id) AS total, row_number() OVER (PARTITION BY chunk_id ORDER BY matches DESC, distance) AS place FROM c)
SELECT chunk_id, distance AS stride, round(matches::DOUBLE / total, 6) AS share FROM r WHERE place = 1
""")
def dimensionality(spark, sf_dir):
    return stats.dimensionality(lines(spark, sf_dir).withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "l_linenumber", ["chunk_id"], "ord").withColumn("share", F.round("share", 6))


@query()
def float_width_guess(spark, sf_dir):
    @F.pandas_udf("binary")
    def raw(x):
        import numpy as np

        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    return stats.guess_width(table(spark, sf_dir, "embeddings").select(raw("embedding").alias("content")), "content")


@query()
def checksum_lineitem(spark, sf_dir):
    return stats.checksum(lines(spark, sf_dir), LINE, ["chunk_id"])
