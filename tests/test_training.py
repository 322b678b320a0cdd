"""What training takes from large tables: the same samples, without putting the others' lines together, and once."""

import pytest
from pyspark.sql import functions as F

from weft import queries_graphs as q
from weft.plans import train


@pytest.fixture()
def forty(spark, monkeypatch):
    """Lines of 40 chunks of several sizes, with nulls in values and keys."""
    rows = spark.range(0, 40 * 50).select(
        F.when(F.col("id") % 997 != 5, F.floor(F.col("id") / 50) * q.CHUNK + F.col("id") % 37).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.when(F.col("id") % 9 != 0, F.col("id") * 7 % 501).alias("l_partkey"),
        (F.col("id") % 11).alias("l_suppkey"), F.lit("2020-01-01").cast("timestamp").alias("l_shipdate"))
    rows = rows.where("id % 50 < 50 - id / 50").withColumn("chunk_id", F.floor(F.col("l_orderkey") / q.CHUNK).cast("long"))
    monkeypatch.setattr(q, "lines", lambda spark, sf_dir: rows)
    return rows


def plainly(rows, order, most, by):
    """The samples by sorting all of them in Python."""
    held = {}
    for r in rows.collect():
        held.setdefault(r.chunk_id, []).append(tuple((x is not None, x) for x in (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey)))
    place = {"l_orderkey": 0, "l_linenumber": 1, "l_partkey": 2, "l_suppkey": 3}
    all_ = [(c, s, b"".join(x[place[s]][1].to_bytes(4, "little") for x in sorted(rs) if x[place[s]][0])) for c, rs in held.items() for s in by]
    return sorted(all_, key=lambda x: ((x[0] is not None, x[0] or 0), x[1]))[:most]


@pytest.mark.parametrize("by, order, most", [(q.STREAMS, ["chunk_id", "stream"], 30), (["l_partkey"], ["chunk_id"], 4)])
def test_line_samples(spark, forty, by, order, most):
    samples = q.line_samples(spark, "", most, by)
    assert samples.select("chunk_id").distinct().count() == len({c for c, _, _ in plainly(forty, order, most, by)}) < 40
    few = train.limit_samples(samples.where(F.col("stream").isin(by)), "content", order, most=most)
    assert sorted(((r.chunk_id, r.stream, bytes(r.content)) for r in few.collect()), key=str) == sorted(plainly(forty, order, most, by), key=str)


def test_search_measures_one_reading(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(8).select(F.lit("numeric").alias("kind"), F.lit(1).alias("width"), F.encode(F.repeat(F.col("id").cast("string"), 40), "UTF-8").alias("content"))
    front = train.search_chains(rows.mapInArrow(count, rows.schema), population=6, generations=3)
    assert front and read.value == 8


def test_orchestrated_training_gathers_chosen_chunks(spark, forty, monkeypatch):
    """The table that training is given has the chunks that it takes, and no others."""
    given = []
    monkeypatch.setattr(q.train, "train", lambda df, graph, *rest, **named: (given.append(df), (graph, {}))[1])
    q.orchestrated_training(spark, "")
    ids = [r.chunk_id for r in given[0].select("chunk_id").collect()]
    assert sorted(ids, key=str) == sorted({c for c, _, _ in plainly(forty, [], 16, ["l_partkey"])}, key=str)
