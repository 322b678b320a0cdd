"""Plans: chains of invertible steps on one column, their manifest, encoding with fall-back and decoding."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import numeric


@dataclass(frozen=True)
class Plan:
    """Steps by name with parameters, on `value`, within chunks `by` along `order`."""

    value: str
    by: tuple[str, ...]
    order: tuple[str, ...]
    steps: tuple[tuple[str, dict], ...]

    def to_json(self) -> str:
        return json.dumps({"value": self.value, "by": self.by, "order": self.order, "steps": self.steps}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        d = json.loads(text)
        return Plan(d["value"], tuple(d["by"]), tuple(d["order"]), tuple((n, p) for n, p in d["steps"]))


def _encode(df: DataFrame, step: str, p: dict, plan: Plan) -> DataFrame:
    v, by, order = F.col(plan.value), list(plan.by), list(plan.order)
    if step == "delta":
        return df.withColumn(plan.value, numeric.delta(v, by, order))
    if step == "zigzag":
        return df.withColumn(plan.value, numeric.zigzag(v))
    if step == "divide_by":
        return df.withColumn(plan.value, numeric.divide_by(v, p["divisor"]))
    if step == "range_pack":
        packed = numeric.range_pack(df, plan.value, by)
        return packed.withColumn(plan.value, F.col("packed")).withColumnRenamed("base", f"base_{p['id']}").drop("packed", "packed_width")
    raise ValueError(f"unknown step {step}")


def _decode(df: DataFrame, step: str, p: dict, plan: Plan) -> DataFrame:
    v, by, order = F.col(plan.value), list(plan.by), list(plan.order)
    if step == "delta":
        return df.withColumn(plan.value, numeric.delta_decode(v, by, order))
    if step == "zigzag":
        return df.withColumn(plan.value, numeric.unzigzag(v))
    if step == "divide_by":
        return df.withColumn(plan.value, v * p["divisor"])
    if step == "range_pack":
        return df.withColumn(plan.value, v + F.col(f"base_{p['id']}")).drop(f"base_{p['id']}")
    raise ValueError(f"unknown step {step}")


def encode(df: DataFrame, plan: Plan) -> DataFrame:
    for step, p in plan.steps:
        df = _encode(df, step, p, plan)
    return df


def decode(df: DataFrame, plan: Plan) -> DataFrame:
    for step, p in reversed(plan.steps):
        df = _decode(df, step, p, plan)
    return df


def write_frame(df: DataFrame, plan: Plan, path: str, permissive: bool = False) -> Plan:
    """Write the encoded stream and its manifest. If a step fails on the data and permissive is set, the stream is stored as it is."""
    spark = df.sparkSession
    try:
        encode(df, plan).write.mode("overwrite").parquet(f"{path}/streams")
    except PySparkException:
        if not permissive:
            raise
        plan = Plan(plan.value, plan.by, plan.order, ())
        df.write.mode("overwrite").parquet(f"{path}/streams")
    spark.createDataFrame([(plan.to_json(),)], "plan string").write.mode("overwrite").parquet(f"{path}/manifest")
    return plan


def read_frame(spark, path: str) -> DataFrame:
    plan = Plan.from_json(spark.read.parquet(f"{path}/manifest").first()[0])
    return decode(spark.read.parquet(f"{path}/streams"), plan)
