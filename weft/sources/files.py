"""Files as streams: raw bytes in chunks, columns of Parquet files as typed streams, maps of features by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from ..functions.stats import WIDTH
from .archive import shred

#: Bytes of a chunk, at most and at least.
CHUNK_BYTES, LEAST_BYTES = 16 << 20, 32 << 10


def raw_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def byte_chunks(df: DataFrame, content: str, keys: list[str], size: int = CHUNK_BYTES, width: int = 1) -> DataFrame:
    """(keys, chunk, content): pieces of at most `size` bytes, cut at whole fields of `width` bytes; an empty content is one empty piece. Sizes below LEAST_BYTES are raised to it."""
    whole = max(size, LEAST_BYTES) // width * width
    count = F.greatest(F.ceil(F.octet_length(content) / whole), F.lit(1)).cast("int")
    sure = F.assert_true(F.octet_length(content) % width == 0, F.lit("no whole number of fields"))
    rows = df.select(*keys, F.col(content).alias("_c"), F.posexplode(F.sequence(F.lit(0), F.when(sure.isNull(), count) - 1)).alias("chunk", "_i"))
    return rows.select(*keys, "chunk", F.substring(F.col("_c"), F.col("_i") * whole + 1, F.lit(whole)).alias("content"))


def segments(df: DataFrame, content: str, keys: list[str], sizes: Column) -> DataFrame:
    """(keys, chunk, content) by the user's own segmenter: sizes is an array column, of any function, that adds up to the content."""
    total = F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = df.select(*keys, F.col(content).alias("_c"), sizes.cast("array<long>").alias("_s"))
    sure = F.when(F.assert_true(total == F.octet_length("_c"), F.lit("segments do not add up")).isNull(), F.col("_s"))
    ends = F.aggregate(sure, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    spans = F.zip_with(ends, F.col("_s"), lambda at, n: F.when(n.isNotNull(), F.struct(at.alias("at"), n.alias("n"))))
    return rows.select(*keys, "_c", F.posexplode(F.filter(spans, lambda s: s.isNotNull())).alias("chunk", "_p")).select(*keys, "chunk", F.substring(F.col("_c"), (F.col("_p.at") + 1).cast("int"), F.col("_p.n").cast("int")).alias("content"))


def stream_kind(type_: str) -> tuple[str, int]:
    """(kind, width) of a column's values as a stream."""
    return ("string", 1) if type_ in ("string", "binary") else ("numeric", WIDTH.get(type_, 8))


def column_streams(df: DataFrame) -> DataFrame:
    """(tag, stream, kind, width, n, nulls, bytes) of every top-level column that is not nested, from one aggregation: Spark reads Parquet's pages and levels."""
    flat = [(i, f) for i, f in enumerate(df.schema) if not isinstance(f.dataType, (ArrayType, MapType)) and f.dataType.typeName() != "struct"]
    aggs = [a for i, f in flat for a in (F.count(f"`{f.name}`").alias(f"n{i}"), (F.sum(F.octet_length(f"`{f.name}`") + 4) if stream_kind(f.dataType.simpleString())[0] == "string" else F.count(f"`{f.name}`") * stream_kind(f.dataType.simpleString())[1]).alias(f"b{i}"))]
    rows = F.array(*[F.struct(F.lit(i).alias("tag"), F.lit(f.name).alias("stream"), F.lit(stream_kind(f.dataType.simpleString())[0]).alias("kind"), F.lit(stream_kind(f.dataType.simpleString())[1]).alias("width"), F.col(f"n{i}").alias("n"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.coalesce(F.col(f"b{i}").cast("long"), F.lit(0).cast("long")).alias("bytes")) for i, f in flat])
    return df.agg(F.count("*").alias("rows"), *aggs).select(F.explode(rows).alias("r")).select("r.*")


def column_values(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(file, row, value) of the values that are there and (file, row) of the nulls of one column of Parquet files, by the rows' own positions."""
    rows = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(column).alias("value"))
    return rows.where("value is not null"), rows.where("value is null").select("file", "row")


#: Kinds of feature maps, by the type of their values.
FEATURES = {"float": "map<bigint,float>", "id_list": "map<bigint,array<bigint>>", "id_list_list": "map<bigint,array<array<bigint>>>", "float_list": "map<bigint,array<float>>", "id_score_list": "map<bigint,map<bigint,float>>"}


def feature_streams(df: DataFrame, maps: dict[str, str], keys: list[str]) -> dict[str, dict[str, DataFrame]]:
    """kind -> path -> stream of typed feature maps (maps: kind of FEATURES -> column), and `rest` -> column -> (keys, value) of all other columns."""
    out: dict[str, dict[str, DataFrame]] = {}
    for kind, column in maps.items():
        if df.schema[column].dataType.simpleString() != FEATURES[kind]:
            raise ValueError(f"{column} is not {FEATURES[kind]}")
        out[kind] = {path.removeprefix(column): s for path, s in shred(df, column, keys).items()}
    out["rest"] = {c: df.select(*keys, F.col(c).alias("value")) for c in df.columns if c not in maps.values() and c not in keys}
    return out
