"""Archives and nested columns: members of zip files, and shredding of arrays, maps and structs into flat streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def zip_members(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, member, size, content) of zip files read by Spark's binaryFile source."""

    def run(batches):
        for rows in batches:
            out: dict[str, list] = {"path": [], "member": [], "size": [], "content": []}
            for name, raw in zip(rows[path], rows[content]):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            for key, value in zip(out, (name, m.filename, m.file_size, z.read(m))):
                                out[key].append(value)
            yield pd.DataFrame(out)

    return files.select(path, content).mapInPandas(run, "path string, member string, size long, content binary")


def shred(df: DataFrame, column: str, keys: list[str]) -> dict[str, DataFrame]:
    """Flat streams of a nested column by path: values with the positions that lead to them, and lengths of lists and maps."""
    out: dict[str, DataFrame] = {}

    def walk(rows: DataFrame, kind, name: str, places: list[str]) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(rows.withColumn("_v", F.col("_v")[f.name]), f.dataType, f"{name}.{f.name}", places)
        elif isinstance(kind, (ArrayType, MapType)):
            out[f"{name}#"] = rows.select(*keys, *places, F.size("_v").cast("long").alias("length"))
            place = f"pos{len(places)}"
            if isinstance(kind, ArrayType):
                walk(rows.select(*keys, *places, F.posexplode("_v").alias(place, "_v")), kind.elementType, f"{name}[]", [*places, place])
            else:
                entries = rows.select(*keys, *places, F.posexplode(F.transform(F.array_sort(F.map_keys("_v")), lambda k: F.struct(k.alias("key"), F.element_at("_v", k).alias("value")))).alias(place, "_e"))
                walk(entries.withColumn("_v", F.col("_e.key")).drop("_e"), kind.keyType, f"{name}{{key}}", [*places, place])
                walk(entries.withColumn("_v", F.col("_e.value")).drop("_e"), kind.valueType, f"{name}{{value}}", [*places, place])
        else:
            out[name] = rows.select(*keys, *places, F.col("_v").alias("value"))

    walk(df.select(*keys, F.col(column).alias("_v")), df.schema[column].dataType, column, [])
    return out
