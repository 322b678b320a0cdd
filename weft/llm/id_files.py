"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The dictionary file, magic b"WVD1" and u32 ids, holds the ids by falling frequency over all documents (ties: smaller id
first); a code is a place in it. A block file holds whole documents. Little-endian layout:

    magic b"WVB1" | u32 documents | u32 crc32 of the dictionary file | u64 ids | u64 bytes of data
    documents x i64: document ids | documents x u32: ids in each
    (ids + 3) // 4 control bytes: two bits an id, low bits first: bytes of its code less 1
    data: the codes' bytes, little-endian, least number of bytes each

Files are the rows of Parquet tables in the shared folder, dictionary (body) and blocks (part, block, ids_before, n_ids,
body), so Spark's own commit
protocol covers lost executors and any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coder import LibraryCoder, text_slices
from .shared import binary, map_rows, new_path, remove, slices, stage, text_or_empty

MAGIC, DICTIONARY, HEAD = b"WVB1", b"WVD1", "<4sIIQQ"
BLOCK_IDS = 1 << 18
#: Code bytes (1 to 4) of the four codes that a control byte describes.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "uint32")
NULL_ID = -(1 << 63)


def write_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, code_of: np.ndarray, dictionary: bytes) -> bytes:
    codes = np.ascontiguousarray(code_of[ids], "<u4")
    size = 1 + (codes > 0xFF) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    data = codes.view("u1").reshape(-1, 4)[np.arange(4) < size[:, None]]
    padded = np.zeros(-(-len(ids) // 4) * 4, "u1")
    padded[: len(ids)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], "u1")).sum(1).astype("u1")
    head = struct.pack(HEAD, MAGIC, len(doc_ids), zlib.crc32(dictionary), len(ids), len(data))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def read_block(body: bytes, dictionary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids in each, all ids) of a block file."""
    magic, docs, crc, n, size = struct.unpack_from(HEAD, body)
    if magic != MAGIC or dictionary[:4] != DICTIONARY or crc != zlib.crc32(dictionary):
        raise ValueError("not a block file, or of another dictionary")
    at = struct.calcsize(HEAD)

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(body, kind, count, at)
        at += found.nbytes
        return found

    by_rank = np.frombuffer(dictionary, "<u4", -1, 4)
    doc_ids, sizes, control = take(docs, "<i8"), take(docs, "<u4"), take(-(-n // 4), "u1")
    data = np.concatenate([take(size, "u1"), np.zeros(4, "u1")])
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    codes = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").ravel() & MASKS[lengths]
    return doc_ids, sizes, by_rank[codes]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary; unsigned 16 bits if the vocabulary allows, else 32) with end_id after each document."""

    def make():
        coder = LibraryCoder(tokenizer)
        width = 2 if coder.library.get_vocab_size() <= 1 << 16 else 4

        def each(part):
            ids, count = coder.encode(part["text"])
            return {"doc_id": part["doc_id"], "ids": binary(np.insert(ids, np.cumsum(count), end_id).astype(f"<u{width}"), (count + 1) * width), "width": np.full(len(count), width)}

        return each

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")), make, "doc_id long, ids binary, width int", text_slices)


def id_frequencies(encoded: DataFrame) -> dict[int, int]:
    """Count of each id over all documents: summed within tasks, then by id; the result has at most a row an id of the vocabulary."""

    def count(batches):
        total = np.zeros(0, "int64")
        for part in slices(batches):
            for ids, width in zip(part["ids"].to_pylist(), part["width"].to_pylist()):
                found = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), "int64")])
                total[: len(found)] += found
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return {r[0]: r[1] for r in encoded.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()}


def write_id_files(docs: DataFrame, tokenizer: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents and write block files at path, documents in ascending order of id over (part, block)."""
    spark = docs.sparkSession
    encoded = stage(token_ids(docs, tokenizer, end_id, id_col=id_col, text_col=text_col), "ids")
    counts = id_frequencies(encoded)
    by_rank = np.asarray(sorted(counts, key=lambda i: (-counts[i], i)), "int64")
    code_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "int64")
    code_of[by_rank] = np.arange(len(by_rank))
    dictionary = DICTIONARY + by_rank.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(dictionary),)], "body binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def flush():
            nonlocal block, before, held, n
            sizes = np.asarray([len(x) for _, x in held], "int64")
            body = write_block(np.asarray([d for d, _ in held], "int64"), sizes, np.concatenate([x for _, x in held]), code_of, dictionary)
            row = pa.RecordBatch.from_pydict({"part": [part], "block": [block], "ids_before": [before], "n_ids": [n], "body": [body]}, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())]))
            block, before, held, n = block + 1, before + n, [], 0
            return row

        for some in slices(batches):
            for doc, ids, width in zip(some["doc_id"].to_pylist(), some["ids"].to_pylist(), some["width"].to_pylist()):
                ids = np.frombuffer(ids, f"<u{width}")
                held.append((NULL_ID if doc is None else doc, ids))
                n += len(ids)
                if n >= block_ids:
                    yield flush()
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, null ids too, are dealt to several parts by what they hold and where they lie
    order = ["doc_id", "hash", "row"]
    ordered = encoded.withColumn("hash", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # not compressed again: the bytes of a block lie in the file as the format has them
    ordered.mapInArrow(blocks, "part int, block long, ids_before long, n_ids long, body binary").write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, encoded)


def read_id_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned 32-bit) from block files.

    Starts need the sum of ids of each part only: as many rows as the files were written in parts.
    """
    files = spark.read.schema("part int, block long, ids_before long, n_ids long, body binary").parquet(f"{path}/blocks")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").collect()[0][0])  # as many ids as the vocabulary has at most

    def decode(part):
        out = {k: [] for k in ("part", "doc_id", "start", "n_tokens", "ids")}
        for p, before, body in zip(part["part"].to_pylist(), part["ids_before"].to_pylist(), part["body"].to_pylist()):
            doc_ids, sizes, ids = read_block(body, dictionary)
            ends = np.cumsum(sizes, dtype="int64")
            raw = ids.astype("<u4").tobytes()
            out["part"] += [p] * len(doc_ids)
            out["doc_id"] += [None if d == NULL_ID else d for d in doc_ids.tolist()]
            out["start"] += (before + ends - sizes).tolist()
            out["n_tokens"] += sizes.tolist()
            out["ids"] += [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
        return out

    def make():
        return decode

    rows = map_rows_one(files.select("part", "ids_before", "body"), make, "part int, doc_id long, start long, n_tokens long, ids binary")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def map_rows_one(df: DataFrame, make, schema: str) -> DataFrame:
    """map_rows with a block at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = make()
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_pydict(each(part), schema=target)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids.

    Null texts count as empty: end_id alone. Texts of any length are encoded whole; one text's ids lie in one block. A null id
    sorts first and comes back as null. Rows of one id, repeated ones too, each keep their row and come in some fixed order.
    An empty table gives empty files and an empty result; other columns are not read.
    """
    path = path or new_path(docs.sparkSession, "id-files")
    write_id_files(docs, tokenizer, path, end_id=end_id)
    return read_id_files(docs.sparkSession, path)
