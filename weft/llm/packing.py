"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coder import LibraryCoder, text_slices
from .shared import binary, map_rows, stage, text_or_empty

#: Pieces that one bucket of a length holds at most, about; bounds what one task ranks.
BUCKET_ROWS = 50_000


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each document, append end_id and cut at multiples of capacity.

    doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens. Null texts count as empty: one piece with end_id alone.
    """

    def make():
        coder = LibraryCoder(tokenizer)

        def each(part):
            ids, count = coder.encode(part["text"])
            ids = np.insert(ids, np.cumsum(count), end_id)
            count = count + 1
            pieces = -(-count // capacity)
            doc = np.repeat(np.arange(len(count)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, count[doc] - start)
            return {"doc_id": part["doc_id"].take(pa.array(doc)), "start": start, "length": length, "ids": binary(ids, length * 4), "doc_tokens": count[doc]}

        return each

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")), make, "doc_id long, start long, length long, ids binary, doc_tokens long", text_slices)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: lengths from the longest on go to the packs that are shortest so far, whole counts at a time.

    A pack that is reached takes as many pieces of that length as fit before the next shortest one has its turn, so that counts
    are handled whole: packs of one pattern stay together, and the number of patterns stays small.
    Returns (pattern of lengths, number of sequences with it). Work and result depend on the number of lengths, not of documents.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # used length -> pattern -> count
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, grown = histogram[length], []
        for used in sorted(x for x in open_packs if x + length <= capacity):
            while left and open_packs[used]:
                pattern, n = open_packs[used].popitem()
                # as many of this length as fit go to each of these packs at once
                times = max(1, min((capacity - used) // length, left // n)) if left >= n else 1
                took = min(n, left // times)
                if took < n:
                    open_packs[used][pattern] = n - took
                grown.append((used + length * times, pattern + (length,) * times, took))
                left -= took * times
            if not open_packs[used]:
                del open_packs[used]
            if not left:
                break
        if left:
            times = capacity // length
            if left >= times:
                grown.append((length * times, (length,) * times, left // times))
            if left % times:
                grown.append((length * (left % times), (length,) * (left % times), 1))
        for used, pattern, n in grown:
            open_packs[used][pattern] = open_packs[used].get(pattern, 0) + n
    return sorted(((p, n) for packs in open_packs.values() for p, n in packs.items()), reverse=True)


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of each pattern: the length, the first rank of that length that it takes, the first sequence, the offset."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, seen[length], sequence, offset))
            seen[length] += n
            offset += length
        sequence += n
    rows.sort()
    table = np.asarray(rows, "int64").reshape(-1, 4)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def pack(pieces: DataFrame, *, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to pieces (any frame with a length column of 1 to capacity and the keys; columns of these two names are replaced).

    The histogram of lengths, at most capacity rows, goes to the driver. The rank of a piece among those of its length is the
    number of such pieces in earlier hash buckets of the keys plus the rank within its bucket, so that a length that most
    pieces share is still ranked by many tasks. Rows are staged with a number that goes into the hash, so pieces of equal keys
    (null ids, repeated rows) are dealt over buckets too; each gets a place of its own. Empty input, empty result.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = stage(pieces.select(*kept).withColumn("_pack_row", F.monotonically_increasing_id()), "pieces")
    total = pieces.count()
    buckets = max(64, -(-total // BUCKET_ROWS))
    hashed = pieces.withColumn("_pack_bucket", F.pmod(F.xxhash64(*keys, "_pack_row"), F.lit(buckets)))
    counts = stage(hashed.groupBy("length", "_pack_bucket").agg(F.count("*").alias("_pack_n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_pack_n")).collect()}
    slots = slots_of(pack_histogram(histogram, capacity))
    earlier = counts.select("length", "_pack_bucket", (F.sum("_pack_n").over(Window.partitionBy("length").orderBy("_pack_bucket")) - F.col("_pack_n")).alias("_pack_before"))
    ranked = hashed.join(earlier.hint("merge"), ["length", "_pack_bucket"]).withColumn("_pack_rank", F.col("_pack_before") + F.row_number().over(Window.partitionBy("length", "_pack_bucket").orderBy(*keys, "_pack_row")) - 1)
    wide = 1 << 40  # above any rank
    start = slots["length"] * wide + slots["rank"]

    def make():
        def each(part):
            length, rank = (part[c].to_numpy(zero_copy_only=False).astype("int64") for c in ("length", "_pack_rank"))
            at = np.searchsorted(start, length * wide + rank, side="right") - 1
            return {c: part[c] for c in kept} | {"sequence_id": pa.array(slots["sequence"][at] + rank - slots["rank"][at]), "offset": pa.array(slots["offset"][at])}

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*kept).schema) + ", sequence_id long, offset long"
    return map_rows(ranked.select(*kept, "_pack_rank"), make, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Whole documents to places in sequences: doc_id, start, length, ids (or ids_crc32 if not with_ids), doc_tokens, sequence_id, offset.

    Null texts count as empty, texts of any length are cut into pieces, repeated rows each have pieces of their own, an empty
    table gives an empty result, other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    if not with_ids:
        pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, capacity=capacity)
