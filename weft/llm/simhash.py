"""SimHash fingerprints, and links between near fingerprints through a covering code of anchors.

The 64 bits are cut into blocks; fingerprints that differ in at most `threshold` bits differ in at most threshold // blocks
bits of one of them. For a block the anchors are the words of the direct sum of the perfect [15, 11] Hamming code and the
whole space on its other bits: every block lies within 1 (the covering radius) of an anchor. Each fingerprint is at home at
its nearest anchor and a guest at every anchor within radius + share of the threshold. If x and y are near, they are so in
some block, and y is a guest where x is at home: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coder import text_slices
from .components import connected_components
from .shared import map_rows, remove, stage, text_or_empty

SEED, SHINGLE = 42, 4
CODE_BITS, RADIUS = 15, 1
#: Rows that one anchor compares in one group; larger anchors are cut into tiles, and all pairs of tiles are compared.
TILE_ROWS = 2048


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Bit i is 1 if it is in over half the XXH64 values of the word shingles, repeats counted; 0 for a text with no word."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), "int64", len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    ones = np.zeros(64, "int64")
    for at in range(0, n, 1 << 14):
        hashes = np.asarray([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each whole text; null texts count as empty and have fp 0."""

    def make():
        return lambda part: {"doc_id": part["doc_id"], "fp": [fingerprint(t, words) for t in part["text"].to_pylist()]}

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")), make, "doc_id long, fp long", text_slices)


def error_masks(bits: int, reach: int) -> list[list[int]]:
    """For each syndrome of the Hamming code on the low 15 of `bits` bits: the errors of weight up to reach that lead to an anchor, the nearest first."""
    from itertools import combinations

    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < CODE_BITS else 0
            found[syndrome].append(sum(1 << p for p in places))
    return [sorted(x, key=lambda m: (m.bit_count(), m)) for x in found]


def anchors(fp: Column, threshold: int) -> Column:
    """Array of (key, home) structs: the anchors that a fingerprint goes to; key holds the block and the anchor."""
    count = 3 if threshold >= 2 else 2
    sizes = [64 // count + (i >= count - 64 % count) for i in range(count)]
    arrays, low = [], 0
    for i, bits in enumerate(sizes):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        syndrome = sum(((F.bit_count(part.bitwiseAND(F.lit(sum(1 << p for p in range(CODE_BITS) if (p + 1) >> k & 1)).cast("long"))) % 2) * (1 << k) for k in range(4)), F.lit(0))
        masks = error_masks(bits, RADIUS + threshold // count)
        # the nearest anchor comes first: an error of weight 0, or of weight 1 within the code's bits
        masks = [sorted(x, key=lambda m: (m >> CODE_BITS != 0, m.bit_count(), m)) for x in masks]
        table = F.array(*[F.array(*[F.lit(m).cast("long") for m in x]) for x in masks])
        arrays.append(F.transform(F.element_at(table, (syndrome + 1).cast("int")), _placed(part, i)))
        low += bits
    return F.concat(*arrays)


def _placed(part: Column, block: int):
    return lambda mask, at: F.struct((part.bitwiseXOR(mask) * 4 + block).alias("key"), (at == 0).alias("home"))


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal keys in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = batch.slice(a, b - a)
            if held and held[0][key][0].as_py() != int(keys[a]):
                yield joined(held)
                held = []
            held.append(part)
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c].to_numpy(zero_copy_only=False) for p in parts]) for c in parts[0].schema.names}


def spanning(home: np.ndarray, guest: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join all of home and guest that links within threshold bits join; never more than there are nodes."""
    nodes, where = np.unique(np.concatenate([home, guest]), return_inverse=True)
    h, g = where[: len(home)], where[len(home) :]
    near = np.bitwise_count(home.view("u8")[:, None] ^ guest.view("u8")[None, :]) <= threshold
    if near.sum() <= len(home):  # each with itself alone
        return nodes[:0], nodes[:0]
    root = np.arange(len(nodes), dtype="int32")
    while True:
        was = root.copy()
        np.minimum.at(root, h, np.where(near, root[g][None, :], len(nodes)).min(1).astype("int32"))
        np.minimum.at(root, g, np.where(near, root[h][:, None], len(nodes)).min(0).astype("int32"))
        root = root[root]
        if (root == was).all():
            break
    linked = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[root[linked]]


def near_links(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """distinct (fp) to links (u, v) whose components are those of all pairs within threshold bits."""
    placed = distinct.select("fp", F.explode(anchors(F.col("fp"), threshold)).alias("a")).select("fp", F.col("a.key").alias("key"), F.col("a.home").alias("home"))
    large = placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS).select("key", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("tiles"))
    tiled = placed.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("cell", F.least("own", "other") * F.col("tiles") + F.greatest("own", "other"))
    # one value for anchor and pair of tiles: runs of it are the groups
    keyed = tiled.select(F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("group"), "key", "cell", "fp", "home")

    def compare(batches):
        for rows in groups_of(batches, "group"):
            if len(rows["fp"]) < 2:
                continue
            same = (rows["key"] == rows["key"][0]) & (rows["cell"] == rows["cell"][0])
            for part in [rows] if same.all() else [{c: v[(rows["key"] == k) & (rows["cell"] == t)] for c, v in rows.items()} for k, t in set(zip(rows["key"].tolist(), rows["cell"].tolist()))]:
                home = part["fp"][part["home"].astype(bool)]
                if len(home):
                    u, v = spanning(home, part["fp"], threshold)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return keyed.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, threshold: int = 4, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that links of at most threshold bits reach).

    Documents of equal fingerprint meet first, within map tasks, so copies cost one row each. Null and empty texts, and those
    of white space, have fingerprint 0 and are linked like others. Fewer words than a shingle: the whole sequence is one.
    Repeated rows each get a row. A null id never becomes a component_id unless the group has no other. Texts of any length are
    fingerprinted whole. An empty table gives an empty result; other columns are not read.
    """
    found = stage(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = connected_components(near_links(distinct.select("fp"), threshold))
    grouped = stage(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "grouped")
    least = stage(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    of_fp = stage(grouped.join(least, "component").select("fp", "component_id"), "components")
    for old in (linked, grouped, least, distinct):
        remove(docs.sparkSession, old)
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_firsts(docs: DataFrame, *, threshold: int = 4, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, all columns as they are: that of the smallest id, then of the smallest SHA-256 of its text.

    Rows count as documents of their own whatever their ids, so null and repeated ids are kept where their texts differ; a null
    id comes after all others. Rows are staged with a number, by which the chosen ones are
    found again. Of repeated rows one stays. An empty table gives an empty result; the name _row is taken.
    """
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("_row", rows[id_col].cast("long").alias("doc_id"), text_or_empty(rows, text_col).alias("text"))

    def make():
        return lambda part: {"_row": part["_row"], "doc_id": part["doc_id"], "digest": [sha256(t.encode()).digest() for t in part["text"].to_pylist()], "fp": [fingerprint(t, words) for t in part["text"].to_pylist()]}

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "_row"))
    distinct = stage(map_rows(texts, make, "_row long, doc_id long, digest binary, fp long", text_slices).groupBy("fp").agg(first.alias("first")), "distinct")
    linked = connected_components(near_links(distinct.select("fp"), threshold))
    grouped = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("first.*", F.coalesce("component", "fp").alias("component"))
    chosen = stage(grouped.groupBy("component").agg(first.alias("first")).select("first._row"), "chosen")
    for old in (linked, distinct):
        remove(docs.sparkSession, old)
    # merged at every size: whether what was chosen could be broadcast depends on how many documents there are
    return rows.join(chosen.hint("merge"), "_row", "left_semi").select(*docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
