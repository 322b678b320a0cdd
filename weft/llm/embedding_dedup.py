"""Near-duplicate embeddings: sorted projection passes with bounded windows, the rest by tiles, components.

In each pass vectors are ordered by label and the concatenated values of random cross-polytope hashes (which signed axis of a
random rotation a vector lies nearest to), so near vectors share long prefixes. Each vector is compared with the next WINDOW
vectors in that order, within the task that sorted them; what travels is the vector in 16 bits a number, whose error is known,
so that a pair counts as near only if it is so for certain. Verified pairs of all passes are united.
Windows miss pairs that no pass brings close, so all pairs of vectors of equal label and dimension are then compared: pairs of
tiles, of bounded size each, emit exact counts and spanning links. Components are those of the links of both, so no link is
lost. The work of this step grows with the square of a label's count of distinct vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import binary, remove, slices, stage
from .simhash import groups_of

PASSES, HASHES, WINDOW = 6, 3, 128
#: Dimensions that hashes look at: vectors of more are projected to so many. A value of a hash takes HASH_BITS bits.
HASH_SIZE, HASH_BITS = 512, 10
STEP, TILE = 512, 512
#: A label has at least SPLIT tiles where they keep TILE rows, so that tasks share it; beyond that tiles grow to TILE_VALUES numbers, so that fewer copies are made.
SPLIT, TILE_VALUES = 3, 1 << 19


def usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which vectors can be linked: not null or empty, finite, not zero; how many numbers each of those has; their numbers)"""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype("int64")
    flat = vectors.flatten()
    flat = (flat if flat.type == pa.float32() else flat.cast(pa.float64())).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    keep = sizes > 0
    keep[keep] = np.logical_and.reduceat(np.isfinite(flat), starts[keep]) & np.logical_or.reduceat(flat != 0, starts[keep]) if keep.any() else False
    return keep, sizes[keep], flat[np.repeat(keep, sizes)]


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(size: int, number: int) -> np.ndarray:
    """A random rotation, or projection to HASH_SIZE dimensions; made once a worker."""
    if (size, number) not in _ROTATIONS:
        normal = np.random.default_rng([size, number]).normal(size=(size, min(size, HASH_SIZE)))
        _ROTATIONS[size, number] = np.linalg.qr(normal)[0].astype("f4")
    return _ROTATIONS[size, number]


def unit(a: np.ndarray) -> np.ndarray:
    scaled = a / np.abs(a).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def pass_keys(vectors: np.ndarray, passes: int, hashes: int) -> np.ndarray:
    """One key a vector and pass: the values of its hashes, the first the highest."""
    vectors = vectors.astype("f4")
    keys = np.zeros((len(vectors), passes), "int64")
    for p in range(passes):
        for h in range(hashes):
            turned = vectors @ rotation(vectors.shape[1], p * hashes + h)
            axis = np.abs(turned).argmax(1)
            keys[:, p] = keys[:, p] << HASH_BITS | (2 * axis + (turned[np.arange(len(axis)), axis] < 0))
    return keys


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Vectors of equal size, stored in `wide` bytes a number, as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), f"<f{wide}").reshape(len(column), -1).astype(float)


def coded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in 16 bits a number: (numbers, their unit, the length of what rounding took away)."""
    unit_of = np.abs(units).max(1) / 32767
    numbers = np.rint(units / unit_of[:, None]).astype("<i2")
    return numbers, unit_of, np.linalg.norm(units - numbers * unit_of[:, None], axis=1)


def roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the pairs of positions (a, b) join."""
    up = list(range(len(nodes)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    root = np.asarray([find(i) for i in range(len(nodes))])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_block(u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors reach threshold in double precision; single precision decides those beyond its error."""
    margin = (u.shape[1] + 8) * 2.0**-23
    about = u.astype("f4") @ v.astype("f4").T
    near = about >= threshold + margin
    i, j = np.nonzero((about >= threshold - margin) & ~near)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        near[a, b] = np.einsum("ij,ij->i", u[a], v[b]) >= threshold
    return near


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) positions, columns counted after rows, that join what near joins; never more than rows and columns."""
    rows, columns = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
    some = near[np.ix_(rows, columns)]
    places = np.concatenate([rows, columns + len(near)])
    root = np.arange(len(places))
    while len(places):
        was = root.copy()
        up, down = root[: len(rows)], root[len(rows) :]
        np.minimum(up, np.where(some, down[None, :], len(places)).min(1), out=up)
        np.minimum(down, np.where(some, up[:, None], len(places)).min(0), out=down)
        if (root == was).all():
            break
    return places, places[root]


def distinct_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, digest) of the rows that can be linked, and (node, label, digest, least, copies, size, wide, vector) of their distinct vectors by label."""
    base = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[label_col].cast("string").alias("label"), embeddings[vector_col].alias("v"))

    def pack(batches):
        for part in slices(batches, 4096):
            keep, sizes, flat = usable(part["v"])
            where = pa.array(np.nonzero(keep)[0])
            if len(where):
                wide = pa.array(np.full(len(where), flat.itemsize, "int32"))
                yield pa.RecordBatch.from_arrays([part["vec_id"].take(where), part["label"].take(where), pa.array(sizes.astype("int32")), wide, binary(flat.view("u1"), sizes * flat.itemsize)], names=["vec_id", "label", "size", "wide", "vector"])

    packed = base.where("label is not null").mapInArrow(pack, "vec_id long, label string, size int, wide int, vector binary").withColumn("digest", F.unhex(F.sha2("vector", 256)))
    # equal vectors of a label meet by digest, first within map tasks
    groups = packed.groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("wide").alias("wide"), F.any_value("vector").alias("vector"))
    return packed.select("vec_id", "label", "digest"), stage(groups.withColumn("node", F.monotonically_increasing_id()), "distinct")


def window_links(vectors: DataFrame, threshold: float, passes: int = PASSES, hashes: int = HASHES, window: int = WINDOW) -> DataFrame:
    """Links (u, v) between nodes that a pass brings within a window of each other, as far as they join more than others do.

    Windows end where a task's part of the order does.
    """

    def place(batches):
        for part in slices(batches, 4096):
            size, wide = part["size"].to_numpy(), int(part["wide"][0].as_py())
            for n in np.unique(size):
                some = part.take(pa.array(np.nonzero(size == n)[0]))
                units = unit(matrix(some["vector"], wide))
                keys, (numbers, unit_of, gone) = pass_keys(units, passes, hashes), coded(units)
                code = binary(numbers.view("u1"), np.full(len(units), 2 * n))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), p, "int32")), some["label"], some["size"], pa.array(keys[:, p]), some["node"], pa.array(unit_of), pa.array(gone), code], names=["pass", "label", "size", "key", "node", "unit", "gone", "code"])

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            yield from near(held)
            held = held.slice(max(0, held.num_rows - window))  # compared with what comes next

    def near(rows):
        size, group, node = (rows[c].to_numpy() for c in ("size", "group", "node"))
        unit_of, gone = rows["unit"].to_numpy(), rows["gone"].to_numpy()
        cuts = np.concatenate([[0], np.nonzero(np.diff(size))[0] + 1, [len(size)]]).tolist()
        left, right = [], []
        for start, end in zip(cuts[:-1], cuts[1:]):
            units = np.frombuffer(b"".join(rows["code"].slice(start, end - start).to_pylist()), "<i2").reshape(end - start, -1).astype("f4") * unit_of[start:end, None].astype("f4")
            g, lost = group[start:end], gone[start:end]
            sure = threshold + (units.shape[1] + 16) * 2.0**-23
            for at in range(0, end - start, STEP):
                a, b = slice(at, at + STEP), slice(at, at + STEP + window)
                ahead = np.arange(len(g[b]))[None, :] - np.arange(len(g[a]))[:, None]
                i, j = np.nonzero((units[a] @ units[b].T >= sure + lost[a, None] + 1.01 * lost[None, b]) & (ahead > 0) & (ahead <= window) & (g[a, None] == g[None, b]))
                left.append(start + at + i)
                right.append(start + at + j)
        u, v = roots(node, np.concatenate(left), np.concatenate(right))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "size", "key", "node"]
    placed = vectors.select("node", "label", "size", "wide", "vector").mapInArrow(place, "pass int, label string, size int, key long, node long, unit double, gone double, code binary")
    in_order = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return in_order.select("size", F.xxhash64("pass", "label", "size").alias("group"), "node", "unit", "gone", "code").mapInArrow(compare, "u long, v long")


def tile_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs of equal label and size by pairs of tiles: links (u, v, null) that span what they join, and (u, null, n) with counts of rows linked to u."""
    sizes = vectors.groupBy("label", "size").agg(F.count("*").alias("n"))
    rows_of_tile = F.least(F.greatest(F.col("n") / SPLIT, F.lit(TILE)), F.greatest(TILE_VALUES / F.col("size"), F.lit(TILE)))
    tiled = vectors.join(sizes, ["label", "size"]).withColumn("tiles", F.ceil(F.col("n") / rows_of_tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = tiled.select(F.xxhash64("label", "size", F.least("own", "other"), F.greatest("own", "other")).alias("group"), F.xxhash64("label", "size").alias("whole"), "own", "other", "node", "copies", "wide", "vector")

    def count(batches):
        for rows in groups_of(batches, "group"):
            for whole, low, high in set(zip(rows["whole"].tolist(), np.minimum(rows["own"], rows["other"]).tolist(), np.maximum(rows["own"], rows["other"]).tolist())):
                one = rows["whole"] == whole
                # between two tiles pairs across count, within one tile all
                at = [np.nonzero(one & (rows["own"] == a) & (rows["other"] == b))[0] for a, b in ([(low, high), (high, low)] if low < high else [(low, low)])]
                if not all(map(len, at)):
                    continue
                wide = int(rows["wide"][at[0][0]])
                units = [unit(np.frombuffer(b"".join(rows["vector"][i] for i in x), f"<f{wide}").reshape(len(x), -1).astype(float)) for x in at]
                copies, totals = [rows["copies"][x] for x in at], [np.zeros(len(x), "int64") for x in at]
                left, right = [], []
                for start in range(0, len(at[0]), TILE):
                    near = near_block(units[0][start : start + TILE], units[-1], threshold)
                    if low == high:
                        near[np.arange(len(near)), np.arange(start, start + len(near))] = False
                    totals[0][start : start + TILE] += near @ copies[-1]
                    if low < high:
                        totals[1] += copies[0][start : start + TILE] @ near
                    places, root = spanning(near)
                    node = np.concatenate([np.arange(start, start + len(near)), np.arange(len(at[-1])) + (len(at[0]) if low < high else 0)])
                    left.append(node[places])
                    right.append(node[root])
                ids, total = rows["node"][np.concatenate(at)], np.concatenate(totals)
                u, v = roots(ids, np.concatenate(left), np.concatenate(right))
                some = np.nonzero(total)[0]
                for a, b, n in ((u, pa.array(v), pa.nulls(len(u), pa.int64())), (ids[some], pa.nulls(len(some), pa.int64()), pa.array(total[some]))):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), b, n], names=["u", "v", "n"])

    return cells.repartition("group").sortWithinPartitions("group").mapInArrow(count, "u long, v long, n long")


def near_duplicates(embeddings: DataFrame, *, threshold: float = 0.93, passes: int = PASSES, hashes: int = HASHES, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Every row is a vector of its own, whatever its id: repeated rows link with each other, and unlike vectors of one id stay
    apart. Links join vectors of equal, non-null label and dimension whose cosine in double precision is threshold or more.
    Null and empty vectors, zero ones and those with null or non-finite components, and rows of null label, link with nothing:
    0 links, a component of their own. component_id is the smallest id of a component; a null id counts only where there is
    no other. Equal vectors are compared as one. An empty table gives an empty result; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows, vectors = distinct_vectors(embeddings, id_col, vector_col, label_col)
    compared = stage(tile_links(vectors, threshold), "compared")
    linked = connected_components(window_links(vectors, threshold, passes, hashes, window).union(compared.where("v is not null").select("u", "v")))
    counts = compared.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    nodes = vectors.select("node", "label", "digest", "least", "copies").join(counts, "node", "left").join(linked, "node", "left").select("label", "digest", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    nodes = stage(nodes, "nodes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stage(nodes.join(least, "component").select("label", "digest", "n_links", "component_id"), "found")
    for old in (vectors, compared, linked, nodes):
        remove(spark, old)
    alone = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[label_col].cast("string").alias("label"), embeddings[vector_col].alias("v"))
    alone = alone.where(F.col("label").isNull()).select("vec_id").union(unusable(alone.where(F.col("label").isNotNull())))
    joined = rows.join(found, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    result = joined.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return result.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))


def unusable(rows: DataFrame) -> DataFrame:
    """vec_id of the rows whose vector v links with nothing."""

    def rest(batches):
        for part in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([part["vec_id"].filter(pa.array(~usable(part["v"])[0]))], names=["vec_id"])

    return rows.select("vec_id", "v").mapInArrow(rest, "vec_id long")
