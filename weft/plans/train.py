"""Training: samples with limits, measured choices, trees with a held-out part, clusters, chains and dictionaries for the holes of a graph."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as g
from . import search
from .route import fit_stumps

#: Samples that training learns from: number, bytes of each, bytes of all. Everything that comes to the driver follows from these.
MOST_SAMPLES, MOST_BYTES, MOST_TOTAL = 512, 1 << 20, 64 << 20
#: Steps and coders that the search puts together, and the prebuilt chains that it starts from.
SPACE = {"steps": ("delta", "zigzag", "range_pack", "divide_by"), "coders": ("store", "bitpack", "partition_bitpack", "zstd", "lz4", "transpose_split", "field_lz"), "longest": 4}


def limit_samples(samples: DataFrame, content: str, order: list[str], most: int = MOST_SAMPLES, most_bytes: int = MOST_BYTES, most_total: int = MOST_TOTAL) -> DataFrame:
    """The first samples in order that are not larger than most_bytes, `most` at most, as long as they are most_total bytes together."""
    return within_limits(samples, F.octet_length(content), order, most, most_bytes, most_total)


def within_limits(samples: DataFrame, size: Column, order: list[str], most: int = MOST_SAMPLES, most_bytes: int = MOST_BYTES, most_total: int = MOST_TOTAL) -> DataFrame:
    """limit_samples by sizes that are known before the contents are put together."""
    few = samples.where(size <= most_bytes).orderBy(*order).limit(most)
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over `most` rows
    return few.withColumn("_total", total).where(F.col("_total") <= most_total).drop("_total")


def measure(samples: DataFrame, graphs: list[g.Graph], keys: list[str]) -> DataFrame:
    """(keys, features, sizes: bytes of the frame by each graph, null where it fails) of numeric samples (kind, width, content); every graph in one pass."""

    def run(batches):
        for batch in batches:
            streams = [g.Stream(c or b"", k, w) for c, k, w in zip(*(batch[x].to_pylist() for x in ("content", "kind", "width")))]
            found = [g.features_of(s) if s.kind == "numeric" else None for s in streams]
            sizes = [[g.Context().measure(x, [s]) for x in graphs] for s in streams]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(found, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.int64()))], names=[*keys, "features", "sizes"])

    types = "".join(f"`{k}` {samples.schema[k].dataType.simpleString()}, " for k in keys)
    return samples.select(*keys, "kind", "width", "content").mapInArrow(run, types + "features array<double>, sizes array<long>")


def fit_selector(measured: DataFrame, keys: list[str], held_out: int = 5, rounds: int = 20) -> tuple[list, dict]:
    """(forests for g.select_numeric, report) from measure()'s rows; those whose keys hash to 0 modulo held_out are not learned from.

    report: samples and held_out, accuracy on the held-out ones, and their bytes by the choices, by the best and by the first.
    """
    rows = measured.select("features", "sizes", (F.pmod(F.xxhash64(*keys), F.lit(held_out)) == 0).alias("held")).collect()
    rows = [r for r in rows if r.features is not None and any(s is not None for s in r.sizes)]
    names = list(g.NUMERIC_CHOICES)
    best = [min((s, i) for i, s in enumerate(r.sizes) if s is not None)[1] for r in rows]
    learn = [([float(x) for x in r.features], names[b]) for r, b in zip(rows, best) if not r.held]
    forests = fit_stumps(learn, names, list(g.FEATURES), rounds=rounds).forests
    plain = [[[int(t[0]), *map(float, t[1:])] for t in forest] for forest in forests]

    def chosen(features: list[float]) -> int:
        return int(np.argmax([sum(t[2] if features[t[0]] < t[1] else t[3] for t in forest) for forest in plain]))

    test = [(r, b, chosen(r.features)) for r, b in zip(rows, best) if r.held]
    cost = lambda r, i: r.sizes[i] if r.sizes[i] is not None else max(s for s in r.sizes if s is not None)
    report = {"samples": len(rows), "held_out": len(test), "accuracy": float(np.mean([b == c for _, b, c in test])) if test else 1.0, "bytes": sum(cost(r, c) for r, _, c in test), "best_bytes": sum(cost(r, b) for r, b, _ in test), "first_bytes": sum(cost(r, 0) for r, _, _ in test)}
    return plain, report


def train_dictionary(contents: list[bytes], size: int = 8192) -> bytes:
    """A zstd dictionary from samples; the samples' own ends where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, contents).as_bytes()
    except zstandard.ZstdError:
        return b"".join(contents)[-size:]


# -- clusters ------------------------------------------------------------------------------------------------------------


def full_split(single: dict, pair: dict) -> list[list]:
    """Every stream on its own."""
    return [[c] for c in sorted(single)]


def bottom_up(single: dict, pair: dict) -> list[list]:
    """The two groups whose members save most on average by their pairs' costs are joined, as long as that is more than nothing."""
    groups = full_split(single, pair)

    def saved(a: list, b: list) -> float:
        each = [single[x] + single[y] - pair.get((x, y), pair.get((y, x), single[x] + single[y])) for x in a for y in b]
        return sum(each) / len(each)

    while len(groups) > 1:
        a, b = max(combinations(groups, 2), key=lambda ab: (saved(*ab), ab))
        if saved(a, b) <= 0:
            break
        groups = [x for x in groups if x not in (a, b)] + [sorted(a + b)]
    return sorted(groups)


def pair_costs(samples: DataFrame, ports: list[tuple[int, str, int]], keys: list[str]) -> tuple[dict, dict]:
    """Bytes of each port's streams alone and of each two of one kind and width joined, in one pass. ports: (port, kind, width)."""
    alike = [(a[0], b[0]) for a, b in combinations(ports, 2) if a[1:] == b[1:] and a[1] != "string"]
    rows = samples.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("port", F.struct("kind", "width", "content", "lengths")))).alias("by_port"))

    def run(batches):
        total = np.zeros(len(ports) + len(alike), "int64")
        graph, context = g.generic(), g.Context()
        for batch in batches:
            for held in batch["by_port"].to_pylist():
                found = {p: g.Stream(s["content"] or b"", s["kind"], s["width"], None if s["lengths"] is None else np.asarray(s["lengths"])) for p, s in held}
                for i, (port, *_) in enumerate(ports):
                    total[i] += context.measure(graph, [found[port]]) or 0
                for i, (a, b) in enumerate(alike):
                    total[len(ports) + i] += context.measure(graph, [g.Stream(found[a].content + found[b].content, found[a].kind, found[a].width)]) or 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "bytes"])

    sums = dict(rows.select("by_port").mapInArrow(run, "place long, bytes long").groupBy("place").agg(F.sum("bytes")).collect())
    return {p[0]: sums.get(i, 0) for i, p in enumerate(ports)}, {ab: sums.get(len(ports) + i, 0) for i, ab in enumerate(alike)}


# -- chains --------------------------------------------------------------------------------------------------------------


def chain_graph(chain: tuple[str, ...]) -> g.Graph:
    """Steps and a coder in the end as a graph."""
    *steps, coder = chain
    out = g.CHAINS[coder] if coder in ("transpose_split", "field_lz") else g.leaf(coder)
    for name in reversed(steps):
        out = g.step(name, out)
    return out


def search_space() -> list[tuple[str, ...]]:
    """The prebuilt chains that a search starts from."""
    return [(c,) for c in SPACE["coders"]] + [("delta", "zigzag", c) for c in SPACE["coders"]] + [("range_pack", c) for c in SPACE["coders"]]


def search_chains(samples: DataFrame, population: int = 40, generations: int = 20, seed: int = 0) -> list[tuple[tuple[str, ...], float, float]]:
    """(chain, bytes, steps) of the front of bytes and simplicity over samples; all new candidates of a generation are measured in one pass."""
    steps, ends = SPACE["steps"], SPACE["coders"]

    def cost(chains: list[tuple]) -> list[tuple[float, float]]:
        sizes = measure(samples, [chain_graph(c) for c in chains], []).select(F.posexplode("sizes").alias("i", "n"), F.lit(1).alias("one"))
        found = {r[0]: (r[1], r[2]) for r in sizes.groupBy("i").agg(F.sum("n"), F.count(F.when(F.col("n").isNull(), 1))).collect()}
        return [(float("inf") if found.get(i, (0, 0))[1] else float(found.get(i, (0, 0))[0] or 0), float(len(c))) for i, c in enumerate(chains)]

    def mutate(chain: tuple, rng) -> tuple:
        kind = rng.integers(3)
        if kind == 0:
            return (*chain[:-1], ends[rng.integers(len(ends))])
        if kind == 1 and len(chain) > 1:
            at = rng.integers(len(chain) - 1)
            return chain[:at] + chain[at + 1 :]
        return (steps[rng.integers(len(steps))], *chain)[-SPACE["longest"] :]

    def cross(a: tuple, b: tuple, rng) -> tuple:
        return (*a[: rng.integers(len(a))], *b[rng.integers(len(b)) :])[-SPACE["longest"] :]

    own = samples.storageLevel == StorageLevel.NONE
    samples = samples.persist() if own else samples  # bounded by the limits; each generation measures them anew
    try:
        front = search.genetic(search_space(), cost, mutate, cross, population=population, generations=generations, seed=seed)
    finally:
        if own:
            samples.unpersist()
    return sorted((c, float(k[0]), float(k[1])) for c, k in front)


# -- all of it -----------------------------------------------------------------------------------------------------------


def train(df: DataFrame, graph: g.Graph, inputs: list[g.Input], keys: list[str], *, trainer: Callable = search.greedy_clusters, most: int = MOST_SAMPLES, population: int = 12, generations: int = 4) -> tuple[g.Graph, dict]:
    """(graph with its holes filled, report), in this order: `cluster`, `chain`, `select`, `dictionary`, each only if the graph has it.

    Samples are what reaches a hole while the graph runs over the first rows (limit_samples). A graph without a hole is an error.
    """
    holes = [n.hole for n in graph.nodes() if n.hole]
    known = ("cluster", "chain", "select", "dictionary")
    if not set(holes) & set(known):
        raise ValueError("nothing to train in this graph")
    few, report = limit_samples(df.select(*keys, *dict.fromkeys(c for i in inputs for c in (i.column, i.lengths) if c)), inputs[0].column, keys, most=most), {}
    for name in known:
        if name not in holes:
            continue
        samples = g.collect_samples(few, graph, inputs, keys).where(F.col("hole") == name).persist()  # bounded by the limits
        if name == "cluster":
            ports = [tuple(r) for r in samples.select("port", "kind", "width").distinct().orderBy("port").collect()]
            groups = trainer(*pair_costs(samples, ports, keys))
            graph, report[name] = graph.put(name, g.build("clustered", clusters=[list(map(int, c)) for c in groups if len(c) > 1])), groups
        elif name == "chain":
            front = search_chains(samples, population, generations)
            best = min(front, key=lambda x: (x[1], x[2]))
            graph, report[name] = graph.put(name, chain_graph(best[0])), front
        elif name == "select":
            forests, report[name] = fit_selector(measure(samples, [g.CHAINS[c] for c in g.NUMERIC_CHOICES], keys), keys)
            graph = graph.put(name, g.select_numeric(forests))
        else:
            contents = [bytes(r[0]) for r in samples.select("content").toLocalIterator()]
            dictionary = train_dictionary(contents)
            graph, report[name] = graph.put(name, g.leaf("zstd", dictionary=dictionary)), {g.dictionary_id(dictionary): dictionary}
        samples.unpersist()
    return graph, report
