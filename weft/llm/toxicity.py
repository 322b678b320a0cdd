"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coder import Memo, split_words, text_slices
from .shared import keep_rows, map_rows, remove, slices, stage

BUCKETS = 1 << 22
#: Labelled rows of each class that the model learns from (expected size of a hash sample): the one bound on what is learned from.
SAMPLE_ROWS = 4000
#: What a term needs to get parameters: documents of the sample, and standard deviations from the rate of label 1, to either side,
#: among all of them or among those that hold a term which speaks for label 1 (so that a term which only matters beside such a one has a say).
LEAST_DOCS, LEAST_Z = 4, 3.5
FACTORS, EPOCHS, BATCH, RATE, SHRINK = 8, 30, 32, 0.1, 3e-4
EDGES = ".,;:!?\"'()[]{}*%$&#<>-_/\\|`~^+=@…«»„“”‘’¡¿"


def terms(word: str) -> tuple[int, ...]:
    """Buckets of a lower-cased word and, so that inflected forms share what they learn, of its first 4 and 5 letters."""
    import xxhash

    word = word.strip(EDGES)
    if not word:
        return ()
    found = [word] + [f"^{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(xxhash.xxh64_intdigest(t.encode()) % BUCKETS for t in found)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Machine:
    """bias + sum w_i + sum over pairs <v_i, v_j> of the terms that a text has; index maps buckets to parameters."""

    index: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, present: set[int]) -> float:
        if not present:
            return float(sigmoid(self.bias))
        at = sorted(present)
        v = self.v[at]
        total = v.sum(0)
        return float(sigmoid(self.bias + self.w[at].sum() + 0.5 * (total @ total - (v * v).sum())))


def fit(rows: list[tuple[int, np.ndarray]], weights: dict[int, float]) -> Machine:
    """rows: (label, distinct buckets), all of which get parameters; weights: of a row of each label, so that scores are calibrated to all labelled rows.

    Adaptive gradient steps over small batches; factors that the rows give no reason for shrink to nothing.
    """
    label = np.asarray([y for y, _ in rows], float)
    sizes = np.asarray([len(x) for _, x in rows], "int64")
    seen, place = np.unique(np.concatenate([np.zeros(0, "int64"), *(x for _, x in rows)]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    weight = np.asarray([weights[int(y)] for y in label]) if len(label) else np.zeros(0)
    prior = (weight * label).sum() / max(weight.sum(), 1e-9)
    bias = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(seen)), rng.normal(0, 0.01, (len(seen), FACTORS))
    gw, gv, gb = np.full(len(w), 1e-6), np.full(len(w), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for some in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            n, count = len(some), sizes[some]
            row = np.repeat(np.arange(n), count)
            term, at = np.unique(place[np.repeat(starts[some] - (np.cumsum(count) - count), count) + np.arange(len(row))], return_inverse=True)
            own, each = v[term], v[term][at]
            total = np.stack([np.bincount(row, each[:, k], n) for k in range(FACTORS)], 1)
            z = bias + np.bincount(row, w[term][at], n) + 0.5 * ((total * total).sum(1) - np.bincount(row, (each * each).sum(1), n))
            error = weight[some] * (sigmoid(z) - label[some]) / n
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
            dw = np.bincount(at, error[row], len(term))
            gw[term] += dw * dw
            w[term] -= RATE * dw / np.sqrt(gw[term])
            dv = np.stack([np.bincount(at, error[row] * (total[row, k] - each[:, k]), len(term)) for k in range(FACTORS)], 1)
            gv[term] += (dv * dv).mean(1)
            step = (RATE / np.sqrt(gv[term]))[:, None]
            moved = own - step * dv
            v[term] = moved * np.maximum(1 - step * SHRINK / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12), 0)
    return Machine({int(b): i for i, b in enumerate(seen)}, float(bias), w, v)


def tally(features: DataFrame, holding: np.ndarray | None = None) -> DataFrame:
    """(bucket, docs, hits: those of label 1) over rows of features, or over those with one of the buckets in holding; counted within tasks first."""
    held = None if holding is None else np.unique(holding).astype("<u4")

    def count(batches):
        for part in slices(batches):
            found = [np.frombuffer(b, "<u4") for b in part["buckets"].to_pylist()]
            some = [(y, b) for y, b in zip(part["label"].to_pylist(), found) if held is None or np.isin(b, held, assume_unique=True).any()]
            if some:
                seen, at = np.unique(np.concatenate([b for _, b in some]), return_inverse=True)
                label = np.repeat([y for y, _ in some], [len(b) for _, b in some])
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype("int64")), pa.array(np.bincount(at, minlength=len(seen))), pa.array(np.bincount(at, label, len(seen)).astype("int64"))], names=["bucket", "docs", "hits"])

    return features.mapInArrow(count, "bucket long, docs long, hits long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))


def telling(counts: DataFrame, rows: int, hits: int) -> dict[int, float]:
    """Buckets of LEAST_DOCS documents or more that lie LEAST_Z standard deviations or more from the rate hits / rows: how many, signed."""
    rate = hits / max(rows, 1)
    z = (F.col("hits") - F.col("docs") * rate) / F.sqrt(F.greatest(F.col("docs") * rate * (1 - rate), F.lit(1e-9)))
    found = counts.where(F.col("docs") >= LEAST_DOCS).select("bucket", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    return {r[0]: r[1] for r in found.toLocalIterator()}


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """Fit on a bounded hash sample of labelled documents (sample_rows a class, expected) where learn holds.

    The sample of labels is small by its bound, so it is broadcast and texts are not shuffled. Terms are counted and chosen on
    the executors; the driver gets the chosen terms of each row only. A document with several labels has label 1 if one of
    them is 1; rows of one doc_id are documents of their own with that label. Null labels, and labels without a document,
    teach nothing. None if no label is 1 or none is 0, so for empty tables. Other columns are not read.
    """
    spark = docs.sparkSession
    given = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    given = (given.where(learn) if learn is not None else given).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in given.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    parts = 1 << 40
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(parts))
    limit = {y: int(parts * min(1.0, sample_rows / n)) for y, n in counts.items()}
    sample = given.where(F.when(F.col("label") == 1, share < limit[1]).otherwise(share < limit[0]))

    def make():
        memo = Memo(terms, 200_000)

        def each(part):
            words = [set((t or "").lower().split()) for t in part["text"].to_pylist()]
            found = [np.asarray(sorted(set().union(*map(memo.__getitem__, w))), "<u4") for w in words]
            return {"label": part["label"], "buckets": [f.tobytes() for f in found]}

        return each

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("label", "text")
    features = stage(map_rows(texts, make, "label int, buckets binary", text_slices), "terms")
    found = {r[0]: r[1] for r in features.groupBy("label").count().collect()}
    if not found.get(0) or not found.get(1):
        return None
    alone = telling(tally(features), found[0] + found[1], found[1])
    toxic = np.asarray([b for b, z in alone.items() if z > 0], "int64")
    chosen = set(alone)
    if len(toxic):
        beside = stage(tally(features, toxic), "beside")
        of = {r[0]: r[1] for r in within(features, toxic).groupBy("label").count().collect()}
        chosen |= set(telling(beside, sum(of.values()), of.get(1, 0)))
        remove(spark, beside)
    rows = [(r[0], np.frombuffer(r[1], "<u4").astype("int64")) for r in within(features, np.asarray(sorted(chosen), "int64"), every=True).toLocalIterator()]
    remove(spark, features)
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    # rows of a class that was sampled count for those left out; scaled so that a row counts as 1 on average
    raw = {y: counts[y] / found[y] for y in (0, 1)}
    mean = sum(raw[y] for y, _ in rows) / len(rows)
    return fit(rows, {y: n / mean for y, n in raw.items()})


def within(features: DataFrame, buckets: np.ndarray, every: bool = False) -> DataFrame:
    """features with those of their buckets alone that are given, of rows that have one, or of every row."""
    chosen = np.unique(buckets).astype("<u4")

    def cut(batches):
        for part in slices(batches):
            found = [b[np.isin(b, chosen, assume_unique=True)] for b in (np.frombuffer(x, "<u4") for x in part["buckets"].to_pylist())]
            rows = [i for i, f in enumerate(found) if every or len(f)]
            yield pa.RecordBatch.from_arrays([part["label"].take(pa.array(rows, pa.int64())), pa.array([found[i].tobytes() for i in rows], pa.binary())], names=["label", "buckets"])

    return features.mapInArrow(cut, "label int, buckets binary")


def score(docs: DataFrame, machine: Machine | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) of each whole text, however long.

    Null and empty texts get the score of no terms. Repeated rows each get a row; an empty table gives an empty result; other
    columns are not read. Without a machine every score is 0.
    """

    def make():
        each = scorer(machine)

        def columns(part):
            out = each(part["text"])
            return {"doc_id": part["doc_id"], "score": out, "predicted": (out >= threshold).astype("int32")}

        return columns

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, "doc_id long, score double, predicted int", text_slices)


def keep_clean(docs: DataFrame, machine: Machine | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below threshold, all columns and repeated rows as they are, whatever their ids; all without a machine."""

    def make():
        each = scorer(machine)
        return lambda texts: each(texts) < threshold

    return keep_rows(docs, make, text_slices, text_col)


def scorer(machine: Machine | None):
    """Function of texts (Arrow) to scores; without a machine 0."""
    index = machine.index if machine else {}
    memo = Memo(lambda word: tuple(index[t] for t in terms(word) if t in index))

    def each(texts: pa.Array) -> np.ndarray:
        if not machine:
            return np.zeros(len(texts))
        places, offsets, words = split_words(pc.fill_null(texts, ""))
        known = list(map(memo.__getitem__, words))
        hits = np.nonzero(np.fromiter(map(bool, known), bool, len(known))[places])[0]
        present: list[set[int]] = [set() for _ in range(len(texts))]
        for doc, place in zip((np.searchsorted(offsets, hits, side="right") - 1).tolist(), places[hits].tolist()):
            present[doc].update(known[place])
        return np.asarray([machine.score(x) for x in present])

    return each
