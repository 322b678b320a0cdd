"""Language identification: interpolated Kneser-Ney character models, in sorted hash arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coder import split_words, sums, text_slices
from .shared import keep_rows, map_rows, remove, stage

ORDER = 4
#: Documents of each language that the model learns from, and that rejection is calibrated on (expected size of a hash sample).
SAMPLE_DOCS, CALIBRATION_DOCS = 300, 150
#: A text is rejected from REJECT_MARGIN bits a character above what REJECT_SHARE of the calibration documents of its language cost at most.
REJECT_SHARE, REJECT_MARGIN = 0.98, 2.5
#: Sharpness of the score: odds of two languages double for each 1 / SHARPNESS bits a character between them.
SHARPNESS = 8.0
DISCOUNT = 0.75
LETTER = r"\p{L}"
MIX = np.uint64(0x9E3779B97F4A7C15)
UND = "und"


#: A run of letters, with the marks that belong to them.
RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letter_runs(word: str) -> list[str]:
    """What is scored of a lower-cased word: all of its letters, in runs."""
    return [word] if word.isalpha() else RUNS.findall(word)


def padded(word: str) -> str:
    return f" {word} "


def gram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """h[k][i]: hash of the k + 1 characters that end at i; those that would start before the array hash what there is."""
    out, h = [], np.zeros(len(chars), "u8")
    with np.errstate(over="ignore"):
        weight = np.uint64(1)
        for k in range(order):
            shifted = np.concatenate([np.zeros(min(k, len(chars)), "u8"), chars[: max(0, len(chars) - k)]]) + np.uint64(1)
            weight = weight * MIX
            h = h + shifted * weight * (shifted + np.uint64(k + 1) * MIX)
            x = h ^ (h >> np.uint64(29))
            out.append(x * np.uint64(0xBF58476D1CE4E5B9))
    return out


@dataclass
class CharModels:
    """For k = 1 to ORDER: sorted hashes of grams with a row of discounted probabilities a language; of contexts with back-off weights."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    limits: np.ndarray | None = None

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, one row a word."""
        texts = [padded(w) for w in words]
        sizes = np.fromiter(map(len, texts), "int64", len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(starts, sizes)
        hashes = gram_hashes(chars, ORDER)
        p = np.full((len(chars), len(self.langs)), self.floor)
        for k in range(ORDER):
            ok = place >= k  # the gram lies within its word
            if k:
                keys, gamma = self.contexts[k]
                at = np.minimum(np.searchsorted(keys, before := np.concatenate([[np.uint64(0)], hashes[k - 1][:-1]])), len(keys) - 1)
                known = ok & (keys[at] == before)
                p[known] *= gamma[at[known]]
            else:
                p *= self.contexts[0][1][0]
            keys, alpha = self.grams[k]
            at = np.minimum(np.searchsorted(keys, hashes[k]), len(keys) - 1)
            known = ok & (keys[at] == hashes[k])
            p[known] += alpha[at[known]]
        bits = -np.log2(p)
        bits[starts] = 0  # the blank before a word is given
        return np.add.reduceat(bits, starts, axis=0)


def count_grams(word: str, n: int, into: Counter) -> None:
    """Grams of the full order, and shorter ones at the start of the word, which have no longer history."""
    for run in letter_runs(word):
        text = padded(run)
        for i in range(1, len(text)):
            into[text[max(0, i - ORDER + 1) : i + 1]] += n


def fit_models(counts: Iterable[tuple[str, str, int]]) -> CharModels:
    """counts: (language, gram, n) with grams of ORDER characters, or fewer that start a word."""
    by_lang: dict[str, Counter] = defaultdict(Counter)
    for lang, gram, n in counts:
        by_lang[lang][gram] += n
    langs = sorted(by_lang)
    chars = {c for grams in by_lang.values() for g in grams for c in g}
    floor = 1.0 / (len(chars) + 256)
    alphas: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
    gammas: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
    for j, lang in enumerate(langs):
        level = Counter(by_lang[lang])
        for k in range(ORDER - 1, -1, -1):
            here = {g: n for g, n in level.items() if len(g) == k + 1}
            totals, kinds = Counter(), Counter()
            for g, n in here.items():
                totals[g[:-1]] += n
                kinds[g[:-1]] += 1
            for g, n in here.items():
                alphas[k][g][j] = max(n - DISCOUNT, 0) / totals[g[:-1]]
            for context, n in totals.items():
                gammas[k][context][j] = DISCOUNT * kinds[context] / n
            # continuation counts: in how many contexts a shorter gram was seen; grams at a word's start keep their own counts
            level = Counter({g: n for g, n in level.items() if len(g) <= k})
            for g in here:
                level[g[1:]] += 1

    def arrays(rows: dict[str, dict[int, float]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(rows)
        values = np.full((max(1, len(names)), len(langs)), missing)
        for i, g in enumerate(names):
            for j, v in rows[g].items():
                values[i, j] = v
        if not names or not names[0] and len(names) == 1:
            return np.zeros(1, "u8"), values
        keys = np.asarray([gram_hashes(np.frombuffer(g.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8"), len(g))[-1][-1] for g in names], "u8")
        order = np.argsort(keys)
        return keys[order], values[order]

    return CharModels(langs, [arrays(a, 0.0) for a in alphas], [arrays(g, 1.0) for g in gammas], floor)


class Scorer:
    """Cross-entropy of whole texts in bits a character under each language; bits of words are remembered."""

    def __init__(self, models: CharModels, entries: int = 300_000):
        self.models, self.entries = models, entries
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.bits = np.zeros((0, len(self.models.langs) + 1))

    def score(self, texts: pa.Array) -> np.ndarray:
        places, offsets, words = split_words(texts)
        if len(self.index) > self.entries:
            self.reset()
        fresh = [w for w in words if w not in self.index]
        if fresh:
            rows = [np.zeros((0, self.bits.shape[1]))] + [self.rows(list(map(letter_runs, fresh[i : i + 20_000]))) for i in range(0, len(fresh), 20_000)]
            self.index.update(zip(fresh, range(len(self.bits), len(self.bits) + len(fresh))))
            self.bits = np.concatenate([self.bits, *rows])
        rows = self.bits[np.fromiter(map(self.index.__getitem__, words), "int64", len(words))][places]
        out = np.column_stack([sums(rows[:, j], offsets) for j in range(rows.shape[1])])
        return out[:, :-1] / np.maximum(out[:, -1:], 1)

    def rows(self, runs: list[list[str]]) -> np.ndarray:
        """Bits under each language and characters of the runs of each word."""
        flat = [r for some in runs for r in some]
        bits = np.column_stack([self.models.word_bits(flat), [len(r) + 1 for r in flat]]) if flat else np.zeros((0, len(self.models.langs) + 1))
        ends = np.cumsum([len(some) for some in runs])
        return np.column_stack([sums(bits[:, j], np.concatenate([[0], ends])) for j in range(bits.shape[1])])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> CharModels | None:
    """Fit on a bounded hash sample (sample_docs documents a language) of rows where learn holds and text and language are given.

    One scan counts languages, one draws the samples, by a hash of doc_id: a fixed choice that needs no sort and no shuffle of
    texts. Counts of grams are gathered on the executors; the driver gets those of the sample only. Rejection is calibrated on
    documents that the models did not learn from (calibration_docs a language, a quarter of the hash's range). Repeated rows
    count as often as they come; other columns are not read. None if there is nothing to learn from, as in an empty table.
    """
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where(F.col("lang").isNotNull())
    given = given.where(learn) if learn is not None else given
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(4)) == 0
    counts = {(r[0], r[1]): r[2] for r in given.groupBy("lang", held.alias("held")).count().collect()}
    parts = 1 << 40
    share, keep = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(parts)), F.lit(False)
    for (lang, of_held), n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == F.lit(lang)) & (held == F.lit(of_held)) & (share < int(parts * min(1.0, (calibration_docs if of_held else sample_docs) / n))))
    sample = stage(given.where(keep & F.col("text").isNotNull()).withColumn("held", held), "language-sample")

    def grams(batches):
        for part in text_slices(batches):
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist()):
                words[lang].update(text.lower().split())
            for lang, seen in words.items():
                found: Counter = Counter()
                for word, n in seen.items():
                    count_grams(word, n, found)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": list(found), "n": list(found.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    found = sample.where("not held").select("text", "lang").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        remove(docs.sparkSession, sample)
        return None
    models = fit_models(found.itertuples(index=False))
    checked = predict(sample.where("held"), models).where("score > 0")
    usual = {r[0]: r[1] for r in checked.groupBy("lang_pred").agg(F.percentile("bits", F.lit(REJECT_SHARE))).collect()}
    models.limits = np.asarray([usual.get(lang, np.inf) + REJECT_MARGIN for lang in models.langs])
    remove(docs.sparkSession, sample)
    return models


def predict(docs: DataFrame, models: CharModels | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits (cross-entropy a character), rejected.

    lang_pred is the language of lowest length-normalised cross-entropy over the whole text, `und` (score 0, rejected) if the
    text is null or has no letter, or if nothing was learned. Ties go to the language that sorts first. A text is rejected too
    if its cross-entropy is above its language's limit. Texts of any length are scored whole. Repeated rows each get a row, an empty table gives an empty result, other columns are not read.
    """
    schema = "doc_id long, lang_pred string, score double, bits double, rejected boolean"

    def make():
        each = predictor(models)
        return lambda part: {"doc_id": part["doc_id"], **each(part["text"])}

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, schema, text_slices)


def keep_accepted(docs: DataFrame, models: CharModels | None, *, text_col: str = "text") -> DataFrame:
    """The documents that predict does not reject, all columns and repeated rows as they are, whatever their ids.

    All of them if nothing was learned, but for null texts and texts without a letter.
    """

    def make():
        each = predictor(models)
        return lambda texts: ~each(texts)["rejected"] if models else pc.match_substring_regex(pc.fill_null(texts, ""), LETTER).to_numpy(zero_copy_only=False)

    return keep_rows(docs, make, text_slices, text_col)


def predictor(models: CharModels | None):
    """Function of texts (Arrow) to the columns of predict but doc_id."""
    scorer = Scorer(models) if models else None

    def each(found):
        texts = pc.fill_null(found, "")
        lettered = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False) & bool(scorer)
        bits = scorer.score(texts) if scorer else np.zeros((len(texts), 1))
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        odds = np.exp2(-SHARPNESS * (bits - low[:, None])).sum(1)
        limit = models.limits[best] if scorer and models.limits is not None else np.full(len(texts), np.inf)
        langs = models.langs if scorer else [UND]
        return {
            "lang_pred": [langs[b] if ok else UND for b, ok in zip(best, lettered)],
            "score": np.where(lettered, 1 / odds, 0.0),
            "bits": np.where(lettered, low, 0.0),
            "rejected": ~lettered | (low > limit),
        }

    return each
