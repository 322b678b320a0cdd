"""Operators of the llm subpackage against brute force, on edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns of clashing names."""

import base64
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from weft.llm import byte_bpe, chat_format, embedding_dedup, id_files, language_id, media_jpeg, packing, simhash, token_counts, toxicity
from weft.llm.coder import LibraryCoder
from weft.llm.components import connected_components

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n", "a", "Hello, World", "hello, world", "a  b \n\n c\t", "it's we'LL don't", "x <|endoftext|> y", "<|ENDOFTEXT|>", "日本語 テキスト é", "x" * 300, "no  no", "word " * 4000, "a" * 70]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, sequence_id string, length int").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def random_texts(n, letters, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_coder_is_the_library(library, path):
    texts = [t or "" for t in TEXTS] + random_texts(300, "abcdeé's .!1$AB\n") + random_texts(100, "abé \n\t　日1.")
    coder = LibraryCoder(path)
    ids, count = coder.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(count)[:-1])
    assert [p.tolist() for p in parts] == [ids_of(library, path, t) for t in texts]
    assert coder.count(pa.array(texts)).tolist() == count.tolist()
    assert len(coder.encode(pa.array([], pa.string()))[0]) == 0


def test_token_counts(spark, docs, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    out = token_counts.count_tokens(docs, WORD, limit=3, cache=cache).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        n = len(ids_of(library, WORD, TEXTS[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((TEXTS[r.doc_id] or "").encode()), n > 3)
    stored = spark.read.parquet(cache).count()
    more = token_counts.count_tokens(docs.limit(3).unionByName(spark.createDataFrame([(99, "new", "", "", 0)], docs.schema)), WORD, cache=cache)
    assert more.count() == 4 and spark.read.parquet(cache).count() == stored + 1
    assert spark.read.parquet(cache).select("digest").distinct().count() == stored + 1
    assert token_counts.count_tokens(docs.limit(0), WORD).count() == 0


def check_packing(out, expected, capacity):
    """expected: ids of each document with its end"""
    by_doc: dict[int, list] = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.asarray(expected[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(expected[r.doc_id])
    seqs: dict[int, list] = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_doc


def test_packing(docs, library):
    expected = {i: [*ids_of(library, BYTE, t), 0] for i, t in enumerate(TEXTS)}
    out = packing.pack_documents(docs, BYTE, capacity=64, with_ids=False).collect()
    by_doc = check_packing(out, expected, 64)
    for i, ids in expected.items():
        copies = 2 if i == 5 else 1
        assert sum(r.length for r in by_doc[i]) == copies * len(ids)
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_packing_of_equal_keys_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, 0, 1 + i % 3, "s", i, "b") for i in range(300)], "doc_id long, start long, length long, sequence_id string, offset long, _bucket string").repartition(4)
    out = packing.pack(rows, capacity=10).collect()
    assert out[0].asDict().keys() == {"doc_id", "start", "length", "_bucket", "sequence_id", "offset"} and len(out) == 300
    taken = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert all(a[0] < b[0] or a[1] + a[2] == b[1] for a, b in zip(taken, taken[1:])) and all(o + n <= 10 for _, o, n in taken)


def test_scratch(spark):
    from weft.llm import shared

    with shared.scratch(spark):
        inside, kept = shared.stage(spark.range(3).toDF("i"), "a"), shared.new_path(spark, "b")
        out = shared.stage(inside, "b", kept)
        gone = inside.inputFiles()[0].rsplit("/", 1)[0]
    assert out.count() == 3 and not shared.path_exists(spark, gone) and shared.path_exists(spark, kept)


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1024, rng.geometric(1 / rng.integers(20, 900), 5000))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    patterns = packing.pack_histogram(histogram, 1024)
    got: dict[int, int] = {}
    for p, n in patterns:
        assert sum(p) <= 1024
        for x in p:
            got[x] = got.get(x, 0) + n
    assert got == histogram
    assert packing.pack_histogram({300: 3000}, 1024) == [((300, 300, 300), 1000)]


def test_byte_bpe(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text) and r.decoded == text.encode() and r.n_tokens == len(r.ids) // 4
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs.limit(0), RANKS, P.PATTERN), RANKS).count() == 0
    coder = byte_bpe.RankCoder(RANKS, P.PATTERN, entries=50)
    texts = random_texts(200, "abcdeé's .!1$AB\n") + random_texts(50, "abé \n\t　日1.", 2) + ["ab" * 500, "é" * 90]
    ids, count = coder.encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [own.encode_ordinary(t) for t in texts]


def test_id_files(spark, docs, library):
    rows = docs.unionByName(spark.createDataFrame([(None, "null id", "", "", 0)], docs.schema))
    out = id_files.round_trip(rows, WORD).collect()
    expected = sorted([(-1, "null id"), *enumerate(TEXTS), (5, TEXTS[5])], key=lambda x: x[0])
    start = 0
    for r, (i, text) in zip(sorted(out, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.start)), expected, strict=True):
        ids = [*ids_of(library, WORD, text), 1]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    assert id_files.round_trip(docs.limit(0), WORD).count() == 0
    same = spark.createDataFrame([(7, "one text")] * 40 + [(None, "one text")] * 40, "doc_id long, text string").repartition(4)
    n = len(ids_of(library, WORD, "one text")) + 1
    assert sorted(((r.doc_id or 0, r.start, r.n_tokens) for r in id_files.round_trip(same, WORD).collect())) == [(0 if i < 40 else 7, i * n, n) for i in range(80)]


def test_block_codes_of_all_sizes():
    by_rank = np.arange(70_000)[::-1].copy()
    code_of = np.argsort(by_rank)
    dictionary = id_files.DICTIONARY + by_rank.astype("<u4").tobytes()
    ids = np.random.default_rng(0).integers(70_000, size=1001)
    body = id_files.write_block(np.array([3, 9]), np.array([1, 1000]), ids, code_of, dictionary)
    docs, sizes, back = id_files.read_block(body, dictionary)
    assert docs.tolist() == [3, 9] and sizes.tolist() == [1, 1000] and (back == ids).all()
    with pytest.raises(ValueError):
        id_files.read_block(body, dictionary + b"\0\0\0\0")


def plain_fingerprint(text, n=4):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_documents(docs):
    out = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for t in TEXTS]
    comp = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == comp[r.doc_id]
    kept = simhash.keep_firsts(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_firsts_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(12)]
    assert min((plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() for a in texts for b in texts if a != b) > 4
    # null ids alone, twice; one null id beside an id; one id with three texts; copies in rows of other ids
    rows = [(None, t, "x") for t in texts[:6]] + [(None, texts[0], "y"), (7, texts[5], "z")] + [(3, t, "x") for t in texts[6:9]] + [(9, texts[6], "x"), (2, texts[9], "x"), (1, texts[9], "x"), (5, None, "x"), (None, "", "x")]
    kept = simhash.keep_firsts(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    assert kept.columns == ["doc_id", "text", "source"]
    expected = [(None, t) for t in texts[:5]] + [(7, texts[5])] + [(3, t) for t in texts[6:9]] + [(1, texts[9]), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(("threshold", "tile"), [(4, 2048), (4, 16), (3, 2048), (1, 2048)])
def test_simhash_links_are_whole(spark, monkeypatch, threshold, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(5)} | {base[0] ^ 1 << i for i in range(40)}
    fps = sorted(near | set(base))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    linked = connected_components(simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), threshold))
    groups: dict[int, set] = {}
    for r in linked.collect():
        groups.setdefault(r.component, set()).add(r.node)
    comp = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= threshold])
    expected: dict[int, set] = {}
    for s, c in zip(signed, comp):
        expected.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = connected_components(links).collect()
    assert len(out) == 201 and {r.component for r in out} == {0}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16))
    rows, label = [], []
    for i in range(400):
        rows.append((centre[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.5])).tolist())
        label.append(i % 2)
    rows += [rows[0], None, [0.0] * 16, [float("nan")] * 16, rows[1], [None, 1.0], [1.0, 2.0]]
    label += [0, 0, 0, 0, None, 1, 1]
    table = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in enumerate(zip(rows, label))], "vec_id long, embedding array<double>, label int, component_id string")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and label[i] is not None]
    unit = {i: np.asarray(rows[i]) / np.linalg.norm(rows[i]) for i in good}
    pairs = [(i, j) for i in good for j in good if i < j and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    comp = components_of(len(rows), pairs)
    assert len(out) == len(rows)
    assert [out[i].component_id for i in range(len(rows))] == comp
    assert [out[i].n_links for i in range(len(rows))] == links
    assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_repeated_and_null_ids(spark):
    v, w, x = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v), (1, w), (2, v), (3, w), (7, x), (7, x), (None, x), (None, [1.0, 1.0, 0.0]), (9, None), (9, [])]
    table = spark.createDataFrame([(i, a, "a", "n") for i, a in rows], "vec_id long, embedding array<double>, label string, node string").repartition(3)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()), key=str)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)], key=str)


def planted(n, pairs, size, low=0.9305, high=0.94, seed=11):
    """Random unit vectors, and partners of the first ones at given cosines."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(pairs, size))
    other -= (other * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(low, high, size=(pairs, 1))
    return np.concatenate([base, cosine * base[:pairs] + np.sqrt(1 - cosine**2) * other])


@pytest.mark.parametrize(("n", "size"), [(20_000, 64), (3_000, 2100)])
def test_windows_alone_find_most(spark, tmp_path, n, size):
    """What the sorted passes find by themselves in a label far larger than the window."""
    rows, pairs = planted(n, 400, size), 400
    frame = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.FixedSizeListArray.from_arrays(rows.astype("f4").ravel(), size).cast(pa.list_(pa.float32())), "label": np.ones(len(rows), "int32")})
    import pyarrow.parquet as pq

    pq.write_table(frame, f"{tmp_path}/v.parquet")
    _, vectors = embedding_dedup.distinct_vectors(spark.read.parquet(f"file://{tmp_path}/v.parquet"), "vec_id", "embedding", "label")
    links = connected_components(embedding_dedup.window_links(vectors, 0.93))
    of = {r.node: r.least for r in vectors.select("node", "least").collect()}
    groups = {of[r.node]: of[r.component] for r in links.collect()}
    assert sum(groups.get(i, -1) == groups.get(n + i, -2) for i in range(pairs)) >= 0.9 * pairs


def test_embeddings_beyond_every_window(spark):
    """Lone pairs just above the threshold in a large label, which passes and windows bring together only by chance."""
    rows = planted(3000, 300, 64)
    near = rows @ rows.T >= 0.93
    np.fill_diagonal(near, False)
    assert near[:300].any(1).all()
    comp = components_of(len(rows), list(zip(*map(np.ndarray.tolist, np.nonzero(np.tril(near))))))
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, passes=1, window=4).collect()}
    assert [out[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
    assert [out[i].component_id for i in range(len(rows))] == comp
    assert [i for i in range(len(rows)) if not out[i].kept] == [i for i, c in enumerate(comp) if c != i]


@pytest.mark.parametrize("size", [3, 64])
def test_embeddings_at_the_threshold(size):
    """Blocks decide by double precision, also where single precision cannot tell; spanning pairs join what near pairs join."""
    rng = np.random.default_rng(size)
    u = rng.normal(size=(200, size))
    v = np.concatenate([u[:100] + rng.normal(size=(100, size)) * 0.3, u])
    u, v = embedding_dedup.unit(u), embedding_dedup.unit(v)
    exact = np.einsum("id,jd->ij", u, v)
    for threshold in (0.93, float(np.einsum("i,i", u[3], v[3])), float(np.nextafter(np.einsum("ij,ij->i", u[3:4], v[3:4])[0], 2))):
        near = embedding_dedup.near_block(u, v, threshold)
        clear = abs(exact - threshold) > 1e-12
        assert (near == (exact >= threshold))[clear].all()
        assert near[3, 3] == (np.einsum("ij,ij->i", u[3:4], v[3:4])[0] >= threshold)
        a, b = embedding_dedup.spanning(near)
        assert len(a) <= sum(near.shape)
        pairs = [(i, len(u) + j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)))]
        assert components_of(sum(near.shape), pairs) == components_of(sum(near.shape), list(zip(a.tolist(), b.tolist())))


def test_language(spark):
    vocab = {"en": "the and ing tion with from".split(), "de": "und der schaft keit über für".split(), "fr": "le que être eaux ment où".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(vocab[lang], k=30)), lang, "x") for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    table = spark.createDataFrame([*rows, (900, None, None, "x"), (901, "", "en", "x"), (902, "123 %%%", "en", "x"), (903, "the " * 20000, None, "x")], "doc_id long, text string, lang string, score string")
    models = language_id.train(table.where("doc_id < 300"), learn=F.col("doc_id") % 5 != 0, sample_docs=50, calibration_docs=20)
    out = {r.doc_id: r for r in language_id.predict(table, models).collect()}
    assert len(out) == 304
    assert all(out[i].lang_pred == rows[i][2] for i in range(300)) and out[903].lang_pred == "en"
    assert all(out[i].lang_pred == "und" and out[i].rejected for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = language_id.keep_accepted(table, models)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= set(range(300)) and not {900, 901, 902} & {r.doc_id for r in kept.collect()}
    assert language_id.train(table.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(table, None).collect()} == {"und"}


def kneser_ney(counts):
    """Plain interpolated model of one language by its definition: function of (gram so far, next character) to a probability."""
    from functools import cache

    order = language_id.ORDER
    level = {order: {g: n for g, n in counts.items()}}
    for k in range(order - 1, 0, -1):  # continuation counts; grams that start a word, which have no longer history, keep their own
        level[k] = {g: n for g, n in level[k + 1].items() if len(g) <= k}
        for g in [g for g in level[k + 1] if len(g) == k + 1]:
            level[k][g[1:]] = level[k].get(g[1:], 0) + 1
    floor = 1 / (len({c for g in counts for c in g}) + 256)

    @cache
    def p(context, c):
        if context is None:
            return floor
        k = len(context) + 1
        here = {g: n for g, n in level[k].items() if len(g) == k and g[:-1] == context}
        below = p(context[1:] if context else None, c)
        if not here:
            return below
        total = sum(here.values())
        return max(here.get(context + c, 0) - language_id.DISCOUNT, 0) / total + language_id.DISCOUNT * len(here) / total * below

    return p, floor


def test_kneser_ney_sums_to_one():
    from collections import Counter

    seen: Counter = Counter()
    for w in "abc abd bcd aab".split():
        language_id.count_grams(w, 1, seen)
    p, floor = kneser_ney(seen)
    models = language_id.fit_models([("x", g, n) for g, n in seen.items()])
    assert models.floor == floor
    chars = sorted({c for g in seen for c in g})
    for context in ("", " ", " a", "ab", " ab", "zzz", "aab"):
        # the 256 characters that are kept for what was never seen share the floor alike
        assert abs(sum(p(context, c) for c in chars) + 256 * p(context, "#") - 1) < 1e-12


def test_cross_entropy_by_brute_force():
    from collections import Counter

    rng = random.Random(12)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(80)] for lang, letters in (("a", "abcdé"), ("b", "cdefß"))}
    counts = {}
    for lang, some in words.items():
        counts[lang] = Counter()
        for w in some:
            language_id.count_grams(w, 1, counts[lang])
    models = language_id.fit_models([(lang, g, n) for lang, c in counts.items() for g, n in c.items()])
    floor = models.floor
    scorer = language_id.Scorer(models)
    texts = ["Abc dE, 12ab3cd zz", "ß", "a1b2 " * 30, "née-cafe x_y", "c" * 200]
    out = scorer.score(pa.array(texts))
    for j, lang in enumerate(models.langs):
        p, own = kneser_ney(counts[lang])
        for i, text in enumerate(texts):
            bits = length = 0
            for run in re.findall(r"[^\W\d_]+", text.lower()):
                padded = f" {run} "
                for at in range(1, len(padded)):
                    bits -= np.log2(brute(p, padded[max(0, at - language_id.ORDER + 1) : at], padded[at], own, floor))
                length += len(run) + 1
            assert abs(out[i, j] - bits / length) < 1e-9


def brute(p, context, c, own_floor, floor):
    """p with the floor of all languages' characters in place of one's own: what is left to the floor is linear in it."""
    gone = p(context, "\0") / own_floor
    return p(context, c) - gone * own_floor + gone * floor


def test_unseen_languages_are_rejected(spark):
    """Texts of languages that were not learned, and noise, against documents that were not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = language_id.train(docs, learn=F.col("doc_id") % 5 != 0)
    texts = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita", "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan",
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił", "Άνδρα μοι έννεπε, Μούσα, πολύτροπον, ος μάλα πολλά πλάγχθη", "xk7q9 zzpqw vvkxj 8f3a2c qqrtx wzxcv", "これは日本語の文章です",
    ]
    strange = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert language_id.keep_accepted(strange, models).count() == 0
    out = language_id.predict(docs.where("doc_id % 5 = 0"), models).where("lang_pred <> 'und'").collect()
    assert sum(r.rejected for r in out) <= len(out) * 0.01
    assert language_id.predict(docs.limit(0), models).count() == 0
    assert language_id.predict(strange.union(strange), models).count() == 2 * len(texts)


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(800):
        text = rng.choices(words, k=20)
        toxic = i % 8 == 0
        if toxic:
            text += rng.sample(["scum,", "Idiot!", "moron"], 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic), "x"))
    table = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (902, ("w1 " * 20000) + "scum idiot", "x")], "doc_id long, text string, label string")
    marks = spark.createDataFrame([*labels, (5000, 1, "x"), (None, 1, "x"), (3, None, "x"), (0, 1, "x")], "doc_id long, toxic int, text string")
    machine = toxicity.train(table, marks, learn=F.col("doc_id") % 4 != 2)
    out = {r.doc_id: r for r in toxicity.score(table, machine).collect()}
    assert len(out) == 803 and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted == t for i, t, _ in labels) >= 795
    assert out[902].predicted == 1 and out[900].predicted == out[901].predicted == 0
    kept = toxicity.keep_clean(table, machine)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    assert toxicity.train(table, marks.limit(0)) is None and toxicity.score(table, None).where("predicted = 1").count() == 0


def test_interactions_are_learned():
    """A pair that is toxic only together: additive weights cannot tell it."""
    rng = random.Random(0)
    rows = []
    for _ in range(600):
        kind = rng.randrange(4)
        rows.append((int(kind == 3), np.asarray(sorted([10] * (kind in (1, 3)) + [11] * (kind in (2, 3)) + [rng.randrange(100, 130)]))))
    m = toxicity.fit(rows, {0: 1.0, 1: 1.0})
    a, b = m.index.get(10), m.index.get(11)
    assert a is not None and b is not None
    assert m.score({a, b}) > 0.5 > max(m.score({a}), m.score({b}))


def test_a_second_term_takes_the_toxicity_away(spark):
    """An insult that is toxic alone and harmless beside a term that is not toxic itself, nor rare in clean texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1600):
        kind = rng.randrange(4)  # neither, insult, second term, both
        rows.append((i, " ".join(rng.choices(words, k=8) + ["scum"] * (kind in (1, 3)) + ["pond"] * (kind in (2, 3)))))
        labels.append((i, int(kind == 1)))
    table = spark.createDataFrame([*rows, (9000, "scum w1"), (9001, "scum pond w1"), (9002, "pond w1"), (9000, "scum w1")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, labels[0][1])], "doc_id long, toxic int")
    machine = toxicity.train(table, marks)
    out = toxicity.score(table, machine).where("doc_id >= 9000").collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == 4 and score[9000] > 0.6 and score[9001] < 0.3 and score[9002] < 0.3
    assert toxicity.score(table.limit(0), machine).count() == 0


def test_machine_is_the_double_sum():
    rng = np.random.default_rng(9)
    m = toxicity.Machine({i: i for i in range(40)}, -1.0, rng.normal(size=40), rng.normal(size=(40, 8)))
    for size in (0, 1, 2, 17, 40):
        present = rng.choice(40, size, replace=False).tolist()
        z = m.bias + sum(m.w[i] for i in present) + sum(m.v[i] @ m.v[j] for i in present for j in present if i < j)
        assert abs(m.score(set(present)) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 383, 384, 385, 5000])
def test_jpeg_payload(n):
    raw = random.Random(n).randbytes(n)
    padded = raw.ljust(max(64, -(-n // 64) * 64), b"\0")
    found = media_jpeg.read_jpeg(media_jpeg.write_payload(padded, n))
    assert media_jpeg.payload_of(found) == (padded, n)
    rgb = media_jpeg.rgb_of(found)
    assert rgb.shape == (found["height"], found["width"], 3)


def test_jpeg_general_scans():
    """Scans as other writers make them: runs of zeros, bands that end early, new coefficients in refinements, restarts."""
    rng = np.random.default_rng(1)
    coefficients = np.where(rng.random((4, 64)) < 0.2, rng.integers(-20, 21, (4, 64)), 0)
    coefficients[1, 1:] = 0

    class Writer:
        def __init__(self):
            self.bits = []

        def put(self, value, n):
            self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    # codes of eight bits for the symbols 0 to 254 in order
    def table(kind, number):
        return media_jpeg.huffman(kind, number, {8: list(range(128)), 9: list(range(128, 255))})

    def code(w, s):
        w.put(s, 8) if s < 128 else w.put(256 + s - 128, 9)

    shifted = np.sign(coefficients) * (np.abs(coefficients) >> 1)
    dc, dc_bits, ac, refine = Writer(), Writer(), Writer(), Writer()
    last = 0
    for block in range(4):
        value = int(coefficients[block, 0]) >> 1
        n, bits = signed(value - last)
        last = value
        code(dc, n)
        dc.put(bits, n)
        dc_bits.put(int(coefficients[block, 0]) & 1, 1)
    for block in range(4):
        zeros = 0
        for k in range(1, 64):
            v = int(shifted[block, k])
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                code(ac, 0xF0)
                zeros -= 16
            n, bits = signed(v)
            code(ac, zeros << 4 | n)
            ac.put(bits, n)
            zeros = 0
        if zeros:
            code(ac, 0)
        band, ones = coefficients[block], [k for k in range(1, 64) if abs(int(coefficients[block, k])) == 1]
        zeros, pending = 0, []
        end = ones[-1] if ones else 0
        for k in range(1, 64):
            v = int(band[k])
            if abs(v) > 1:
                pending.append(abs(v) & 1)
            elif abs(v) == 1:
                code(refine, zeros << 4 | 1)
                refine.put(int(v > 0), 1)
                for b in pending:
                    refine.put(b, 1)
                zeros, pending = 0, []
            else:
                zeros += 1
                if zeros == 16 and k < end:
                    code(refine, 0xF0)
                    for b in pending:
                        refine.put(b, 1)
                    zeros, pending = 0, []
        if end < 63:
            code(refine, 0)
            for b in pending:
                refine.put(b, 1)
    data = b"".join([
        b"\xff\xd8", media_jpeg.segment(0xDB, bytes([0]) + bytes([1]) * 64), media_jpeg.segment(0xC2, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])), table(0, 0), table(1, 0),
        *[media_jpeg.scan(1, 0, a, b, h, lo, media_jpeg.pack_bits(np.asarray(w.bits, "u1"))) for w, a, b, h, lo in ((dc, 0, 0, 0, 1), (ac, 1, 63, 0, 1), (dc_bits, 0, 0, 1, 0), (refine, 1, 63, 1, 0))],
        b"\xff\xd9",
    ])
    found = media_jpeg.read_jpeg(data)
    assert (found["parts"][0]["c"] == coefficients).all()


class Coded:
    """Bits of scans as a plain writer makes them, with codes of eight or nine bits for the symbols 0 to 254 in order."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s, value=0, n=0):
        self.put(s, 8) if s < 128 else self.put(256 + s - 128, 9)
        self.put(value, n)

    def number(self, v, run=0):
        n = abs(v).bit_length()
        self.symbol(run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n)

    def done(self):
        return media_jpeg.pack_bits(np.asarray(self.bits, "u1")).replace(b"\xff", b"\xff\x00")


def test_jpeg_subsampled_interleaved_and_restarted():
    """4:2:0 of a size that is no multiple of a block: interleaved DC scans, AC scans by component, all with restarts; colours by the plain formulas."""
    rng = np.random.default_rng(5)
    height, width, restart = 20, 24, 2
    sampling, own, stride = [(2, 2), (1, 1), (1, 1)], [(3, 3), (2, 2), (2, 2)], [(4, 4), (2, 2), (2, 2)]  # (down, across)
    c = [np.where(rng.random((down * across, 64)) < 0.1, rng.integers(-9, 10, (down * across, 64)), 0) for down, across in stride]
    for part in c:
        part[:, 0] = rng.integers(-60, 60, len(part))
    for part, (down, across), (most, wide) in zip(c, own, stride):  # blocks beyond the picture have no AC scan
        y, x = np.divmod(np.arange(most * wide), wide)
        part[(y >= down) | (x >= across), 1:] = 0
    mcus = [[[(my * v + dy) * stride[i][1] + mx * h + dx for dy in range(v) for dx in range(h)] for i, (v, h) in enumerate(sampling)] for my in range(2) for mx in range(2)]

    def joined(pieces):
        return b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(pieces) else b"") for i, p in enumerate(pieces))

    first, second = [], []
    for start in range(0, len(mcus), restart):
        a, b, last = Coded(), Coded(), [0, 0, 0]
        for mcu in mcus[start : start + restart]:
            for i, blocks in enumerate(mcu):
                for block in blocks:
                    value = int(c[i][block, 0]) >> 1
                    a.number(value - last[i])
                    last[i] = value
                    b.put(int(c[i][block, 0]) & 1, 1)
        first.append(a.done())
        second.append(b.done())
    scans = [media_jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])) + joined(first)]
    for i, (down, across) in enumerate(own):
        order, pieces = [y * stride[i][1] + x for y in range(down) for x in range(across)], []
        for start in range(0, len(order), restart):
            w = Coded()
            for block in order[start : start + restart]:
                zeros, ac = 0, c[i][block, 1:].tolist()
                while ac and not ac[-1]:
                    ac.pop()
                for v in ac:
                    if not v:
                        zeros += 1
                        continue
                    for _ in range(zeros // 16):
                        w.symbol(0xF0)
                    w.number(v, zeros % 16)
                    zeros = 0
                if len(ac) < 63:
                    w.symbol(0)
            pieces.append(w.done())
        scans.append(media_jpeg.segment(0xDA, bytes([1, i + 1, 0, 1, 63, 0])) + joined(pieces))
    scans.append(media_jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])) + joined(second))
    quant = rng.integers(1, 20, (2, 64))
    every = {8: list(range(128)), 9: list(range(128, 255))}
    data = b"".join([
        b"\xff\xd8", media_jpeg.segment(0xDB, bytes([0, *quant[0].tolist()])), media_jpeg.segment(0xDB, bytes([1, *quant[1].tolist()])), media_jpeg.segment(0xDD, bytes([0, restart])),
        media_jpeg.segment(0xC2, bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])), media_jpeg.huffman(0, 0, every), media_jpeg.huffman(1, 0, every), *scans, b"\xff\xd9",
    ])
    found = media_jpeg.read_jpeg(data)
    assert all((p["c"] == part).all() for p, part in zip(found["parts"], c))
    # the plain inverse transform, sample by sample
    place = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))

    def sample(i, y, x):
        block = c[i][y // 8 * stride[i][1] + x // 8] * quant[min(i, 1)]
        total = 0.0
        for k, at in enumerate(place):
            v, u = divmod(at, 8)
            if block[k]:
                total += block[k] * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * np.cos((2 * (x % 8) + 1) * u * np.pi / 16) * np.cos((2 * (y % 8) + 1) * v * np.pi / 16)
        return min(255, max(0, int(np.floor(total + 128.5 + 1e-7))))

    rgb = media_jpeg.rgb_of(found)
    assert rgb.shape == (height, width, 3)
    for y in range(height):
        for x in range(width):
            luma, cb, cr = sample(0, y, x), sample(1, y // 2, x // 2) - 128, sample(2, y // 2, x // 2) - 128
            expected = [luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb]
            assert rgb[y, x].tolist() == [min(255, max(0, int(np.floor(e + 0.5 + 1e-7)))) for e in expected]
    one = media_jpeg.decode_one(data)
    assert one["payload"] is None and one["error"] is None and one["rgb"] == rgb.tobytes()


def test_media_null_and_broken(spark):
    good = media_jpeg.write_payload(b"x" * 64, 5)
    rows = [(1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, b"GIF89a", "d"), (5, good[: len(good) // 2], "e"), (6, good[:30], "f"), (1, good, "a")]
    table = spark.createDataFrame([(i, bytearray(m) if m is not None else None, r) for i, m, r in rows], "doc_id long, media binary, rgb string")
    out = media_jpeg.with_feature(media_jpeg.decode_media(table)).collect()
    assert len(out) == 7 and sum(r.error is None for r in out) == 2
    assert all((r.payload is None) == (r.feature is None) == (r.error is not None) for r in out)
    assert all(bytes(r.payload) == b"x" * 64 for r in out if r.doc_id == 1)
    assert media_jpeg.decode_media(table.limit(0)).count() == 0


def test_inverse_transform():
    flat = np.zeros((1, 64))
    flat[0, 0] = 80
    assert np.allclose(flat @ media_jpeg.BASIS, 10)
    assert np.allclose(media_jpeg.BASIS @ media_jpeg.BASIS.T, np.eye(64))
    assert media_jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_media_table(docs):
    stored = media_jpeg.store_tensors(media_jpeg.decode_media(media_jpeg.store_texts(docs)))
    out = media_jpeg.with_feature(stored.withColumn("kept", F.col("rgb"))).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert len(r.kept) == r.height * r.width * 3 and r.feature.startswith(f"{r.height}x{r.width}:") and r.error is None
    assert len({r.feature for r in out if r.doc_id == 5}) == 1
    assert media_jpeg.store_texts(docs.limit(0)).count() == 0


def test_tensors_of_one_part_at_a_time(docs, monkeypatch):
    """Every tensor is stored, those of a part are gone before the next part's, and features are those of one part."""
    whole = {(r.doc_id, r.feature) for r in media_jpeg.with_feature(media_jpeg.decode_media(media_jpeg.store_texts(docs))).collect()}
    monkeypatch.setattr(media_jpeg, "PART_BYTES", 1)
    monkeypatch.setattr(media_jpeg, "FILE_ROWS", 2)
    held, store, rows = [], media_jpeg.store_tensors, []

    def watched(decoded):
        assert not any(Path(f.removeprefix("file://")).exists() for f in held)
        out = store(decoded)
        held.extend(out.inputFiles())
        rows.append(out.where("rgb is not null").count())
        return out

    monkeypatch.setattr(media_jpeg, "store_tensors", watched)
    out = media_jpeg.features_by_parts(media_jpeg.store_texts(docs), media_jpeg.decode_media).collect()
    assert 1 < len(rows) <= media_jpeg.MOST_PARTS and sum(rows) == len(out) == docs.count() and max(rows) < len(out)
    assert held and not any(Path(f.removeprefix("file://")).exists() for f in held)
    assert {(r.doc_id, r.feature) for r in out} == whole
    assert media_jpeg.features_by_parts(media_jpeg.store_texts(docs.limit(0)), media_jpeg.decode_media).count() == 0


def test_pictures_written_together():
    """Files of several sizes written at once, one with more blocks than a run of blocks has, are those written alone."""
    rng = np.random.default_rng(4)
    payloads = [(rng.integers(0, 256, 64 * n, "u1").tobytes(), 64 * n - 7) for n in (1, 6, 7, 50000, 13, 1)]
    together = media_jpeg.write_payloads(payloads)
    assert together == [media_jpeg.write_payload(*x) for x in payloads]
    assert [media_jpeg.payload_of(media_jpeg.read_jpeg(x)) for x in together] == payloads
    assert media_jpeg.write_payloads([]) == []


def test_media_functions_need_no_package():
    """What the functions of the media operator are pickled to writes and reads a picture where the package is not installed."""
    from pyspark.cloudpickle import dumps

    raw = bytes(range(256)) * 2

    def there_and_back(raw=raw, write=media_jpeg.write_payloads, read=media_jpeg.decode_one, feature=media_jpeg.feature_of):
        one = read(write([(raw, len(raw))])[0])
        rgb = np.frombuffer(one["rgb"], "u1").reshape(one["height"], one["width"], 3)
        return one["payload"] == raw and len(feature(rgb)) > 0

    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if p]; print(pickle.loads(sys.stdin.buffer.read())())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(Path(pyspark.__file__).parent.parent)}
    out = subprocess.run([sys.executable, "-c", code], input=dumps(there_and_back), env=env, cwd="/", capture_output=True)
    assert out.stdout.strip() == b"True", out.stderr.decode()[-400:]


def test_colours_by_formula():
    """Sums of whole luma and rounded chroma are the rounded sums of the JFIF formulas, for every Cb and Cr."""
    table = media_jpeg.colours()
    cb, cr = np.meshgrid(np.arange(256.0) - 128, np.arange(256.0) - 128, indexing="ij")
    for y in (0, 1, 77, 128, 254, 255):
        for plain, more in ((y + 1.402 * cr, table["red"][None, :]), (y - 0.344136 * cb - 0.714136 * cr, table["green"]), (y + 1.772 * cb, table["blue"][:, None])):
            assert (np.clip(np.floor(plain + 0.5 + 1e-7), 0, 255) == np.clip(y + more, 0, 255)).all()


def test_chat_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", None), (1, 3, "delta", 1, None, "Hel"), (1, 4, "delta", 1, None, "lo"), (1, 4, "delta", 1, None, "lo"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "Bye"), (1, 7, "edit", 0, None, "hey"), (1, 8, "unknown", 0, None, "?"), (None, 1, "message", 0, "user", "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(4)
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.fold_events(events))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "hey"), ("assistant", "Bye")] and out[1].loss == ["Bye"]
    assert [tuple(t) for t in out[None].turns] == [("user", "x")]


def test_chat_fold_by_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for conv in range(12):
        for seq in range(rng.randint(1, 40)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "typing", None])
            rows.append((conv, rng.choice([seq, seq // 2]), kind, rng.randrange(3), rng.choice([None, None, "user", "assistant"]), rng.choice([None, "", "a", "bc", "<s>"])))
    rows += rng.sample(rows, 20)  # delivered twice
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(5)
    expected = {}
    for conv, turn in {(r[0], r[3]) for r in rows}:
        own = {(seq, kind or "", text or "", role) for c, seq, kind, t, role, text in rows if (c, t) == (conv, turn)}
        text, by = "", ""
        for _, kind, piece, _ in sorted(own, key=lambda e: (e[:3], e[3] or "")):
            text = piece if kind in ("message", "edit") else "" if kind == "regenerate" else text + piece if kind == "delta" else text
        for _, kind, _, role in sorted(own, key=lambda e: (e[0], e[1], e[3] or "")):
            by = role if role and kind in ("message", "delta", "regenerate") else by
        expected[conv, turn] = (by, text, min(e[0] for e in own))
    out = chat_format.fold_events(events).collect()
    assert {(r.conv_id, r.turn): (r.role, r.text, r.first_seq) for r in out} == expected and len(out) == len(expected)


def test_chat_log_has_every_kind(spark):
    rows = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "x" * 1001)], "conv_id long, place long, role string, text string")
    log = chat_format.event_log(rows)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    folded = chat_format.fold_events(log.repartition(3)).orderBy("turn").collect()
    assert [(r.role, r.text) for r in folded] == [("user", "hi"), ("assistant", "x" * 1001)]


def test_chat_escapes(spark):
    rng = random.Random(6)
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<s", "", None, "line\nend\n", "x" * 50_000, *["".join(rng.choices(["<", "s>", "/", "\\", "[", "INST]", "</s>", "a", "\n"], k=12)) for _ in range(40)]]
    rows = [(i // 5, i % 3, rng.choice(["user", "assistant", "tool<s>", None]), t, "extra") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(table).collect()
    for r in out:
        own = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == [x[2] for x in own if x[1] == "assistant"]
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """run() against its stages by brute force on small tables."""
    import corpus_pipeline

    rng = random.Random(8)
    vocab = {"en": [f"the{c}ing" for c in "abcdefghij"], "de": [f"sch{c}keit" for c in "abcdefghij"]}
    rows, marks = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        toxic = i % 6 == 1
        text = " ".join(rng.choices(vocab[lang], k=30) + (["moron", "scum"] if toxic else []))
        if i % 20 == 4:
            text = rows[i - 4][1]
        rows.append((i, text, lang, "s", len(text)))
        marks.append((i, 1, int(toxic)))
    rows += [(500, "%%% 12", "en", "s", 6), (501, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {i: t for i, t, *_ in rows if t and i < 500 and not marks[i][2]}
    fps = {i: plain_fingerprint(t) for i, t in clean.items()}
    ids = sorted(clean)
    comp = components_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 4])
    assert {r.doc_id for r in out} == {ids[c] for c in comp}
    coder = LibraryCoder(BYTE)
    check_packing(out, {i: [*coder.library.encode(clean[i], add_special_tokens=False).ids, 0] for i in {r.doc_id for r in out}}, 1024)


def test_jpeg_samples_are_no_bare_black_and_white():
    """Each byte of a text bears on the tensor: samples keep the values between the ends, by the formulas of the transform."""
    raw = b"Words of some length stand here, one after the other, and no two lines are the same. " * 9
    raw = raw[: len(raw) // 384 * 384]
    found = media_jpeg.read_jpeg(media_jpeg.write_payload(raw, len(raw)))
    assert all((p["quant"] == 1).all() for p in found["parts"])
    rgb = media_jpeg.rgb_of(found)
    assert ((rgb > 0) & (rgb < 255)).mean() > 0.8
    for at in range(0, 128, 7):  # another byte, another tensor
        other = raw[:at] + bytes([raw[at] ^ 9]) + raw[at + 1 :]
        assert (media_jpeg.rgb_of(media_jpeg.read_jpeg(media_jpeg.write_payload(other, len(other)))) != rgb).any()
