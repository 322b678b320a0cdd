"""The registered queries of the ten operators over the smallest tables, against the libraries and brute force."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from weft.llm import media_jpeg, queries

from .test_llm import components_of, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(docs.doc_id, docs.text)}


@pytest.fixture(scope="module")
def langs():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(docs.doc_id.tolist(), docs.lang.tolist()))


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.path(path))
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1(spark, texts):
    encode = library("word_bpe_49k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op1_token_counts")}
    expected = {i: (len(t.encode()), n, n > 2048) for i, t in texts.items() for n in [len(encode(t))]}
    assert got == expected


def test_op2(spark, texts):
    encode, out = library("byte_bpe_50k.json"), run(spark, "op2_packing")
    ids = {i: [*encode(t), 0] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in out:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)
    used = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used >= 0.9 * 1024 * len(sequences)


def test_op3(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op3_byte_bpe")}
    assert got == {i: (len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(t.encode())) for i, t in texts.items() for ids in [own.encode_ordinary(t)]}


def test_op4(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    vectors, labels, ids = np.stack(table.embedding.to_numpy()).astype(float), table.label.to_numpy(), table.vec_id.tolist()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = components_of(len(ids), list(zip(*map(np.ndarray.tolist, np.nonzero(np.tril(near))))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op4_embedding_dedup")}
    assert got == {v: (int(near[i].sum()), ids[comp[i]], comp[i] == i) for i, v in enumerate(ids)}


def test_op5(spark, texts, langs):
    out = {r.doc_id: r for r in run(spark, "op5_language_id")}
    assert set(out) == set(texts) and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {i for i, t in texts.items() if not any(c.isalpha() for c in t)}
    held = [i for i, r in out.items() if r.held_out and langs[i] and r.lang_pred != "und"]
    assert np.mean([out[i].lang_pred == langs[i] for i in held]) >= 0.95


def test_op6(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    expected = con.execute(queries.ORACLES["op6_chat_format"]).df().sort_values("conv_id")
    got = queries.QUERIES["op6_chat_format"](spark, SF).toPandas().sort_values("conv_id")
    assert got[sorted(got)].astype(str).to_numpy().tolist() == expected[sorted(expected)].astype(str).to_numpy().tolist()


def test_op7(spark, texts):
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    comp = components_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op7_simhash")} == {i: (f"{fps[k]:016x}", ids[comp[k]]) for k, i in enumerate(ids)}


def test_op8(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op8_toxicity")}
    assert set(out) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = [i for i, y in zip(labels.doc_id.tolist(), labels.toxic.tolist()) if y == 0]
    assert np.mean([out[i].predicted for i in clean]) <= 0.05


def test_op9(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op9_media_jpeg")}
    assert set(out) == set(texts)
    for i, t in texts.items():
        raw = t.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = media_jpeg.write_payload(padded, len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, out[i].feature) == out[i].feature
    # the feature by plain counting of the tensor
    for i in sorted(texts)[:20]:
        raw = texts[i].encode()
        rgb = media_jpeg.rgb_of(media_jpeg.read_jpeg(media_jpeg.write_payload(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw))))
        channels = [rgb[:, :, c].ravel().tolist() for c in range(3)]
        means = [sum(x) * 1000 // len(x) for x in channels]
        bins = [sum(v // 64 == b for v in x) for x in channels for b in range(4)]
        assert out[i].feature == f"{rgb.shape[0]}x{rgb.shape[1]}:{','.join(map(str, means))}:{','.join(map(str, bins))}"


def test_op10(spark, texts):
    encode, start, expected = library("word_bpe_49k.json"), 0, {}
    for i in sorted(texts):
        ids = [*encode(texts[i]), 1]
        expected[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op10_id_files")} == expected
