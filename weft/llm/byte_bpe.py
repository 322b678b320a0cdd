"""Byte-level BPE by rank files: encoding with a segment tree of pair ranks over byte positions, and decoding."""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .coder import UNSAFE_OR_RUN, BatchCoder, split_at_blanks, sums, text_slices, with_blanks, without
from .shared import binary, map_rows, text_or_empty

NONE = np.iinfo(np.int64).max
#: Pieces longer than this are encoded one at a time, so that a batch of trees stays small.
BATCH_BYTES = 64


class RankTable:
    """Ranks of byte strings, which are also the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.single = np.asarray([self.rank[bytes([b])] for b in range(256)])

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys left << 32 | right of all pairs of ids whose bytes join to a ranked string, and those ranks."""
        rank, keys, found = self.rank, [], []
        for token, joined in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(joined)
        keys, found = np.asarray(keys, "int64"), np.asarray(found, "int64")
        order = np.argsort(keys)
        return np.append(keys[order], NONE), np.append(found[order], 0)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, found = self.pairs
        want = left << 32 | right
        at = np.searchsorted(keys, want)
        return np.where(keys[at] == want, found[at], NONE)


def encode_long(table: RankTable, piece: bytes) -> list[int]:
    """One piece of any length: O(n log n)."""
    n, rank = len(piece), table.rank
    size = 1 << (n - 1).bit_length()
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    none = (NONE, 0)

    def pair(i: int):
        j = after[i]
        r = rank.get(piece[i : end[j]]) if j < n else None
        return none if r is None else (r, i)

    tree = [none] * (2 * size)
    tree[size : size + n] = [pair(i) for i in range(n)]
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    while (least := tree[1]) != none:
        i = least[1]
        j = after[i]
        after[i], end[i] = after[j], end[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = after[i]
    return out


def encode_batch(table: RankTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of pieces of 2 to BATCH_BYTES bytes, each in a row of its own: one merge a round for all rows that have any left.

    A leaf holds rank * width + position of the pair that starts there, so the root is the leftmost pair of least rank.
    """
    count, n = len(pieces), np.fromiter(map(len, pieces), "int64", len(pieces))
    size = 1 << int(n.max() - 1).bit_length()
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    filled = np.arange(size) < n[:, None]
    ids = np.zeros((count, size + 1), "int64")
    ids[:, :size][filled] = table.single[flat]
    after = np.tile(np.arange(1, size + 2), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))
    tree = np.full((count, 2 * size), NONE)
    rows, cols = np.nonzero(np.arange(1, size + 1) < n[:, None])
    found = table.pair_rank(ids[rows, cols], ids[rows, cols + 1])
    has = found != NONE
    tree[rows[has], size + cols[has]] = found[has] * size + cols[has]
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(row, col, value):
        node = size + col
        tree[row, node] = value
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row, col):
        right = after[row, col]
        inside = right < n[row]
        got = np.where(inside, table.pair_rank(ids[row, col], ids[row, np.minimum(right, size)]), NONE)
        return np.where(got == NONE, NONE, np.minimum(got, NONE // (2 * size)) * size + col)

    live = np.ones((count, size), bool) & filled
    rows = np.nonzero(tree[:, 1] != NONE)[0]
    while len(rows):
        least = tree[rows, 1]
        col, merged = least % size, least // size
        right = after[rows, col]
        ids[rows, col] = merged
        beyond = after[rows, right]
        after[rows, col] = beyond
        before[rows, np.minimum(beyond, size)] = col
        live[rows, right] = False
        put(rows, right, NONE)
        put(rows, col, pair(rows, col))
        left = before[rows, col]
        has = left >= 0
        put(rows[has], left[has], pair(rows[has], left[has]))
        rows = rows[tree[rows, 1] != NONE]
    return ids[:, :size][live], live.sum(1)


class RankCoder(BatchCoder):
    """Ids of a rank file, each match of the pattern by itself. Ids of words are remembered, up to a number of words."""

    def __init__(self, path: str, pattern: str, entries: int = 300_000):
        import regex

        self.table, self.findall, self.entries = RankTable(path), regex.compile(pattern).findall, entries
        self.known: dict[str, bytes] = {}
        super().__init__(lambda texts: without(texts, UNSAFE_OR_RUN), split_at_blanks, self.of_pieces, lambda text: self.of_words(self.findall(text))[0])

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fresh = [w for w in set(words) if w not in self.known]
        found = self.known
        if fresh:
            found = dict(zip(fresh, self.merge([w.encode() for w in fresh])))
            if len(self.known) < self.entries:
                self.known.update(found)
                found = self.known
            else:
                found = self.known | found
        values = list(map(found.__getitem__, words))
        return np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), "int64", len(values)) // 4

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes: dict[int, list[int]] = {}
        for i, raw in enumerate(words):
            whole = self.table.rank.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(raw) > BATCH_BYTES:
                out[i] = np.asarray(encode_long(self.table, raw), "<u4").tobytes()
            else:
                sizes.setdefault((len(raw) - 1).bit_length(), []).append(i)
        for rows in sizes.values():
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                ids, count = encode_batch(self.table, [words[i] for i in some])
                raw, end = ids.astype("<u4").tobytes(), 0
                for i, n in zip(some, (4 * count).tolist()):
                    out[i] = raw[end : end + n]
                    end += n
        return out

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are cut to matches all at once, a line each, and new words go through the trees together."""
        return with_blanks(pieces, self.of_lines, lambda blank: self.of_words(self.findall(blank))[0])

    def of_lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not lines:
            return np.zeros(0, "<u4"), np.zeros(0, "int64")
        words = self.findall("\n".join(lines))
        ends = np.asarray([i for i, w in enumerate(words) if w == "\n"] + [len(words)])
        firsts = np.concatenate([[0], np.cumsum(np.diff(ends, prepend=-1) - 1)])
        ids, count = self.of_words([w for w in words if w != "\n"])
        return ids, sums(count, firsts)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each whole text.

    Every match of pattern is encoded by itself: a match that is ranked as a whole is one id, else the pair of neighbours of
    least rank, leftmost first, is merged until no pair is ranked. Null and empty texts have no ids. Special strings are
    ordinary text. Texts of any length are encoded whole. Repeated rows keep their rows, an empty table gives an empty result;
    other columns are not read.
    """

    def make():
        coder = RankCoder(ranks, pattern)

        def each(part):
            ids, count = coder.encode(part["text"])
            return {"doc_id": part["doc_id"], "n_tokens": count, "ids": binary(ids, count * 4)}

        return each

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")), make, "doc_id long, n_tokens long, ids binary", text_slices)


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds decoded (binary): the bytes of the ids. Null ids give null."""

    def make():
        token = RankTable(ranks).token

        def each(part):
            out = [None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part["ids"].to_pylist()]
            return {c: part[c] for c in part.schema.names} | {"decoded": pa.array(out, pa.binary())}

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_rows(encoded, make, schema + ", decoded binary")
