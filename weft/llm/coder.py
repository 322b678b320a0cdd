"""Exact, memoised encoding of whole texts, a batch of texts at a time.

Texts are cut where a tokenizer's own pattern always cuts: at single blanks and line ends. The pieces of a batch are
dictionary-encoded by Arrow, each distinct piece is encoded once (and remembered in the worker), and the ids of the texts
are gathered by numpy. The short cut holds only for texts of plain characters with no run of white space and no special
string; every other text is encoded as a whole. So the ids are the tokenizer's own in all cases.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose class, case and normal form are the same in every Unicode version: ASCII, Latin-1 and Latin Extended-A.
SAFE = r"\x20-\x7e\n\x{a1}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}"
UNSAFE = f"[^{SAFE}]"
UNSAFE_OR_RUN = f"{UNSAFE}|[ \n][ \n]"
CUT = "\x00"
#: Bytes of text that a worker handles at a time.
SLICE_BYTES = 6 << 20


class Memo(dict):
    """make(key) for keys not seen yet.

    At the given number of entries, which bounds the worker's memory, the later half goes: frequent keys come early and stay.
    """

    def __init__(self, make: Callable, entries: int = 300_000):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            stay = dict(islice(self.items(), self.entries // 2))
            self.clear()
            self.update(stay)
        value = self[key] = self.make(key)
        return value


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about `size` bytes together, at least one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype="int64")
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(place in the list of each word, first word of each text and the end, distinct words) of lower-cased texts cut at white space."""
    return distinct_words(pc.utf8_split_whitespace(pc.utf8_lower(texts)))


def split_at_blanks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same for pieces that keep the blank before them; line ends are pieces. For texts without runs of white space."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", f"{CUT}\n{CUT}")
    return distinct_words(pc.split_pattern(marked, CUT))


def distinct_words(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    offsets = lists.offsets.to_numpy().astype("int64")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary.to_pylist()


def gather(places: np.ndarray, pool: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in order, number of ids of each word) where pool has the ids of the distinct words, sizes how many each."""
    starts = np.cumsum(sizes) - sizes
    count = sizes[places]
    ends = np.cumsum(count)
    at = np.repeat(starts[places] - (ends - count), count)
    at += np.arange(len(at))
    return pool[at], count


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each stretch between offsets; stretches may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


class BatchCoder:
    """Ids of whole texts: plain tells which texts may be cut, split cuts them, encode_pieces gives (ids, number of ids of
    each) of distinct pieces, encode_text the ids of a whole text."""

    def __init__(self, plain: Callable[[pa.Array], np.ndarray], split: Callable, encode_pieces: Callable, encode_text: Callable[[str], np.ndarray]):
        self.plain, self.split, self.encode_pieces, self.encode_text = plain, split, encode_pieces, encode_text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)"""
        plain = self.plain(texts)
        if plain.all() and len(texts):
            places, offsets, words = self.split(texts)
            ids, count = gather(places, *self.encode_pieces(words))
            return ids, sums(count, offsets)
        parts: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        where = np.nonzero(plain)[0]
        if len(where):
            ids, count = self.encode(texts.take(pa.array(where)))
            for i, part in zip(where.tolist(), np.split(ids, np.cumsum(count)[:-1])):
                parts[i] = part
        for i in np.nonzero(~plain)[0].tolist():
            parts[i] = self.encode_text(texts[i].as_py())
        return np.concatenate([np.zeros(0, "<u4"), *parts]), np.fromiter(map(len, parts), "int64", len(parts))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        plain = self.plain(texts)
        out = np.zeros(len(texts), "int64")
        where = np.nonzero(plain)[0]
        if len(where):
            places, offsets, words = self.split(texts if len(where) == len(texts) else texts.take(pa.array(where)))
            out[where] = sums(self.encode_pieces(words)[1][places], offsets)
        for i in np.nonzero(~plain)[0].tolist():
            out[i] = len(self.encode_text(texts[i].as_py()))
        return out


def without(texts: pa.Array, regex: str, strings: list[str] = ()) -> np.ndarray:
    """Which texts match neither the regular expression nor hold one of the strings."""
    found = pc.match_substring_regex(texts, regex)
    for s in strings:
        found = pc.or_(found, pc.match_substring(texts, s))
    return ~found.to_numpy(zero_copy_only=False)


def with_blanks(pieces: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], blank: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """encode for pieces that are more than white space, blank for the others: no more than a few among distinct pieces."""
    real = np.fromiter(map(bool, map(str.strip, pieces)), bool, len(pieces))
    sizes = np.zeros(len(pieces), "int64")
    ids, sizes[real] = encode([p for p, r in zip(pieces, real.tolist()) if r])
    for at in np.nonzero(~real)[0].tolist():
        own = blank(pieces[at])
        ids = np.insert(ids, int(sizes[:at].sum()), own)
        sizes[at] = len(own)
    return ids, sizes


def in_lines(lines: list[str], encode: Callable[[str], np.ndarray], line_end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each of the lines (no line ends or empty lines among them) from those of all of them together."""
    if not lines:
        return np.zeros(0, "<u4"), np.zeros(0, "int64")
    ids = encode("\n".join(lines))
    ends = np.append(np.nonzero(ids == line_end)[0], len(ids))
    return ids[ids != line_end], np.diff(ends, prepend=-1) - 1


class LibraryCoder(BatchCoder):
    """Ids of a file of the tokenizers library, without added special tokens; special strings in texts as its default has them.

    The pieces of plain texts are merged by the tiktoken library with the ranks of the same file, which gives the same ids
    where the merges are listed in the order of the ids they make; other files are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t["content"] for t in spec["added_tokens"]]
        before, normal, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        made = [model["vocab"].get(m, -1) for m in merged]
        ordered = model["type"] == "BPE" and all(x < y for x, y in zip(made, made[1:])) and not model.get("ignore_merges")
        split, unsafe, pieces = None, UNSAFE, None
        if ordered and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and not normal and not model["end_of_word_suffix"]:
            split, unsafe, pieces = split_at_blanks, UNSAFE_OR_RUN, self.blank_pieces(model, specials)
        elif ordered and normal and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and before.get("type") == "Sequence" and model["end_of_word_suffix"]:
            cut = before["pretokenizers"][0]
            if cut["type"] == "Split" and cut["behavior"] == "Removed" and cut["invert"]:
                split, pieces = split_words, self.word_pieces(model, specials, cut["pattern"]["Regex"])
        super().__init__(
            (lambda texts: without(texts, unsafe, specials)) if split else (lambda texts: np.zeros(len(texts), bool)),
            split,
            pieces,
            lambda text: np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4"),
        )

    @staticmethod
    def ranks(model: dict, specials: list[str], end: bytes = b"") -> dict[bytes, int]:
        """Bytes of each vocabulary entry; a suffix that ends a word becomes the byte `end`."""
        # byte-level characters: printable Latin-1 for itself, the other bytes in order from 256 on
        plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        suffix, out = model["end_of_word_suffix"] or "", {}
        for token, rank in model["vocab"].items():
            if token in specials:
                continue
            ended = bool(suffix) and token.endswith(suffix)
            out[bytes(byte[c] for c in (token[: -len(suffix)] if ended else token)) + (end if ended else b"")] = rank
        return out

    def blank_pieces(self, model: dict, specials: list[str]) -> Callable:
        import tiktoken
        from public_tokenizers import PATTERN

        merge = tiktoken.Encoding("blank", pat_str=PATTERN, mergeable_ranks=(ranks := self.ranks(model, specials)), special_tokens={})
        line_end = ranks[b"\n"]

        def encode(text: str) -> np.ndarray:
            return merge.encode_to_numpy(text, disallowed_special=())

        return lambda found: with_blanks(found, lambda real: in_lines(real, encode, line_end), encode)

    def word_pieces(self, model: dict, specials: list[str], pattern: str) -> Callable:
        import regex
        import tiktoken

        end = "\x01"  # not a plain character; a last character and its end merge first, since their ids are the least
        ranks = self.ranks(model, specials, end.encode())
        merge = tiktoken.Encoding("words", pat_str=f"[^{end}\n]+{end}|\n", mergeable_ranks=ranks, special_tokens={})
        mark, line_end = regex.compile(pattern), ranks[b"\n"]

        def pieces(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.zeros(len(found), "int64")
            real = np.asarray([bool(p) for p in found], bool)
            ids, sizes[real] = in_lines([p for p in found if p], lambda text: merge.encode_to_numpy(mark.sub(rf"\g<0>{end}", text), disallowed_special=()), line_end)
            return ids, sizes

        return pieces
