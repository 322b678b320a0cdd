"""Terminal coders: round trips over edge cases, sizes, and what they refuse."""

import numpy as np
import pytest

from weft.operators import coders

RNG = np.random.default_rng(1)
BYTES = {
    "empty": b"", "one": b"x", "same": b"a" * 1000, "two": b"ab" * 500, "all": bytes(range(256)) * 8, "text": b"the quick brown fox jumps over the lazy dog. " * 40, "random": RNG.integers(0, 256, 4096, "u1").tobytes(),
    "skewed": RNG.geometric(0.3, 4096).astype("u1").tobytes(), "fibonacci": b"".join(bytes([i]) * n for i, n in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657])), "zeros": bytes(64),
}


@pytest.mark.parametrize("name", sorted(set(coders.CODERS) - {"constant", "field_lz"}))
@pytest.mark.parametrize("data", sorted(BYTES))
def test_bytes(name, data):
    coder, raw = coders.CODERS[name], BYTES[data]
    assert coder.decode(coder.encode(raw, 1), 1) == raw


@pytest.mark.parametrize("width", [2, 4, 8])
@pytest.mark.parametrize("name", ["store", "huffman", "bitpack", "partition_bitpack", "field_lz", "lz"])
def test_fields(name, width):
    coder = coders.CODERS[name]
    for x in ([], [7], [0, 0], list(range(300)), [1, 2, 3, 4] * 100, RNG.integers(0, 50, 3000).tolist(), (RNG.integers(0, 1 << 15, 2000)).tolist(), [5] * 3000):
        raw = np.asarray(x, f"<u{width}").tobytes()
        if name == "huffman" and width > 2:
            with pytest.raises(ValueError):
                coder.encode(raw, width)
            return
        assert coder.decode(coder.encode(raw, width), width) == raw


def test_whole_range_of_fields():
    for width in (2, 4, 8):
        raw = np.asarray([0, (1 << 8 * width) - 1, 1, (1 << 8 * width - 1)], f"<u{width}").tobytes()
        for name in ("bitpack", "field_lz"):
            assert coders.CODERS[name].decode(coders.CODERS[name].encode(raw, width), width) == raw


def test_prefix_codes_are_best():
    """Sizes of all merges add up to the length of the code; the code is complete."""
    import heapq

    for counts in ([1, 1], [5, 1, 1], list(range(1, 40)), RNG.integers(1, 1000, 200).tolist()):
        lengths = coders.code_lengths(np.asarray(counts))
        heap, total = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert (lengths * counts).sum() == total and sum(2.0**-n for n in lengths) == 1.0
    assert coders.code_lengths(np.asarray([2**i for i in range(40)])).max() <= 20


def test_entropy_coders_near_entropy():
    x = np.frombuffer(BYTES["skewed"], "u1")
    p = np.bincount(x) / len(x)
    bound = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(x) / 8
    for name in ("huffman", "fse"):
        assert bound <= len(coders.CODERS[name].encode(x.tobytes())) <= 1.05 * bound + 100


def test_partition_adapts():
    x = np.concatenate([RNG.integers(0, 16, 4000), RNG.integers(60_000, 60_016, 4000)]).astype("<u2")
    best, fast = (len(coders.partition_bitpack_encode(x.tobytes(), 2, fast)) for fast in (False, True))
    assert best <= fast and best < len(coders.bitpack_encode(x.tobytes(), 2)) * 0.5


def test_matches_shrink_and_overlap():
    x = np.tile(np.arange(50, dtype="<u4") * 77777, 100)
    assert len(coders.field_lz_encode(x.tobytes(), 4)) < x.nbytes / 20
    literals, runs, lengths, offsets = coders.match_lists(np.asarray([9] * 100), 2)
    assert coders.from_matches(literals, runs, lengths, offsets).tolist() == [9] * 100 and offsets.tolist() == [1]


def test_refusals():
    for call in (lambda: coders.constant_encode(b"ab"), lambda: coders.constant_encode(b""), lambda: coders.field_lz_encode(b"ab", 1), lambda: coders.fse_encode(b"abcd", 2), lambda: coders.bitpack_encode(b"abc", 2)):
        with pytest.raises(ValueError):
            call()
