"""Sets of word shingles as sorted 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes of text worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for each word, eight bytes after another; ``data`` ends with eight spare bytes."""
    lanes = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), (len(data) - 7, 8), (1, 1))
    h = mix(size.astype(np.uint64) * SEEDS[0])
    rest, at, who = size.copy(), start.copy(), np.arange(len(start))
    while len(who):
        lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel() & _LOW[np.minimum(rest, 8)]
        h[who] = mix(h[who] ^ (lane * SEEDS[1] + SEEDS[2]))
        more = rest > 8
        who, at, rest = who[more], at[more] + 8, rest[more] - 8
    return h


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct ``WORDS``-word shingles of each text, sorted.

    Words are runs of bytes other than white space, A-Z in lower case.  A text of
    fewer words has its whole sequence as one shingle; one without words has none.
    """
    raw = [(t or "").encode("utf-8").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
    edges = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data[: edges[-1]]]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    words = _word_hashes(data, start, end - start)
    last = np.searchsorted(start, edges)  # one past each text's last word
    first = np.concatenate([[0], last[:-1]])
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * SEEDS[k]
    runs = mix(runs)
    sets = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= WORDS:
            sets.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * SEEDS[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            sets.append(mix(mix(np.array([short], np.uint64)) ^ SEEDS[4]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_blocks(batches: Iterable, text_at: int = 1) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(other columns' slices, sets) of Arrow batches, about ``BLOCK_BYTES`` of text at a time."""
    for batch in batches:
        texts = batch.column(text_at)
        others = [c for i, c in enumerate(batch.columns) if i != text_at]
        held, size, begin = [], 0, 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            held.append(text)
            size += len(text or "")
            if size >= BLOCK_BYTES or i + 1 == len(texts):
                yield [c.slice(begin, i + 1 - begin) for c in others], shingle_sets(held)
                held, size, begin = [], 0, i + 1


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set as two columns of signed numbers; equal sets have equal ones."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i, 0] = (mix(s ^ SEEDS[1]) * SEEDS[2]).sum(dtype=np.uint64)
        out[i, 1] = mix(s + SEEDS[3]).sum(dtype=np.uint64)
    return mix(out).view(np.int64)


def set_parity(s: np.ndarray) -> bytes:
    """A bit for each residue of shingles, set where an odd number of them has it; 64 bits or more, about one or two for each shingle."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_gap(a: bytes, b: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the other's length; the sets differ in as many elements or more."""
    short, long = sorted((a, b), key=len)
    x, n = int.from_bytes(long, "little"), 8 * len(long)
    while n > 8 * len(short):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(short, "little")).bit_count()
