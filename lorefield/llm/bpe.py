"""Byte-level BPE primitives shared by the token operators.

Texts are cut into *chunks* before a space that a non-space follows.  Under the
split pattern no match runs across such a place and no match on one side
depends on the other side, so a chunk's tokens never depend on its neighbours.
That makes a chunk the unit of caching: the same chunk is encoded once per
Python worker and not once per occurrence.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import regex
import tiktoken

CUT = re.compile(r" (?=\S)")
LETTERS = regex.compile(r"\p{L}+")
#: Unicode's White_Space, which the tokenizer libraries mean by ``\s``; Python's differs in U+001C-U+001F.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN_INSIDE = re.compile(rf"[{WHITE}]{{2,}}(?=[^{WHITE}])")
#: Chunks longer than this are encoded on the spot and not cached.
CACHED_CHARS = 48
#: Entries of a cache before it is emptied.
CACHE_ENTRIES = 300_000
#: A space before any of these is no cut; without such pairs a plain split finds the cuts.
_NO_CUT = [" " + chr(c) for c in range(0x3001) if chr(c).isspace()]


def heads(text: str) -> list[str]:
    """The chunks of a text, all but the first without their leading space."""
    if text.endswith(" ") or any(pair in text for pair in _NO_CUT):
        return CUT.split(text)
    return text.split(" ")


def chunks(text: str) -> list[str]:
    """``text`` as independent chunks; all but the first begin with a space."""
    head, *rest = heads(text)
    return [head, *(" " + x for x in rest)] if head else [" " + x for x in rest]


class ByteBPE:
    """A rank file with its split pattern.

    ``piece`` encodes the bytes of one match, ``encode`` any text.  ``valid``
    tells whether two tokens may stand side by side inside one match: a list
    of tokens is the encoding of its bytes exactly when all neighbours may.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self._set({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _set(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.special = ranks, {}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.pattern = regex.compile(white)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        ends: dict[bytes, set[int]] = {}
        for token in self.ranks:
            ends.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of the tokens that end in these two bytes, and of the single bytes.
        self.ending = {k: sorted(v | {1}, reverse=True) for k, v in ends.items()}
        self._pairs: dict[int, bool] = {}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def piece(self, data: bytes) -> list[int]:
        return self.encoding._encode_single_piece(data)

    def valid(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self.piece(self.token[left] + self.token[right]) == [left, right]
        return known


    @classmethod
    def from_json(cls, path: str, pattern: str) -> ByteBPE:
        """The vocabulary of a tokenizers file, if its merges are in the order of their ids.

        Then the lowest merge and the lowest rank are the same, and so are the ids.
        """
        import json

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, own = file["model"], cls.__new__(cls)
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        ids = [model["vocab"][t] for t in merged]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        if ids != sorted(ids) or len(set(ids)) != len(ids) or any(model["vocab"][c] > ids[0] for c in byte_of):
            raise ValueError("merges are not in the order of their ids")
        names = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t) and (len(t) == 1 or i >= ids[0])}
        if any(t[how] for t in file["added_tokens"] for how in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what stands beside them are not read")
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        own._set({bytes(byte_of[c] for c in t): i for t, i in names.items() if t not in special}, pattern)
        own.special = special
        return own


def _byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: itself if it prints, else the next free one from 256."""
    free = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=4)
def load_json_bpe(path: str, pattern: str) -> ByteBPE:
    """One instance per Python worker."""
    return ByteBPE.from_json(path, pattern)


@lru_cache(maxsize=2)
def load_prefix_counter(path: str, pattern: str) -> PrefixCounter:
    """One instance per Python worker: what one task has learnt serves the next."""
    return PrefixCounter(load_json_bpe(path, pattern))


@lru_cache(maxsize=4)
def load_bpe(path: str, pattern: str) -> ByteBPE:
    """One instance per Python worker."""
    return ByteBPE(path, pattern)


class ChunkEncoder:
    """Packed ids of a text's chunks, from a cache that misses fill in batches.

    Chunks that are not known yet are encoded together as one string, which the
    cuts between them allow, and dealt back by their byte lengths.
    """

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self._known: dict[str, bytes] = {}

    def _fill(self, missing: list[str]) -> dict[str, bytes]:
        ids = np.array(self.bpe.encode(" " + " ".join(missing)), "<u4")
        ends = np.searchsorted(np.cumsum(self.bpe.length[ids]), np.cumsum([len(c.encode("utf-8")) + 1 for c in missing])) + 1
        packed, found, start = ids.tobytes(), {}, 0
        for chunk, end in zip(missing, (4 * ends).tolist()):
            found[chunk] = packed[start:end]
            start = end
        if len(self._known) + len(found) > CACHE_ENTRIES:
            self._known.clear()
        self._known.update((c, ids) for c, ids in found.items() if len(c) <= CACHED_CHARS)
        return found

    def packed(self, text: str) -> list[bytes]:
        """One entry for each chunk; an empty head counts as a chunk without ids."""
        head, *rest = heads(text)
        get = self._known.get
        found = [get(c) for c in rest]
        if None in found:
            fresh = self._fill(list({c for c, ids in zip(rest, found) if ids is None}))
            found = [fresh[c] if ids is None else ids for c, ids in zip(rest, found)]
        return [np.array(self.bpe.encode(head), "<u4").tobytes(), *found]


# --------------------------------------------------------------------------
# counts at every prefix


def prefix_programs(bpe: ByteBPE, pieces: list[bytes]) -> Iterator[list[int]]:
    """For each of the sorted pieces the token counts of ``data[:0] … data[:n]``, each as if encoded alone.

    ``start[i]`` is where the final token of the encoding of ``data[:i]`` begins and
    ``last[i]`` that token: the one that ends there and may follow ``last[start[i]]``.
    The count follows from the shorter prefix by adding one.  No other token passes
    that test, so the likeliest, the last one grown by a byte, is tried first.  A piece
    goes on from the states of the prefix that it shares with the piece before it.
    """
    ranks, ending, valid = bpe.ranks, bpe.ending, bpe.valid
    last, start, count, before = [-1], [0], [0], b""
    for data in pieces:
        same = next((k for k, (x, y) in enumerate(zip(before, data)) if x != y), min(len(before), len(data)))
        del last[same + 1 :], start[same + 1 :], count[same + 1 :]
        for i in range(same + 1, len(data) + 1):
            j = start[i - 1]
            token = ranks.get(data[j:i])
            if token is None or (j and not valid(last[j], token)):
                grown = i - j
                for n in ending.get(data[max(0, i - 2) : i], (1,)):
                    if n == grown or n > i:
                        continue
                    j = i - n
                    token = ranks.get(data[j:i])
                    if token is not None and (j == 0 or valid(last[j], token)):
                        break
                else:
                    raise ValueError("the rank file lacks a single byte")
            last.append(token)
            start.append(j)
            count.append(count[j] + 1)
        before = data
        yield count


#: Longer pieces go through the program one by one.
TABLE_BYTES = 32
_LOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class PrefixTables:
    """The program of ``prefix_programs`` for many pieces at a time, a byte place after another.

    Pieces are rows in order; at each place only rows that differ from the row before
    are worked on, and the others take over its state.  Tokens are found by the hash of
    their bytes, from running hashes of the rows; whether two tokens may stand side by
    side is kept in a table of fixed size.
    """

    def __init__(self, bpe: ByteBPE, slots: int = 1 << 20):
        self.bpe = bpe
        rng = np.random.default_rng(20260704)
        self.letter = rng.integers(1, 1 << 63, 256, np.uint64)
        self.power = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * TABLE_BYTES, np.uint64))
        self.longest = min(TABLE_BYTES, max(map(len, bpe.ranks)))
        short = [(t, r) for t, r in bpe.ranks.items() if len(t) <= TABLE_BYTES]
        keys = self._running([t for t, _ in short])[1]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([r for _, r in short], np.int64)[order]
        self.pair_key, self.pair_ok = np.full(slots, _LOST), np.zeros(slots, bool)

    def _running(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running hashes of the rows, hashes of whole rows, their lengths, their bytes."""
        size = np.array([len(p) for p in pieces])
        data = np.array(pieces, f"S{TABLE_BYTES}").view(np.uint8).reshape(len(pieces), TABLE_BYTES)
        running = np.zeros((len(pieces), TABLE_BYTES + 1), np.uint64)
        for k in range(int(size.max())):
            running[:, k + 1] = running[:, k] * self.power[1] + self.letter[data[:, k]]
        return running, running[np.arange(len(pieces)), size], size, data

    def _tokens(self, running: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: int) -> np.ndarray:
        """The token that the bytes from ``begin`` to ``end`` of each row are, or -1."""
        key = running[rows, end] - running[rows, begin] * self.power[end - begin]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)

    def _valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = ((key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) & (len(self.pair_key) - 1)
        missing = self.pair_key[slot] != key
        if not missing.any():
            return self.pair_ok[slot]
        ok = self.pair_ok[slot]
        fresh, back = np.unique(key[missing], return_inverse=True)
        token, piece = self.bpe.token, self.bpe.piece
        found = np.fromiter((len(got := piece(token[a] + token[b])) == 2 and got[0] == a for a, b in zip((fresh >> np.uint64(32)).tolist(), (fresh & np.uint64(0xFFFFFFFF)).tolist())), bool, len(fresh))
        ok[missing] = found[back]
        self.pair_key[slot[missing]] = key[missing]
        self.pair_ok[slot[missing]] = ok[missing]
        return ok

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token counts of each prefix (rows, places), the rows' lengths and bytes; ``pieces`` sorted, none empty or long."""
        running, _, size, data = self._running(pieces)
        n, width = len(pieces), int(size.max())
        same = np.zeros(n, np.int64)
        if n > 1:
            apart = data[1:] != data[:-1]
            same[1:] = np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), TABLE_BYTES), np.minimum(size[1:], size[:-1]))
        last, start, count = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int8), np.zeros((n, width + 1), np.int16)
        every = np.arange(n)
        for end in range(1, width + 1):
            own = (same < end) & (size >= end)
            rows = np.flatnonzero(own)
            begin = start[rows, end - 1].astype(np.int64)
            grown = end - begin
            token = self._fitting(running, last, rows, begin, end)
            open_ = np.flatnonzero(token < 0)
            for length in range(1, min(end, self.longest) + 1):
                if not len(open_):
                    break
                tried = open_[grown[open_] != length]
                at = np.full(len(tried), end - length)
                got = self._fitting(running, last, rows[tried], at, end)
                hit = tried[got >= 0]
                token[hit], begin[hit] = got[got >= 0], end - length
                open_ = open_[token[open_] < 0]
            if len(open_):
                raise ValueError("the rank file lacks a single byte")
            last[rows, end], start[rows, end], count[rows, end] = token, begin, count[rows, begin] + 1
            row = np.maximum.accumulate(np.where(own, every, 0))  # the others share this prefix with the row before
            last[:, end], start[:, end], count[:, end] = last[row, end], start[row, end], count[row, end]
        return count, size, data

    def _fitting(self, running, last, rows, begin, end) -> np.ndarray:
        """Tokens from ``begin`` to ``end`` that may follow the last token before ``begin``, or -1."""
        token = self._tokens(running, rows, begin, end)
        ask = np.flatnonzero((token >= 0) & (begin > 0))
        if len(ask):
            bad = ask[~self._valid(last[rows[ask], begin[ask]], token[ask])]
            token[bad] = -1
        return token

    def steps(self, pieces: list[bytes]) -> Iterator[bytes]:
        """For each of the sorted pieces its steps by code points, packed as 16-bit numbers."""
        count, size, data = self.counts(pieces)
        begins = np.zeros((len(pieces), count.shape[1]), bool)  # a code point begins after this many bytes, or the piece ends
        begins[:, :-1] = (data[:, : count.shape[1] - 1] & 0xC0) != 0x80
        begins &= np.arange(count.shape[1])[None, :] < size[:, None]
        begins[np.arange(len(pieces)), size] = True
        begins[:, 0] = False
        ends = count[begins]
        letters = begins.sum(axis=1)
        first = np.cumsum(letters) - letters
        steps = np.diff(ends, prepend=0)
        steps[first] = ends[first]
        packed, edge = steps.astype(np.int16).tobytes(), (2 * np.append(first, len(ends))).tolist()
        for a, b in zip(edge, edge[1:]):
            yield packed[a:b]


def _packed_steps(counts: list[int]) -> bytes:
    return array("h", map(sub, counts[1:], counts)).tobytes()


class PrefixCounter:
    """Exact token counts for every prefix of a text, as steps from each prefix to the next.

    A prefix of a text ends inside one match of the split pattern; the matches before
    it stay as they are.  So a text's steps are those of its matches, one after another,
    but for two cases: a contraction cut short falls into a quote and letters, and white
    space that ends a prefix is one match where the whole text gives its last character
    to what follows.  Steps of chunks are kept, so a text that is made of known chunks
    takes lookups only; those of a block that are not known are worked out together.
    """

    def __init__(self, bpe: ByteBPE, entries: int = 400_000):
        self.bpe, self.entries, self.tables = bpe, entries, PrefixTables(bpe)
        self._known: dict[str, bytes] = {}  # chunks without their leading space

    def _of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Steps of pieces by code points; in order, so that they share prefixes."""
        listed = sorted(pieces)  # as strings: UTF-8 has the order of code points
        coded = [p.encode("utf-8") for p in listed]
        long = [k for k, d in enumerate(coded) if len(d) > TABLE_BYTES]
        out = {}
        for k, counts in zip(long, prefix_programs(self.bpe, [coded[k] for k in long])):
            if len(coded[k]) > len(listed[k]):
                ends, at = [0], 0
                for ch in listed[k]:
                    at += len(ch.encode("utf-8"))
                    ends.append(at)
                counts = [counts[e] for e in ends]
            out[listed[k]] = _packed_steps(counts)
        if long:
            listed, coded = [p for p in listed if p not in out], [d for d in coded if len(d) <= TABLE_BYTES]
        if listed:
            out.update(zip(listed, self.tables.steps(coded)))
        return out

    def _contraction(self, piece: str) -> bytes:
        quote, rest = len(self.bpe.piece(b"'")), piece[1:-1].encode("utf-8")
        before = [len(self.bpe.piece(rest[:k])) for k in range(1, len(rest) + 1)]
        return _packed_steps([0, quote, *(quote + n for n in before), len(self.bpe.piece(piece.encode("utf-8")))])

    def _fill(self, fresh: list[str]) -> list[bytes]:
        """Steps of chunks; one of a space and letters is a match by itself."""
        found = self.bpe.pattern.findall
        split = [None if c[1:].isalpha() and c[0] == " " else found(c) for c in fresh]
        pieces = {c for c, ps in zip(fresh, split) if ps is None}
        pieces.update(p for ps in split if ps is not None for p in ps)
        known = self._of_pieces(pieces)
        out = []
        for chunk, ps in zip(fresh, split):
            if ps is None:
                out.append(known[chunk])
            elif "'" in chunk:
                out.append(b"".join([self._contraction(p) if p[0] == "'" and len(p) > 1 and p[1].isalpha() else known[p] for p in ps]))
            else:
                out.append(b"".join([known[p] for p in ps]))
        return out

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """For each text one number a code point: what it adds to the count of the prefix before it."""
        split = [heads(t) for t in texts]
        first = [parts.pop(0) for parts in split]
        if len(self._known) > self.entries:
            self._known.clear()
        fresh = list(set().union(*split).difference(self._known))
        firsts = list({x for x in first if x})
        filled = self._fill([" " + c for c in fresh] + firsts)
        at_first = dict(zip(firsts, filled[len(fresh) :])) | {"": b""}
        long = {c: s for c, s in zip(fresh, filled) if len(c) > CACHED_CHARS}
        self._known.update(zip(fresh, filled))
        out = [self._whole(t, at_first[x] + b"".join(map(self._known.__getitem__, parts))) for t, x, parts in zip(texts, first, split)]
        for c in long:
            del self._known[c]
        return out

    def _whole(self, text: str, packed: bytes) -> np.ndarray:
        steps = np.frombuffer(packed, np.int16)
        runs = [m.span() for m in RUN_INSIDE.finditer(text)]
        if runs:
            steps = steps.copy()
            whole = self._of_pieces({text[a:b] for a, b in runs})
            for a, b in runs:  # as one match up to its end; what follows is then as before
                more = sum(array("h", whole[text[a:b]])) - int(steps[a:b].sum())
                steps[b - 1] += more
                steps[b] -= more
        return steps

    def steps(self, text: str) -> np.ndarray:
        return self.block([text])[0]


class SpecialSplitter:
    """Cuts a text at the special strings of a tokenizer file: the leftmost first, of those the longest."""

    def __init__(self, special: dict[str, int]):
        self.ids = special
        self.pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special strings by turns, beginning and ending with ordinary text."""
        return self.pattern.split(text) if self.pattern and any(s in text for s in self.ids) else [text]


# --------------------------------------------------------------------------
# encoding as a tree reduction


class TreeEncoder:
    """Encodes halves and joins them; packed little-endian 32-bit ids throughout."""

    def __init__(self, bpe: ByteBPE, leaf_chars: int = 2048):
        self.bpe, self.leaf_chars, self.chunks = bpe, leaf_chars, ChunkEncoder(bpe)

    def leaf(self, text: str) -> bytes:
        return b"".join(self.chunks.packed(text)) if text else b""

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> bytes:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf_chars:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def _trim(self, ids: np.ndarray, n_bytes: int, from_end: bool) -> int | None:
        """How many tokens at one end make up ``n_bytes`` exactly."""
        step = 64
        while True:
            part = ids[-step:][::-1] if from_end else ids[:step]
            ends = np.cumsum(self.bpe.length[part])
            if len(ends) == len(ids) or (len(ends) and ends[-1] >= n_bytes):
                k = int(np.searchsorted(ends, n_bytes))
                return 0 if n_bytes == 0 else (k + 1 if k < len(ends) and ends[k] == n_bytes else None)
            step *= 4

    def join(self, text: str, lo: int, mid: int, hi: int, left: bytes, right: bytes) -> bytes:
        """Neighbours' tokens with the window around ``mid`` encoded again.

        The window grows on both sides until it ends at places whose outside no
        longer depends on it: a cut between chunks, or the end of the span; or,
        inside a long run of letters, tokens that may stand next to the
        window's own.
        """
        if CUT.match(text, mid, min(hi, mid + 2)):
            return left + right
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        width, was_a, was_b = 32, None, None
        while True:
            from_, to = max(lo, mid - width), min(hi, mid + width)
            cuts = [m.start() for m in CUT.finditer(text, from_, to)]
            start = next((c for c in reversed(cuts) if lo < c < mid), lo if from_ == lo else None)
            end = next((c for c in cuts if c > mid), hi if to == hi else None)
            if start is not None and end is not None:
                drop = self._trim(a, len(text[start:mid].encode("utf-8")), True)
                skip = self._trim(b, len(text[mid:end].encode("utf-8")), False)
                if drop is not None and skip is not None:
                    return left[: len(left) - 4 * drop] + self.leaf(text[start:end]) + right[4 * skip :]
            elif width > CACHED_CHARS and LETTERS.fullmatch(text, from_, to):
                got = self._within(a, b, width // 8)
                if got is not None:
                    return got
            if from_ == lo and to == hi:
                return self.leaf(text[lo:hi])
            width *= 2

    def _within(self, a: np.ndarray, b: np.ndarray, k: int) -> bytes | None:
        """Both ends lie in one long match: encode ``k`` tokens of each again."""
        if len(a) <= k + 1 or len(b) <= k + 1:
            return None
        token = self.bpe.token
        if sum(len(token[i]) for i in a[-k:]) > 4 * k or sum(len(token[i]) for i in b[:k]) > 4 * k:
            return None  # the window might leave the run of letters
        mid = self.bpe.piece(b"".join([token[i] for i in a[-k:]] + [token[i] for i in b[:k]]))
        if self.bpe.valid(int(a[-k - 1]), mid[0]) and self.bpe.valid(mid[-1], int(b[k])):
            return a[:-k].tobytes() + np.array(mid, "<u4").tobytes() + b[k:].tobytes()
        return None

    def decode(self, packed: bytes, leaf_ids: int = 8192) -> bytes:
        """Leaves decode by table; parents concatenate."""
        if len(packed) <= 4 * leaf_ids:
            token = self.bpe.token
            return b"".join([token[i] for i in np.frombuffer(packed, "<u4").tolist()])
        half = len(packed) // 8 * 4
        return self.decode(packed[:half], leaf_ids) + self.decode(packed[half:], leaf_ids)
