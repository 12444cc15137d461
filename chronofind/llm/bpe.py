"""Byte-pair encoding by backtracking: exact merges in linear time.

An Aho-Corasick automaton gives the longest token that starts at each byte. Tokens are taken greedily; a
pair may stand side by side only if encoding their joined bytes gives just that pair, which a table of
merges decides. Where a token doesn't fit, its next shorter prefix is tried, and where none does, the
last token is taken back. Each end position is ruled out at most once, which bounds the work.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex

# Fixed values of byte-level BPE: the pattern that splits text before the merges, and the printable
# characters that stand for bytes in vocabulary files (bytes without a printable one follow from 256 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Pieces remembered by a worker, and the characters of the longest of them.
CACHE, REMEMBERED = 1 << 18, 64


def _byte_of() -> dict[str, int]:
    table = {chr(b): b for b in _PRINTABLE}
    for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE)):
        table[chr(256 + i)] = b
    return table


class Encoder:
    """Encoder and decoder of one vocabulary file (model of type BPE, ids in order of the merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of()
        raw = {word: bytes(byte_of[c] for c in word) for word in model["vocab"] if all(c in byte_of for c in word)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        reached = {w for a, b in merges for w in (a, b, a + b)} | {c for c in byte_of}
        self.bytes_of = {i: raw[w] for w, i in vocab.items() if w in raw and w in reached}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        #: (left, right) -> token, and how each token is made. A token's rank is its merge's place; bytes come first.
        self.merged, self.made, rank = {}, {}, {}
        for b in (i for i, x in self.bytes_of.items() if len(x) == 1):
            self.made[b], rank[b] = (b, b), -1
        for place, (a, b) in enumerate(merges):
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = token
            if token not in self.made:
                self.made[token], rank[token] = (vocab[a], vocab[b]), place
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for token, content in self.bytes_of.items():
            self.automaton.add_word(content.decode("latin-1"), (len(content), token))
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self._known_piece = lru_cache(CACHE)(self._encode_piece)
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size + 1, np.int64)
        for token, content in self.bytes_of.items():
            lengths[token + 1] = len(content)
        self.offsets = np.cumsum(lengths)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        if (found := self._shorter.get(token)) is None:
            text = self.bytes_of[token].decode("latin-1")
            # Matches come in order of their ends; those as long as what was read begin where the token does.
            prefixes = [t for end, (size, t) in self.automaton.iter(text) if size == end + 1 < len(text)]
            found = self._shorter[token] = prefixes[-1] if prefixes else -1
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging would leave the two tokens side by side as they are."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, the latest first, and look at what touches at the seam: a merge
        across it that comes before the one undone last would have been made instead."""
        rank, made, merged = self.rank, self.made, self.merged
        bound, from_left = len(merged) + 1, True
        while True:
            across = merged.get((left, right))
            if across is not None:
                r = rank[across]
                # A tie is won by the merge that stands further left.
                if r < bound or (r == bound and not from_left):
                    return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # Of equal merges the left one is made first, so the right one is undone first.
            if a > b:
                bound, from_left, left = a, True, made[left][1]
            else:
                bound, from_left, right = b, False, made[right][0]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        if (whole := self.id_of.get(data)) is not None:
            # The longest match at the first byte, with nothing before it to disagree.
            return (whole,)
        n = len(data)
        longest = [0] * n
        best = [-1] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > longest[start]:
                longest[start], best[start] = size, token
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        size_of = self.bytes_of
        while at < n:
            while True:
                end = at + len(size_of[token])
                if open_[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    token = best[at] if at < n else -1
                    break
                token = self.shorter(token)
                if token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= len(size_of[token])
        return tuple(out)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        return self._known_piece(piece) if len(piece) <= REMEMBERED else self._encode_piece(piece)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose names are ordinary text. Null and empty texts give none."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.encode_piece, self.split(text))))

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """encode for each text. Every different piece is encoded once, and ids are gathered by the pieces' places."""
        pieces = [self.split(t) if t else [] for t in texts]
        coded = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        encoded = list(map(self.encode_piece, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.r_[0, np.cumsum(each)]
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], each)
        last = np.cumsum(np.r_[0, np.fromiter(map(len, pieces), np.int64, len(pieces))])
        return pa.ListArray.from_arrays(pa.array(ends[last].astype(np.int32)), pa.array(ids[at]))

    def decode_bytes(self, ids: list[int] | np.ndarray) -> bytes:
        """The bytes of the ids, gathered through the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
