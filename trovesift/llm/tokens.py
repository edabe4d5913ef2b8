"""Byte-level BPE token ids of whole Arrow batches, exactly as the tokenizer's own file (JSON, or ranks in base64) defines them.

Texts are cut into pre-tokens by array operations on code points, equal pre-tokens of a
worker are encoded once, and the ids of each text are put together by gathers.
"""

from __future__ import annotations

import base64
import json
import unicodedata

import numpy as np
import pyarrow as pa

from trovesift.llm import textops

# White space by Unicode's White_Space property; the pre-token pattern of this family of tokenizers.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Distinct pre-tokens that a worker remembers before it begins anew.
CACHE = 400_000


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    table[_WHITE] = _SPACE
    return table


class BpeEncoder:
    """Encodes with the vocabulary of a `tokenizers` JSON file of byte-level BPE, or of a `.tiktoken` file of ranks."""

    _kept: dict[str, BpeEncoder] = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        if path.endswith(".tiktoken"):
            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        else:
            with open(path, encoding="utf-8") as file:
                vocabulary = json.load(file)["model"]["vocab"]
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            of_char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(of_char[c] for c in token): i for token, i in vocabulary.items() if all(c in of_char for c in token) and token != "<|endoftext|>"}
        self.encoding = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = self.encoding.encode_ordinary("\n")[0]
        self.classes = _classes()
        self._forget()

    @classmethod
    def load(cls, path: str) -> BpeEncoder:
        """One encoder per worker and file."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _forget(self) -> None:
        self.known, self.place, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _store(self, rows: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Append ids to the memory; their places and lengths."""
        flat, lengths = rows
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        places = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return places, lengths

    def _encode_new(self, parts: list[bytes], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and their counts, for pre-tokens; the blank ones have white space only."""
        counts = np.zeros(len(parts), np.int64)
        words = np.flatnonzero(~blank)
        ids = np.array(self.encoding.encode_ordinary("\n".join(parts[k].decode() for k in words.tolist())), np.uint32)
        cuts = np.flatnonzero(ids == self.newline)
        ends, starts = np.concatenate([cuts, [len(ids)]]), np.concatenate([[0], cuts + 1])
        if len(words) and len(ends) != len(words):
            raise ValueError("pre-tokens don't come apart as they were joined")
        own = {}
        for k in np.flatnonzero(blank).tolist():
            own[k] = np.array(self.encoding.encode_ordinary(parts[k].decode()), np.uint32)
            counts[k] = len(own[k])
        if len(words):
            counts[words] = ends - starts
        flat = np.zeros(counts.sum(), np.uint32)
        at = np.cumsum(counts) - counts
        if len(words):
            flat[np.repeat(at[words] - (np.cumsum(counts[words]) - counts[words]), counts[words]) + np.arange(counts[words].sum())] = ids[ids != self.newline]
        for k, x in own.items():
            flat[at[k] : at[k] + len(x)] = x
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and n+1 bounds. Null texts are empty."""
        data, offsets = textops.text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        n = len(points)
        bounds = np.searchsorted(lead, offsets)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        space = kind == _SPACE
        before = np.concatenate([[False], space[:-1]])
        start = edge[:n] | (space & ~before)
        follows = np.concatenate([~space[1:], [False]]) & ~edge[1:]
        start |= space & follows
        blank_before = np.concatenate([[False], points[:-1] == 32])
        inner = ~space & ~edge[:n]
        start |= inner & before & ~blank_before
        start |= inner & ~before & np.concatenate([[False], kind[1:] != kind[:-1]])
        first = np.flatnonzero(start)
        last = np.concatenate([first[1:], [n]]) - 1
        byte_bounds = np.concatenate([lead, [len(data)]])
        begin, end = byte_bounds[first], byte_bounds[last + 1]
        hashes, sample, which = np.unique(textops.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        found = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(found, len(self.known) - 1)] != hashes
        if new.any():
            rows = sample[new]
            parts = [data[a:b].tobytes() for a, b in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)]
            places, lengths = self._store(self._encode_new(parts, space[last[rows]]))
            self.known = np.insert(self.known, found[new], hashes[new])
            self.place = np.insert(self.place, found[new], places)
            self.length = np.insert(self.length, found[new], lengths)
            found = np.searchsorted(self.known, hashes)
        counts, places = self.length[found][which], self.place[found][which]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(places - (total - counts), counts) + np.arange(total[-1])]
        token_bounds = np.concatenate([[0], total])[np.searchsorted(first, bounds)]
        return self._with_quotes(texts, data, offsets, ids, token_bounds)

    def _with_quotes(self, texts, data, offsets, ids, bounds):
        """Texts with an apostrophe may have contractions, which pre-token by other rules: encode them by themselves."""
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(data == 39), "right") - 1)
        if not len(odd):
            return ids, bounds
        rows = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in odd.tolist():
            rows[k] = np.array(self.encoding.encode_ordinary(data[offsets[k] : offsets[k + 1]].tobytes().decode()), np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
