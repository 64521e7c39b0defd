"""Token ids of whole texts by a public tokenizer, with a bounded memory of the ids of pieces between white space.

A byte-level BPE splits text before merging so that no token crosses from other bytes into white space. A piece (white
space and the bytes up to the next white space) therefore has the same ids wherever it stands. Texts with white space
outside ASCII or with strings of special tokens go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from tidewave.llm.words import _SPACE, mix, randoms, spans

SLOTS, POOL, CHUNK = 1 << 20, 1 << 22, 1 << 18
_AT = randoms(64 * 256, 2)
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<[|]")
_HINT = np.zeros(256, bool)
_HINT[[0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of texts. New pieces are merged by the file's own vocabulary, whose ids are its merge ranks, in the faster of two libraries; the other
    one is loaded only where a text goes to it whole. The memory holds SLOTS pieces (direct-mapped) and POOL ids at most."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        special = {x["content"]: x["id"] for x in read["added_tokens"]}
        vocab = read["model"]["vocab"] | special
        del read
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # in bytes: a byte-level vocabulary has one character for each
        self.lengths[list(vocab.values())] = [len(k) for k in vocab]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary shows as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in k): i for k, i in vocab.items() if k not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self, pool: int = POOL) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at, self.n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(pool, np.int32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of new pieces. Those of white space and other bytes are encoded as one text and told apart by their
        lengths; the others, which begin or end a text, each alone."""
        lone = np.fromiter((not (_SPACE[p[0]] and not _SPACE[p[-1]]) for p in pieces), bool, len(pieces))
        joined = [p for p, x in zip(pieces, lone) if not x]
        flat = np.array(self.fast.encode_ordinary(b"".join(joined).decode()), np.int32)
        lasts, edges = np.cumsum(self.lengths[flat]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        ends = np.searchsorted(lasts, edges) + 1
        if len(edges) and not np.array_equal(lasts[ends - 1], edges):
            raise ValueError("a token crosses from one piece into the next: this vocabulary does not split at white space")
        n = np.zeros(len(pieces), np.int32)
        n[~lone] = np.diff(ends, prepend=0)
        alone = [self.fast.encode_ordinary(p.decode()) for p, x in zip(pieces, lone) if x]
        n[lone] = np.fromiter(map(len, alone), np.int32, len(alone))
        at = np.zeros(len(pieces), np.int32)
        at[~lone] = self.used + np.cumsum(n[~lone]) - n[~lone]
        at[lone] = self.used + len(flat) + np.cumsum(n[lone]) - n[lone]
        flat = np.append(flat, np.array([i for x in alone for i in x], np.int32))
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.keys[slots], self.at[slots], self.n[slots] = hashes, at, n
        return at, n

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = _SPACE[raw]
        start = np.zeros(len(raw), bool)
        start[1:] = space[1:] & ~space[:-1]
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        first = np.flatnonzero(start)
        ends = np.append(first[1:], len(raw))
        lengths = ends - first
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        value = _AT[((place & 63) << 8) | raw]
        if lengths.max() > 64:
            far = place > 63
            value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = mix(np.add.reduceat(value, first))
        slots = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slots] != h)
        if len(missing) and self.used + int(lengths[missing].sum()) > len(self.pool):  # a piece has no more ids than bytes
            self.clear(max(POOL, len(raw)))
            missing = np.arange(len(h))
        at, n = self.at[slots], self.n[slots]
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            data = raw.tobytes()
            at_new, n_new = self._learn(new, [data[a:b] for a, b in zip(first[missing[where]], ends[missing[where]])])
            at[missing], n[missing] = at_new[back], n_new[back]
        total = np.cumsum(n, dtype=np.int64)
        flat = self.pool[np.repeat(at - (total - n), n) + np.arange(total[-1])]
        by_text = np.searchsorted(first, offsets)
        return flat, np.append(0, total)[by_text]

    def encode(self, texts: pa.Array):
        """Yields the ids of each text in turn, as int32 arrays."""
        raw, offsets = spans(texts)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
            part, cuts = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            flat, at = self._chunk(part, cuts) if len(part) else (np.empty(0, np.int32), np.zeros(len(cuts), np.int64))
            hints = np.append(0, np.cumsum(_HINT[part]))[cuts]
            for k in range(j - i):
                if hints[k + 1] > hints[k] and _ODD.search(text := part[cuts[k] : cuts[k + 1]].tobytes().decode()):
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                else:
                    yield flat[at[k] : at[k + 1]]
            i = j


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, until it is dropped."""
    return Encoder(path)


def drop_encoders() -> None:
    """A worker outlives its task: what its encoders hold would lie idle in the stages that follow."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
