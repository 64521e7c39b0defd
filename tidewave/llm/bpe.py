"""Exact byte-pair encoding by backtracking, and decoding by a table of offsets.

A word is a row of symbols: its bytes, the last of which is marked as the word's end. One Aho-Corasick pass finds all tokens that begin at each of them.
The encoder takes the longest token that may follow the one before it, and goes back to a shorter one where nothing fits any more. Two
tokens may stand side by side if merging, by rank and then from the left, would leave the border between them alone; a row of tokens of which
all neighbours may is what merging gives, and each place has one such row up to it, so no place is entered again once it has been left. Texts are
cut into words as the tokenizer's file says. See "So many tokens, so little time: Introducing a faster, more flexible byte-pair tokenizer"
(Antoniades and van Antwerpen, 2024) for the method.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidewave.llm.store import small_batches

#: Words, and characters of words, that a Python worker remembers the ids of.
WORDS, CHARS = 1 << 18, 1 << 24
#: Answers of the compatibility table that are kept.
PAIRS = 1 << 20
#: Symbols of a word that are searched at once.
WINDOW = 1 << 12
#: Code points that are cut by a pattern of their own, which is faster.
COMMON = range(0x530)
#: Characters of a text that are cut into words at once.
CHUNK = 1 << 20
#: Ids that are decoded at once.
_IDS = 1 << 19
_INNER = {b: 256 + b for b in range(256)}


def _byte_characters() -> dict[str, int]:
    """The characters that a byte-level vocabulary shows bytes as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@functools.cache
def _marks() -> list[str]:
    """A combining mark of each class."""
    return list({unicodedata.combining(c): c for c in map(chr, range(0xFFFF, 0x2FF, -1)) if unicodedata.combining(c)}.values())


class Merges:
    """Tokens over an alphabet of characters, and the rows of them that merging gives. alphabet: symbols; merges: pairs of tokens (as strings), first
    the one that is merged first. Tokens are numbered: the alphabet in order, then what each merge makes."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]], shown: dict[str, str]):
        import ahocorasick

        number = {name: i for i, name in enumerate(alphabet)}
        base = len(alphabet)
        spelled = [shown[name] for name in alphabet]
        self.parts, self.merged = [(-1, -1)] * base, {}
        for a, b in merges:
            pair = number[a], number[b]
            if a + b in number:
                raise ValueError("two merges make the same token")
            number[a + b] = self.merged[pair] = len(self.parts)
            self.parts.append(pair)
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
        self.base, self.names, self.known = base, list(number), {}
        self.lengths = [len(x) for x in spelled]
        self.longest = max(self.lengths)
        self.find = ahocorasick.Automaton()
        comes = [True] * base
        for a, b in self.parts[base:]:  # a token never comes out of merging if a part doesn't, or if another merge takes from them first
            comes.append(comes[a] and comes[b] and self._apart(a, b, len(comes)))
        for i, x in enumerate(spelled):
            if comes[i]:
                self.find.add_word(x, i)
        self.find.make_automaton()

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge crosses from token a into token b before that of the number before. Undoes their merges, the latest first: two tokens at the border are merged
        with each other if that comes before either is merged with its other neighbour; of equal merges the left one comes first."""
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if max(a, b) < self.base:
                return True
            if a > b:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging can leave token b after token a; put into the table of what is known, whose size is bounded."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        found = self.known[a, b] = self._apart(a, b, len(self.parts))
        return found

    def _starts(self, symbols: str, begin: int) -> list[list[int]]:
        """Tokens that begin at each place of a window of symbols, the shortest first."""
        starts: list[list[int]] = [[] for _ in range(min(WINDOW, len(symbols) - begin))]
        lengths = self.lengths
        for end, token in self.find.iter(symbols if len(symbols) <= WINDOW else symbols[begin : begin + WINDOW + self.longest - 1]):
            place = end + 1 - lengths[token]
            if place < len(starts):
                starts[place].append(token)
        return starts

    def encode(self, symbols: str) -> list[int]:
        """Numbers of the tokens that merging makes of a row of symbols."""
        window = functools.lru_cache(maxsize=4)(lambda w: self._starts(symbols, w * WINDOW)) if len(symbols) > WINDOW else None
        starts = None if window else self._starts(symbols, 0)
        at, tried, out, lengths, known, n = 0, None, [], self.lengths, self.known, len(symbols)
        open_ = bytearray(b"\1") * (n + 1)
        while at < n:
            tokens = starts[at] if starts else window(at // WINDOW)[at % WINDOW]
            i = len(tokens) - 1 if tried is None else tokens.index(tried) - 1
            while i >= 0:
                token = tokens[i]
                if open_[at + lengths[token]]:
                    if not out:
                        break
                    fits = known.get((out[-1], token))
                    if self.compatible(out[-1], token) if fits is None else fits:
                        break
                i -= 1
            if i >= 0:
                out.append(token)
                at, tried = at + lengths[token], None
            else:
                open_[at] = 0
                tried = out.pop()
                at -= lengths[tried]
        return out


class _Numbers(dict):
    """word -> its place in the memory, which learns words that it does not have."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        self[word] = found = self.learn(word)
        return found


class Tokenizer:
    """What a tokenizers file of this kind says: NFC, one space for white space, lower case; words by a pattern; byte-level merges with a suffix at a word's end; special tokens
    found in the raw text. Other kinds raise."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"], spec["decoder"]
        if kinds != (["NFC", "Replace", "Lowercase"], "Removed", True, "ByteLevel", False, False, None) or spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
            raise ValueError(f"{path}: normalizer, pre-tokenizer or decoder of another kind")
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"] or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: model or special tokens of another kind")
        end, bytes_ = model["end_of_word_suffix"], _byte_characters()
        shown = {c + e: chr(256 + b + 256 * bool(e)) for e in ("", end) for c, b in bytes_.items()}
        if missing := shown.keys() - model["vocab"].keys():
            raise ValueError(f"{path}: the vocabulary lacks {len(missing)} bytes")
        self.merges = Merges(list(shown), [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]], shown)
        self.ids = np.array([model["vocab"][x] for x in self.merges.names], np.int32)
        self.special = {x["content"]: x["id"] for x in added}
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.library = Library.from_file(path)
        self.agreed = {c for c in map(chr, COMMON) if self._agrees(c)}
        blank, letter, figure = (re.escape("".join(c for c in sorted(self.agreed) if regex.match(x, c))) for x in (r"\p{White_Space}", r"\p{L}", r"\p{N}"))
        self.odd = re.compile(f"[^{re.escape(''.join(sorted(self.agreed)))}]")
        self.fast = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{figure}]").replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{figure}]"))
        if r"\p" in self.fast.pattern or r"\s" in self.fast.pattern:
            raise ValueError(f"{path}: pattern of another kind")
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.pieces = pa.array([f"{names[i]} " if i in names else "" for i in range(max(names) + 1)] + [""], pa.string())  # one buffer of bytes and a table of offsets
        self._forget()

    def _forget(self) -> None:
        self.memory, self.chars, self.used = _Numbers(self._learn), 0, 0
        self.at, self.n, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, word: str) -> int:
        data = word.encode()
        ids = self.merges.encode(data[:-1].decode("latin-1").translate(_INNER) + chr(512 + data[-1]))
        k, self.chars = len(self.memory), self.chars + len(word)
        if k == len(self.at):
            self.at, self.n = np.append(self.at, self.at), np.append(self.n, self.n)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        self.at[k], self.n[k] = self.used, len(ids)
        self.pool[self.used : self.used + len(ids)] = self.ids[ids]
        self.used += len(ids)
        return k

    def _agrees(self, c: str) -> bool:
        """Whether Python's tables and the library's say the same of a character, which is of a word, a number, a blank or none; they are of different years.
        Marks are also put on either side of marks of all classes, which tells their own."""
        marks = "".join(f"q{m}{c}q{c}{m}" for m in _marks()) if unicodedata.category(c)[0] in "MC" else ""
        probe, blank = f"a{c}!{c}1", regex.match(r"\p{White_Space}", c)
        same = (" " if blank else self._lowered(c + marks)) == self.library.normalizer.normalize_str(c if blank else c + marks)
        return same and [len(x.encode()) for x in self.pattern.findall(probe)] == [len(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]

    @staticmethod
    def _lowered(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself, whatever stands around it

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.fast.findall(text.lower())
        lowered = self._lowered(text)
        if not self.odd.search(text) and not self.odd.search(lowered):
            return self.fast.findall(lowered)
        if new := (set(text) | set(lowered)) - self.agreed:
            self.agreed |= (same := {c for c in new if self._agrees(c)})
            if new - same:  # characters of a year that only one side knows
                bytes_ = _byte_characters()
                return [bytes(bytes_[c] for c in x).decode(errors="surrogatepass") for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return self.pattern.findall(lowered)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], np.int32))
                continue
            at = 0
            while at < len(part):  # a word ends at white space, which nothing before it depends on
                end = len(part)
                if end - at > CHUNK and (end := max(part.rfind(x, at + 1, at + CHUNK) for x in " \n")) < 0:
                    end = min((i for i in (part.find(x, at + CHUNK) for x in " \n") if i > 0), default=len(part))
                if len(self.memory) > WORDS or self.chars > CHARS:
                    self._forget()
                words = self.words(part[at:end])
                numbers = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
                n = self.n[numbers]
                total = np.cumsum(n)
                out.append(self.pool[np.repeat(self.at[numbers] - (total - n), n) + np.arange(total[-1] if len(n) else 0)])
                at = end
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """Texts of rows of ids that begin at cuts: tokens with a space between them. Ids that name no token are left out."""
        taken = self.pieces.take(pa.array(np.where((ids >= 0) & (ids < len(self.pieces)), ids, len(self.pieces) - 1)))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[cuts] if len(taken) else np.zeros(len(cuts), np.int32)
        data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: ends[-1]]
        some, ends = ends[1:] > ends[:-1], ends[1:]
        data = np.delete(data, ends[some] - 1)  # the space after a row's last token
        offsets = np.append(0, ends - np.cumsum(some)).astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows (null rows and ids: none, and -1), and where rows begin."""
    n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return np.asarray(lists.flatten().fill_null(-1), np.int64), np.append(0, np.cumsum(n))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(rows: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """rows with a column (array of int) of the ids of a text; a column of that name is replaced, all others stay.

    Whole texts are encoded, of any length: a null or empty text has no ids. Strings of special tokens in a text have those tokens' ids. Equal texts have
    equal ids; rows may repeat; no rows give none. A worker's memory of words is bounded.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = tokenizer(path)
        for batch in batches:
            ids = [code.encode(x.as_py() or "") for x in batch]
            ends = np.append(0, np.cumsum(np.array([len(x) for x in ids], np.int64)))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

    small_batches(rows.sparkSession)
    return rows.withColumn(into, F.arrow_udf(run, "array<int>")(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with a column (string) of the tokens of ids (array of int), with one space between them; a column of that name is replaced.

    Special tokens are kept. No ids, or null, give an empty text; ids that name no token, and null ones, are left out. No rows give none.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = tokenizer(path)
        for batch in batches:
            flat, cuts = _rows(batch)
            texts, i = [], 0
            while i < len(batch) or not texts:
                j = min(len(batch), max(i + 1, int(np.searchsorted(cuts, cuts[i] + _IDS, side="right")) - 1))
                texts.append(code.decode(flat[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]))
                i = j
            yield pa.concat_arrays(texts)

    small_batches(rows.sparkSession)
    return rows.withColumn(into, F.arrow_udf(run, "string")(F.col(ids).cast("array<int>")))


def id_digest(ids: Column) -> Column:
    """SHA-256 (lowercase hex) of ids as little-endian unsigned 32-bit integers; of nothing, for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, cuts = _rows(batch)
            data = memoryview(flat.astype("<u4")).cast("B")
            yield pa.array([hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string())

    return F.arrow_udf(run, "string")(ids)
