"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

The encoder never runs the merge list. An Aho-Corasick automaton over all tokens gives the
longest token at each byte. A row of tokens is the BPE encoding exactly if every two
neighbours are compatible, that is, no merge across their border would come before the merges
that made them; so a token is taken if it fits the one before, else a shorter one, else the
one before is given up. Each byte border is refused at most once, which keeps this linear.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from varloom.llm.common import binary_rows, prepare, small_batches, text_buffers

# Fixed by the tokenizer format: how byte-level vocabularies cut text before merging.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_TWO_SPACES = regex.compile(r"\s ")
_MARKS = frozenset(".,;:!?")
# Bytes that half a worker's memory of words may take, and half the pairs of tokens it remembers.
ROOM, PAIRS = 24 << 20, 200_000
_FIRST = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as bytes by id, the merges, and texts that are tokens as a whole."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer file in JSON with a byte-level BPE model."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} holds no byte-level BPE model")
        if data["normalizer"] or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} changes texts before it encodes them")
        letters, vocab = byte_letters(), data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        tokens = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            if token not in added:
                tokens[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            tokens[i] = token.encode()
        merges = []
        for pair in data["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        return cls(tokens, merges, added)

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens as one run of bytes, and where each begins."""
        ends = np.cumsum([0, *map(len, self.tokens)])
        return np.frombuffer(b"".join(self.tokens), np.uint8), ends


class Encoder:
    """Encodes texts with one vocabulary; keeps a bounded memory of words seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = [len(t) for t in vocabulary.tokens]
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for rank, (a, b, ab) in enumerate(vocabulary.merges):
            if max(self.made.get(a, -1), self.made.get(b, -1)) >= rank:
                raise ValueError("a merge comes before the merges that it needs")
            self.joins[a, b] = rank
            if ab not in self.made:
                self.made[ab], self.parts[ab] = rank, (a, b)
        own = set(vocabulary.special.values())
        self.ids = {
            t.decode("latin-1"): i for i, t in enumerate(vocabulary.tokens) if t and i not in own
        }
        self.widest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        # by token, the next shorter token that begins it
        self.shorter = [-1] * len(self.size)
        for token, i in self.ids.items():
            ends = range(len(token) - 1, 0, -1)
            self.shorter[i] = next((self.ids[token[:n]] for n in ends if token[:n] in self.ids), -1)
        self.special = vocabulary.special
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special))
        self.fits: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self.words = _Memory(self.word)
        self.spaced = _Memory(self._spaced)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = self.older.get(key)
            if known is None:
                known = self._compatible(left, right)
            if len(self.fits) >= PAIRS:
                self.older = self.fits.copy()
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """No pair that ever meets at the border merges before it is merged elsewhere.

        At the border stand, one after another, the right-hand parts of the left token and
        the left-hand parts of the right one, each until the merge that takes it in. Of two
        equal merges the one further left comes first.
        """
        x, x_until = left, _FIRST
        while True:
            y, y_until = right, _FIRST
            while True:
                rank = self.joins.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
                if y not in self.parts:
                    break
                y_until, y = self.made[y], self.parts[y][0]
            if x not in self.parts:
                return True
            x_until, x = self.made[x], self.parts[x][1]

    def word(self, word: str) -> bytes:
        """Token ids of one piece of text, as little-endian unsigned 32-bit integers."""
        raw = word.encode().decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return _little([whole])
        ids = [i for _, i in self.automaton.iter_long(raw)]
        known = self.fits.get
        last = ids[0]
        for k in range(1, len(ids)):
            token = ids[k]
            if not known(last << 32 | token) and not self.compatible(last, token):
                return _little(self._backtrack(raw, ids[:k]))
            last = token
        if sum([self.size[i] for i in ids]) != len(raw):
            ids = self._backtrack(raw, [])
        return _little(ids)

    def _longest(self, raw: str, at: int) -> int:
        """The longest token that begins here, or -1."""
        ahead = raw[at : at + self.widest]
        size = self.automaton.longest_prefix(ahead)
        while size:
            token = self.ids.get(ahead[:size])
            if token is not None:
                return token
            size -= 1
        return -1

    def _backtrack(self, raw: str, ids: list[int]) -> list[int]:
        """Go on after the tokens ``ids``, whose neighbours are compatible."""
        sizes, shorter, fits = self.size, self.shorter, self.compatible
        at = sum([sizes[i] for i in ids])
        refused: set[int] = set()
        token = self._longest(raw, at)
        while at < len(raw):
            while token >= 0 and (
                at + sizes[token] in refused or (ids and not fits(ids[-1], token))
            ):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                token = self._longest(raw, at) if at < len(raw) else -1
            elif ids:  # nothing fits after the last token: give it up for a shorter one
                refused.add(at)
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary cannot spell this text")
        return ids

    def _pieces(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(piece)))

    def _spaced(self, piece: str) -> bytes:
        """A space and what follows it up to the next space."""
        if piece.isalpha():
            return self.word(" " + piece)
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return self.spaced[piece[:-1]] + self.words[piece[-1]]
        return self._pieces(" " + piece)

    def _plain(self, text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return self._pieces(text)
        # a single space always begins a word, so texts may be cut there first
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self.spaced.__getitem__, rest))

    def text(self, text: str) -> bytes:
        """Token ids of a whole text."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            _little([self.special[part]]) if part in self.special else self._plain(part)
            for part in self.cut.split(text)
            if part
        )


class _Memory(dict):
    """Results by key. When they fill the room they become the older half, whose place the next
    ones take; what is asked for again moves up. Long keys are not kept."""

    def __init__(self, make):
        self.make, self.room, self.older = make, ROOM, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 40:
            self.room -= 200 + 2 * len(key) + len(value)  # with the objects and their place
            if self.room < 0:
                self.older = self.copy()
                self.clear()
                self.room = ROOM
            self[key] = value
        return value


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def load(spark: SparkSession, path: str) -> Broadcast:
    """Read a tokenizer file on the driver and send it to the workers; its size is that of
    the vocabulary, whatever the texts."""
    return prepare(spark).sparkContext.broadcast(Vocabulary.read(path))


def encode(
    df: DataFrame, vocabulary: Broadcast, *, key: str, text: str = "text", back: bool = False
) -> DataFrame:
    """(key, ids, n_tokens): the token ids of each text, as little-endian unsigned 32-bit
    integers in one binary value. With ``back`` also ``decoded``, the text that ``decode`` gives
    for the ids, from the same worker.

    A NULL text counts as empty and has no tokens; repeated rows stay; other columns are not
    read. Texts of any length are encoded whole.
    """
    names = ["key", "ids", "n_tokens"] + ["decoded"] * back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = vocabulary.value.encoder.text
        for batch in small_batches(batches, "_text", 1 << 20):
            ids = [one(t) if t else b"" for t in batch.column(1).to_pylist()]
            count = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [batch.column(0), pa.array(ids, pa.binary()), count]
            if back:
                columns.append(_decoded(columns[1], *vocabulary.value.table))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS _text")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids binary, n_tokens bigint" + ", decoded string" * back
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: Broadcast, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of each row's ids, looked up in one table of token bytes.

    Bytes that are no UTF-8 become U+FFFD. NULL ids give an empty text; an id outside the
    vocabulary raises. A column named ``decoded`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != "decoded"]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = vocabulary.value.table
        for batch in batches:
            for part in _token_slices(batch, at, 1 << 20):
                texts = _decoded(part.column(at), table, starts)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*kept, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema)
    return df.select(kept).mapInArrow(run, f"{fields}, decoded string")


def _token_slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    start = total = 0
    for i, size in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if total and total + (size or 0) > 4 * most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _decoded(column: pa.Array, table: np.ndarray, starts: np.ndarray) -> pa.Array:
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    ids = raw.view("<u4").astype(np.int64)
    if len(ids) and ids.max() >= len(starts) - 1:
        raise ValueError("an id is outside the vocabulary")
    sizes = starts[ids + 1] - starts[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], sizes)
    bounds = ends[(off - off[0]) // 4]
    out = binary_rows(table[source], bounds)
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())
