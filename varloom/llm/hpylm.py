"""A hierarchical Pitman-Yor language model of word pairs, words and their bytes.

A text is its lower-cased words and one end. A word is drawn in the restaurant of the word before
it (the end, before the first); the parent of all these is the restaurant of words without
context, whose parent spells words byte by byte: every byte is drawn in the restaurant of the
five bytes before it in its word, whose parent is the restaurant of the last four of them, and
so on down to three; those share a base that is known from pairs of bytes. At every level the
tables of a restaurant are the customers of its parent. How many tables a dish has is sampled by
Gibbs steps, all dishes of a level at once; predictive probabilities are averaged over samples
and used to score texts.

Counts never meet in one place. Documents lie in blocks by a hash of their id. A block sends
its distinct keys (words, pairs of words, and runs of six bytes) with their counts to shards. A
shard of pairs holds whole restaurants, by the word before; in every sweep it sends the tables
of its words to the shards of words and gets back what it needs for their probabilities. A shard
of runs of bytes holds whole subtrees. In the end every block gets numbers for each of its keys,
in the order of the keys.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import text_buffers
from varloom.llm.shingles import LOWER, SPACE, mix, runs
from varloom.plans.scale import cut_in_parts, cut_lineage, discard

BLOCK_BYTES = 8 << 20
PIECE = 2 << 20
PARTS = 4  # tables of what blocks send to shards of pairs, each deleted once it is read
ORDER, ROOT = 6, 3
END, GAP = 10, 32
END_TOKEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Discount and strength of the restaurants of bytes by context length from ROOT to
    ORDER - 1, strengths of the words' one and of those by the word before (their discounts
    are estimated), sweeps before the first sample, samples, and the seed."""

    discount: tuple[float, ...] = (0.4, 0.5, 0.6)
    strength: tuple[float, ...] = (2.0, 1.0, 0.5)
    word_strength: float = 1.0
    pair_strength: float = 1.0
    burn_in: int = 2
    samples: int = 3
    seed: int = 13


# --- texts ----------------------------------------------------------------------------------


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token hashes (an end after the last word of each text) and their bounds by text;
    where each token begins and how long it is in the bytes, which come last."""
    raw, off = text_buffers(column)
    low = LOWER[raw]
    hashes, starts = runs(low, off, SPACE)
    inside = np.append(~SPACE[low], False)
    stops = np.flatnonzero(~inside)
    # a word ends at the next space or at the end of its text
    n = len(off) - 1
    owner = np.searchsorted(off, starts, side="right") - 1
    ends = np.minimum(stops[np.searchsorted(stops, starts)], off[owner + 1]) if len(starts) else starts
    place = np.arange(len(hashes)) + owner
    bounds = np.searchsorted(starts, off) + np.arange(n + 1)
    every = np.full(len(hashes) + n, END_TOKEN)
    begin = np.full(len(every), len(low))
    size = np.ones(len(every), np.int64)
    every[place], begin[place], size[place] = hashes, starts, ends - starts
    return every, bounds, begin, size, np.append(low, np.uint8(END))


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of chosen runs one after another, and the n + 1 bounds of the runs."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], size)], bounds


def spelled(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words with a gap after each; an end needs none."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    closed = np.ones(n, np.int64)
    if len(data):
        closed[(size == 1) & (data[np.minimum(bounds[:-1], len(data) - 1)] == END)] = 0
    to = np.concatenate([[0], np.cumsum(size + closed)])
    out = np.full(to[-1], GAP, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - bounds[:-1], size)] = data
    return out, to


def grams(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each symbol of a word, it and the ORDER - 1 before it as one number; before the
    word stand ends."""
    code = np.zeros(len(symbols), np.uint64)
    place = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(ORDER - 1, -1, -1):
        before = np.full(len(symbols), END, np.uint64)
        inside = np.flatnonzero(place >= back)
        before[inside] = symbols[inside - back]
        code = code << np.uint64(8) | before
    return code


class Words:
    """The distinct tokens of a block, sorted by hash, with their training counts and bytes."""

    def __init__(self, text: pa.Array, trained: np.ndarray):
        keys, counts, parts = [], [], []
        self.streams = []
        at = shift = 0
        for part in pieces(text):
            every, bounds, begin, size, data = tokens(part)
            own, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            self.streams.append((own, inverse, bounds))
            weight = np.repeat(trained[at : at + len(part)], np.diff(bounds))
            at += len(part)
            keys.append(own)
            counts.append(np.bincount(inverse, weight, len(own)).astype(np.int64))
            parts.append(gather(data, begin[first], size[first]))
        if not keys:
            keys, counts, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        joined = np.concatenate(keys)
        self.keys, first, inverse = np.unique(joined, return_index=True, return_inverse=True)
        self.count = np.bincount(inverse, np.concatenate(counts), len(self.keys)).astype(np.int64)
        begin, size = [], []
        for data, bounds in parts:
            begin.append(bounds[:-1] + shift)
            size.append(np.diff(bounds))
            shift += len(data)
        data = np.concatenate([d for d, _ in parts])
        self.symbols, self.bounds = spelled(*gather(data, np.concatenate(begin)[first], np.concatenate(size)[first]))
        self.grams = grams(self.symbols, self.bounds)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The sum by word of a value for each of its symbols."""
        return np.add.reduceat(value, self.bounds[:-1]) if len(self.keys) else np.zeros(0)


class Pairs:
    """The distinct (word before, word) of a block with their training counts, sorted. A pair is
    the place of the one in ``words.keys``, times their number, plus that of the other."""

    def __init__(self, words: Words, trained: np.ndarray):
        self.n_words = max(len(words.keys), 1)
        end = np.searchsorted(words.keys, END_TOKEN)
        codes, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        self.streams = []
        for own, inverse, bounds in words.streams:
            place = np.searchsorted(words.keys, own)[inverse]
            # the word before a text's first is the end of the text before it
            code = np.concatenate([[end], place[:-1]]) * self.n_words + place
            texts = len(bounds) - 1
            weight = np.repeat(trained[at : at + texts], np.diff(bounds))
            at += texts
            some, back = np.unique(code, return_inverse=True)
            self.streams.append((some, back))
            codes.append(some)
            counts.append(np.bincount(back, weight, len(some)).astype(np.int64))
        self.codes, self.count = counted(np.concatenate(codes), np.concatenate(counts))
        self.before, self.word = np.divmod(self.codes, self.n_words)
        # the contexts, and where the pairs of each begin
        self.contexts, self.first = np.unique(self.before, return_index=True)
        self.sizes = np.diff(np.append(self.first, len(self.codes)))


def pieces(column: pa.Array) -> list[pa.Array]:
    """The rows of a column in runs of about PIECE bytes."""
    _, off = text_buffers(column)
    out, start = [], 0
    while start < len(column):
        end = max(int(np.searchsorted(off, off[start] + PIECE, side="right")) - 1, start + 1)
        out.append(column.slice(start, end - start))
        start = end
    return out


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    if len(heads) == 0:
        return keys, np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weight[order], heads)


def shard_of(keys: np.ndarray, kind: str, shards: int) -> np.ndarray:
    """Words go by their hash, pairs by that of the word before, runs of bytes by the context
    of their root restaurant."""
    if kind == "pair":
        keys = mix(keys)
    if kind == "gram":
        keys = mix((keys >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1))
    return ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


# --- the model ------------------------------------------------------------------------------

_EXACT = 32


def log_stirling(discount: float, most: int = _EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t): ways to seat c at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        grow = out[c, t] + np.log(np.maximum(c - discount * t, 1e-300))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], np.where(c - discount * t > 0, grow, -np.inf))
    return out


def draw_tables(
    count: np.ndarray,
    others: np.ndarray,
    parent: np.ndarray,
    discount: float,
    strength: float,
    random: np.random.Generator,
) -> np.ndarray:
    """Tables of each dish, given its customers, the tables of the restaurant's other dishes
    and the parent's probability of the dish.

    Up to 32 customers the conditional distribution is listed and drawn from. Beyond, eight
    seatings are made customer by customer, in growing groups, and one is taken by its weight.
    """
    out = np.minimum(count, 1).astype(np.int64)
    small = np.flatnonzero((count > 1) & (count <= _EXACT))
    stirling = log_stirling(discount)
    for at in range(0, len(small), 1 << 15):
        own = small[at : at + (1 << 15)]
        t = np.arange(1, _EXACT + 1)
        rise = np.log(strength + discount * (others[own][:, None] + t - 1)) + np.log(parent[own])[:, None]
        weight = np.cumsum(rise, axis=1) + stirling[count[own]][:, 1:]
        weight += random.gumbel(size=weight.shape)
        out[own] = weight.argmax(axis=1) + 1
    large = np.flatnonzero(count > _EXACT)
    if len(large):
        seats = np.tile(count[large], (8, 1))
        base, p = others[large][None, :], parent[large][None, :]
        n, t = np.ones_like(seats), np.ones_like(seats)
        weight = np.zeros(seats.shape)
        while (todo := n < seats).any():
            step = np.where(todo, np.minimum(np.maximum(n // 16, 1), seats - n), 0)
            new = (strength + discount * (base + t)) * p
            total = new + np.maximum(n + step / 2 - discount * t, 1e-9)
            t = t + random.binomial(step, np.minimum(new / total, 1.0))
            weight += step * (np.log(total) - np.log(np.maximum(n + step / 2, 1)))
            n = n + step
        pick = (weight + random.gumbel(size=weight.shape)).argmax(axis=0)
        out[large] = t[pick, np.arange(len(large))]
    return out


class Restaurants:
    """All restaurants whose contexts end in the shard's root contexts."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, base: np.ndarray, settings: Settings):
        """``keys`` are distinct runs of ORDER bytes, ``count`` their training customers;
        ``base`` gives the probability of a byte after a byte."""
        self.settings, self.count = settings, count
        self.levels = []
        for length in range(ORDER - 1, ROOT - 1, -1):
            own = keys & np.uint64((1 << 8 * (length + 1)) - 1)
            cells, of_key = np.unique(own, return_inverse=True)
            _, room = np.unique(cells >> np.uint64(8), return_inverse=True)
            self.levels.append((cells, of_key, room))
        self.up = []  # from the cells of a level to those of its parent's level
        for i, (cells, _, _) in enumerate(self.levels[:-1]):
            own = cells & np.uint64((1 << 8 * (ORDER - 1 - i)) - 1)
            self.up.append(np.searchsorted(self.levels[i + 1][0], own))
        last = self.levels[-1][0]
        self.base = base[((last >> np.uint64(8)) & np.uint64(255)).astype(int), (last & np.uint64(255)).astype(int)]

    def run(self) -> np.ndarray:
        """Probabilities of all keys, averaged over the samples."""
        s = self.settings
        seed = int(mix(self.levels[0][0][:1] + np.uint64(s.seed))[0])
        random = np.random.default_rng(seed)
        tables = [None] * len(self.levels)
        customers = [self.count] + [None] * (len(self.levels) - 1)
        for i in range(len(self.levels)):  # first one table a dish
            tables[i] = np.minimum(customers[i], 1)
            if i + 1 < len(self.levels):
                customers[i + 1] = np.bincount(self.up[i], tables[i], len(self.levels[i + 1][0])).astype(np.int64)
        total = np.zeros(len(self.count))
        for sweep in range(s.burn_in + s.samples):
            chance = self.chances(customers, tables)
            for i, (_, _, room) in enumerate(self.levels):
                parent = chance[i + 1][self.up[i]] if i + 1 < len(self.levels) else self.base
                others = np.bincount(room, tables[i])[room] - tables[i]
                d, c = s.discount[-1 - i], s.strength[-1 - i]
                tables[i] = draw_tables(customers[i], others, parent, d, c, random)
                if i + 1 < len(self.levels):
                    customers[i + 1] = np.bincount(self.up[i], tables[i], len(self.levels[i + 1][0])).astype(np.int64)
            if sweep >= s.burn_in:
                total += self.chances(customers, tables)[0]
        return total / s.samples

    def chances(self, customers: list, tables: list) -> list[np.ndarray]:
        """The predictive probability of every cell, level by level."""
        out: list = [None] * len(self.levels)
        for i in range(len(self.levels) - 1, -1, -1):
            parent = out[i + 1][self.up[i]] if i + 1 < len(self.levels) else self.base
            room = self.levels[i][2]
            d, c = self.settings.discount[-1 - i], self.settings.strength[-1 - i]
            seated, opened = np.bincount(room, customers[i]), np.bincount(room, tables[i])
            whole = (c + seated)[room]
            out[i] = (customers[i] - d * tables[i] + (c + d * opened)[room] * parent) / whole
        return out


# --- the jobs -------------------------------------------------------------------------------


def discount_of(once: float, twice: float) -> float:
    """The discount that fits how many words occur once and twice."""
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


def packed(rows: list[dict], schema: str) -> pa.Table:
    """Rows as a table; fields that a row lacks are NULL."""
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields})


def dealt(keys: np.ndarray, kind: str, shards: int) -> list[tuple[int, np.ndarray]]:
    """The places of sorted keys by shard, in the order of the keys."""
    return by_shard(shard_of(keys, kind, shards), shards)


def by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """The places of each shard's number, rising."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(s), order[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts))]


def places(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where wanted keys are among sorted ones; -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def planes(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers byte by byte, the lowest byte of all first: high bytes, mostly zeros, then lie side
    by side and take next to nothing in compressed files."""
    whole = np.ascontiguousarray(values.astype(kind))
    return whole.view(np.uint8).reshape(-1, whole.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: str = "<i4") -> np.ndarray:
    """The numbers that ``planes`` wrote."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def links(at: np.ndarray) -> bytes:
    """Rising places in a list, -1 where there is none, as steps from one to the next."""
    step, own = np.zeros(len(at), np.int64), np.flatnonzero(at >= 0)
    step[own] = np.diff(at[own], prepend=-1)
    return planes(step)


def linked(raw: bytes) -> np.ndarray:
    """The places that ``links`` wrote."""
    step = unplanes(raw).astype(np.int64)
    return np.where(step > 0, np.cumsum(step) - 1, -1)


SEATS = (
    "kind string, shard int, peer int, contexts binary, sizes binary, hosts binary, words binary, place binary, "
    "counts binary, tables binary, total binary, facts array<double>"
)
VOCAB = (
    "kind string, shard int, peer int, keys binary, counts binary, owner binary, chance binary, "
    "tables binary, total binary, mass binary, facts array<double>"
)


def _asks(state: dict, tables: np.ndarray, shards: int, words: np.ndarray | None = None) -> list[dict]:
    """The tables of a shard's words, for the shards of words; the first ask names the words, later
    ones keep its order."""
    hosts = unplanes(state["hosts"])
    customers = np.bincount(unplanes(state["place"]), tables, len(hosts))
    return [
        {
            "kind": "ask",
            "shard": s,
            "peer": state["shard"],
            "words": None if words is None else planes(words[i], "<u8"),
            "counts": planes(customers[i]),
        }
        for s, i in by_shard(hosts, shards)
    ]


def first_seats(table: pa.Table, shards: int) -> pa.Table:
    """A shard's restaurants by the word before, with one table a dish, and for each block the
    places of its contexts and pairs in them."""
    told = [
        {
            "peer": row["block"],
            "keys": unplanes(row["keys"], "<u8"),
            "sizes": unplanes(row["sizes"]),
            "words": unplanes(row["words"], "<u8"),
            "counts": unplanes(row["counts"]).astype(np.int64),
        }
        for row in table.select(["block", "keys", "sizes", "words", "counts"]).to_pylist()
    ]
    before = np.concatenate([np.repeat(r["keys"], r["sizes"])[r["counts"] > 0] for r in told])
    word = np.concatenate([r["words"][r["counts"] > 0] for r in told])
    count = np.concatenate([r["counts"][r["counts"] > 0] for r in told])
    contexts, of_context = np.unique(before, return_inverse=True)
    words, of_word = np.unique(word, return_inverse=True)
    code, count = counted(of_context * len(words) + of_word, count)
    shard, rows = table.column("shard")[0].as_py(), []
    for r in told:
        at = places(r["keys"], contexts)
        own, to = np.repeat(at, r["sizes"]), places(r["words"], words)
        pair = places(np.where((own < 0) | (to < 0), -1, own * len(words) + to), code)
        rows.append({"kind": "link", "shard": shard, "peer": r["peer"], "contexts": links(at), "place": links(pair)})
    if not len(words):
        return packed(rows, SEATS)
    own, place = np.divmod(code, len(words))
    tables = np.ones(len(code), np.int64)
    state = {
        "kind": "state",
        "shard": shard,
        "sizes": planes(np.bincount(own, minlength=len(contexts))),
        "hosts": planes(shard_of(words, "word", shards)),
        "place": planes(place),
        "counts": planes(count),
        "tables": planes(tables),
        "total": planes(np.zeros(len(code))),
        "facts": [float(tables.sum()), float((count == 1).sum()), float((count == 2).sum())],
    }
    return packed([state, *_asks(state, tables, shards, words), *rows], SEATS)


def next_seats(
    state: dict, replies: list[dict], shards: int, parent, discount: float, strength: float, seed: list[int], sample: bool
) -> pa.Table:
    """The tables of a shard's restaurants drawn anew; ``parent`` makes the probabilities of
    words of the masses and spellings in the replies of the shards of words."""
    hosts = unplanes(state["hosts"])
    chance, of = np.zeros(len(hosts)), {r["peer"]: r for r in replies}
    for s, i in by_shard(hosts, shards):
        chance[i] = parent(np.frombuffer(of[s]["mass"], "<f4"), np.frombuffer(of[s]["chance"], "<f4"))
    sizes, place, count, tables, total = (
        unplanes(state[x]).astype(np.int64) for x in ("sizes", "place", "counts", "tables", "total")
    )
    room = np.repeat(np.arange(len(sizes)), sizes)
    others = np.bincount(room, tables)[room].astype(np.int64) - tables
    random = np.random.default_rng([*seed, state["shard"]])
    tables = draw_tables(count, others, chance[place], discount, strength, random)
    out = state | {
        "tables": planes(tables),
        "total": planes(total + tables * sample),
        "facts": [float(tables.sum()), *state["facts"][1:]],
    }
    return packed([out, *_asks(out, tables, shards)], SEATS)


def first_vocabulary(table: pa.Table) -> pa.Table:
    """A shard's words: training counts, spellings, and the one block that spells each; and the
    places of each block's words among them."""
    rows = table.select(["block", "keys", "counts", "chance"]).to_pylist()
    keys = [unplanes(r["keys"], "<u8") for r in rows]
    words, count = counted(np.concatenate(keys), np.concatenate([unplanes(r["counts"]) for r in rows]).astype(np.int64))
    chance, owner = np.zeros(len(words)), np.full(len(words), np.iinfo(np.int32).max)
    shard, places_of = table.column("shard")[0].as_py(), []
    for r, own in zip(rows, keys):
        at = np.searchsorted(words, own)
        places_of.append({"kind": "link", "shard": shard, "peer": r["block"], "keys": links(at)})
        chance[at] = np.frombuffer(r["chance"], "<f4")
        owner[at] = np.minimum(owner[at], r["block"])
    state = {
        "kind": "state",
        "shard": shard,
        "keys": planes(words, "<u8"),
        "counts": planes(count, "<i8"),
        "owner": planes(owner),
        "chance": chance.astype("<f4").tobytes(),
        "tables": b"",
        "total": np.zeros(len(words)).tobytes(),
        "facts": [float(count.sum()), float((count > 0).sum())],
    }
    return packed([state, *places_of], VOCAB)


def customers_of(rows: list[dict], asks: list[dict]) -> tuple[dict, np.ndarray, dict[int, np.ndarray]]:
    """A shard's state, the customers of its words, and the places of the words of each that asks."""
    state = next(r for r in rows if r["kind"] == "state")
    words = unplanes(state["keys"] or b"", "<u8")
    at = {r["peer"]: linked(r["keys"]) for r in rows if r["kind"] == "seat"}
    customers = np.zeros(len(state["chance"]) // 4, np.int64)
    for ask in asks:
        if ask["words"] is not None:
            at[ask["peer"]] = np.searchsorted(words, unplanes(ask["words"], "<u8"))
        customers[at[ask["peer"]]] += unplanes(ask["counts"])
    return state, customers, at


def next_vocabulary(
    rows: list[dict], asks: list[dict], opened: float, whole: float, discount: float, settings: Settings, seed: list[int], sample: bool
) -> pa.Table:
    """The tables of a shard's words drawn anew, with replies to the shards of pairs.

    ``opened`` counts the tables of all words, ``whole`` is the strength and all customers.
    """
    state, customers, at = customers_of(rows, asks)
    chance = np.frombuffer(state["chance"], "<f4")
    before = unplanes(state["tables"]) if state["tables"] else np.minimum(customers, 1)
    random = np.random.default_rng([*seed, state["shard"]])
    tables = draw_tables(
        customers,
        np.maximum(int(opened) - before, 0),
        np.exp(np.maximum(chance.astype(float), -600)),
        discount,
        settings.word_strength,
        random,
    )
    mass = customers - discount * tables
    out = state | {
        "keys": None,  # the places of all that ask are known now
        "tables": planes(tables),
        "total": (np.frombuffer(state["total"]) + sample * mass / whole).tobytes(),
        "facts": [float(tables.sum())],
    }
    replies = [
        {
            "kind": "reply",
            "shard": ask["peer"],
            "peer": state["shard"],
            "mass": mass[at[ask["peer"]]].astype("<f4").tobytes(),
            "chance": chance[at[ask["peer"]]].tobytes(),
        }
        for ask in asks
    ]
    asking = [{"kind": "seat", "shard": state["shard"], "peer": p, "keys": links(i)} for p, i in at.items()]
    return packed([out, *asking, *replies], VOCAB)


def byte_pairs(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How likely a byte follows a byte in the words of training texts, and the bytes of all
    texts. At most one number for each pair of bytes comes to the driver."""

    def run(batches):
        pair, size = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for part in pieces(batch.column(1)):
                size += len(text_buffers(part)[0])
            trained = batch.filter(batch.column(2))
            for part in pieces(trained.column(1)):
                raw, off = text_buffers(part)
                low = np.where(SPACE[raw], GAP, LOWER[raw]).astype(np.int64)
                before = np.concatenate([[GAP], low[:-1]])[: len(low)]
                pair += np.bincount(before << 8 | low, minlength=1 << 16)
                pair[END << 8 | END] += len(part)
        some = np.flatnonzero(pair)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(pair[some], size))], ["pair", "n"]
        )

    rows = docs.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    count, size = np.zeros(1 << 16), 0
    for row in rows.collect():
        if row.pair < 0:
            size = row.n
        else:
            count[row.pair] = row.n
    count = count.reshape(256, 256)
    count[END] += count[GAP]  # what follows a gap also begins a word
    whole = (count.sum(axis=0) + 1) / (count.sum() + 256)
    return (count + 5 * whole) / (count.sum(axis=1, keepdims=True) + 5), size


def score(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    trained: Column,
    settings: Settings = Settings(),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, trained, n_tokens, n_known, train_tokens, vocabulary, base_score, score).

    The model learns from rows for which ``trained`` is true and scores all. ``score`` is the
    base-10 logarithm of the text's probability, ``base_score`` that of words alone with one
    added to every count; ``n_known`` counts tokens that training texts hold. For both, all
    words that no training text holds are one and the same: its probability under ``score`` is
    what the spelling of the known words leaves, times what its context leaves to the parent.

    A NULL or empty text is just an end; a NULL condition is false; repeated rows are learned
    and scored as often; texts are read whole; other columns are not read; an empty table
    gives no rows. Without training rows all words are the unknown one, and scores are 0.
    """
    docs = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(trained, F.lit(False)).alias("trained"),
    )
    base, size = byte_pairs(docs)
    blocks = max(1, math.ceil(size / block_bytes))
    shards = max(64, blocks)
    spread = F.pmod(F.xxhash64("key", F.length("text"), F.substring("text", 1, 64)), F.lit(blocks))
    docs = docs.withColumn("block", spread.cast("int"))
    sent = df.sparkSession.sparkContext.broadcast(base)

    def words_of(table: pa.Table) -> tuple[Words, np.ndarray]:
        text, trained = (table.column(c).combine_chunks() for c in ("text", "trained"))
        trained = trained.to_numpy(zero_copy_only=False).astype(np.int64)
        return Words(text, trained), trained

    def pairs_by_shard(words: Words, pairs: Pairs) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By shard, the places of contexts and of their pairs."""
        out = []
        for s, i in dealt(words.keys[pairs.contexts], "pair", shards):
            size = pairs.sizes[i]
            start = np.cumsum(size) - size
            out.append((s, i, np.arange(size.sum()) + np.repeat(pairs.first[i] - start, size)))
        return out

    told_schema = "part int, shard int, block int, keys binary, counts binary, chance binary, sizes binary, words binary"

    def tell(table: pa.Table) -> pa.Table:
        block, (words, trained) = table.column("block")[0].as_py(), words_of(table)
        pairs = Pairs(words, trained)
        before = ((words.grams >> np.uint64(8)) & np.uint64(255)).astype(int)
        chance = words.sums(np.log(sent.value[before, words.symbols])).astype("<f4")
        rows = [
            {
                "part": PARTS,
                "shard": s,
                "block": block,
                "keys": planes(words.keys[i], "<u8"),
                "counts": planes(words.count[i]),
                "chance": chance[i].tobytes(),
            }
            for s, i in dealt(words.keys, "word", shards)
        ] + [
            {
                "part": s % PARTS,
                "shard": s,
                "block": block,
                "keys": planes(words.keys[pairs.contexts[i]], "<u8"),
                "sizes": planes(pairs.sizes[i]),
                "words": planes(words.keys[pairs.word[j]], "<u8"),
                "counts": planes(pairs.count[j]),
            }
            for s, i, j in pairs_by_shard(words, pairs)
        ]
        return packed(rows, told_schema)

    told = docs.groupBy("block").applyInArrow(tell, told_schema)
    *of_pairs, of_words = cut_in_parts(told, "part", range(PARTS + 1))

    def facts(table: DataFrame, size: int) -> list[float]:
        row = table.where("kind = 'state'").agg(*[F.sum(F.col("facts")[i]) for i in range(size)]).first()
        return [x or 0.0 for x in row]

    # restaurants by the word before, and the one of words, in turn; from here on blocks know
    # their words and pairs by places in the shards
    vocab = cut_lineage(of_words.groupBy("shard").applyInArrow(first_vocabulary, VOCAB), replaces=of_words)
    word_links = cut_lineage(vocab.where("kind = 'link'").select("shard", "peer", "keys"))
    seated_parts = [
        cut_lineage(part.groupBy("shard").applyInArrow(lambda t: first_seats(t, shards), SEATS), replaces=part)
        for part in of_pairs
    ]
    seats = functools.reduce(DataFrame.union, seated_parts)
    n, v = map(int, facts(vocab, 2))
    seated, once, twice = facts(seats, 3)
    pair_discount, opened = discount_of(once, twice), float(v)

    def common(left: pa.Table, right: pa.Table) -> pa.Table:
        _, customers, _ = customers_of(left.to_pylist(), right.to_pylist())
        return pa.table({"once": [int((customers == 1).sum())], "twice": [int((customers == 2).sum())]})

    def split(table: DataFrame, *kinds: str):
        return table.where(F.col("kind").isin(*kinds)).groupBy("shard")

    few = split(vocab, "state").cogroup(split(seats, "ask")).applyInArrow(common, "once bigint, twice bigint")
    discount = discount_of(*(x or 0 for x in few.agg(F.sum("once"), F.sum("twice")).first()))
    strength, backing = settings.word_strength, 0.0

    def sweep(seats: DataFrame, vocab: DataFrame, k: int, opened: float, seated: float):
        whole, sample = strength + seated, k >= settings.burn_in

        def host(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, asks = left.to_pylist(), right.to_pylist()
            return next_vocabulary(rows, asks, opened, whole, discount, settings, [settings.seed, 0, k], sample)

        hosts = split(vocab, "state", "seat").cogroup(split(seats, "ask")).applyInArrow(host, VOCAB)
        vocab = cut_lineage(hosts, replaces=vocab)
        (now,) = facts(vocab, 1)
        share = strength + discount * now

        def parent(mass: np.ndarray, chance: np.ndarray) -> np.ndarray:
            return (mass + share * np.exp(np.maximum(chance.astype(float), -600))) / whole

        def seat(left: pa.Table, right: pa.Table) -> pa.Table:
            state, replies = left.to_pylist()[0], right.to_pylist()
            return next_seats(
                state, replies, shards, parent, pair_discount, settings.pair_strength, [settings.seed, 1, k], sample
            )

        seats = cut_lineage(split(seats, "state").cogroup(split(vocab, "reply")).applyInArrow(seat, SEATS))
        return seats, vocab, now, share / whole

    first = seats
    for k in range(settings.burn_in + settings.samples):
        before = seats
        seats, vocab, opened, share = sweep(seats, vocab, k, opened, seated)
        if before is not first:
            discard(before)
        else:
            pair_links = cut_lineage(first.where("kind = 'link'").select("shard", "peer", "contexts", "place"))
            for part in seated_parts:
                discard(part)
        (seated,) = facts(seats, 1)
        if k >= settings.burn_in:
            backing += share / settings.samples

    made_schema = "kind string, shard int, block int, made binary"

    def answer_words(left: pa.Table, right: pa.Table) -> pa.Table:
        state = right.to_pylist()[0]
        count, owner, tables = (unplanes(state[c], k) for c, k in (("counts", "<i8"), ("owner", "<i4"), ("tables", "<i4")))
        mass = np.frombuffer(state["total"]) / settings.samples
        rows = []
        for row in left.to_pylist():
            at = linked(row["keys"])
            mine = np.where(owner[at] == row["peer"], tables[at], -1)
            made = planes(count[at], "<i8") + mass[at].tobytes() + planes(mine)
            rows.append({"kind": "word", "shard": row["shard"], "block": row["peer"], "made": made})
        return packed(rows, made_schema)

    def answer_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        """By pair, what the restaurant of the word before gives the word itself; by context,
        the share that goes to the parent."""
        state = (right.to_pylist() or [dict.fromkeys(("sizes", "counts", "total"), b"")])[0]
        sizes, count, total = (unplanes(state[c]).astype(np.int64) for c in ("sizes", "counts", "total"))
        room = np.repeat(np.arange(len(sizes)), sizes)
        tables = total / settings.samples
        whole = settings.pair_strength + np.bincount(room, count, len(sizes))
        own = (count - pair_discount * tables) / whole[room]
        rest = (settings.pair_strength + pair_discount * np.bincount(room, tables, len(sizes))) / whole
        rows = []
        for row in left.to_pylist():
            # a context of no training text leaves all to the parent
            to = np.append(rest, 1.0)[linked(row["contexts"])]
            mass = np.append(own, 0.0)[linked(row["place"])]
            made = to.astype("<f4").tobytes() + mass.astype("<f4").tobytes()
            rows.append({"kind": "pair", "shard": row["shard"], "block": row["peer"], "made": made})
        return packed(rows, made_schema)

    word_answers = cut_lineage(
        word_links.groupBy("shard").cogroup(split(vocab, "state")).applyInArrow(answer_words, made_schema), replaces=vocab
    )
    pair_answers = cut_lineage(
        pair_links.groupBy("shard").cogroup(split(seats, "state")).applyInArrow(answer_pairs, made_schema), replaces=seats
    )
    discard(word_links)
    discard(pair_links)

    def answered(right: pa.Table) -> dict:
        return {(k, s): m for k, s, m in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "made")))}

    def word_facts(words: Words, made: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts, masses, and the tables of the words that this block spells."""
        count, mass, tables = (np.zeros(len(words.keys)) for _ in range(3))
        for s, i in dealt(words.keys, "word", shards):
            raw = made["word", s]
            count[i] = unplanes(raw[: 8 * len(i)], "<i8")
            mass[i] = np.frombuffer(raw[8 * len(i) : 16 * len(i)], "<f8")
            tables[i] = unplanes(raw[16 * len(i) :])
        return count, mass, tables

    gram_schema = "shard int, block int, keys binary, counts binary"

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs of bytes of a block; the tables of the words it spells are their customers."""
        words, _ = words_of(left)
        tables = np.maximum(word_facts(words, answered(right))[2], 0).astype(np.int64)
        runs_of, customers = counted(words.grams, np.repeat(tables, np.diff(words.bounds)))
        block = left.column("block")[0].as_py()
        return packed(
            [
                {"shard": s, "block": block, "keys": planes(runs_of[i], "<u8"), "counts": planes(customers[i])}
                for s, i in dealt(runs_of, "gram", shards)
            ],
            gram_schema,
        )

    def answer_grams(table: pa.Table) -> pa.Table:
        keys = [unplanes(x, "<u8") for x in table.column("keys").to_pylist()]
        counts = [unplanes(x) for x in table.column("counts").to_pylist()]
        distinct, count = counted(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        value = np.log10(np.maximum(Restaurants(distinct, count, sent.value, settings).run(), 1e-300))
        rows = [
            {"kind": "gram", "shard": s, "block": b, "made": value[np.searchsorted(distinct, x)].astype("<f4").tobytes()}
            for s, b, x in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), keys)
        ]
        return packed(rows, made_schema)

    grams_told = docs.groupBy("block").cogroup(word_answers.groupBy("block")).applyInArrow(spell, gram_schema)
    gram_answers = cut_lineage(grams_told.groupBy("shard").applyInArrow(answer_grams, made_schema))
    answers = word_answers.union(pair_answers).union(gram_answers)

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        made = answered(right)
        words, trained = words_of(left)
        pairs = Pairs(words, trained)
        count, mass, tables = word_facts(words, made)
        runs_of = np.unique(words.grams)
        value = np.zeros(len(runs_of))
        for s, i in dealt(runs_of, "gram", shards):
            value[i] = np.frombuffer(made["gram", s], "<f4")
        spelling = 10.0 ** np.maximum(words.sums(value[np.searchsorted(runs_of, words.grams)]), -290)
        chance = mass + backing * spelling
        known = count > 0
        to_parent, own = np.zeros(len(pairs.contexts)), np.zeros(len(pairs.codes))
        for s, i, j in pairs_by_shard(words, pairs):
            both = np.frombuffer(made["pair", s], "<f4")
            to_parent[i], own[j] = both[: len(i)], both[len(i) :]
        to_parent = np.repeat(to_parent, pairs.sizes)
        # an unknown word has what its context leaves to the parent, times a constant added later
        by_pair = np.log10(np.where(known[pairs.word], own + to_parent * chance[pairs.word], to_parent))
        by_word = {"n_known": known, "base_score": np.log10(count + 1) - math.log10(n + v + 1)}
        sums: dict = {name: [] for name in ("n_tokens", *by_word, "score")}
        for (distinct, inverse, bounds), (some, back) in zip(words.streams, pairs.streams):
            at = np.searchsorted(words.keys, distinct)
            sums["n_tokens"].append(np.diff(bounds))
            for name, each in by_word.items():
                sums[name].append(np.add.reduceat(each[at][inverse].astype(float), bounds[:-1]))
            at = np.searchsorted(pairs.codes, some)
            sums["score"].append(np.add.reduceat(by_pair[at][back], bounds[:-1]))
        kinds = {"n_tokens": np.int64, "n_known": np.int64, "base_score": float, "score": float}
        out = {"key": left.column("key"), "trained": left.column("trained")}
        for name, kind in kinds.items():
            out[name] = pa.array(np.concatenate([np.zeros(0), *sums[name]]).astype(kind))
        # each known word's spelling counts once, in the block that spells it
        out["spelt"] = pa.array([float(spelling[known & (tables >= 0)].sum())] + [0.0] * (left.num_rows - 1))
        return pa.table(out)

    kind = docs.schema["key"].dataType.simpleString()
    out = (
        docs.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            read,
            f"key {kind}, trained boolean, n_tokens bigint, n_known bigint, base_score double, "
            "score double, spelt double",
        )
    )
    out = cut_lineage(out)
    for table in (word_answers, pair_answers, gram_answers):
        discard(table)
    rest = max(1.0 - (out.agg(F.sum("spelt")).first()[0] or 0.0), 1e-12)
    unknown = math.log10(backing * rest)
    return out.select(
        F.col("key").alias(key),
        "trained",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.lit(v).cast("long").alias("vocabulary"),
        "base_score",
        (F.col("score") + (F.col("n_tokens") - F.col("n_known")) * F.lit(unknown)).alias("score"),
    )
