"""Token-id shards with Re-Pair grammar compression (operator 2).

Texts are encoded, each document ends with id 0, and documents are written in ascending
``doc_id`` order (nulls first, equal ids by content) to shards of about ``SHARD`` ids.  In
each shard frequent pairs of symbols are replaced by nonterminals, again and again.  One
round counts all pairs and replaces many at once: the most frequent first, each unless it
could overlap one already taken, so a round equals replacing its pairs one after the other.
Rounds go on until no pair reaches the least count.  A round looks only where a pair was
frequent in the one before or a nonterminal is new; all other pairs are too rare for good.
Pairs never reach across a document's end, so every document is a run of symbols.

A shard's bytes hold the header, the rules with the length each expands to, the table of
documents and the symbols.  The lengths allow decoding any stretch of a document without
decoding what lies before it (:func:`stretch`).  Shards are rows of a Parquet table, so
Spark's committer settles retried tasks.

Null and empty texts are the end id alone; empty tables give empty results.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, slices, staged
from fluxora.llm.tokens import BYTE_BPE, encoder

MAGIC = b"RPG1"
HEAD = "<4sIIIIq"  # magic, first nonterminal, rules, documents, symbols, ids
END = np.zeros(1, "<u4").tobytes()
SHARD = 1 << 18
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Grammar:
    """How far to compress: pairs of a round, and the least count of a pair."""

    first: int = 50257
    pairs: int = 4096
    least: int = 4


def by_pair(pairs: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their ascending places, by pair and then place."""
    bits = symbols.bit_length()
    if len(pairs) and int(pairs.max()) >> (63 - bits):
        order = np.argsort(pairs, kind="stable")
        return pairs[order], at[order]
    keys = np.sort((pairs << bits) | at)  # one number for both: sorted without an order
    return keys >> bits, keys & ((1 << bits) - 1)


def frequent(pairs: np.ndarray, at: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs that occur ``least`` times and more, ascending; their counts; their places."""
    pairs, at = by_pair(pairs, at, symbols)
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.diff(starts, append=len(pairs))
    often = counts >= least
    return pairs[starts[often]], counts[often], at[np.repeat(often, counts)]


def choose(pairs: np.ndarray, counts: np.ndarray, base: int, grammar: Grammar) -> np.ndarray:
    """Frequent pairs none of which can overlap another, as a sorted array."""
    # The pairs come sorted, so a stable order by count leaves ties in the order of the pairs.
    pairs = pairs[np.argsort(-counts, kind="stable")[: 2 * grammar.pairs]]
    lefts, rights = pairs // base, pairs % base
    none = len(pairs)
    left_at, right_at = np.full(base, none), np.full(base, none)  # the first open pair a symbol is in
    left_of, right_of = np.zeros(base, bool), np.zeros(base, bool)  # of pairs taken
    taken = np.zeros(none, bool)
    todo = np.arange(none)
    # What overlaps no open pair before it is taken, what overlaps a taken one is refused: as one by one.
    while len(todo):
        a, b = lefts[todo], rights[todo]
        left_at[a[::-1]], right_at[b[::-1]] = todo[::-1], todo[::-1]
        now = (right_at[a] >= todo) & (left_at[b] >= todo)
        left_at[a], right_at[b] = none, none
        taken[todo[now]] = True
        left_of[a[now]], right_of[b[now]] = True, True
        todo = todo[~(now | right_of[a] | left_of[b])]
    return np.sort(pairs[taken][: grammar.pairs])


def replace(
    seq: np.ndarray, found: np.ndarray, counts: np.ndarray, places: np.ndarray, taken: np.ndarray, base: int
) -> tuple[np.ndarray, np.ndarray]:
    """``seq`` with every taken pair (left to right) replaced by its nonterminal.

    Also where a pair may be frequent now: at a new nonterminal, or where one was before.  Any
    other pair has occurred too seldom already and can only become rarer.
    """
    number = np.full(len(found), -1, np.int64)
    number[np.searchsorted(found, taken)] = np.arange(len(taken))
    new = np.repeat(number, counts)
    at, new = places[new >= 0], new[new >= 0]
    # In a run of one symbol only every other pair can be replaced.
    same = (taken // base == taken % base)[new]
    if same.any():
        run = at[same]
        begins = np.concatenate([[True], np.diff(run) != 1])
        starts = run[np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))]
        keep = ~same
        keep[same] = (run - starts) % 2 == 0
        at, new = at[keep], new[keep]
    out = seq.copy()
    out[at] = base + new
    kept = np.ones(len(out), bool)
    kept[at + 1] = False
    live = np.zeros(len(out), bool)
    live[places] = True
    kept = np.flatnonzero(kept)
    out, live = out[kept], live[kept]
    live[:-1] |= out[1:] >= base
    live[:-1] &= (out[:-1] != 0) & (out[1:] != 0)
    return out, np.flatnonzero(live[:-1])


def compress(seq: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and the length each rule expands to."""
    rules = np.zeros((0, 2), np.int64)
    lengths = np.ones(grammar.first, np.int64)
    live = np.flatnonzero((seq[:-1] != 0) & (seq[1:] != 0))
    while len(live):
        base = len(lengths)
        pairs = seq[live].astype(np.int64) * base + seq[live + 1]
        found, counts, places = frequent(pairs, live, len(seq), grammar.least)
        taken = choose(found, counts, base, grammar)
        if not len(taken):
            break
        seq, live = replace(seq, found, counts, places, taken, base)
        left, right = taken // base, taken % base
        rules = np.concatenate([rules, np.stack([left, right], axis=1)])
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
    return seq, rules, lengths[grammar.first :]


def shard_bytes(doc_ids: list, ids: list[bytes], grammar: Grammar) -> bytes:
    """A shard of documents, each given as its ids with the end id."""
    raw = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    seq, rules, lengths = compress(raw, grammar)
    # Documents end where their sizes say: id 0 may also stand inside a text ("!").
    inner = np.flatnonzero(seq == 0)
    outer = np.flatnonzero(raw == 0)
    wanted = np.cumsum([len(x) // 4 for x in ids]) - 1
    ends = inner[np.searchsorted(outer, wanted)]
    known = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    head = struct.pack(HEAD, MAGIC, grammar.first, len(rules), len(ids), len(seq), len(raw))
    return b"".join(
        [
            head,
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            known.tobytes(),
            sizes.tobytes(),
            (ends + 1).astype("<u4").tobytes(),
            (seq & 0xFFFF).astype("<u2").tobytes(),
            (seq >> 16).astype("u1").tobytes(),
        ]
    )


@dataclass
class Shard:
    """An opened shard; ``ends`` are the documents' ends among the symbols."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    doc_ids: list
    sizes: np.ndarray
    ends: np.ndarray
    symbols: np.ndarray


def open_shard(data: bytes) -> Shard:
    magic, first, n_rules, docs, symbols, _ = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = struct.calcsize(HEAD)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    rules = take("<u4", 2 * n_rules).reshape(n_rules, 2).astype(np.int64)
    lengths = take("<u4", n_rules).astype(np.int64)
    doc_ids = [None if d == NO_ID else d for d in take("<i8", docs).tolist()]
    sizes = take("<u4", docs).astype(np.int64)
    ends = take("<u4", docs).astype(np.int64)
    low = take("<u2", symbols).astype(np.int64)
    return Shard(first, rules, lengths, doc_ids, sizes, ends, low | take("u1", symbols).astype(np.int64) << 16)


def expand(symbols: np.ndarray, shard: Shard) -> np.ndarray:
    """All ids behind the symbols."""
    seq = symbols
    while True:
        grows = seq >= shard.first
        if not grows.any():
            return seq
        place = np.arange(len(seq)) + np.cumsum(grows) - grows
        out = np.empty(len(seq) + int(grows.sum()), np.int64)
        out[place[~grows]] = seq[~grows]
        rule = shard.rules[seq[grows] - shard.first]
        out[place[grows]] = rule[:, 0]
        out[place[grows] + 1] = rule[:, 1]
        seq = out


def decode(shard: Shard) -> np.ndarray:
    """All ids of the shard: each rule is expanded once, and the lengths say where it lies."""
    rules = expand(shard.rules.ravel(), shard)
    known = np.concatenate([np.arange(shard.first), rules])
    sizes = np.concatenate([np.ones(shard.first, np.int64), shard.lengths])
    starts = np.cumsum(sizes) - sizes
    size = sizes[shard.symbols]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return known[np.repeat(starts[shard.symbols] - ends + size, size) + np.arange(total)]


def stretch(shard: Shard, doc: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one document, expanding only the symbols they touch."""
    begin = int(shard.ends[doc - 1]) if doc else 0
    symbols = shard.symbols[begin : int(shard.ends[doc])]
    sizes = np.ones(len(symbols), np.int64)
    rules = symbols >= shard.first
    sizes[rules] = shard.lengths[symbols[rules] - shard.first]
    after = np.cumsum(sizes)
    lo = int(np.searchsorted(after, start, side="right"))
    hi = int(np.searchsorted(after, stop, side="left")) + 1
    skipped = int(after[lo - 1]) if lo else 0
    return expand(symbols[lo:hi], shard)[start - skipped : max(start, stop) - skipped]


SHARDS = "part int, shard int, n_ids long, data binary"


def write_shards(
    docs: DataFrame, grammar: Grammar | None = None, path: str | None = None, size: int = SHARD
) -> DataFrame:
    """Encode, compress and write; returns the table of shards."""
    grammar = grammar or Grammar()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = doc_view(docs, "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def make():
        work_on = encoder(BYTE_BPE, path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        doc_ids: list = []
        ids: list[bytes] = []
        state = {"ids": 0, "shard": 0}

        def shard() -> list[dict]:
            if not doc_ids:
                return []
            row = {
                "part": part, "shard": state["shard"], "n_ids": state["ids"],
                "data": shard_bytes(doc_ids, ids, grammar),
            }
            doc_ids.clear()
            ids.clear()
            state.update(ids=0, shard=state["shard"] + 1)
            return [row]

        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            names = batch.column("doc_id").to_pylist()
            for doc_id, raw in zip(names, work_on.encode_column(batch.column("text"))):
                doc_ids.append(doc_id)
                ids.append(raw + END)
                state["ids"] += len(raw) // 4 + 1
                if state["ids"] >= size:
                    rows += shard()
            return rows

        work.rest = lambda: iter([shard()])
        return work

    return staged(map_rows(ordered, make, SHARDS), "shards")


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document: where its ids begin among all, their number and checksum."""
    # Two levels: sums per part (their number is bounded by the session), then shards.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.select("part", "shard", "n_ids")
        .withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(bases, "part")
        .select("part", "shard", (F.col("base") + F.col("inside")).alias("base"))
    )
    rows = shards.join(starts, ["part", "shard"]).select("base", "data")

    def run(batches):
        for batch in slices(batches, 8):
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data").to_pylist()):
                shard = open_shard(data)
                raw = memoryview(decode(shard).astype("<u4").tobytes())
                starts = np.concatenate([[0], np.cumsum(shard.sizes)])
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts[:-1] + base, pa.int64()),
                        pa.array(shard.sizes, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(run, DECODED)
