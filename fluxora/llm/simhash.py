"""SimHash near duplicates by BK-trees (operator 13).

A document's fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 hashes
of the document's word shingles, repeats included.  Fingerprints link at ``radius`` or fewer
differing bits.

1. Equal fingerprints are one node, named by its smallest document id, so copies meet once.
2. A fingerprint is cut into radius + 1 runs of bits: two that link agree in at least one run.
   So each goes to one shard per run, chosen by the hash of that run's value.  The number of
   shards follows the number of fingerprints, so shards hold about ``tree_rows`` at any size.
3. The members of a shard become BK-trees of at most some ``tree_rows`` nodes: a child hangs
   on its parent by an edge that carries their Hamming distance.  A crowded shard (near copies
   agree in most runs) has several trees.  Trees are rows of a staged table.
4. Each tree is sent to all slices of its shard's members and only there: the trees of all
   shards together grow with the data, so they are no Spark broadcast, whose size would be
   bounded by nothing.  A slice walks a tree for many members at once, level by level, and
   from a node at distance d follows the edges d - radius to d + radius only: by the triangle
   inequality no other child's subtree holds a link.
5. A walk returns a spanning forest of its links, at most one link per node, and the links
   join to components over the whole table.

Shards with s trees are read s times: a run of bits shared by n fingerprints costs n * n /
``tree_rows`` rows moved, which exact search inside one dense ball cannot avoid; copies are
not among them (step 1).

Null and empty texts and texts without words have the fingerprint zero, which links like any
other.  Rows with one id are one document, linked by any of its texts.  A null id takes no
part: its component is null.  Texts are hashed in bounded runs, so very long ones need no more
memory than their words.  Empty tables give empty results, columns of other names stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, staged, texts
from fluxora.llm.setsketch import components

BITS = 64
RUN = 1 << 15  # hashes whose bits are counted at once


@dataclass(frozen=True)
class Linking:
    """Shingle length, seed, radius, and the sizes of trees and of slices of a shard."""

    shingle: int = 3
    seed: int = 42
    radius: int = 3
    tree_rows: int = 4096
    slice_rows: int = 65536


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """The fingerprint of a text, unsigned."""
    # bytes.lower and bytes.split know ASCII letters and white space only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    runs = zip(*(words[k : len(words) - width + 1 + k] for k in range(width)))
    hashed = map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed))
    total, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for _ in range(0, n, RUN):
        part = np.fromiter((h for h, _ in zip(hashed, range(RUN))), "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * total > n, bitorder="little")
    return int(chosen.view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprinted(docs: DataFrame, config: Linking) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row, staged."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            found = [fingerprint(t, config.shingle, config.seed) for t in texts(batch)]
            ids = batch.column("doc_id").to_pylist()
            return [{"doc_id": i, "fp": signed(f)} for i, f in zip(ids, found)]

        return work

    return staged(map_rows(doc_view(docs, "doc_id", "text"), make, "doc_id long, fp long"), "prints")


@dataclass
class Tree:
    """A BK-tree in arrays; children of one parent are neighbours, ordered by their edge.

    ``slots`` holds parent * 128 + edge of every node but the root, ascending, and
    ``members`` the node in that slot.
    """

    prints: np.ndarray
    slots: np.ndarray
    members: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(prints: np.ndarray) -> Tree:
    """The tree of distinct fingerprints: all nodes of one depth are placed together."""
    n = len(prints)
    below = np.zeros(n, np.int64)  # the deepest node that each is known to hang under
    waiting = np.arange(1, n)
    slots, members = [], []
    while len(waiting):
        edge = distance(prints[waiting], prints[below[waiting]])
        slot = below[waiting] * 128 + edge
        taken, first = np.unique(slot, return_index=True)
        slots.append(taken)
        members.append(waiting[first])
        below[waiting] = waiting[first][np.searchsorted(taken, slot)]
        waiting = np.delete(waiting, first)
    if not slots:
        return Tree(prints, np.zeros(0, np.int64), np.zeros(0, np.int64))
    all_slots, all_members = np.concatenate(slots), np.concatenate(members)
    order = np.argsort(all_slots)
    return Tree(prints, all_slots[order], all_members[order])


def walk(tree: Tree, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``asked``, node) of all nodes within the radius, in parts."""
    who = np.arange(len(asked))
    node = np.zeros(len(asked), np.int64)
    while len(who):
        d = distance(asked[who], tree.prints[node])
        near = d <= radius
        yield who[near], node[near]
        low = np.searchsorted(tree.slots, node * 128 + np.maximum(d - radius, 0))
        high = np.searchsorted(tree.slots, node * 128 + np.minimum(d + radius, 127), side="right")
        many = high - low
        who = np.repeat(who, many)
        skipped = np.repeat(np.cumsum(many) - many, many)
        node = tree.members[np.repeat(low, many) + np.arange(len(skipped)) - skipped]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of ``n`` places is joined to by the links."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def run_key(run: int, runs: int) -> Column:
    """The bits of one run, as a number."""
    low, high = BITS * run // runs, BITS * (run + 1) // runs
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


TREE = "shard long, tree long, prints binary, nodes binary, slots binary, members binary"


def tree_row(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    tree = grow(group["fp"].to_numpy(np.int64).view(np.uint64))
    row = {
        "shard": int(group["shard"].iloc[0]), "tree": int(group["tree"].iloc[0]),
        "prints": tree.prints.astype("<u8").tobytes(),
        "nodes": group["node"].to_numpy("<i8").tobytes(),
        "slots": tree.slots.astype("<i8").tobytes(),
        "members": tree.members.astype("<i8").tobytes(),
    }
    return pd.DataFrame([row])


def links_in(tree_side: pd.DataFrame, asked_side: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links between a slice's members and one tree."""
    if not len(tree_side) or not len(asked_side):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    row = tree_side.iloc[0]
    tree = Tree(
        *(np.frombuffer(row[c], k) for c, k in (("prints", "<u8"), ("slots", "<i8"), ("members", "<i8")))
    )
    in_tree = np.frombuffer(row["nodes"], "<i8")
    asked_side = asked_side.sort_values("node")
    asked, asking = asked_side["fp"].to_numpy(np.int64).view(np.uint64), asked_side["node"].to_numpy()
    names, place = np.unique(np.concatenate([in_tree, asking]), return_inverse=True)
    tree_place, asked_place = place[: len(in_tree)], place[len(in_tree) :]

    def links():
        for at in range(0, len(asked), 256):
            for who, node in walk(tree, asked[at : at + 256], radius):
                yield asked_place[at + who], tree_place[node]

    label = forest(len(names), links())
    joined = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"a": names[joined], "b": names[label[joined]]})


def print_links(nodes: DataFrame, config: Linking) -> DataFrame:
    """Links (a, b) that join all nodes (fp, node) within the radius, staged."""
    total = nodes.count()
    runs = config.radius + 1
    shards = max(1, -(-total // config.tree_rows))
    keyed = nodes.select(
        "fp", "node",
        F.posexplode(F.array(*[run_key(k, runs) for k in range(runs)])).alias("run", "value"),
    )
    shard = F.col("run") * shards + F.pmod(F.xxhash64("run", "value"), F.lit(shards))
    placed = keyed.select("fp", "node", shard.cast("long").alias("shard"))
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(
        "shard",
        F.ceil(F.col("n") / config.tree_rows).alias("trees"),
        F.ceil(F.col("n") / config.slice_rows).alias("slices"),
    )
    # Shards differ from the mean by crowding alone; the sizes are a row per shard.
    members = staged(
        placed.join(sizes, "shard").withColumn("salt", F.xxhash64("fp")), "members"
    )
    grouped = members.select(
        "shard", "slices", F.pmod("salt", "trees").alias("tree"), "fp", "node"
    )
    trees = staged(
        grouped.groupBy("shard", "tree").applyInPandas(tree_row, TREE), "trees"
    )
    sent = trees.join(sizes, "shard").select(
        *[f.split()[0] for f in TREE.split(", ")],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
    )
    asked = members.select(
        "shard", "fp", "node",
        F.pmod(F.shiftright("salt", 16), F.col("slices")).alias("slice"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"),
    )
    radius = config.radius
    key = ["shard", "tree", "slice"]
    found = sent.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
        lambda tree, slice_: links_in(tree, slice_, radius), "a long, b long"
    )
    return staged(found, "links")


def simhash_components(docs: DataFrame, config: Linking | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    config = config or Linking()
    prints = fingerprinted(docs, config)
    nodes = staged(
        prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes"
    )
    named = staged(prints.join(nodes, "fp", "left"), "named")
    # An id with several fingerprints joins their nodes.
    several = (
        named.filter("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    )
    own = named.join(several.select("doc_id", "low"), "doc_id").select(
        F.col("node").alias("a"), F.col("low").alias("b")
    )
    labels = components(print_links(nodes, config).unionByName(own))
    out = named.join(labels, "node", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node")).alias("component_id"),
    )
