"""Near-duplicate detection by SetSketch registers (operator 6).

A document's set are its distinct word shingles.  Its sketch has one register per seed: the
smallest exponentially distributed hash of the set's members, kept as the truncated
exponent 1 - log_b(x) in 16 bits.  Larger registers stand for smaller minima, so the sketch
of a union is the maximum of the sketches, and registers of similar sets tend to be equal.

1. Equal sets are one class, named by its smallest document id.
2. Registers are cut into bands; classes that agree in a band meet in a bucket.  Each member
   is compared with the bucket's hub only (the member that meets most others in all its
   buckets): a star, never all pairs.
3. A pair's similarity is estimated from its registers: the maximum of the joint likelihood
   of "larger, smaller, equal" given both set sizes.  Pairs far below the wanted similarity
   are dropped; of the rest each class goes to its best partner and is verified on the full
   sets of shingles.  Verified links give components.
4. Buckets that still hold several components are searched to the end: buckets that share
   members form a cluster, and in each cluster the members outside its largest component
   meet all other members, in tiles of bounded size, on their full sets.  A tile returns the
   links that join components, at most one per member.  So each pair that meets in a band is
   inside one component or compared in full.

A pair at the wanted similarity of 0.8 misses all 30 bands of 4 with a chance below 1e-6, and
pairs above are safer still.  The estimate's margin is more than four of its standard errors,
and what it drops wrongly step 4 finds.

Documents without words are linked with nothing.  Fewer words than a shingle count as one
shingle.  Rows with one id are one document, linked by any of its texts.  A null id takes no
part: its component is null and it is kept.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, staged, texts
from fluxora.session import counted_side, stage_counted


@dataclass(frozen=True)
class Sketching:
    """Shingle length, similarity in percent, and the shape of the sketches."""

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    base: float = 1.02
    rate: float = 20.0
    margin: float = 0.17
    tile: int = 256
    star: int = 64

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int) -> np.ndarray:
    start = np.uint64(stream) << np.uint64(32)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    # bytes.lower and bytes.split know ASCII letters and white space only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    factors = seeds(width, 1) | np.uint64(1)
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(hashes[k : len(words) - width + 1 + k] + factors[k]) * factors[k]
    return np.unique(mix(total))


def sketches(sets: list[np.ndarray], config: Sketching) -> np.ndarray:
    """Registers (one row per set, none empty)."""
    factors = seeds(config.registers, 2) | np.uint64(1)
    shifts = seeds(config.registers, 3)
    joined = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), config.registers), np.uint64)
    for i in range(config.registers):
        low[:, i] = np.minimum.reduceat(joined * factors[i] + shifts[i], begins)
    # Uniform to exponential keeps the order, so the smallest hash is the smallest draw.
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / config.rate
    levels = np.floor(1 - np.log(x) / np.log(config.base))
    return np.clip(levels, 0, 65535).astype(np.uint16)


def band_keys(registers: np.ndarray, config: Sketching) -> np.ndarray:
    """One 64-bit key per band."""
    parts = registers.reshape(len(registers), config.bands, config.rows).astype(np.uint64)
    keys = np.zeros((len(registers), config.bands), np.uint64) + seeds(config.bands, 4)
    for k in range(config.rows):
        keys = mix(keys + parts[:, :, k] + np.uint64(1))
    return keys


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Similarity of pairs of sketches: maximum of the joint likelihood, given set sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u, v = na / (na + nb), nb / (na + nb)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return (
            larger * np.log(np.maximum(up, tiny))
            + smaller * np.log(np.maximum(down, tiny))
            + equal * np.log(np.maximum(1 - up - down, tiny))
        )

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


SKETCH = "doc_id long, n long, digest binary, registers binary"


def sketched(docs: DataFrame, config: Sketching) -> DataFrame:
    """Set size, digest of the set and registers of every document, staged."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            sets = [shingles(t, config.shingle) for t in texts(batch)]
            rows = [
                {"doc_id": i, "n": len(s), "digest": None, "registers": None}
                for i, s in zip(batch.column("doc_id").to_pylist(), sets)
            ]
            full = [k for k, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(full):
                # Runs of about 64k members stay in the processor's cache.
                stop, size = at, 0
                while stop < len(full) and (stop == at or size < 65536):
                    size += len(sets[full[stop]])
                    stop += 1
                part = full[at:stop]
                for k, registers in zip(part, sketches([sets[k] for k in part], config)):
                    rows[k]["digest"] = blake2b(sets[k].tobytes(), digest_size=16).digest()
                    rows[k]["registers"] = registers.tobytes()
                at = stop
            return rows

        return work

    return staged(map_rows(doc_view(docs, "doc_id", "text"), make, SKETCH), "sketch")


def classes_of(sketch: DataFrame) -> DataFrame:
    """digest, node (smallest id), n, registers and how many documents share the set."""
    rows = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "n", "registers")).alias("first")
    return rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("docs")).select(
        "digest", F.col("first.doc_id").alias("node"), "first.n", "first.registers", "docs"
    )


def banded(classes: DataFrame, config: Sketching) -> DataFrame:
    """(key, node): the buckets each class falls into."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            registers = np.array(
                [np.frombuffer(r, np.uint16) for r in batch.column("registers").to_pylist()]
            )
            keys = band_keys(registers, config).view(np.int64).tolist()
            nodes = batch.column("node").to_pylist()
            return [{"key": k, "node": node} for node, own in zip(nodes, keys) for k in own]

        return work

    return map_rows(classes.select("node", "registers"), make, "key long, node long")


def estimated(pairs: DataFrame, classes: DataFrame, config: Sketching) -> DataFrame:
    """Pairs (a, b) whose estimated similarity comes near the wanted one, with it."""
    sides = classes.select("node", "n", "registers")
    named = lambda side: sides.select(*[F.col(c).alias(f"{side}_{c}") for c in sides.columns])
    both = pairs.join(named("a"), F.col("a") == F.col("a_node")).join(
        named("b"), F.col("b") == F.col("b_node")
    )
    least = config.percent / 100 - config.margin

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            a, b = (
                np.array([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()])
                for c in ("a_registers", "b_registers")
            )
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
            near = estimate(a, b, na, nb, config.base)
            ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), near.tolist())
            return [{"a": x, "b": y, "near": z} for x, y, z in ids if z >= least]

        return work

    columns = ["a", "b", "a_n", "b_n", "a_registers", "b_registers"]
    return map_rows(both.select(*columns), make, "a long, b long, near double")


def sets_of(docs: DataFrame, nodes: DataFrame, config: Sketching) -> DataFrame:
    """node and members (its sorted shingles, 8 bytes each) of the named classes, staged.

    The ids grow with the data, so the join is planned at every size as it has to run on a
    large corpus: one shuffle of the texts, no broadcast.
    """
    rows = doc_view(docs, "doc_id", "text").join(
        nodes.hint("shuffle_merge"), F.col("doc_id") == F.col("node")
    )

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            sets = [shingles(t, config.shingle).tobytes() for t in texts(batch)]
            return [{"node": n, "members": s} for n, s in zip(batch.column("node").to_pylist(), sets)]

        return work

    return staged(map_rows(rows.select("node", "text"), make, "node long, members binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, config: Sketching) -> DataFrame:
    """The pairs (a, b) whose full sets reach the wanted similarity, staged.

    Pairs meet in groups around b of about ``star`` sets; a b with many partners has
    several groups.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / config.star).alias("groups"))
    dealt = pairs.join(sizes, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("salt")
    )
    members = dealt.select(F.col("a").alias("node"), "b", "salt")
    centres = dealt.select(F.col("b").alias("node"), "b", "salt").distinct()
    rows = sets.hint("shuffle_merge").join(members.unionByName(centres), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["b"].iloc[0])
        is_centre = group["node"] == b
        opened = [np.frombuffer(s, np.uint64) for s in group["members"]]
        centres = [s for s, c in zip(opened, is_centre) if c]
        found = []
        for node, own, c in zip(group["node"], opened, is_centre):
            if c:
                continue
            for centre in centres:
                both = len(np.intersect1d(own, centre, assume_unique=True))
                if both and 100 * both >= config.percent * (len(own) + len(centre) - both):
                    found.append(int(node))
                    break
        return pd.DataFrame(
            {"a": pd.Series(found, dtype="int64"), "b": pd.Series([b] * len(found), dtype="int64")}
        )

    linked = rows.select("node", "b", "salt", "members").groupBy("b", "salt").applyInPandas(
        compare, "a long, b long"
    )
    return staged(linked, "links")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of all nodes that have links.

    Each round gives every node the smallest label among itself and its neighbours, and
    then that node's own label; links inside one label disappear and the rest goes on
    between labels, so rounds and links shrink fast.  A component's smallest node keeps its
    own label throughout.  Only counts reach the driver.
    """
    rounds: list[DataFrame] = []
    rest = links.select("a", "b")
    while True:
        rest, n = stage_counted(rest.filter("a <> b").distinct(), "edges")
        if not n:
            break
        both = rest.union(rest.select("b", "a")).toDF("node", "other")
        first = staged(
            both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels"
        )
        further = first.toDF("comp", "label")
        labels = staged(
            first.join(further, "comp", "left").select(
                "node", F.coalesce("label", "comp").alias("comp")
            ),
            "labels",
        )
        rounds.append(labels)
        rest = (
            rest.join(labels.toDF("a", "x"), "a")
            .join(labels.toDF("b", "y"), "b")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.toDF("comp", "label"), "comp", "left").select(
            "node", F.coalesce("label", "comp").alias("comp")
        )
    return staged(out, "labels")


def residue(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, node and comp of the members of buckets that hold several components."""
    placed = stars.join(labels, "node", "left").select(
        "key", "node", "b", F.coalesce("comp", "node").alias("comp")
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low < high")
        .select("key")
    )
    rows = staged(placed.join(mixed, "key").select("node", "comp", "b").distinct(), "rest")
    clusters = components(rows.select(F.col("node").alias("a"), "b"))
    return rows.select("node", "comp").distinct().join(
        clusters.select("node", F.col("comp").alias("cluster")), "node"
    )


def meet(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    out = np.zeros((len(ours), len(theirs)))
    common = np.intersect1d(np.concatenate(ours), np.concatenate(theirs))

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        joined = np.concatenate(sets)
        at = np.searchsorted(common, joined)
        at[at == len(common)] = 0
        hit = common[at] == joined
        return owner[hit], at[hit]

    if not len(common):
        return out
    (a_owner, a_at), (b_owner, b_at) = entries(ours), entries(theirs)
    step = 8192
    for low in range(0, len(common), step):
        width = min(step, len(common) - low)
        a, b = np.zeros((len(ours), width), np.float32), np.zeros((len(theirs), width), np.float32)
        for matrix, owner, at in ((a, a_owner, a_at), (b, b_owner, b_at)):
            inside = (at >= low) & (at < low + width)
            matrix[owner[inside], at[inside] - low] = 1
        out += a @ b.T
    return out


def joining(
    ours: pd.DataFrame, theirs: pd.DataFrame, percent: int
) -> list[tuple[int, int]]:
    """Links between the two sides that join components not yet joined by others."""
    a, b = ([np.frombuffer(s, np.uint64) for s in side["members"]] for side in (ours, theirs))
    both = meet(a, b)
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    linked = (both > 0) & (100 * both >= percent * (sizes - both))
    linked &= ours["comp"].to_numpy()[:, None] != theirs["comp"].to_numpy()[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    nodes, comps = (ours["node"].tolist(), theirs["node"].tolist()), (ours["comp"].tolist(), theirs["comp"].tolist())
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        x, y = root(comps[0][i]), root(comps[1][j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((nodes[0][i], nodes[1][j]))
    return out


def residual_links(rest: DataFrame, sets: DataFrame, config: Sketching) -> DataFrame:
    """Links (a, b) inside the clusters that join different components, staged."""
    per_comp = rest.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    shape = per_comp.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("most"),
        F.max_by("comp", F.struct("n", "comp")).alias("major"),
    )
    shape = shape.select(
        "cluster", "major",
        F.ceil(F.col("n") / config.tile).cast("int").alias("wide"),
        F.ceil((F.col("n") - F.col("most")) / config.tile).cast("int").alias("tall"),
    ).filter("tall > 0")
    rest = rest.join(counted_side(shape, "shape"), "cluster").withColumn("hash", F.xxhash64("node"))
    columns = ["cluster", "node", "comp"]
    every = rest.select(
        *columns, F.lit(False).alias("minor"),
        F.pmod("hash", F.col("wide")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("y"),
    )
    minor = rest.filter("comp != major").select(
        *columns, F.lit(True).alias("minor"),
        F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("x"),
        F.pmod(F.shiftright("hash", 20), F.col("tall")).cast("int").alias("y"),
    )

    def search(tile: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = tile[tile["minor"]], tile[~tile["minor"]]
        found = joining(ours, theirs, config.percent) if len(ours) and len(theirs) else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    placed = sets.hint("shuffle_merge").join(every.unionByName(minor), "node")
    found = placed.groupBy("cluster", "x", "y").applyInPandas(
        search, "a long, b long"
    )
    return staged(found, "links")


def links_of(docs: DataFrame, classes: DataFrame, config: Sketching) -> DataFrame:
    """node and comp of every class that is linked with another."""
    bands = staged(banded(classes, config), "bands")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(bands.join(sizes, "key"), "shared")
    hubs = shared.groupBy("node").agg(F.sum("n").alias("hub"))
    centres = (
        shared.join(hubs, "node")
        .groupBy("key")
        .agg(F.max_by("node", F.struct("hub", -F.col("node"))).alias("b"))
    )
    stars = staged(shared.select("key", "node").join(centres, "key"), "stars")
    sets = sets_of(docs, stars.select("node").distinct(), config)
    pairs = stars.filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    near = estimated(pairs, classes, config)
    best = near.groupBy("a").agg(F.max_by("b", F.struct("near", -F.col("b"))).alias("b"))
    links = verified(staged(best, "pairs"), sets, config)
    labels = components(links)
    rest, n = stage_counted(residue(stars, labels), "rest")
    if not n:
        return labels
    return components(links.unionByName(residual_links(rest, sets, config)))


def near_duplicates(docs: DataFrame, config: Sketching | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    config = config or Sketching()
    sketch = sketched(docs, config)
    classes = staged(classes_of(sketch), "classes")
    labels = links_of(docs, classes, config)
    known = (
        classes.join(labels, "node", "left")
        .filter("comp IS NOT NULL OR docs > 1")
        .select("digest", F.coalesce("comp", "node").alias("comp"))
    )
    out = sketch.select("doc_id", "n", "digest").join(known, "digest", "left")
    # An id with several texts belongs to the smallest component of its texts.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def first_of_each(docs: DataFrame, config: Sketching | None = None) -> DataFrame:
    """One document of each component, with all columns."""
    gone = near_duplicates(docs, config).filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    gone = staged(gone.distinct(), "gone")
    return docs.join(gone, F.col("`doc_id`") == F.col("__gone"), "left_anti")
