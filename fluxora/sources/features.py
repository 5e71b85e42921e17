"""Scan of FeatureCollection documents of any length: one file is read by many tasks.

The text is cut at every closing brace, which the file splits of Spark handle, so a document on
one single line splits as well.  Where a split starts (inside a string or not, how deep) depends
on all text before it.  So every block first says what it does to either kind of start: whether it
ends inside a string, by how much the nesting changes, how low it falls, and which ``"features": [``
are still open at its end.  These few numbers per block are put together in file order; then every
block cuts its own text into features.  A feature that runs over the end of a block is put together
from its pieces, one group for each such feature.

Nothing is lost silently: every object in the ``features`` array of the root is either a row or a
rejected one, with file, byte position and reason, and every file has a row that tells whether its
nesting closed (unknown for compressed files, which one task reads each).

* A feature that is no valid JSON or UTF-8, or has values of another type: rejected.
* A document that ends within a feature: its open piece is rejected, block by block.
* Brackets that do not match shift what follows: up to the end of the file it is one open piece.
* Members of ``features`` that are no objects hold nothing to read.  An escaped spelling of the
  key ``features`` is not recognised.  Empty files and files without features give no rows.

The window over blocks has one row per block of ``spark.sql.files.maxPartitionBytes``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxora.session import counted_side, stage

FILE, BLOCK, SEQ, DATA = "__file", "__block", "__seq", "__data"
BROKEN = "__broken"
OPENS_FEATURES = re.compile(rb'"features"\s*:\s*\[')
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1
TOKEN = STEP != 0
TOKEN[ord('"')] = True


@dataclass(frozen=True)
class Collections:
    """Features (properties and geometry), rejected ones, and a row per file."""

    rows: DataFrame
    rejected: DataFrame
    files: DataFrame


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, in file order within a block."""
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return text.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.col("_metadata.file_size").alias("__size"),
        F.monotonically_increasing_id().alias(SEQ),
        F.col("value").cast("binary").alias(DATA),
    )


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, int, bytes]]:
    """First row, file, block, file size and text of the rows of one block that follow one another."""
    files, blocks = batch.column(FILE), batch.column(BLOCK).to_numpy(zero_copy_only=False)
    if not len(blocks):
        return
    codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    edges = [0, *change.tolist(), len(blocks)]
    data, sizes = batch.column(DATA), batch.column("__size")
    for low, high in zip(edges[:-1], edges[1:]):
        text = b"}".join(data.slice(low, high - low).to_pylist()) + b"}"
        yield low, files[low].as_py(), int(blocks[low]), sizes[low].as_py(), text


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of braces, brackets and plain quotes, their steps, and the quotes before each."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(TOKEN[raw])
    quotes = raw[at] == ord('"')
    escaped = []
    for p in at[quotes & (at > 0) & (raw[np.maximum(at - 1, 0)] == ord("\\"))].tolist():
        q = p
        while q and raw[q - 1] == ord("\\"):
            q -= 1
        if (p - q) % 2:
            escaped.append(p)
    if escaped:
        keep = ~np.isin(at, escaped)
        at, quotes = at[keep], quotes[keep]
    return at, STEP[raw[at]], np.cumsum(quotes) - quotes


def feature_arrays(text: bytes, at: np.ndarray) -> list[tuple[int, int]]:
    """Tokens that begin the key and the array of each ``"features": [``."""
    found = []
    for m in OPENS_FEATURES.finditer(text):
        i, j = np.searchsorted(at, [m.start(), m.end() - 1]).tolist()
        if at[i] == m.start():
            found.append((i, j))
    return found


def quotes_in(steps: np.ndarray) -> int:
    return int(np.count_nonzero(steps == 0))


class Summary:
    """What one block does to a start outside (0) and inside (1) a string.

    The text comes with a brace at its end that the file may lack: ``cut_depth`` and ``cut_low``
    are told without it.
    """

    def __init__(self) -> None:
        self.bytes = 0
        self.flips = 0
        self.depth = [0, 0]
        self.low = [0, 0]
        self.open: list[list[int]] = [[], []]
        self.pending = b""

    def add(self, text: bytes) -> None:
        self.take(self.pending)
        self.pending = text

    def take(self, text: bytes) -> None:
        at, steps, before = tokens(text)
        arrays = feature_arrays(text, at)
        for start in (0, 1):
            outside = (before + self.flips + start) % 2 == 0
            depth = self.depth[start] + np.cumsum(np.where(outside, steps, 0))
            if not len(depth):
                continue
            least = np.minimum.accumulate(depth[::-1])[::-1]
            # Still open: the nesting never fell back to where the array stands.
            self.open[start] = [d for d in self.open[start] if least[0] > d] + [
                int(depth[j]) - 1 for i, j in arrays if outside[i] and outside[j] and least[j] >= depth[j]
            ]
            self.low[start] = min(self.low[start], int(least[0]))
            self.depth[start] = int(depth[-1])
        self.bytes += len(text)
        self.flips += quotes_in(steps)

    def row(self, file: str, block: int, size: int) -> dict:
        self.take(self.pending[:-1])
        cut = {"cut_depth": list(self.depth), "cut_low": list(self.low)}
        self.take(self.pending[-1:])
        return {
            FILE: file, BLOCK: block, "__size": size, "bytes": self.bytes, "flips": self.flips % 2,
            "depth": self.depth, "low": self.low, **cut,
            "open": [sorted(set(levels)) for levels in self.open],
        }


SUMMARY = pa.schema(
    [
        (FILE, pa.string()), (BLOCK, pa.int64()), ("__size", pa.int64()), ("bytes", pa.int64()),
        ("flips", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("depth", "low", "cut_depth", "cut_low")],
        ("open", pa.list_(pa.list_(pa.int64()))),
    ]
)
SUMMARY_DDL = (
    f"{FILE} string, {BLOCK} bigint, __size bigint, bytes bigint, flips bigint, depth array<bigint>, "
    "low array<bigint>, cut_depth array<bigint>, cut_low array<bigint>, open array<array<bigint>>"
)


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, told = None, Summary()
    for batch in batches:
        done = []
        for _, file, block, size, text in runs(batch):
            if key != (file, block, size):
                if key:
                    done.append(told.row(*key))
                key, told = (file, block, size), Summary()
            told.add(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, SUMMARY)
    if key:
        yield pa.RecordBatch.from_pylist([told.row(*key)], SUMMARY)


def starts(summaries: DataFrame) -> DataFrame:
    """For each block: how it starts, where its text lies, and who holds the feature it starts in.

    ``owner`` is the block in which the feature open at the start began; ``ends`` tells whether the
    one open at the end of this block is closed further on.
    """
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)

    def sum_before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    def pick(name: str) -> Column:
        cut = F.element_at(f"cut_{name}", (F.col("inside") + 1).cast("int"))
        return F.when(F.col("trim"), cut).otherwise(F.element_at(name, (F.col("inside") + 1).cast("int")))

    # Bytes that the fragments have beyond the file: one for a brace the file does not end with,
    # three less for a byte-order mark, which the reader takes off.
    beyond = F.col("total") - F.col("__size")
    return (
        summaries.withColumn("total", F.sum("bytes").over(Window.partitionBy(FILE)))
        .withColumn("last", F.lead(BLOCK).over(Window.partitionBy(FILE).orderBy(BLOCK)).isNull())
        .withColumn("trim", F.col("last") & beyond.isin(1, -2))
        .withColumn("inside", sum_before("flips") % 2)
        .withColumn("offset", sum_before("bytes") + F.when(beyond.isin(-3, -2), 3).otherwise(0))
        .withColumn("step", pick("depth"))
        .withColumn("start", sum_before("step"))
        .withColumn("lowest", F.col("start") + pick("low"))
        .withColumn("end", F.col("start") + F.col("step"))
        .withColumn(
            "opens", F.array_contains(F.element_at("open", (F.col("inside") + 1).cast("int")), 1 - F.col("start"))
        )
        # A block that falls to the root decides alone whether ``features`` is open at its end.
        .withColumn("decides", F.when(F.col("lowest") <= 1, F.col("opens")))
        .withColumn("within", F.coalesce(F.last("decides", True).over(before), F.lit(False)))
        .withColumn("owner", F.last(F.when(F.col("lowest") <= 2, F.col(BLOCK)), True).over(before))
        .withColumn("ends", F.coalesce(F.min("lowest").over(after) <= 2, F.lit(False)))
        .withColumn("closed", F.when(beyond.isin(0, 1, -2, -3), F.col("end") == 0))
        .select(FILE, BLOCK, *STATE, "closed")
    )


# How a block starts, and whether the feature that is open at its end has one.
STATE = ["inside", "start", "within", "owner", "ends", "offset", "trim"]
PIECES = pa.schema(
    [
        (FILE, pa.string()), ("posicao", pa.int64()), (BLOCK, pa.int64()), ("owner", pa.int64()),
        ("whole", pa.bool_()), ("open", pa.bool_()), (DATA, pa.binary()),
    ]
)
PIECES_DDL = (
    f"{FILE} string, posicao bigint, {BLOCK} bigint, owner bigint, whole boolean, open boolean, {DATA} binary"
)


class Cutter:
    """Cuts the text of one block, whose start is known, into features and pieces of them."""

    def __init__(self, file: str, block: int, told: dict) -> None:
        self.file, self.block, self.told = file, block, told
        self.depth, self.inside = told["start"], told["inside"]
        self.within = told["within"]
        self.offset = told["offset"]
        # Text of the feature that is open, its position, and whether it began in this block.
        self.parts: list[bytes] = []
        self.position, self.own = self.offset, False
        self.open = self.within and self.depth > 2
        self.pending = b""

    def piece(self, whole: bool, open_end: bool) -> dict:
        owner = self.block if self.own else self.told["owner"]
        return {
            FILE: self.file, "posicao": self.position, BLOCK: self.block, "owner": owner,
            "whole": whole, "open": open_end, DATA: b"".join(self.parts),
        }

    def add(self, text: bytes) -> Iterator[dict]:
        yield from self.take(self.pending)
        self.pending = text

    def take(self, text: bytes) -> Iterator[dict]:
        at, steps, before = tokens(text)
        outside = (before + self.inside) % 2 == 0
        moves = np.where(outside, steps, 0)
        depth = self.depth + np.cumsum(moves)
        arrays = {j for i, j in feature_arrays(text, at) if outside[i]}
        # Entering a member of the root, opening a feature, closing one.
        enter = (moves == 1) & (depth == 2)
        first = (moves == 1) & (depth == 3)
        close = (moves == -1) & (depth == 2)
        kept_from = 0
        for i in np.flatnonzero(enter | first | close).tolist():
            p = int(at[i])
            if enter[i]:
                self.within = i in arrays
            elif not self.within:
                continue
            elif first[i] and text[p : p + 1] == b"{":
                self.open, self.own, self.parts = True, True, []
                self.position, kept_from = self.offset + p, p
            elif close[i] and self.open:
                self.parts.append(text[kept_from : p + 1])
                yield self.piece(self.own, False)
                self.open, self.parts = False, []
        if self.open:
            self.parts.append(text[kept_from:])
        if len(depth):
            self.depth = int(depth[-1])
        self.inside = (self.inside + quotes_in(steps)) % 2
        self.offset += len(text)

    def finish(self) -> Iterator[dict]:
        yield from self.take(self.pending[:-1] if self.told["trim"] else self.pending)
        if self.open:
            yield self.piece(False, not self.told["ends"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, cutter = None, None
    for batch in batches:
        done: list[dict] = []
        states = batch.select(STATE)
        for row, file, block, _, text in runs(batch):
            if key != (file, block):
                if cutter:
                    done += cutter.finish()
                told = states.slice(row, 1).to_pylist()[0]
                if told["start"] is None:
                    raise RuntimeError(f"the splits of {file} changed between two reads")
                key, cutter = (file, block), Cutter(file, block, told)
            done += cutter.add(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, PIECES)
    if cutter:
        done = list(cutter.finish())
        if done:
            yield pa.RecordBatch.from_pylist(done, PIECES)


def scan_collections(spark: SparkSession, path: str, properties: dict[str, str]) -> Collections:
    """Features of all FeatureCollection documents below ``path``; see the module's rules."""
    summaries = stage(fragments(spark, path).mapInArrow(summarise, SUMMARY_DDL), "feature-blocks")
    told = stage(starts(summaries), "feature-starts")
    text = fragments(spark, path).join(
        counted_side(told.select(FILE, BLOCK, *STATE), "feature-states"), [FILE, BLOCK], "left"
    )
    ordered = text.sortWithinPartitions(FILE, BLOCK, SEQ)
    pieces = stage(ordered.mapInArrow(cut, PIECES_DDL), "feature-pieces")
    whole = pieces.where("whole").select(FILE, "posicao", DATA)
    # One group is one feature, and only those that run over the end of a block.
    parts = pieces.where("NOT whole AND NOT open").groupBy(FILE, "owner").agg(
        F.array_sort(F.collect_list(F.struct(BLOCK, "posicao", DATA))).alias("p")
    )
    joined = parts.select(
        FILE,
        F.col("p")[0]["posicao"].alias("posicao"),
        F.aggregate(F.col("p")[DATA], F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias(DATA),
    )
    props = ", ".join(f"`{n}`: {t}" for n, t in properties.items())
    schema = (
        f"struct<properties: struct<{props}>, geometry: struct<type: string, coordinates: string>, "
        f"{BROKEN}: string>"
    )
    valid = F.is_valid_utf8(F.col(DATA).cast("string"))
    read = (
        whole.unionByName(joined)
        .withColumn("valid", valid)
        .withColumn(
            "f",
            F.when(F.col("valid"), F.from_json(F.col(DATA).cast("string"), schema, {"columnNameOfCorruptRecord": BROKEN})),
        )
        .withColumn(
            "motivo",
            F.when(~F.col("valid"), "undecodable").when(F.col("f")[BROKEN].isNotNull(), "malformed"),
        )
    )
    read = stage(read, "features")
    rows = read.where("motivo IS NULL").select("f.properties.*", "f.geometry")
    shown = [F.col(FILE).alias("arquivo"), "posicao", "motivo", F.col(DATA).alias("dados")]
    rejected = read.where("motivo IS NOT NULL").select(*shown).unionByName(
        pieces.where("open").withColumn("motivo", F.lit("open")).select(*shown)
    )
    files = told.groupBy(F.col(FILE).alias("arquivo")).agg(
        F.count(F.lit(1)).alias("blocos"),
        F.max_by("closed", BLOCK).alias("fechada"),
    )
    return Collections(rows, rejected, files)


def write_collections(lines: DataFrame, path: str) -> None:
    """Features given as JSON in the first column, one whole document per task."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string())})

        comma = ""
        yield part(['{"type": "FeatureCollection", "features": ['])
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            if texts:
                yield part([comma + texts[0], *("," + t for t in texts[1:])])
                comma = ","
        yield part(["]}"])

    lines.mapInArrow(documents, "value string").write.mode("overwrite").text(path)
