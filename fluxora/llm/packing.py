"""Best-fit packing with certified bin counts (operator 8).

Documents are tokenised once; longer ones are cut into pieces of ``room`` tokens, and the
table of pieces (no ids) is staged.  Pieces are dealt to groups of bounded size.  Each
group is packed by best-fit decreasing: a piece goes to the fullest sequence it fits into.

Dual feasible functions bound from below how many sequences a group needs: a function that
keeps sums of fitting pieces within a sequence turns the lengths into a sum that no packing
can beat.  Two families are tried at every parameter.  A group whose count equals its bound
is certified.  In each round the groups with a gap give up the pieces of all but their full
sequences, and certified groups those of their emptiest sequence (what a bound per group
cannot see); these are dealt anew to ever fewer groups and packed again by best-fit
decreasing.  Rounds end when one group is left, nothing is given up, or what is left no
longer fits fewer groups of bounded size.

Null or empty texts are a single piece, the end id.  Rows that repeat a doc_id are packed
each.  Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, staged
from fluxora.llm.tokens import WORD_BPE, encoder

ROOM = 4096
END = np.array([1], "<u4").tobytes()
GROUP = 100_000
SHRINK = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"


def pieces(docs: DataFrame, room: int = ROOM, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and checksum of every piece."""

    def make():
        work_on = encoder(WORD_BPE, path)

        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, raw in zip(ids, work_on.encode_column(batch.column("text"))):
                raw += END
                for n, at in enumerate(range(0, len(raw), 4 * room)):
                    part = raw[at : at + 4 * room]
                    crc = zlib.crc32(part)
                    rows.append(
                        {
                            "doc_id": doc_id, "piece": n, "start": at // 4,
                            "length": len(part) // 4, "ids_crc32": crc,
                            "row_key": zlib.crc32(f"{doc_id} {n}".encode(), crc),
                        }
                    )
            return rows

        return work

    return staged(map_rows(doc_view(docs, "doc_id", "text"), make, PIECES), "pieces")


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """The largest bound that the dual feasible functions give."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=room + 1).astype(np.int64)
    sizes = np.arange(room + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // room)
    # Above room - k counts as a whole sequence, below k as nothing.
    sums, many = np.cumsum(counts * sizes), np.cumsum(counts)
    for k in range(1, room // 2 + 1):
        whole = int(many[room] - many[room - k])
        middle = int(sums[room - k] - sums[k - 1])
        best = max(best, whole + -(-middle // room))
    # Rounded fractions: the sizes that divide evenly stay, others fall to a step below.
    for k in range(1, 33):
        even = (k + 1) * sizes % room == 0
        value = np.where(even, k * sizes, (k + 1) * sizes // room * room)  # times k
        best = max(best, -(-int(counts @ value) // (k * room)))
    return best


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]  # bins by what is left
    mask, made = 0, 0  # bit r: some bin has r left
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            at, left, made = made, room, made + 1
        bins[i], offsets[i] = at, room - left
        if left > size:
            free[left - size].append(at)
            mask |= 1 << (left - size)
    return bins, offsets


def pack_group(group: pd.DataFrame, room: int, number: int, last: bool) -> pd.DataFrame:
    """Pack one group; ``open`` marks the pieces it gives up for the next round."""
    group = group.sort_values(["length", "doc_id", "piece", "row_key"]).reset_index(drop=True)
    lengths = group["length"].to_numpy(np.int64)
    bins, offsets = best_fit(lengths, room)
    made = int(bins.max()) + 1 if len(bins) else 0
    bound = lower_bound(lengths, room)
    fill = np.bincount(bins, weights=lengths, minlength=made)
    given = np.zeros(made, dtype=bool)
    if not last and made:
        if made > bound:
            given = fill < room
        given[int(fill.argmin())] |= fill.min() < room
    group["sequence_id"], group["offset"] = bins + (number << 34), offsets
    group["open"] = given[bins]
    group["bins"], group["bound"] = made, bound
    return group


PACKED = PIECES + ", sequence_id long, offset long, open boolean, bins long, bound long"


def packer(room: int, number: int, last: bool):
    """:func:`pack_group` for the groups numbered from ``number``."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        own = number + int(part["group"].iloc[0])
        return pack_group(part.drop(columns="group"), room, own, last)

    return work


def packed(
    docs: DataFrame, room: int = ROOM, group_rows: int = GROUP, path: str | None = None
) -> DataFrame:
    """Every piece with its sequence and its place there."""
    todo = pieces(docs, room, path)
    names = [f.split()[0] for f in PIECES.split(", ")]
    # Full pieces fill a sequence alone and need no group.
    full = todo.filter(F.col("length") == room)
    todo = todo.filter(F.col("length") < room)
    groups = max(1, -(-todo.count() // group_rows))
    settled, number, last = [], 0, groups == 1
    while True:
        key = F.pmod(F.xxhash64("doc_id", "piece", "row_key", F.lit(number)), F.lit(groups))
        rows = todo.select(*names, key.cast("long").alias("group"))
        work = packer(room, number, last)
        done = staged(rows.groupBy("group").applyInPandas(work, PACKED), "packed")
        settled.append(done.filter(~F.col("open")))
        todo = done.filter("open").select(*names)
        left = 0 if last else todo.count()
        if not left:
            break
        number += groups
        fewer = max(1, -(-groups // SHRINK), -(-left // (4 * group_rows)))
        last = fewer == 1 or fewer >= groups
        groups = min(groups, fewer)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.select(
        *columns[:5],
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return out.select(*columns).unionByName(alone)
