"""Importance resampling towards a target distribution (operator 12).

Words (and runs of up to ``longest`` words) fall into hashed buckets.  Bucket counts of all
documents and of all target texts give each bucket's gain, the rounded-down log ratio of its
two smoothed shares; a document's weight is the mean gain of its features.  Noise drawn from
a hash of its id (Gumbel, so that the best scores are a draw without replacement by weight)
is added, and of the documents with at least ``least_words`` words a fixed percentage with
the highest scores is drawn.

* Counts: each task adds up one array of buckets; rows per bucket and task are shuffled, never
  a row per word.  A document's buckets are kept in a staged table, two bytes a feature, so
  that texts are cut into words once.
* Weights: the gains are one array of ``buckets`` integers (its size is the parameter), sent
  with the tasks; a document's weight is a lookup and a mean over its bucket array.
* Cutoff: a quantile sketch over the scores brackets the wanted place.  Exact counts of the
  rows above and inside the bracket tell whether the cutoff is inside; if not, the bracket is
  widened and counted again.  Only the rows of the bracket are sorted.
* Ranks: the drawn rows are sorted in ranges; a range begins after the rows of those before.

A null or empty text has no features and weight 0.  A null id has no score (its hash is
undefined) and is not drawn; it is not one of the N documents.  Rows that repeat an id are
drawn and ranked each; between equal rows the order has no effect on the result.  Ties go to
the smaller id.  Without target texts every t is 0.  Empty tables give empty results; columns
of other names stay out.  Very long texts are cut by one pass over their bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, staged, texts


@dataclass(frozen=True)
class Resampling:
    """Feature runs, hashed buckets, noise seed, and what share of which documents is drawn."""

    longest: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10
    accuracy: int = 10_000


def word_letters() -> bytes:
    """For bytes.translate: A-Z in lower case, digits, letters and other scripts, else a space."""
    table = bytearray(b" " * 256)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = bytes(range(low, high + 1))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    return bytes(table)


LETTERS = word_letters()


def features(text: str, config: Resampling) -> tuple[int, np.ndarray]:
    """The number of words of a text and the buckets of its features."""
    words = text.encode("utf-8", "surrogatepass").translate(LETTERS).split(b" ")
    words = [w for w in words if w]
    hashed = list(map(zlib.crc32, words))
    for size in range(2, config.longest + 1):
        runs = zip(*(words[k:] for k in range(size)))
        hashed += map(zlib.crc32, map(b" ".join, runs))
    return len(words), np.array(hashed, np.uint32) % np.uint32(config.buckets)


def hashed_features(docs: DataFrame, config: Resampling) -> DataFrame:
    """doc_id, words, n and the buckets (unsigned 32-bit numbers) of every row, staged."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words, found = features(text, config)
                kind = "<u2" if config.buckets <= 1 << 16 else "<u4"
                rows.append(
                    {"doc_id": doc_id, "words": words, "n": len(found), "buckets": found.astype(kind).tobytes()}
                )
            return rows

        return work

    schema = "doc_id long, words long, n long, buckets binary"
    return staged(map_rows(docs, make, schema), "features")


def opened(raw: bytes, config: Resampling) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if config.buckets <= 1 << 16 else "<u4")


def bucket_counts(hashed: DataFrame, config: Resampling) -> np.ndarray:
    """How many features fall into each bucket: one array, as long as there are buckets."""

    def make():
        total = np.zeros(config.buckets, np.int64)

        def work(batch: pa.RecordBatch) -> list[dict]:
            raw = b"".join(batch.column("buckets").to_pylist())
            total[:] += np.bincount(opened(raw, config), minlength=config.buckets)
            return []

        def rest():
            at = np.flatnonzero(total)
            yield [{"bucket": int(b), "n": int(total[b])} for b in at]

        work.rest = rest
        return work

    parts = map_rows(hashed.select("buckets"), make, "bucket int, n long")
    out = np.zeros(config.buckets, np.int64)
    # At most one row per bucket reaches the driver.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, config: Resampling) -> np.ndarray:
    """The rounded-down log ratio of every bucket."""
    s_all, t_all = float(source.sum() + config.buckets), float(target.sum() + config.buckets)
    pairs = zip(source.tolist(), target.tolist())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in pairs], np.int64
    )


def noise(doc_id: int, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(hashed: DataFrame, gain: np.ndarray, config: Resampling) -> DataFrame:
    """doc_id, words, n_features, weight and score of every row, staged."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "words", "n", "buckets"))
            for doc_id, words, n, raw in zip(*columns):
                weight = int(gain[opened(raw, config)].sum()) // n if n else 0
                score = None if doc_id is None else weight + noise(doc_id, config.seed)
                rows.append(
                    {"doc_id": doc_id, "words": words, "n_features": n, "weight": weight, "score": score}
                )
            return rows

        return work

    schema = "doc_id long, words long, n_features long, weight long, score long"
    return staged(map_rows(hashed, make, schema), "scores")


def cutoff(rows: DataFrame, wanted: int, total: int, accuracy: int) -> tuple[int, int] | None:
    """(score, doc_id) of the row at place ``wanted`` by falling score, then rising id.

    A sketch proposes scores low and high; counts decide: fewer than ``wanted`` rows stand
    above high, and at least so many at low or above.  Else that side of the bracket moves on
    by twice the ranks it was taken to be off by.
    """
    if wanted <= 0:
        return None
    off_low = off_high = 2 * total / accuracy + 1

    def share(place: float) -> float:
        return min(1.0, max(0.0, 1 - place / total))

    while True:
        asked = [share(wanted + off_low), share(wanted - off_high)]
        low, high = rows.agg(
            F.percentile_approx("score", asked, accuracy).alias("p")
        ).first()["p"]
        if off_low >= total:
            low = rows.agg(F.min("score")).first()[0]
        if off_high >= total:
            high = rows.agg(F.max("score")).first()[0]
        above, upto = rows.agg(
            F.coalesce(F.sum((F.col("score") > high).cast("long")), F.lit(0)),
            F.coalesce(F.sum((F.col("score") >= low).cast("long")), F.lit(0)),
        ).first()
        if above < wanted <= upto:
            break
        off_high *= 2 if above >= wanted else 1
        off_low *= 2 if upto < wanted else 1
    bracket = rows.filter(F.col("score").between(low, high))
    # Scores are whole numbers in a range that the formula bounds (some 10**5 values), so the
    # bracket's histogram may be collected; it leads to the score that holds the place, and
    # only that score's rows are ordered by id.
    left = wanted - above
    steps = bracket.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"))
    for score, n in steps.collect():
        if left <= n:
            break
        left -= n
    ids = ranked(bracket.filter(F.col("score") == score).select("score", "doc_id"))
    return score, ids.filter(F.col("rank") == left).first()["doc_id"]


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` (from 1) by falling score, then rising id.

    Rows are sorted in ranges: a range's first rank is the number of rows in the ranges before.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    dealt = staged(
        rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # One row per range: as many as the session has shuffle partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (
        dealt.withColumn("inside", inside)
        .join(F.broadcast(starts), "range")
        .withColumn("rank", (F.col("start") + F.col("inside")).cast("long"))
        .drop("range", "inside", "start")
    )


def resampled(docs: DataFrame, target: DataFrame, config: Resampling | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    config = config or Resampling()
    hashed = hashed_features(doc_view(docs, "doc_id", "text"), config)
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    source_counts = bucket_counts(hashed, config)
    target_counts = bucket_counts(hashed_features(aims, config), config)
    rows = scored(hashed, gains(source_counts, target_counts, config), config)
    enough = rows.filter((F.col("words") >= config.least_words) & F.col("score").isNotNull())
    total = enough.count()
    last = cutoff(enough, total * config.percent // 100, total, config.accuracy)
    names = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    score, doc_id = last
    is_drawn = (
        (F.col("words") >= config.least_words)
        & F.col("score").isNotNull()
        & ((F.col("score") > score) | (F.col("score") == score) & (F.col("doc_id") <= doc_id))
    )
    drawn = ranked(rows.filter(is_drawn).select(*names))
    # A repeated id at the cutoff can bring more rows than wanted: the first ones are drawn.
    wanted = total * config.percent // 100
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.filter(~F.coalesce(is_drawn, F.lit(False)))
    return drawn.select(*names, "rank").unionByName(
        rest.select(*names, F.lit(None).cast("long").alias("rank"))
    )


def oracle(config: Resampling | None = None) -> str:
    """DuckDB's twin; the checksum is folded over each distinct word's bytes."""
    c = config or Resampling()
    if c.longest != 1:
        raise ValueError("the twin knows single words only")
    return f"""
WITH RECURSIVE poly(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
  FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
w AS (
  SELECT 's' AS side, doc_id, n.word FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents) n
  UNION ALL
  SELECT 't', NULL, n.word FROM (
    SELECT unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark) n),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
hashed AS (
  SELECT word, CAST(xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2),
        lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
      lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) AS BIGINT) + 1])),
      4294967295::UBIGINT) % {c.buckets} AS BIGINT) AS bucket
  FROM words, crc),
counts AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
  FROM w JOIN hashed USING (word) GROUP BY bucket),
alls AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + {c.buckets})::DOUBLE
    / ((s + 1) * (t_all + {c.buckets})::DOUBLE))) AS BIGINT) AS g FROM counts, alls),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
  FROM w JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id),
scores AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{c.seed}:' || d.doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    count(*) OVER () AS total
  FROM scores WHERE n_features >= {c.least_words})
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= {c.percent} * total // 100 THEN rank END AS rank
FROM scores LEFT JOIN placed USING (doc_id)
"""
