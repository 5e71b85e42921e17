"""Toxicity: a convolutional text classifier in numpy (operator 9).

Words are hashed to rows of an embedding table; filters of widths 1, 2 and 3 run over the
whole text, each filter keeps its largest response (max pooling), and a logistic layer
weighs the responses.  The model learns from every labelled document whose
``crc32(doc_id) % 5`` is not 0; scoring reads every document whole.

The language that picks a document's threshold is guessed from its function words, never
read from a column.  A quarter of the labelled documents is held from training; thresholds
come from the counts of all of them by logit (steps of ``1 / GRID``), and are folded into the
score, so that 0.5 is the threshold everywhere.

The texts are turned into word buckets once; the counts of words, the training and the
scores read those.  Training runs in shards of some ``shard`` documents: in a round every
shard goes on from the same model over its own documents, and the weights are averaged (a
word's over the shards that moved it).  Every document is passed ``epochs`` times at any size:
by a single shard in one round, by more shards in as many rounds.  The averages are sums of fixed-point integers, so the same input gives the same model whatever
the order.  The driver holds the model, which has a fixed size, and no document.

Null and empty texts get the score of a text without words.  Without labels of both kinds
every score is 0.  Several labels of one document count as toxic if one is; repeated rows
are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, staged, texts, worker_store
from fluxora.session import shuffles_removed

WORD = re.compile(r"[^\W\d_]+")
WIDTHS = (1, 2, 3)
GRID = 512  # steps of a logit in the counts behind the thresholds
FIXED = 1 << 30  # fixed point of weights that are averaged
# Function words of some languages (fixed values).
PROFILES = {
    "en": "the of and to in is that for it with as was on are by this be at from or",
    "de": "der die und das von den mit im des auf für ist nicht ein eine als dem sich zu",
    "fr": "le la les et des un une du dans est que qui sur pas pour au avec par en",
    "es": "el los las que y del un una por con para es se su al lo como más en",
    "it": "il di che è per un una sono non della con del si da come le gli nel",
    "pt": "o os as que e do da em um uma para com não por mais dos no na ao",
    "nl": "het een van en dat op te zijn met voor niet aan er om ook als bij",
}


@dataclass(frozen=True)
class Config:
    """Size of the network, documents of a shard and passes over them."""

    shard: int = 8192
    bits: int = 18
    dim: int = 8
    filters: int = 8
    epochs: int = 8
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


def bucket(word: str, bits: int) -> int:
    # Bucket 0 is left to the padding.
    return 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % ((1 << bits) - 1)


def word_ids(text: str, bits: int) -> tuple[np.ndarray, str]:
    """Buckets of the words, and the guessed language ("" if none stands out)."""
    words = WORD.findall(text.lower())
    known = worker_store(f"buckets{bits}")
    if len(known) > 400_000:
        known.clear()
    ids = np.empty(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        at = known.get(w)
        if at is None:
            at = known[w] = bucket(w, bits)
        ids[i] = at
    return ids, guess(words)


def guess(words: list[str]) -> str:
    tables = worker_store("profiles")
    if not tables:
        tables.update({k: frozenset(v.split()) for k, v in PROFILES.items()})
    hits = {k: sum(map(t.__contains__, words)) for k, t in tables.items()}
    best = max(hits, key=lambda k: (hits[k], k))
    return best if hits[best] >= 2 else ""


def responses(ids: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over the text, and where its window begins."""
    n, pad = len(ids), max(WIDTHS) - 1
    x = model["table"][np.concatenate([ids, np.zeros(pad + (n == 0), dtype=np.int64)])]
    tops, places = [], []
    for width, taps in zip(WIDTHS, model["taps"]):
        rows = max(1, n)
        z = x[:rows] @ taps[0]
        for k in range(1, width):
            z = z + x[k : k + rows] @ taps[k]
        at = z.argmax(axis=0)
        places.append(at)
        tops.append(z[at, np.arange(z.shape[1])])
    return np.concatenate(tops), np.concatenate(places)


def logit(ids: np.ndarray, model: dict) -> float:
    top, _ = responses(ids, model)
    return float(np.maximum(top + model["shift"], 0) @ model["out"] + model["bias"][0])


def new_model(buckets: np.ndarray, seen: np.ndarray, total: np.ndarray, config: Config) -> dict:
    """The model before training: ``seen`` holds, per class, the documents with each bucket."""
    rng = np.random.default_rng(config.seed)
    size, dim, count = 1 << config.bits, config.dim, config.filters
    table = rng.normal(0, 0.05, (size, dim)).astype(np.float32)[buckets]
    # First component: smoothed log odds of a word among toxic documents.
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    table[:, 0] = np.where(seen.sum(axis=0) >= 3, 0.25 * odds, 0)
    taps = [rng.normal(0, 0.3, (w, dim, count)).astype(np.float32) for w in WIDTHS]
    for block in taps:
        block[0, 0] += 1
    free = np.concatenate(
        [*[t.ravel() for t in taps], np.zeros(count * len(WIDTHS)), np.full(count * len(WIDTHS), 0.1), [-1.0]]
    ).astype(np.float32)
    # For every weight the sum of its squared steps (Adagrad); one for a row of the table.
    return {
        "bits": config.bits, "buckets": buckets, "rows": table, "free": free,
        "grown_rows": np.full(len(buckets), 1e-2, dtype=np.float32),
        "grown_free": np.full(len(free), 1e-2, dtype=np.float32),
    }


def cut_free(free: np.ndarray, dim: int, count: int) -> dict:
    """The weights beside the table by name, as views."""
    out, at = {"taps": []}, 0
    for w in WIDTHS:
        out["taps"].append(free[at : at + w * dim * count].reshape(w, dim, count))
        at += w * dim * count
    all_filters = count * len(WIDTHS)
    out["shift"], out["out"] = free[at : at + all_filters], free[at + all_filters : at + 2 * all_filters]
    out["bias"] = free[at + 2 * all_filters :]
    return out


def unfold(model: dict, config: Config) -> dict:
    """The model as :func:`responses` reads it; bucket 0 (the padding) is zero."""
    table = np.zeros((1 << config.bits, config.dim), dtype=np.float32)
    table[model["buckets"]] = model["rows"]
    named = cut_free(model["free"].copy(), config.dim, config.filters)
    return {"table": table, "bits": config.bits, "cuts": model.get("cuts"), **named}


def train(
    docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, folded: dict, config: Config,
    passes: int, seed: list[int],
) -> tuple[dict, dict, np.ndarray]:
    """Adagrad over single documents; gradients flow through the winning windows only.

    Gives the weights, their sums of squares and which buckets' weights moved.
    """
    rng = np.random.default_rng(seed)
    size, dim, count = 1 << config.bits, config.dim, config.filters
    model = unfold(folded, config)
    table, taps = model["table"], model["taps"]
    grown = cut_free(folded["grown_free"].copy(), dim, count)
    grown["table"] = np.full((size, 1), 1e-2, dtype=np.float32)
    grown["table"][folded["buckets"], 0] = folded["grown_rows"]
    for _ in range(passes):
        for i in rng.permutation(len(docs)):
            ids = docs[i]
            top, at = responses(ids, model)
            raw = top + model["shift"]
            hidden = np.maximum(raw, 0)
            z = float(np.clip(hidden @ model["out"] + model["bias"][0], -30, 30))
            slope = float((1 / (1 + np.exp(-z)) - labels[i]) * weight[labels[i]])
            if abs(slope) < 1e-3:
                continue
            down = slope * model["out"] * (raw > 0)
            step = slope * hidden + config.decay * model["out"]
            grown["out"] += step**2
            model["out"] -= config.rate * step / np.sqrt(grown["out"])
            grown["shift"] += down**2
            model["shift"] -= config.rate * down / np.sqrt(grown["shift"])
            grown["bias"] += slope**2
            model["bias"] -= config.rate * slope / np.sqrt(grown["bias"])
            padded = np.concatenate([ids, np.zeros(max(WIDTHS), dtype=np.int64)])
            for b, width in enumerate(WIDTHS):
                cut = slice(b * count, (b + 1) * count)
                grad = down[cut]
                if not grad.any():
                    continue
                for k in range(width):
                    rows = padded[at[cut] + k]
                    vectors = table[rows]
                    tap = taps[b][k]
                    back = tap.T * grad[:, None]
                    push = vectors.T * grad[None, :]
                    grown["taps"][b][k] += push**2
                    tap -= config.rate * push / np.sqrt(grown["taps"][b][k])
                    words, where = np.unique(rows, return_inverse=True)
                    total_back = np.zeros((len(words), dim), dtype=np.float32)
                    np.add.at(total_back, where, back)
                    grown["table"][words, 0] += (total_back**2).sum(axis=1)
                    table[words] -= config.rate * total_back / np.sqrt(grown["table"][words])
                    table[0] = 0
    moved = folded["buckets"][grown["table"][folded["buckets"], 0] != folded["grown_rows"]]
    return model, grown, moved


def flat(named: dict) -> np.ndarray:
    return np.concatenate([*[t.ravel() for t in named["taps"]], named["shift"], named["out"], named["bias"]])


Bins = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # grid places, documents, toxic ones


def thresholds(bins: Bins) -> dict[str, float]:
    """Per guessed language the logit with the best F1; few examples lean on all."""

    def best(places: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
        order = np.argsort(-places, kind="stable")
        s, hits = places[order] / GRID, np.cumsum(toxic[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + toxic.sum())
        at = int(np.argmax(f1))
        after = s[at + 1] if at + 1 < len(s) else s[at] - 1
        return float((s[at] + after) / 2)

    every, where = np.unique(np.concatenate([b[0] for b in bins.values()]), return_inverse=True)
    sums = [np.zeros(len(every), dtype=np.int64) for _ in range(2)]
    for total, k in zip(sums, (1, 2)):
        np.add.at(total, where, np.concatenate([b[k] for b in bins.values()]))
    out = {"*": best(every, *sums)}
    for lang in sorted(bins):
        n, toxic = int(bins[lang][1].sum()), int(bins[lang][2].sum())
        if toxic >= 5 and toxic < n:
            share = toxic / (toxic + 10)
            out[lang] = share * best(*bins[lang]) + (1 - share) * out["*"]
    return out


WORDS = "doc_id long, lang string, ids binary"


def word_rows(docs: DataFrame, config: Config) -> DataFrame:
    """The word buckets and the guessed language of every document."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids, lang = word_ids(text, config.bits)
                rows.append({"doc_id": doc_id, "lang": lang, "ids": zlib.compress(ids.astype("<i4").tobytes(), 6)})
            return rows

        return work

    return map_rows(doc_view(docs, "doc_id", "text"), make, WORDS)


def buckets_of(ids: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(ids), dtype="<i4").astype(np.int64)


def learned_rows(words: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with a label to learn from, and whether training leaves them out."""
    marked = (
        labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`toxic`").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    held = F.crc32(F.concat(F.lit("held "), F.col("doc_id").cast("string"))) % 4 == 0
    # Labels grow with the documents, so neither side is broadcast at any size.
    return words.join(marked.hint("merge"), "doc_id").withColumn("held", held)


def bucket_counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all these documents, and per class how many documents have each."""
    schema = pa.schema([("bucket", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), dtype=np.int64)
        for b in batches:
            for toxic, ids in zip(b.column("toxic").to_pylist(), b.column("ids").to_pylist()):
                seen[toxic, np.unique(buckets_of(ids))] += 1
        met = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(seen[0, met]), pa.array(seen[1, met])], schema=schema
        )

    found = (
        rows.select("toxic", "ids").mapInArrow(tally, "bucket int, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .toArrow()
    )
    order = np.argsort(found["bucket"].to_numpy())
    buckets = found["bucket"].to_numpy().astype(np.int64)[order]
    return buckets, np.stack([found[c].to_numpy()[order] for c in ("clean", "toxic")]).astype(np.float64)


def learn_round(rows: DataFrame, model: dict, weight: np.ndarray, config: Config, passes: int, number: int) -> dict:
    """Every shard goes on from the model; the average of what they learn."""
    size, dim = 1 << config.bits, config.dim
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # One row per bucket that moved (its weights and sum of squares) and per other weight.
    names = ["at", *[f"v{k}" for k in range(dim + 1)]]

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        docs = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "toxic", "ids"))))
        labels = np.array([y for _, y, _ in docs], dtype=np.int64)
        new, grown, moved = train(
            [buckets_of(ids) for _, _, ids in docs], labels, weight, shared.value, config, passes,
            [config.seed, number, key[0].as_py()],
        )
        free, grown_free = flat(new), flat(grown)
        values = np.zeros((len(moved) + len(free), dim + 1))
        values[: len(moved), :dim] = new["table"][moved]
        values[: len(moved), dim] = grown["table"][moved, 0]
        values[len(moved) :, 0], values[len(moved) :, 1] = free, grown_free
        fixed = np.rint(values * FIXED).astype(np.int64)
        at = np.concatenate([moved, size + np.arange(len(free))])
        return pa.table([pa.array(at), *[pa.array(fixed[:, k].copy()) for k in range(dim + 1)]], names=names)

    averages = (
        rows.select("shard", "doc_id", "toxic", "ids").groupBy("shard")
        .applyInArrow(learn, ", ".join(f"{n} long" for n in names))
        .groupBy("at")
        .agg(*[(F.sum(n) / F.count(F.lit(1)) / F.lit(FIXED)).cast("float").alias(n) for n in names[1:]])
    )
    # A round deals all documents out: its shuffle files go before the next one.
    with shuffles_removed(rows.sparkSession):
        found = staged(averages, "toxic-round").toArrow()
    shared.unpersist()
    at = found["at"].to_numpy()
    values = np.stack([found[n].to_numpy() for n in names[1:]], axis=1)
    # Spark does not say in which order the rows come; each has its place.
    out = {**model, **{c: model[c].copy() for c in ("rows", "free", "grown_rows", "grown_free")}}
    words = at < size
    place = np.searchsorted(model["buckets"], at[words])
    out["rows"][place], out["grown_rows"][place] = values[words, :dim], values[words, dim]
    out["free"][at[~words] - size] = values[~words, 0]
    out["grown_free"][at[~words] - size] = values[~words, 1]
    return out


def logit_bins(rows: DataFrame, model: dict, config: Config) -> Bins:
    """Documents and toxic ones by guessed language and place of their logit on the grid."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        network = unfold(shared.value, config)

        def work(batch: pa.RecordBatch) -> list[dict]:
            return [
                {"lang": lang, "place": round(float(np.clip(logit(buckets_of(ids), network), -30, 30)) * GRID),
                 "toxic": toxic}
                for lang, ids, toxic in zip(*(batch.column(c).to_pylist() for c in ("lang", "ids", "toxic")))
            ]

        return work

    found = (
        map_rows(rows.select("lang", "ids", "toxic"), make, "lang string, place int, toxic int")
        .groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
        .orderBy("lang", "place").toArrow()
    )
    langs = np.array(found["lang"].to_pylist(), dtype=object)
    columns = [found[c].to_numpy() for c in ("place", "n", "toxic")]
    return {lang: tuple(c[langs == lang] for c in columns) for lang in sorted(set(langs))}


def fit(words: DataFrame, labels: DataFrame, config: Config) -> dict | None:
    """The model learned from all labelled documents; None without labels of both kinds."""
    with shuffles_removed(words.sparkSession):
        rows = staged(learned_rows(words, labels), "toxic-learn")
    counts = np.zeros((2, 2), dtype=np.int64)  # held, toxic
    for r in rows.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[int(r["held"]), r["toxic"]] = r["n"]
    if not counts.sum(axis=0).all():
        return None
    if counts.all():
        use, test, total = rows.filter("NOT held"), rows.filter("held"), counts[0]
    else:
        use, test, total = rows, rows, counts.sum(axis=0)
    buckets, seen = bucket_counts(use, config.bits)
    model = new_model(buckets, seen, total, config)
    weight = 0.5 / total * total.sum()
    shards = math.ceil(int(total.sum()) / config.shard)
    use = use.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)))
    rounds, passes = (1, config.epochs) if shards == 1 else (config.epochs, 1)
    for number in range(rounds):
        model = learn_round(use, model, weight, config, passes, number)
    model["cuts"] = thresholds(logit_bins(test, model, config))
    return {k: model[k] for k in ("bits", "buckets", "rows", "free", "cuts")}


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per document: held_out, score (0 to 1) and the prediction at 0.5."""
    config = config or Config()
    words = staged(word_rows(docs, config), "toxic-words")
    shared = docs.sparkSession.sparkContext.broadcast(fit(words, labels, config))

    def make():
        model = unfold(shared.value, config) if shared.value else None

        def score(ids: bytes, lang: str) -> float:
            z = logit(buckets_of(ids), model) - model["cuts"].get(lang, model["cuts"]["*"])
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            for doc_id, lang, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "ids"))):
                value = score(ids, lang) if model else 0.0
                held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
                rows.append(
                    {"doc_id": doc_id, "held_out": held, "score": value, "predicted": int(value >= 0.5)}
                )
            return rows

        return work

    return map_rows(words, make, SCHEMA)
