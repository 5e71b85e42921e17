"""Quality rules: base rules and divergence from language references (operator 4).

Every document is held against two references of its language, both counted over all
documents: the shares of character classes, and the shares of the language's most common
words (what is not among them is one more class).  The Jensen-Shannon distance (base 2,
0 to 1) to either reference must stay below a bound.  Shares of short documents scatter,
so the bound has a slack that falls with the square root of the number of words, and
documents below ``min_words`` are left to the base rules.  A reference scatters as well
while its language has fewer than ``least_words`` words: a second slack grows from 0 as
they shrink.  A distance is at most 1, so where the bound reaches 1 the reference is no
longer held against anyone and the base rules decide; there is no other reference.

Two passes over the texts and no shuffle of them: the first counts words and classes per
language (summed in each task before the shuffle), the second judges row by row.

Null or empty texts have no words and fail the base rule.  A null language is a language
of its own.  Repeated rows are judged each alone; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import SPACES, doc_view, map_rows, slices, texts

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "latin", "beyond")
FLUSH = 200_000


@dataclass(frozen=True)
class Rules:
    """Bounds of the operator."""

    common: int = 60
    min_words: int = 50
    least_words: int = 20_000
    char_bound: float = 0.25
    word_bound: float = 0.42
    slack: float = 0.5
    scatter: float = 10.0
    repeat_percent: int = 50


def class_table() -> np.ndarray:
    """Class of each code point below 0x250; beyond is the last class."""
    table = np.full(0x250, CLASSES.index("other"), dtype=np.int64)
    for code in range(0x250):
        c = chr(code)
        if c in SPACES:
            table[code] = CLASSES.index("space")
        elif c in SYMBOLS:
            table[code] = CLASSES.index("symbol")
        elif c in ".,;:'\"!?-()":
            table[code] = CLASSES.index("stop")
        elif c.isdigit() and code < 128:
            table[code] = CLASSES.index("digit")
        elif code < 128 and c.isalpha():
            table[code] = CLASSES.index("lower" if c.islower() else "upper")
        elif c.isalpha():
            table[code] = CLASSES.index("latin")
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = table[np.minimum(codes, len(table) - 1)]
    kinds = np.where(codes < len(table), kinds, len(CLASSES) - 1)
    return np.bincount(kinds, minlength=len(CLASSES))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as bytes (bytes.split knows no other space)."""
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n = len(words)
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        base = len(ids)
        if base < 2_000_000:
            windows = (seq[:-2] * base + seq[1:-1]) * base + seq[2:]
        else:
            pairs = np.unique(seq[:-2] * base + seq[1:-1], return_inverse=True)[1]
            windows = pairs * base + seq[2:]
        _, where, often = np.unique(windows, return_inverse=True, return_counts=True)
        hit = often[where] > 1
        if hit.any():
            covered = np.zeros(n, dtype=bool)
            covered[:-2] |= hit
            covered[1:-1] |= hit
            covered[2:] |= hit
            repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of counts to a reference distribution."""
    total = counts.sum()
    if total == 0:
        return 1.0
    p = counts / total
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(reference > 0, reference * np.log2(reference / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


class _Tally:
    """Counts of a task per language: words, and classes under a marked key."""

    def __init__(self) -> None:
        self.table = class_table()
        self.words: dict[str | None, Counter] = {}
        self.classes: dict[str | None, np.ndarray] = {}

    def __call__(self, batch: pa.RecordBatch) -> list[dict]:
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist()):
            if not text:
                continue
            self.words.setdefault(lang, Counter()).update(words_of(text.lower()))
            counts = class_counts(text, self.table)
            self.classes[lang] = self.classes.get(lang, 0) + counts
        if sum(map(len, self.words.values())) > FLUSH:
            return self.flush()
        return []

    def flush(self) -> list[dict]:
        rows = [
            {"lang": lang, "kind": None, "word": w.decode("utf-8", "replace"), "n": n}
            for lang, counter in self.words.items()
            for w, n in counter.items()
        ]
        rows += [
            {"lang": lang, "kind": i, "word": None, "n": int(n)}
            for lang, counts in self.classes.items()
            for i, n in enumerate(counts)
        ]
        self.words, self.classes = {}, {}
        return rows

    def rest(self) -> Iterator[list[dict]]:
        yield self.flush()


References = dict[str | None, tuple[np.ndarray, list[str], np.ndarray, int]]


def references(docs: DataFrame, rules: Rules) -> References:
    """Per language class shares, common words, their shares and the number of words.

    One small row set per language comes to the driver: ``common`` words and the classes.
    """
    counts = (
        map_rows(doc_view(docs, "text", "lang"), _Tally, "lang string, kind int, word string, n long")
        .groupBy("lang", "kind", "word")
        .agg(F.sum("n").alias("n"))
    )
    counts = counts.persist()
    try:
        totals = {
            r["lang"]: r["n"]
            for r in counts.filter("kind IS NULL").groupBy("lang").agg(F.sum("n").alias("n")).collect()
        }
        classes: dict[str | None, np.ndarray] = {}
        for r in counts.filter("kind IS NOT NULL").collect():
            classes.setdefault(r["lang"], np.zeros(len(CLASSES)))[r["kind"]] += r["n"]
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        top: dict[str | None, list[tuple[str, int]]] = {}
        ranked = counts.filter("kind IS NULL").withColumn("rank", F.row_number().over(order))
        for r in ranked.filter(F.col("rank") <= rules.common).orderBy("lang", "rank").collect():
            top.setdefault(r["lang"], []).append((r["word"], r["n"]))
    finally:
        counts.unpersist()

    def reference(shares: np.ndarray, words: list[tuple[str, int]], total: int):
        known = np.array([n for _, n in words] + [max(0, total - sum(n for _, n in words))], float)
        return shares / max(1, shares.sum()), [w for w, _ in words], known / max(1, total), total

    return {lang: reference(classes[lang], words, totals[lang]) for lang, words in top.items()}


def reference_slack(total: int, rules: Rules) -> float:
    """What the bounds are widened by for a reference of so many words."""
    return max(0.0, rules.scatter * (max(1, total) ** -0.5 - rules.least_words**-0.5))


class _Judge:
    """Verdict on single documents."""

    def __init__(self, refs: References, rules: Rules) -> None:
        self.rules, self.table = rules, class_table()
        self.refs = {
            lang: (
                shares, {w.encode(): i for i, w in enumerate(words)}, known, reference_slack(total, rules)
            )
            for lang, (shares, words, known, total) in refs.items()
        }

    def __call__(self, text: str, lang: str | None) -> dict:
        rules = self.rules
        words = words_of(text)
        n = len(words)
        chars, symbols, dup_lines, repeated = base_counts(text, words)
        failed = n < 50 or 100 * repeated > rules.repeat_percent * n
        char_gap = word_gap = None
        slack = rules.slack / max(1, n) ** 0.5
        if n >= rules.min_words:
            shares, index, known, scatter = self.refs[lang]
            slack += scatter
            char_gap = distance(class_counts(text, self.table), shares)
            counts = np.zeros(len(known))
            other = len(known) - 1
            for w, k in Counter(words_of(text.lower())).items():
                counts[index.get(w, other)] += k
            word_gap = distance(counts, known)
        passed = char_gap is None or (
            char_gap <= rules.char_bound + slack and word_gap <= rules.word_bound + slack
        )
        return {
            "n_words": n,
            "word_chars": chars,
            "n_symbols": symbols,
            "n_dup_lines": dup_lines,
            "n_repeat_words": repeated,
            "base_failed": failed,
            "kept": not failed and passed,
            "char_distance": char_gap,
            "word_distance": word_gap,
        }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, "
    "char_distance double, word_distance double"
)


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per document with the base counts, both distances and the verdict."""
    rules = rules or Rules()
    refs = references(docs, rules)

    def make():
        judge = _Judge(refs, rules)

        def work(batch: pa.RecordBatch) -> list[dict]:
            ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
            return [{"doc_id": i} | judge(t, g) for i, t, g in zip(ids, texts(batch), langs)]

        return work

    return map_rows(doc_view(docs, "doc_id", "text", "lang"), make, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = rules or Rules()
    refs = references(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(refs, rules)
        for part in slices(batches):
            langs = part.column("lang").to_pylist()
            yield part.filter(pa.array([judge(t, g)["kept"] for t, g in zip(texts(part), langs)]))

    return docs.mapInArrow(run, docs.schema)
