"""Secret scans: base patterns and a battery of randomness tests (operator 10).

Base spans (kinds ``assign``, ``access``, ``hex``) come from fixed patterns and always
stay.  The method adds spans of kind ``random``: unbroken tokens of 16 and more symbols
whose encoding is inferred and which pass a battery.  The encoding is the narrowest of
hex, base32, base36 (each in lower or upper case), alphanumeric and base64.
A token with marks of both base64 forms ("+/" and "-_", as in a URL's path) is in neither:
it is read whole, over all four marks, and in its parts of each form, between the marks of
the other.  Readings that are found and overlap make one span.  The battery:

* uniformity: chi-squared of the symbol counts over the encoding's alphabet,
* runs: number of changes between lower case, upper case, digits and marks,
* serial correlation: lag-one correlation of the symbols' places in the alphabet.

A token must not look unlike a uniform draw (each of the three at level ``reject``).
Against the other hypothesis, that it is text, it gets a p-value: the chance that a text
token of its length shows as many class changes and as many digits (binomial tails with
the rates of written text, combined by Fisher's rule).  Those p-values are held to the
Benjamini-Hochberg rule at ``fdr`` within each length class, counted over all documents,
so that the many short tokens do not use up the allowance of the long ones.

Pass 1 counts p-values per length class in fixed bins (a few hundred rows in all); pass 2
reports.  Texts are never shuffled.  Null and empty texts have no spans; repeated rows are
reported each; offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxora.llm.common import doc_view, map_rows, slices, texts

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
# Runs are maximal, so a bound on their length finds the same matches as a later check.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")

HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64_ALPHABET = ALNUM_ALPHABET + "+/"
URL_ALPHABET = ALNUM_ALPHABET + "-_"
MARKED_ALPHABET = ALNUM_ALPHABET + "+/-_"
PARTS = (re.compile(r"[^+/]{16,}"), re.compile(r"[^_-]{16,}"))
# One-case encodings, the narrowest first.
NARROW = tuple(
    (name, cased, frozenset(cased))
    for name, alphabet in (("hex", HEX_ALPHABET), ("base32", BASE32_ALPHABET), ("base36", BASE36_ALPHABET))
    for cased in (alphabet.lower(), alphabet.upper())
)
BINS = 60  # p-values are counted by -log10, half a unit each


@dataclass(frozen=True)
class Battery:
    """Levels of the tests."""

    reject: float = 1e-4
    fdr: float = 0.01
    change_rate: float = 0.12
    digit_rate: float = 0.06


def encoding(token: str) -> tuple[str, str]:
    """Name and alphabet of the narrowest encoding that holds the token."""
    symbols = set(token)
    for name, alphabet, held in NARROW:
        if symbols <= held:
            return name, alphabet
    if symbols <= set(ALNUM_ALPHABET):
        return "alnum", ALNUM_ALPHABET
    if symbols & set("-_"):
        return ("marked", MARKED_ALPHABET) if symbols & set("+/") else ("base64", URL_ALPHABET)
    return "base64", BASE64_ALPHABET


def symbol_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail by the Wilson-Hilferty normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_tail(n: int, k: int, p: float) -> float:
    """Chance of k or more among n."""
    if k <= 0:
        return 1.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, j = term, k
    while j < n and term > total * 1e-12:
        term *= (n - j) / (j + 1) * p / (1 - p)
        total += term
        j += 1
    return min(1.0, total)


def random_tests(token: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, given a uniform draw."""
    n, k = len(token), len(alphabet)
    counts = Counter(token)
    chi = sum(c * c for c in counts.values()) * k / n - n
    uniform = chi_squared_tail(chi, k - 1)
    share = Counter(map(symbol_class, alphabet))
    same = sum((v / k) ** 2 for v in share.values())
    changes = sum(symbol_class(a) != symbol_class(b) for a, b in zip(token, token[1:]))
    spread = math.sqrt(max(1e-9, (n - 1) * same * (1 - same)))
    runs = normal_two_sided((changes - (n - 1) * (1 - same)) / spread) if same < 1 else 1.0
    place = {c: i for i, c in enumerate(alphabet)}
    xs = [place[c] for c in token]
    mean = sum(xs) / n
    total = sum((x - mean) ** 2 for x in xs)
    if total == 0:
        return uniform, runs, 0.0
    lag = sum((a - mean) * (b - mean) for a, b in zip(xs, xs[1:])) / total
    return uniform, runs, normal_two_sided((lag + 1 / n) * math.sqrt(n))


def text_p(token: str, battery: Battery) -> float:
    """Chance that a token of text shows as many class changes and digits."""
    n = len(token)
    changes = sum(symbol_class(a) != symbol_class(b) for a, b in zip(token, token[1:]))
    digits = sum(c.isdigit() for c in token)
    p = binomial_tail(n - 1, changes, battery.change_rate)
    q = binomial_tail(n, digits, battery.digit_rate)
    stat = -2 * (math.log(max(p, 1e-300)) + math.log(max(q, 1e-300)))
    return math.exp(-stat / 2) * (1 + stat / 2)


def length_class(n: int) -> int:
    """16-23, 24-39, 40-79 and 80 and more symbols."""
    return 0 if n < 24 else 1 if n < 40 else 2 if n < 80 else 3


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-2 * math.log10(max(p, 1e-300))))


def readings(text: str) -> Iterator[tuple[int, int]]:
    """start and end of each token, and of its parts if it holds marks of both base64 forms."""
    for m in TOKEN.finditer(text):
        yield m.span()
        token = m.group()
        if ("+" in token or "/" in token) and ("-" in token or "_" in token):
            for part in PARTS:
                for n in part.finditer(token):
                    yield m.start() + n.start(), m.start() + n.end()


def candidates(text: str, battery: Battery) -> Iterator[tuple[int, int, int, int, bool]]:
    """start, end, length class, bin of p and whether the token passes as random."""
    for start, end in readings(text):
        core = text[start:end].strip("=")
        if len(core) < 16:
            continue
        if core.isalpha() and (core.islower() or core.isupper() or core.istitle()):
            # One class throughout: no change, no digit, p = 1 and never reported.
            yield start, end, length_class(len(core)), 0, False
            continue
        p = text_p(core, battery)
        likely = min(random_tests(core.replace("=", ""), encoding(core.replace("=", ""))[1]))
        yield start, end, length_class(len(core)), p_bin(p), likely >= battery.reject


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


Cuts = dict[int, int]


def cut_bins(docs: DataFrame, battery: Battery) -> Cuts:
    """Per length class the lowest bin that the Benjamini-Hochberg rule admits.

    A bin's p-values are taken as its largest, so the rule errs to the strict side.
    """

    def make():
        found: Counter = Counter()

        def work(batch: pa.RecordBatch) -> list[dict]:
            for text in texts(batch):
                for _, _, size, at, _ in candidates(text, battery):
                    found[size, at] += 1
            return []

        work.rest = lambda: iter(
            [[{"size": s, "bin": b, "n": n} for (s, b), n in found.items()]]
        )
        return work

    rows = (
        map_rows(doc_view(docs, "text"), make, "size int, bin int, n long")
        .groupBy("size", "bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    total: Counter = Counter()
    for r in rows:
        total[r["size"]] += r["n"]
    cuts: Cuts = {}
    for size, n in total.items():
        counts = {r["bin"]: r["n"] for r in rows if r["size"] == size}
        below = 0
        for at in range(BINS - 1, 0, -1):
            below += counts.get(at, 0)
            if below and 10 ** (-at / 2) <= battery.fdr * below / n:
                cuts[size] = at
    return cuts


def spans_of(text: str, cuts: Cuts, battery: Battery) -> tuple[list, list]:
    """Base spans, and all spans; a random token that a base span touches adds nothing."""
    base = base_spans(text)
    extra: list[tuple[int, int, int]] = []
    for start, end, size, at, likely in sorted(candidates(text, battery)):
        if likely and size in cuts and at >= cuts[size]:
            if not any(s < end and start < e for s, _, e in base):
                if extra and start < extra[-1][2]:
                    start, _, last = extra.pop()
                    end = max(end, last)
                extra.append((start, 3, end))
    return base, sorted(base + extra)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, n_random long"
)


def secrets(docs: DataFrame, battery: Battery | None = None) -> DataFrame:
    """One row per document with the counts, the digest of the base and all spans."""
    battery = battery or Battery()
    cuts = cut_bins(docs, battery)

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                base, spans = spans_of(text, cuts, battery)
                kinds = Counter(kind for _, kind, _ in spans)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append(
                    {
                        "doc_id": doc_id, "n_assign": kinds[0], "n_access": kinds[1],
                        "n_hex": kinds[2], "base_sha256": digest, "spans": joined(spans),
                        "n_random": kinds[3],
                    }
                )
            return rows

        return work

    return map_rows(doc_view(docs, "doc_id", "text"), make, SCHEMA)


MASK = "[secret]"


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by the mask."""
    parts, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, battery: Battery | None = None) -> DataFrame:
    """The documents with their secrets masked and ``n_chars`` brought up to date."""
    battery = battery or Battery()
    cuts = cut_bins(docs, battery)
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            old = part.column(place).to_pylist()
            new = [t and masked(t, spans_of(t, cuts, battery)[1]) for t in old]
            columns = list(part.columns)
            columns[place] = pa.array(new, type=part.schema.field(place).type)
            if length is not None:
                kept = part.column(length).to_pylist()
                sizes = [k if a == b else len(b) for k, a, b in zip(kept, old, new)]
                columns[length] = pa.array(sizes, type=part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
