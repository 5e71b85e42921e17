"""Token ids by the tokenizers library, remembered per piece of text.

Both vocabularies cut a text into words before they merge, and no word reaches across the
place where a non-space meets a space or line feed, or an ASCII letter one of ``MARKS``.  So
the texts of a slice are cut there all at once, Arrow finds the distinct pieces, those not
known to the worker are encoded, and the ids are taken per piece.  Texts with any other white
space are one piece.  ``tests/llm`` holds the two ways against each other.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fluxora.llm.common import worker_store

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
# White space that is neither a space nor a line feed; none lies beyond U+3000.
OTHER_SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LETTER = re.compile(f"[{LETTERS}]")
# A piece of these letters alone is one word to either vocabulary.
WORD = re.compile(f" ?[{LETTERS}]+")
MARKS = ".,;:!?#$%&*|"
REMEMBERED = 500_000  # about 130 MB a worker
AT_ONCE = 1000
BYTES_AT_ONCE = 1 << 21  # of text, unless a single one is longer
OTHER, SPACE, LINE, ALPHA, SIGN = range(5)
BIG_ENDIAN = sys.byteorder == "big"
MARK = "<|endoftext|>"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def byte_kinds() -> bytes:
    """The kind of each byte, as a table for ``bytes.translate``."""
    table = bytearray(256)
    for kind, members in ((SPACE, b" "), (LINE, b"\n"), (SIGN, MARKS.encode())):
        for b in members:
            table[b] = kind
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha():
            table[b] = ALPHA
    return bytes(table)


def byte_cuts(spaces_count: bool) -> bytes:
    """Whether a piece begins at a byte: a table of 8 times the kind before it plus its own."""
    table = bytearray(256)
    for before in (OTHER, ALPHA, SIGN):
        for space in (SPACE, LINE):
            table[8 * before + space if spaces_count else 8 * space + before] = 1
    table[8 * ALPHA + SIGN] = table[8 * SIGN + ALPHA] = 1
    return bytes(table)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; one per worker and vocabulary."""

    def __init__(self, path: str, spaces_count: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.mark = self.plain.token_to_id(MARK)
        self.kinds, self.cuts = byte_kinds(), byte_cuts(spaces_count)
        self.known: dict[str, bytes] = {}
        self.model = self.plain.model
        self.lower = not spaces_count
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        # The same model on words that are spelled and told apart already.
        self.spelled = Tokenizer(self.model)
        self.spelled.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.plain.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] == self.space]] = True

    def word(self, piece: str) -> bytes:
        """Ids of a single word: the library's model on the word's byte letters."""
        if self.lower:
            piece = piece.lower()
        if piece.isascii():
            # ASCII letters stand for themselves; only the space in front has another letter.
            spelled = self.space + piece[1:] if piece[0] == " " else piece
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(spelled)])

    def spaced_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words behind a space, encoded together: the space tells them apart."""
        out = {}
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            joined = "".join(part)
            if joined.isascii():
                joined = joined.replace(" ", " " + self.space)
            else:
                spelled = joined.encode().decode("latin-1").translate(self.letters)
                joined = spelled.replace(self.space, " " + self.space)
            found = self.spelled.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(found, "<u4")
            starts = np.flatnonzero(self.begins[ids]).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(part, starts, [*starts[1:], len(ids)], strict=True):
                out[p] = raw[4 * a : 4 * b]
        return out

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if BIG_ENDIAN:
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def bulk(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, encoded together: a special token between them tells them apart."""
        out = {p: self.whole(p) for p in pieces if "<|" in p}
        plain = [p for p in pieces if p not in out] if out else pieces
        self.plain.encode_special_tokens = False
        for at in range(0, len(plain), AT_ONCE):
            part = plain[at : at + AT_ONCE]
            joined = MARK.join(part) + MARK
            found = self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(found, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw, start = ids.tobytes(), 0
            for p, end in zip(part, ends, strict=True):
                out[p] = raw[4 * start : 4 * end]
                start = end + 1
        self.plain.encode_special_tokens = True
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of unknown pieces; remembered while there is room for more.

        A word ends where marks follow a letter and begins after a line feed, so such
        pieces are encoded in parts, each only if it is not known.
        """
        known, parts, out = self.known, {}, {}
        word, is_word = self.word, WORD.fullmatch
        if not self.lower:
            spaced = [p for p in pieces if p[0] == " " and (p.isascii() and p[1:].isalpha() or is_word(p))]
            out = self.spaced_words(sorted(spaced, key=str.isascii))
            pieces = pieces.difference(spaced)
        for p in pieces:
            if is_word(p):
                out[p] = word(p)
                continue
            stem = p.rstrip(MARKS)
            cut = [stem, p[len(stem) :]] if stem and LETTER.match(stem[-1]) else [p]
            if len(p) > 1 and p[0] == "\n" and LETTER.match(p[1]):
                cut = ["\n", cut[0][1:], *cut[1:]]
            parts[p] = [c for c in cut if c]
        fresh = {c for cut in parts.values() for c in cut if c not in known and c not in out}
        words = [c for c in fresh if WORD.fullmatch(c)]
        out.update(self.bulk(sorted(fresh.difference(words))))
        for c in words:
            out[c] = self.word(c)
        for p, cut in parts.items():
            out[p] = b"".join([out[c] if c in out else known[c] for c in cut])
        if len(known) < REMEMBERED:
            known.update(out)
        return out

    def pieces(self, texts: pa.LargeStringArray, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where those of each text begin and the last end.

        Texts marked in ``whole`` are one piece.  Spaces that do not count are dropped.
        """
        n = len(texts)
        places = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        size = int(places[-1] - places[0])
        data = texts.buffers()[2].slice(int(places[0]), size).to_pybytes() if size else b""
        places = places - places[0]
        kinds = np.frombuffer(data.translate(self.kinds), np.uint8)
        begins = np.zeros(size + 1, bool)
        pairs = (kinds[:-1] << 3) | kinds[1:]
        begins[1:size] = np.frombuffer(pairs.tobytes().translate(self.cuts), bool)
        begins[places] = True
        if not self.lower:
            # A single line feed and the letter behind it are two words.
            line = np.flatnonzero(begins[:size] & (kinds == LINE))
            line = line[line < size - 1]
            begins[line[kinds[line + 1] == ALPHA] + 1] = True
        alone = [(int(places[i]), int(places[i + 1])) for i in np.flatnonzero(whole)]
        for start, end in alone:
            begins[start + 1 : end] = False
        begins = begins[:size]
        if self.lower:
            kept = (kinds != SPACE) & (kinds != LINE)
            for start, end in alone:
                kept[start:end] = True
            places = np.concatenate([[0], np.cumsum(kept)])[places]
            begins, size = begins[kept], int(places[-1])
            data = np.frombuffer(data, np.uint8)[kept]
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, size).astype(np.int64)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        return cut, np.searchsorted(starts, places)

    def encode_some(self, texts: pa.LargeStringArray) -> list[bytes]:
        odd = pc.match_substring_regex(texts, OTHER_SPACE)
        whole = {t: self.whole(t) for t in texts.filter(odd).to_pylist()}
        cut, places = self.pieces(texts, odd.to_numpy(zero_copy_only=False))
        cut = cut.dictionary_encode()
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
        found = list(map(self.known.get, distinct))
        if None in found:
            learnt = self.learn({p for p, f in zip(distinct, found) if f is None and p not in whole}) | whole
            found = [learnt[p] if f is None else f for p, f in zip(distinct, found)]
        ids = pa.array(found, pa.large_binary()).take(cut.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[places].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column, null as empty; so many at once as have a bounded size."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, side="right")))
            yield from self.encode_some(texts.slice(at, end - at))
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.large_string())))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(name: str, path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; ``path`` overrides the public place."""
    store = worker_store("encoders")
    key = path or name
    if key not in store:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        store[key] = Encoder(path, spaces_count=name == BYTE_BPE)
    return store[key]
