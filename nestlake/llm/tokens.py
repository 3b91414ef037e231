"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

import bisect
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import trimmed, worker_caches

#: Characters that end a piece: no token of a tokenizer that drops white space reaches over one.
SEPARATORS = " \n"
#: Texts of more characters are encoded in chunks of CHUNK that overlap.
HUGE, CHUNK, OVERLAP = 8192, 4096, 128
#: Pieces that a worker keeps in each of two generations, and their longest: some 190 MB at most.
CACHE, CACHED_CHARS = 450_000, 40
#: A word and the ASCII marks behind it. The letters are Latin ones that lower-casing turns into one letter each (the dotted capital
#: I becomes a letter and a mark of its own, so it isn't among them), and that composing leaves alone.
WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!#$%&*+,./:;=?@^_~-]*)")


#: Byte-level models see a byte as a letter: itself where it can be seen, else the next free one from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Pieces(dict):
    """The token ids, as bytes, of any piece of text without SEPARATORS. Those of short pieces are kept for reuse."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.older: dict[str, bytes] = {}
        added = self.tok.get_added_tokens_decoder().values()
        whole = not any(t.lstrip or t.rstrip or set(t.content) & set(SEPARATORS) for t in added)
        #: Whether white space is dropped, so that texts may be cut there. Other tokenizers get whole texts.
        self.drops = whole and all(self._same(t, t.replace("\n", " ").split(" ")) for t in ("ab  cd\n\n", " ab. 1 2\n!? x", "\n it's a \n", " ", "A b\nC"))
        #: Whether marks part from Latin words, and whether capitals count as small letters.
        self.parts = self.drops and self._same("abc.,", ["abc", ".,"]) and self._same("\u00e9b#!-", ["\u00e9b", "#!-"])
        self.lowers = self.parts and self._same("AZ\u00c9\u0178", ["az\u00e9\u00ff"])
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        letters = [c for c in map(chr, range(0x41, 0x250)) if WORD.fullmatch(c)]
        low = "".join(letters).lower() if self.lowers else "".join(letters)
        #: Whether a word of those letters may go to the model itself, its bytes written as the letters that stand for them: tried with each of them.
        self.direct = self.parts and all(self._word(x) == self._ids(x) for x in (*low, *(low[i : i + 5] for i in range(0, len(low), 3))))

    def _same(self, text: str, parts: list[str]) -> bool:
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        return ids(text) == [i for x in parts for i in ids(x)]

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > CACHED_CHARS:
            return self._ids(piece)
        if len(self) >= CACHE:  # half of what is kept goes
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        if out is None:
            out = self._split(piece)
        self[piece] = out
        return out

    def _split(self, piece: str) -> bytes:
        """A word with marks behind it is two pieces, and a word with capitals one in small letters: they are met more often."""
        m = WORD.fullmatch(piece) if self.parts else None
        if m is None:
            return self._ids(piece)
        word, marks = m.groups()
        if marks:
            return self[word] + self[marks]
        low = word.lower() if self.lowers else word
        if low != word:
            return self[low]
        return self._word(word) if self.direct else self._ids(word)

    def _word(self, word: str) -> bytes:
        """The ids of a word that no step before the model changes or cuts. That takes less than half the time of all steps."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
        return self._bytes([t.id for t in self.tok.model.tokenize(shown)])

    def _ids(self, piece: str) -> bytes:
        return self._bytes(self.tok.encode(piece, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)  # faster than numpy for few ids
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text: those of its pieces, one after another."""
        if not self.drops:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def units(self, text: str) -> tuple[list[bytes], list[int]]:
        """The ids of each piece of a text, and where each piece begins."""
        parts = text.replace("\n", " ").split(" ")
        return [self[x] for x in parts], list(accumulate((len(x) + 1 for x in parts[:-1]), initial=0))


_loaded: dict[str, Pieces] = {}
worker_caches.append(_loaded)


def pieces_of(path: str) -> Pieces:
    """One tokenizer for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


#: Gives the units of a text (tokens, or the ids of whole pieces) and where each begins, in ascending order.
Encoder = Callable[[str], tuple[list, list[int]]]


def after_separator(text: str, at: int) -> bool:
    """True where a tokenizer that drops white space always begins anew."""
    return at == 0 or text[at - 1] in SEPARATORS


def resync(encode: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, stable: Callable[[str, int], bool] = after_separator) -> Iterator[list]:
    """Lists of units that joined are encode(text)'s, of which no call sees much more than a chunk.

    Two neighbouring chunks share `overlap` characters. They are spliced at a place there at which both have a unit
    begin, and of which `stable` proves that what stands before it doesn't change what comes after. If there is none, the
    overlap doubles, up to the whole of the earlier chunk, and then the chunk itself: at worst one call sees the whole text.
    """
    begin, size = 0, chunk  # all before begin is done
    base, first, end = 0, 0, min(len(text), chunk)  # of the chunk at hand: where it begins, its first unit that counts, its end
    units, starts = encode(text[:end])
    while end < len(text):
        over, cut, to = overlap, None, min(len(text), end + chunk)
        while cut is None:
            low = max(begin + 1, end - over)
            new, new_starts = encode(text[low:to])
            common = set(new_starts[: bisect.bisect_right(new_starts, end - low)])
            for i in range(len(starts) - 1, max(first, bisect.bisect_left(starts, low - base)) - 1, -1):
                p = base + starts[i]
                if p - low in common and (i == first or starts[i - 1] < starts[i]) and stable(text, p):
                    cut = i, p
                    break
            if cut is None and low == begin + 1:
                break
            over *= 2
        if cut is None:  # no place to splice: a longer chunk from the same beginning
            size *= 2
            base, first, end = begin, 0, min(len(text), begin + size)
            units, starts = encode(text[begin:end])
            continue
        yield units[first : cut[0]]
        begin, size = cut[1], chunk
        units, starts, base, first, end = new, new_starts, low, bisect.bisect_left(new_starts, begin - low), to
    yield units[first:]


def _library(pieces: Pieces) -> Encoder:
    def encode(text: str):
        e = pieces.tok.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]

    return encode


def encode_text(pieces: Pieces, text: str, huge: int = HUGE) -> bytes:
    """The ids of any text as bytes of pieces.dtype. That of a huge one, if it may be cut at all, comes by `resync`."""
    if len(text) <= huge or not pieces.drops:
        return pieces.encode(text)
    return b"".join(b"".join(x) for x in resync(pieces.units, text))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its key, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `tokenizer` is a file of the tokenizers library on every executor. One that drops white space gets texts in pieces, and those
    of over HUGE characters in overlapping chunks; any other gets whole texts. No special
    tokens are added; those inside texts count as the library counts them. A null text is empty and has no tokens; repeated
    rows, equal and null keys give a row each; other columns aren't read. Nothing is shuffled.
    """
    d = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def count(batches):
        pieces = pieces_of(tokenizer)
        for b in batches:
            t = b.column(1).fill_null("")
            n = np.fromiter((len(encode_text(pieces, x)) for x in t.to_pylist()), np.int64, len(t)) // pieces.dtype.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(t).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names)

    return d.mapInArrow(trimmed(count), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
