"""Exact removal of repeated byte strings, and maximal repeats, by enhanced suffix arrays.

A suffix array of a whole corpus fits no machine, so suffixes are first dealt out such that all that can share LENGTH bytes
meet. Every string of LENGTH bytes (a window) has an anchor: its K bytes of least hash, the leftmost on a tie. Equal windows have
equal anchors, so the windows of one anchor form a cell, and cells meet by the hash of their anchors:

1. A cell that equals one of a document of smaller doc_id goes whole. If all cells of an anchor are equal, that settles them.
2. Where cells of one anchor differ (at the ends of what repeats), those that aren't gone are laid side by side in an enhanced suffix
   array. A stack finds its intervals of a common prefix of LENGTH or more, which are the groups of repeats with all occurrences;
   those that can't be extended to the left decide what goes.

What tasks send each other is packed by part of the hash: a few bytes for each anchor. Before that a task settles the cells that equal one of
a smaller doc_id at hand, so that copies send little. The cells of a hot anchor (one that a large share of the texts at hand has, or very
many texts in all) don't meet: each of its windows goes by its own hash, and equal ones at hand are settled first.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_WORDS, materialize, mix, pieces, powers, release, text_buffers, trimmed, trimmed_group

LENGTH, K = 50, 24
#: Bytes of text whose anchors a task packs at once; anchors that meet in one group, about.
PACK_BYTES, GROUP_ANCHORS = 8_000_000, 700_000
LEAST_PARTS = 64
#: Bytes of text in which a task looks at open cells at once; bytes of cells of one suffix array, about.
OPEN_BYTES, ARRAY_BYTES = 3_000_000, 1_500_000
#: Places of repeat groups that are gone through at once.
PLACES = 300_000
#: An anchor is hot if, of the texts that a task has at hand, over HOT_LOCAL and over a quarter have it in cells of their own, or if over HOT_CELLS
#: different cells meet. This only routes.
HOT_LOCAL, HOT_CELLS = 256, 100_000
_U = np.uint64


# ---- enhanced suffix arrays ----

#: Bytes that the first ranks of suffixes are made from: seven of nine bits each fill a whole number.
FIRST = 7


class SuffixArray:
    """Suffixes of strings of bytes laid one after another, in order, with the length of the prefix that each shares with the one before.

    Only the suffixes at `starts` are kept. Each ends with its string; an end sorts before any byte. Ranks of the first seven bytes
    are made first; those of prefixes of twice the length come from pairs of ranks, until `depth` bytes are ordered (None: all).
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, starts: np.ndarray, depth: int | None = None):
        """text: all bytes; sizes: length of each string; starts: places in text."""
        n = len(text) + len(sizes)
        string = np.repeat(np.arange(len(sizes)), sizes)
        most = int(sizes.max(initial=0))
        depth = most if depth is None else min(depth, most)
        s = np.zeros(n + FIRST, np.int16)
        s[np.arange(len(text)) + string] = text.astype(np.int16) + 1
        key = np.zeros(n, np.int64)
        for i in range(FIRST):
            key <<= 9
            key |= s[i : n + i]
        ranks, step = [self._ranked(key)], FIRST
        while step < depth:
            key = ranks[-1] * np.int64(n + 1)
            key[: n - step] += ranks[-1][step:]
            key[: n - step] += 1
            ranks.append(self._ranked(key))
            step *= 2
        at = starts + string[starts] if len(starts) else starts
        by = np.argsort(ranks[-1][at], kind="stable")
        #: Numbers of the starts in order of their suffixes.
        self.order = by
        ends = np.cumsum(sizes + 1) - 1
        rest = (ends[string[starts]] - at)[by] if len(starts) else starts
        p, q, h = at[by][:-1], at[by][1:], np.zeros(max(0, len(at) - 1), np.int64)
        for r in reversed(ranks):
            step //= 2 if r is not ranks[-1] else 1
            padded = np.append(r, np.int32(-1))
            h += step * ((padded[np.minimum(p + h, n)] == padded[np.minimum(q + h, n)]) & (p + h < n) & (q + h < n))
        for _ in range(FIRST - 1):
            h += s[np.minimum(p + h, n)] == s[np.minimum(q + h, n)]
        #: For each place in order, how many bytes its suffix shares with the one before; 0 for the first.
        self.prefixes = np.minimum(np.minimum(h, rest[:-1]), rest[1:]) if len(at) else h
        self.prefixes = np.concatenate([np.zeros(min(1, len(at)), np.int64), self.prefixes])

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        return rank


def interval_tree(prefixes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """length, from, to of each interval of suffixes [from, to) whose common prefix has `least` or more, inner ones first.

    A stack holds the intervals that are open. Suffixes that share less than `least` with the one before close all, so they're passed over.
    """
    stack: list[tuple[int, int]] = []
    out: list[tuple[int, int, int]] = []
    seen = np.flatnonzero((prefixes >= least) | np.append(prefixes[:-1] >= least, False) | np.concatenate([[False], prefixes[:-1] >= least]))
    for i, h in zip([*seen.tolist(), len(prefixes)], [*prefixes[seen].tolist(), 0], strict=True):
        begin = i - 1
        while stack and stack[-1][0] > h:
            length, begin = stack.pop()
            out.append((length, begin, i))
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, begin))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    length, a, b = np.array(out, np.int64).T
    return length, a, b


def diverse(left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which intervals [a, b) have suffixes with different bytes before them; a negative one differs from all."""
    change = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))])
    return (change[b - 1] > change[a]) | (left[a] < 0) if len(left) else np.zeros(0, bool)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Every string of `least` bytes or more that occurs twice or more in the texts and can't be made longer on either side in
    all its occurrences, with all of them as (text, place). For as much text as one machine holds.

    An interval's string can't grow to the right, as its suffixes then part; it can't grow to the left if two occurrences
    have different bytes before them, or one begins its text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    own = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    array = SuffixArray(text, sizes, np.arange(len(text)))
    left = np.where(np.arange(len(text)) == begins[own], -1, np.append(text[-1:], text[:-1]).astype(np.int64))[array.order] if len(text) else array.order
    length, a, b = interval_tree(array.prefixes, least)
    out = []
    for h, i, j in zip(*(x[diverse(left, a, b)].tolist() for x in (length, a, b)), strict=True):
        at = np.sort(array.order[i:j])
        out.append((text[at[0] : at[0] + h].tobytes(), list(zip(own[at].tolist(), (at - begins[own[at]]).tolist(), strict=True))))
    return sorted(out)


def repeat_groups(text: np.ndarray, sizes: np.ndarray, counts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of cells laid one after another, which windows hold a string of LENGTH bytes that a cell of a smaller doc has too.

    sizes: bytes of each cell; counts: its windows, one from each of its first bytes on; doc: its document. The cells of an anchor are all
    here, so equal windows are. Each interval of the suffix array with a common prefix of LENGTH or more is a group of repeats with all its
    occurrences. Those with different bytes to the left, or with the beginning of a cell among them, are maximal: what others
    cover is covered by the maximal one that begins before them in the same cells.
    """
    begin = np.cumsum(sizes) - sizes
    cell = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[cell] + within
    array = SuffixArray(text, sizes, start)
    own = array.order
    left = np.where(within == 0, -1, text[start - 1].astype(np.int64))[own] if len(own) else own
    length, a, b = interval_tree(array.prefixes, LENGTH)
    maximal = diverse(left, a, b)
    length, a, b = length[maximal], a[maximal], b[maximal]
    gone = np.zeros(len(own) + 1, np.int64)
    if len(a):
        d = doc[cell][own]
        # pairs of places for reduceat; every second result is that of an interval
        least = np.minimum.reduceat(np.append(d, np.iinfo(np.int64).max), np.column_stack([a, b]).ravel())[::2]
        # intervals lie within others, so all their places together may be very many: some at once
        batch = np.cumsum(b - a) // PLACES
        for i, j in pairwise([*np.flatnonzero(np.diff(batch, prepend=-1)).tolist(), len(a)]):
            size = (b - a)[i:j]
            place = np.repeat(a[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            late = d[place] > np.repeat(least[i:j], size)
            first, more = own[place[late]], np.repeat(length[i:j], size)[late] - LENGTH + 1
            np.add.at(gone, first, 1)
            np.add.at(gone, first + more, -1)
    return np.cumsum(gone[:-1]) > 0


# ---- anchors and cells ----


def cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts one after another: hash of the anchor, hash of the cell, text, first window (within the text) and number of windows."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    p, q = powers(n)
    prefix = np.zeros(n + 1, _U)
    np.cumsum(BYTE_WORDS[data] * p[:n], out=prefix[1:])
    value = mix((prefix[K:] - prefix[:-K]) * q[: n - K + 1])
    hashes = value
    place = np.zeros(len(value), np.uint8)
    size, width = 1, LENGTH - K + 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:] + np.uint8(step), place[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    inside = np.zeros(n + 1, np.int64)  # windows stay within their text
    long = np.diff(off) >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    anchor = window + place[window]
    new = np.ones(len(window), bool)
    doc = np.searchsorted(off, window, "right") - 1
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    lo, at, doc = window[begin], anchor[begin], doc[begin]
    hi = lo + count - 1 + LENGTH
    cell = mix((prefix[hi] - prefix[lo]) * q[lo] + (at - lo).astype(_U) * _U(64) + count.astype(_U))
    return hashes[at], cell, doc, lo - off[doc], count


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed string, with the bytes of equal weight together."""
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in arrays]
    sizes = np.array([len(x) for x in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view("<i8"), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def _by_part(part: np.ndarray, within: np.ndarray):
    """(part, rows) of each part, rows in the order of `within`."""
    order = np.lexsort((within, part))
    begin = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        yield int(part[order[a]]), order[a:b]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h & _U(0xFFFFFF)) % _U(parts)).astype(np.int64)


def _marks(doc: np.ndarray, tag: np.ndarray, mark: np.ndarray):
    """A table with the marks of each document in a list."""
    order = np.lexsort((tag, doc))
    doc, tag, mark = doc[order], tag[order], mark[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    begin = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)).astype(np.int32)), pa.array(mark))
    return pa.table([pa.array(doc[begin]), pa.array(tag[begin]), lists], ["doc_id", "tag", "marks"])


def _outdone(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a value that a row of a smaller doc has too."""
    if not len(value):
        return np.zeros(0, bool)
    order = np.argsort(value)
    begin = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1]))
    least = np.minimum.reduceat(doc[order], begin)
    out = np.zeros(len(value), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(begin, len(value))))
    return out


def _often(value: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a value that more than `most` docs have, and which are the first of such a value."""
    often, leads = np.zeros(len(value), bool), np.zeros(len(value), bool)
    order = np.argsort(value)
    begin = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1])) if len(value) else order
    rows = np.diff(np.append(begin, len(value)))
    for b, n in zip(begin[rows > most].tolist(), rows[rows > most].tolist(), strict=True):
        own = order[b : b + n]
        if len(np.unique(doc[own])) > most:
            often[own] = True
            leads[own.min()] = True
    return often, leads


def _own_marks(doc: np.ndarray, mark: np.ndarray, ids: np.ndarray, tags: np.ndarray, parts: int):
    """(part, blob) with marks that are settled already. Their parts are negative and follow from the ids, so a task run again sends the same."""
    own, ordinal = np.unique(doc, return_inverse=True)
    part = -1 - int(_part_of(mix(ids[own[:1]].astype(_U)), parts)[0])
    return part, _pack([ordinal.astype("<u4"), mark.astype("<i8"), ids[own].astype("<i8"), tags[own].astype("<i8")])


def _read_own(table: pa.Table) -> pa.Table:
    out = []
    for blob in table.column("blob").to_pylist():
        ordinal, mark, ids, tags = _unpack(blob, ["<u4", "<i8", "<i8", "<i8"])
        out.append(_marks(ids[ordinal], tags[ordinal], mark))
    return pa.concat_tables(out)


MARKS = "doc_id long, tag long, marks array<long>"
_CELLS = ["<u4", "u1", "<u4", "<u4", "<u4", "u1", "<i8", "<i8"]
_WINDOWS = ["<u2", "<u4", "<u4", "u1", "u1", "<i8", "<i8"]


def _settled(docs: DataFrame, parts: int, hot_local: int, hot_cells: int) -> DataFrame:
    """Marks 256 * first window + 128 * hot + 2 * windows + open: cells to remove (open 0), and cells to look at window by window (open 1)."""

    def send(batches):
        held, size = [], 0

        def flush():
            ids, tags = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            shift = np.cumsum([0] + [len(x[0]) for x in held])
            h, cell, doc, lo, count = (np.concatenate([x[2][i] + (s if i == 2 else 0) for x, s in zip(held, shift[:-1], strict=True)]) for i in range(5))
            held.clear()
            gone = _outdone(cell, ids[doc])
            hot, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
            hot[~gone], first[~gone] = _often(h[~gone], doc[~gone], max(hot_local, len(ids) // 4))
            here = gone | (hot & ~first)
            if here.any():
                yield _own_marks(doc[here], (lo[here] << 8) + 2 * count[here] + np.where(gone[here], 0, 129), ids, tags, parts)
            count = count + 128 * first  # one cell tells the others of its anchor
            h, cell, doc, lo, count = (x[~here] for x in (h, cell, doc, lo, count))
            high = h >> _U(24)
            for part, rows in _by_part(_part_of(h, parts), high):
                own, ordinal = np.unique(doc[rows], return_inverse=True)
                yield part, _pack([(high[rows] & _U(0xFFFFFFFF)).astype("<u4"), (high[rows] >> _U(32)).astype(np.uint8), (cell[rows] >> _U(32)).astype("<u4"), ordinal.astype("<u4"), lo[rows].astype("<u4"), count[rows].astype(np.uint8), ids[own].astype("<i8"), tags[own].astype("<i8")])

        def batch_of(rows):
            rows = list(rows)
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for lo, hi, data, off in pieces(b.column(2)):
                held.append((ids[lo:hi], tags[lo:hi], cells(data, off)))
                size += len(data)
                if size >= PACK_BYTES:
                    yield batch_of(flush())
                    held, size = [], 0
        if held:
            yield batch_of(flush())

    def settle(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return _read_own(table)
        got, base = [], 0
        for blob in table.column("blob").to_pylist():
            low, high, cell, ordinal, lo, count, ids, tags = _unpack(blob, _CELLS)
            got.append((low.astype(_U) | (high.astype(_U) << _U(32)), cell, ordinal.astype(np.int64) + base, lo, count, ids, tags))
            base += len(ids)
        h, cell, row, lo, count, ids, tags = (np.concatenate([x[i] for x in got]) for i in range(7))
        del got
        order = np.lexsort((ids[row], cell, h))
        h, cell, row, lo, count = h[order], cell[order], row[order], lo[order], count[order]
        doc = ids[row]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c = new_h.copy()
        new_c[1:] |= cell[1:] != cell[:-1]
        at_h, at_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        begin = np.flatnonzero(new_h)
        differ = np.bincount(at_h[new_c])
        hot = np.logical_or.reduceat(count > 127, begin) | (differ > hot_cells)
        several = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)) & (differ > 1)
        gone = doc[np.flatnonzero(new_c)][at_c] < doc
        use = gone | (several | hot)[at_h]
        mark = (lo[use].astype(np.int64) << 8) + 2 * (count[use].astype(np.int64) & 127) + np.where(gone[use], 0, 1 + 128 * hot[at_h[use]])
        return _marks(doc[use], tags[row[use]], mark)

    blobs = docs.mapInArrow(trimmed(send), "part int, blob binary")
    marks = blobs.groupBy("part").applyInArrow(trimmed_group(settle), MARKS)
    return materialize(marks.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")


def _opened(docs: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """Marks of the windows to remove in open cells."""

    def send(batches):
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for lo, hi, data, off in pieces(b.column(2), OPEN_BYTES):
                own = b.column(3).slice(lo, hi - lo)
                mark = own.flatten().to_numpy()
                doc = np.repeat(np.arange(hi - lo), pc.list_value_length(own).to_numpy())
                at, count, hot = mark >> 8, (mark & 127) >> 1, (mark & 128) > 0
                n = np.where(hot, count, 1)  # windows of hot anchors go one by one
                doc, count, hot = np.repeat(doc, n), np.repeat(np.where(hot, 1, count), n), np.repeat(hot, n)
                at = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = off[doc] + at
                p, q = powers(len(data))
                prefix = np.zeros(len(data) + 1, _U)
                np.cumsum(BYTE_WORDS[data] * p[: len(data)], out=prefix[1:])
                h = np.full(len(first), ~_U(0))
                for j in range(LENGTH - K + 1):
                    i = first + j
                    h = np.minimum(h, mix((prefix[i + K] - prefix[i]) * q[i]))
                i = first[hot]
                h[hot] = mix(mix((prefix[i + LENGTH] - prefix[i]) * q[i]))
                gone = np.zeros(len(h), bool)
                gone[hot] = _outdone(h[hot], ids[lo:hi][doc[hot]])
                out = []
                if gone.any():
                    place, of = at[gone], doc[gone]
                    run = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1]) | (np.arange(1, len(of)) % 32 == 0)))
                    out.append(_own_marks(of[run], (place[run] << 8) + 2 * np.diff(np.append(run, len(of))), ids[lo:hi], tags[lo:hi], parts))
                    doc, at, count, first, h = (x[~gone] for x in (doc, at, count, first, h))
                for part, rows in _by_part(_part_of(h, parts), h):
                    docs_of, ordinal = np.unique(doc[rows], return_inverse=True)
                    size = count[rows] - 1 + LENGTH
                    text = data[np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    out.append((part, _pack([(h[rows] >> _U(48)).astype("<u2"), ordinal.astype("<u4"), at[rows].astype("<u4"), count[rows].astype(np.uint8), text, ids[lo:hi][docs_of].astype("<i8"), tags[lo:hi][docs_of].astype("<i8")])))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["part", "blob"])

    def settle(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return _read_own(table)
        got, base = [], 0
        for blob in table.column("blob").to_pylist():
            some, ordinal, at, count, text, ids, tags = _unpack(blob, _WINDOWS)
            got.append((some, ordinal.astype(np.int64) + base, at.astype(np.int64), count.astype(np.int64), text, ids, tags))
            base += len(ids)
        some, row, at, count, text, ids, tags = (np.concatenate([x[i] for x in got]) for i in range(7))
        del got
        size = count - 1 + LENGTH
        begin = np.cumsum(size) - size
        order = np.argsort(some, kind="stable")  # cells of one anchor have the same bits of its hash
        edges = np.flatnonzero(np.diff(some[order], prepend=-1))
        total = np.cumsum(size[order])
        found, i = [], 0
        while i < len(order):
            fits = edges[(edges > i) & (total[np.maximum(edges - 1, 0)] - total[i] + size[order[i]] <= ARRAY_BYTES)]
            later = edges[edges > i]
            j = int(fits[-1] if len(fits) else later[0]) if len(later) and total[-1] - total[i] + size[order[i]] > ARRAY_BYTES else len(order)
            found.append(removed(order[i:j], row, at, count, size, begin, text, ids))
            i = j
        cell, first, n = (np.concatenate([x[i] for x in found]) for i in range(3))
        return _marks(ids[row[cell]], tags[row[cell]], ((at[cell] + first) << 8) + 2 * n)

    def removed(own, row, at, count, size, begin, text, ids):
        """Runs of windows to remove of the cells `own`: cell, first window within it, windows."""
        count, size = count[own], size[own]
        bytes_ = text[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        pick = np.flatnonzero(repeat_groups(bytes_, size, count, ids[row[own]]))
        cell = np.repeat(np.arange(len(own)), count)
        within = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
        new = np.ones(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1] + 1) | (cell[pick][1:] != cell[pick][:-1])
        first = np.flatnonzero(new)
        return own[cell[pick[first]]], within[pick[first]], np.diff(np.append(first, len(pick)))

    open_ = marks.select("doc_id", "tag", F.filter("marks", lambda x: x.bitwiseAND(1) == 1).alias("marks")).where(F.size("marks") > 0)
    d = docs.join(open_, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks").dropDuplicates(["doc_id", "tag"])
    blobs = d.mapInArrow(trimmed(send), "part int, blob binary")
    return materialize(blobs.groupBy("part").applyInArrow(trimmed_group(settle), MARKS), "windows")


def _cleaned(docs: DataFrame, hot_local: int = HOT_LOCAL, hot_cells: int = HOT_CELLS) -> DataFrame:
    """For rows (doc_id, text): doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    spark = docs.sparkSession
    d = docs.withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(LEAST_PARTS, int(size * 0.075 / GROUP_ANCHORS) + 1)
    full = d.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    marks = _settled(full, parts, hot_local, hot_cells)
    release(spark)
    windows = _opened(full, marks, parts)
    release(spark)
    settled = marks.select("doc_id", "tag", F.filter("marks", lambda x: x.bitwiseAND(1) == 0).alias("marks"))
    gone = settled.unionByName(windows).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("marks")).alias("marks")).where(F.size("marks") > 0)
    d = d.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "marks")
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                data, off = text_buffers(part.column(1))
                marks = part.column(2)
                rows = []
                for i in range(len(part)):
                    text = data[off[i] : off[i + 1]]
                    if marks[i].is_valid:
                        m = marks[i].values.to_numpy()
                        change = np.zeros(len(text) + 1, np.int64)
                        np.add.at(change, m >> 8, 1)
                        np.add.at(change, (m >> 8) + ((m & 255) >> 1) - 1 + LENGTH, -1)
                        bad = np.cumsum(change[:-1]) > 0
                        rows.append((text[~bad].tobytes(), len(text), int(bad.sum()), int(bad[:1].sum() + (bad[1:] & ~bad[:-1]).sum())))
                    else:
                        rows.append((text.tobytes(), len(text), 0, 0))
                kept, *counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]], names)

    return d.mapInArrow(trimmed(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def remove_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept binary) of each row of docs: its UTF-8 bytes without any covered by a string of LENGTH bytes that also starts
    in a document of smaller doc_id.

    Strings are judged on the input, so what remains may still repeat; cuts may fall within a character, so bytes come back. A
    null text is empty. Rows that share a doc_id don't take from each other. Rows of null doc_id stay whole and take
    from none. Other columns aren't read.
    """
    return _cleaned(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "kept")


def substring_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`remove_substrings` in figures: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    d = _cleaned(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return materialize(d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "report")
