"""Removal of passages that repeat, by sliding spans of sentences.

A span is the fewest consecutive sentences, from any one on, that are SPAN or more (or all of a document that has fewer) and have
LEAST_WORDS words or more; the last span of a document runs to its end. Spans are hashed and joined over all documents; a span is not the first if it stands in a document of smaller doc_id too, or earlier in its own.
Every sentence that such a span covers goes.

A passage that begins inside a sentence shifts the cuts of long ones, so that its spans differ from those of its copy. Where
`run` is given, chosen runs of words (see `word_runs`) are hashed and joined as well, and go word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _LOWER, _SPACE
from .shared import materialize, mix, pieces, powers, prefix_hash, release, span_hash, trimmed

#: Sentences of a span, words at least. A sentence ends with . ! ? or a line, and after LONGEST words in any case.
SPAN, LEAST_WORDS, LONGEST = 3, 12, 16
#: Words of a passage that doesn't stay whole in a later document, wherever it begins.
RUN = 51
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of texts one after another begins and ends."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    at = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    to = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    return at, to


def _sums(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """Two kinds of prefix sums over the hashes of words, with A-Z taken as a-z."""
    h = span_hash(prefix_hash(_LOWER[data]), at, to)
    p, _ = powers(len(h))
    return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * p[: len(h)])]) for x in (h, mix(h ^ np.uint64(0x2545F4914F6CDD1D)))]


def _hash(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    _, q = powers(len(c))
    return mix((c[j] - c[i]) * q[i] + (j - i).astype(np.uint64))


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each n elements in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = pick(x[: len(x) - step], x[step:])
        size += step
    return x


def word_runs(data: np.ndarray, off: np.ndarray, run: int = RUN):
    """(first, starts, stops, h1, h2) of chosen runs of run // 2 + 1 words: first is the number of the first run of each text
    and of all; starts and stops are in bytes, white space behind a run included.

    Of each (run + 1) // 2 runs on end in a text, those of least hash are chosen (winnowing). What is chosen within `run` words
    depends on them alone, so two texts that share `run` words share a chosen run. Texts of fewer words have none.
    """
    k, n = run // 2 + 1, (run + 1) // 2
    at, to = _words(data, off)
    word_of = np.searchsorted(at, off)
    none = np.zeros(0, np.int64)
    if len(at) < k + n - 1:
        return np.zeros(len(off), np.int64), none, none, none.astype(np.uint64), none
    sums = _sums(data, at, to)
    i = np.arange(len(at) - k + 1)
    g = _hash(sums[0], i, i + k)
    least = _sliding(g, n, np.minimum)
    end = np.repeat(word_of[1:], np.diff(word_of))  # the word behind the text of each word
    w = np.arange(len(least))
    inside = w + n - 1 + k <= end[: len(least)]
    pad = np.zeros(n - 1, np.uint64)
    least = np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad])
    i = i[(_sliding(least, n, np.maximum) == g) & (i + k <= end[: len(g)])]
    after = np.append(at, len(data))
    stops = np.minimum(after[i + k], off[np.searchsorted(word_of, i, "right")])
    return np.searchsorted(i, word_of), at[i], stops, g[i], (_hash(sums[1], i, i + k) >> np.uint64(33)).astype(np.int64)


def sentence_spans(data: np.ndarray, off: np.ndarray, span: int = SPAN, least: int = LEAST_WORDS):
    """Over texts one after another: (begins, first, starts, stops, h1, h2).

    begins: where each sentence begins; first: number of the first sentence of each text, and of all; starts, stops: the first
    sentence of each span and the one after its last; h1, h2: 64 and 31 bits of its hash, from its words with A-Z taken as a-z.
    """
    at, to = _words(data, off)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(off), np.int64), none, none, none.astype(np.uint64), none
    word_of = np.searchsorted(at, off)  # the first word of each text
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    after = np.concatenate([at[1:], [len(data)]])
    last = _STOP[data[to - 1]] | (lines[after] > lines[to])
    last[word_of[1:][word_of[1:] > 0] - 1] = True
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    length = np.diff(np.concatenate([begin, [len(at)]]))
    parts = -(-length // LONGEST)
    begin = np.repeat(begin, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    first = np.searchsorted(begin, word_of)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    starts, end = np.arange(len(begin)), first[1:][doc]
    bounds = np.append(begin, len(at))
    stops = np.maximum(starts + np.minimum(n, span)[doc], np.searchsorted(bounds, begin + least))
    fits = stops <= end
    starts, stops, doc, end = starts[fits], stops[fits], doc[fits], end[fits]
    final = np.ones(len(starts), bool)
    final[:-1] = doc[1:] != doc[:-1]
    stops = np.where(final, end, stops)
    words_to = bounds[stops]
    sums = [_hash(c, begin[starts], words_to) for c in _sums(data, at, to)]
    return at[begin], first, starts, stops, sums[0], (sums[1] >> np.uint64(33)).astype(np.int64)


def _spans(docs: DataFrame, words: int = 0) -> DataFrame:
    """(h1, h2, doc_id) of each distinct span of each row, and of its chosen runs of words if `words` is above 0."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column(1)):
                _, first, starts, _, h1, h2 = sentence_spans(data, off)
                row = np.searchsorted(first, starts, "right") - 1
                if words:
                    first, starts, _, *h = word_runs(data, off, words)
                    row = np.concatenate([row, np.searchsorted(first, np.arange(len(starts)), "right") - 1])
                    h1, h2 = np.concatenate([h1, h[0]]), np.concatenate([h2, h[1]])
                order = np.lexsort((h1, row))
                new = np.ones(len(order), bool)
                new[1:] = (h1[order][1:] != h1[order][:-1]) | (row[order][1:] != row[order][:-1])
                pick = order[new]
                ids = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(h1[pick].view(np.int64)), pa.array(h2[pick].astype(np.int32)), pa.array(ids[row[pick]], pa.int64())], ["h1", "h2", "doc_id"])

    return docs.where("doc_id is not null").mapInArrow(trimmed(run), "h1 long, h2 int, doc_id long")


def _later(docs: DataFrame, words: int = 0) -> DataFrame:
    """(doc_id, spans array of h1) with the spans of each document that a document of smaller doc_id holds too."""
    spans = _spans(docs, words)
    first = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    hits = spans.join(first, ["h1", "h2"]).where("doc_id > least").select("doc_id", "h1").distinct()
    return materialize(hits.groupBy("doc_id").agg(F.collect_list("h1").alias("spans")), "spans")


def _cut(data: np.ndarray, begins: np.ndarray, starts: np.ndarray, stops: np.ndarray, h1: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one text: which sentences go, and where each begins and the last ends."""
    n = len(begins)
    _, once = np.unique(h1, return_index=True)
    again = np.ones(len(h1), bool)
    again[once] = False
    gone = np.zeros(n + 1, np.int64)
    bad = again | np.isin(h1, later)
    np.add.at(gone, starts[bad], 1)
    np.add.at(gone, stops[bad], -1)
    return np.cumsum(gone[:-1]) > 0, np.concatenate([begins, [len(data)]])


def _cut_runs(keep: np.ndarray, starts: np.ndarray, stops: np.ndarray, h1: np.ndarray, later: np.ndarray) -> None:
    """For one text: take the bytes of repeated runs of words out of keep, but not those of a run's first place in its own text."""
    _, at, own = np.unique(h1, return_index=True, return_inverse=True)
    late = np.isin(h1, later)
    begins = np.where(late, starts, np.maximum(starts, stops[at[own]]))
    bad = (late | (at[own] != np.arange(len(h1)))) & (begins < stops)
    if bad.any():
        gone = np.zeros(len(keep) + 1, np.int64)
        np.add.at(gone, begins[bad], 1)
        np.add.at(gone, stops[bad], -1)
        keep &= np.cumsum(gone[:-1]) == 0


def _cleaned(docs: DataFrame, words: int = 0) -> DataFrame:
    """For rows (doc_id, text): doc_id, kept (binary), n_bytes, n_removed, n_spans, n_sentences, n_removed_sentences."""
    later = _later(docs, words)
    release(docs.sparkSession)
    d = docs.join(later, "doc_id", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_sentences", "n_removed_sentences"]

    def run(batches):
        for b in batches:
            spans = b.column(2)
            for lo, hi, data, off in pieces(b.column(1)):
                begins, first, starts, stops, h1, _ = sentence_spans(data, off)
                own = np.searchsorted(starts, first)
                if words:
                    firsts, run_from, run_to, run_h, _ = word_runs(data, off, words)
                rows = []
                for i in range(hi - lo):
                    text = data[off[i] : off[i + 1]]
                    s = slice(own[i], own[i + 1])
                    late = spans[lo + i].values if spans[lo + i].is_valid else None
                    late = np.zeros(0, np.uint64) if late is None else late.to_numpy().view(np.uint64)
                    gone, at = _cut(text, begins[first[i] : first[i + 1]] - off[i], starts[s] - first[i], stops[s] - first[i], h1[s], late)
                    keep = np.ones(len(text), bool)
                    if gone.any():
                        keep = ~np.repeat(np.concatenate([[False], gone]), np.diff(np.concatenate([[0], at])))
                    if words and len(gone):
                        r = slice(firsts[i], firsts[i + 1])
                        _cut_runs(keep, run_from[r] - off[i], run_to[r] - off[i], run_h[r], late)
                        gone = ~np.logical_or.reduceat(keep, at[:-1])
                    runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                    rows.append((text[keep].tobytes(), len(text), int((~keep).sum()), runs, len(gone), int(gone.sum())))
                kept, *counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]], names)

    return d.mapInArrow(trimmed(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, n_sentences long, n_removed_sentences long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 0) -> DataFrame:
    """(doc_id, text) of every row of docs without the sentences that a span covers which isn't the first of its kind.

    The smallest doc_id that has a span keeps it, once. Rows that share a doc_id don't take from each other; those of null doc_id only
    lose what repeats within themselves. A null text comes back empty. A sentence goes with the white space behind it.
    With `run`, no row keeps `run` words on end that a smaller doc_id has too, wherever they begin: of these, up to run // 2 may stay at
    each end, and shorter runs of run // 2 + 1 words may go. Of what repeats within a row, the first stays.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _cleaned(d, run).select("doc_id", F.col("kept").cast("string").alias("text"))


def repeats_report(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 0) -> DataFrame:
    """`remove_repeats` in figures: doc_id, n_bytes, n_removed, n_spans (runs of removed text), kept_sha256, n_sentences, n_removed_sentences."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(_cleaned(d, run).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_sentences", "n_removed_sentences"), "report")
