"""Language identification by multilingual mixture inference.

A language is a model of byte trigrams within words: the likelihood of a word is the product of those of its letters after
the two before. A document is a mixture of languages from which each of its words is drawn; expectation-maximisation finds
their proportions. Languages join the mixture one by one, best gain first, while the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import materialize, others, pieces, quoted, trimmed

#: Labelled documents of each language that are learnt from, about: whole texts, chosen by hash.
TRAIN_DOCUMENTS = 20_000
#: Languages of one model: the driver and each task hold a table of counts for each. More languages are dealt to several models.
GROUP = 200
ADDED = ["lang_pred", "score", "langs"]
#: Buckets of trigrams. Codes: 0 ends a word, 1 to 26 are letters, the rest are bytes of letters outside ASCII.
BUCKETS, CODES = 1 << 16, 155
ROUNDS, WEIGHT, PRIOR, FLOOR = 12, 3.0, 0.5, -14.0
_LETTER = regex.compile(r"\p{L}")

_codes = np.zeros(256, np.uint32)
_codes[97:123] = _codes[65:91] = np.arange(1, 27)
_codes[128:] = np.arange(27, 155)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased texts one after another: trigram buckets, contexts, first gram of each word, document of each word.

    A word's grams are those of its letters and of its end. Each text is taken to be followed by an end.
    """
    code = np.zeros(len(data) + len(off) - 1 + 2, np.uint32)
    own = _codes[data]
    for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        code[lo + i + 2 : hi + i + 2] = own[lo:hi]
    one, two, three = code[:-2], code[1:-1], code[2:]
    context = np.where(two == 0, 0, one) * np.uint32(CODES) + two
    bucket = ((context * np.uint32(CODES) + three) * np.uint32(2654435761)) >> np.uint32(16)
    used = np.flatnonzero((three != 0) | (two != 0))
    begins = np.flatnonzero((two[used] == 0) & (three[used] != 0))
    ends = off[1:] + np.arange(1, len(off))  # of the documents, in code[2:]
    return bucket[used], context[used], begins, np.searchsorted(ends, used[begins], "right")


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


Model = tuple[list[str], np.ndarray, np.ndarray]


def learn(labelled: DataFrame, per_language: int = TRAIN_DOCUMENTS, text: str = "text", lang: str = "lang", group: int = GROUP) -> Iterator[Model]:
    """Models of at most `group` languages: their names and logarithms of the trigram and context counts, from rows with text and lang; nulls are left out.

    The driver gets a number of documents for each language and, for one model after another, counts for each bucket: no more for more documents.
    """
    d = labelled.select(quoted([text])[0].alias("text"), quoted([lang])[0].cast("string").alias("lang")).where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    for i in range(0, len(langs), group):
        yield _model(d, {k: n[k] for k in langs[i : i + group]}, per_language)


def _model(d: DataFrame, n: dict[str, int], per_language: int) -> Model:
    langs = list(n)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / n[k]))])
    d = d.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    at = {k: i for i, k in enumerate(langs)}

    def count(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            lower = _lower(b.column(0))
            which = np.array([at[x] for x in b.column(1).to_pylist()], np.int64)
            for i in np.unique(which).tolist():
                for _, _, data, off in pieces(lower.filter(pa.array(which == i))):
                    bucket, context, _, _ = grams(data, off)
                    t = own.setdefault(i, np.zeros(BUCKETS + CODES * CODES, np.int64))
                    t[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    t[BUCKETS:] += np.bincount(context, minlength=CODES * CODES)
        for i, t in own.items():
            there = np.flatnonzero(t)
            yield pa.record_batch([pa.array(np.full(len(there), i)), pa.array(there), pa.array(t[there])], ["l", "g", "n"])

    sums = d.mapInArrow(trimmed(count), "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    t = np.zeros((len(langs), BUCKETS + CODES * CODES))
    t[sums["l"].to_numpy(), sums["g"].to_numpy()] = sums["n"].to_numpy()
    return langs, np.log(t[:, :BUCKETS] + PRIOR / 64).astype(np.float32), np.log(t[:, BUCKETS:] + PRIOR).astype(np.float32)


def word_scores(tri: np.ndarray, bi: np.ndarray, bucket: np.ndarray, context: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log-likelihoods of words, a row for each language."""
    return np.stack([np.add.reduceat(t[bucket] - c[context], begins) for t, c in zip(tri, bi, strict=True)])


def mixtures(score: np.ndarray, doc: np.ndarray, n_docs: int, fits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Proportions of languages, the posterior of the best single one and, if asked for, the penalised log-likelihood, by document; score: see `word_scores`.

    A language can't raise the likelihood of n words by more than n times the logarithm of the mean of its part by what the
    mixture gives, so most documents are settled without a single round.
    """
    langs = len(score)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)

    def by_doc(x, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sums, by document and row of x, of the words of documents that have `count` words each from `where` on."""
        out = np.zeros((len(count), len(x)))
        some = count > 0
        if some.any():
            for i, row in enumerate(x):
                out[some, i] = np.add.reduceat(row, where[some], dtype=np.float64)
        return out

    single = by_doc(score, first[:-1], n)
    best = single.argmax(1)
    share = np.zeros((n_docs, langs))
    share[np.arange(n_docs), best] = 1.0
    odds = np.exp(np.maximum(single - single.max(1, keepdims=True), -700))
    sure = odds[np.arange(n_docs), best] / odds.sum(1)
    p = np.exp(np.maximum(score - score.max(0), FLOOR))
    growing = np.flatnonzero(n > 1)

    def words_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        count = n[docs]
        at = np.cumsum(count) - count
        return p[:, np.repeat(first[docs] - at, count) + np.arange(count.sum())], np.repeat(np.arange(len(docs)), count), at, count

    def mixed(q: np.ndarray, own: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return sum(row * w[own] for row, w in zip(q, weights.T.astype(np.float32), strict=True) if w.any())

    for _ in range(langs - 1):
        if not len(growing):
            break
        q, own, at, count = words_of(growing)
        inverse = 1 / mixed(q, own, share[growing])
        gain = by_doc([row * inverse for row in q], at, count) / count[:, None]
        gain[share[growing] > 0] = 0
        more = gain.argmax(1)
        most = gain[np.arange(len(growing)), more]
        need = WEIGHT * np.log(count)
        hope = 2 * count * np.log(np.maximum(most, 1)) > need
        growing, more, need = growing[hope], more[hope], need[hope]
        if not len(growing):
            break
        q, own, at, count = words_of(growing)
        before = mixed(q, own, share[growing])
        new = share[growing] * 0.7
        new[np.arange(len(growing)), more] += 0.3
        for _ in range(ROUNDS):
            inverse = 1 / mixed(q, own, new)
            new = new * by_doc([row * inverse for row in q], at, count) / count[:, None]
        rise = by_doc([np.log(mixed(q, own, new) / before)], at, count)[:, 0]
        taken = 2 * rise > need
        share[growing[taken]] = new[taken]
        growing = growing[taken]
    fit = None
    if fits:
        q, own, at, count = words_of(every := np.flatnonzero(n > 0))
        fit = np.full(n_docs, -np.inf)
        top = score.max(0)[np.repeat(first[every] - at, count) + np.arange(count.sum())]
        fit[every] = by_doc([np.log(mixed(q, own, share[every])) + top], at, count)[:, 0] - WEIGHT / 2 * np.log(count) * ((share[every] > 0).sum(1) - 1)
    return share, sure, fit


def _predict(docs: DataFrame, model: Model, at: int, more: bool) -> DataFrame:
    """docs with lang_pred, score, langs and fit; if it has them already (`more`), where this model fits better."""
    langs, tri, bi = model
    shared = docs.sparkSession.sparkContext.broadcast((tri, bi))
    own = [*ADDED, "fit"]
    names = others(docs.columns, own)

    def predict(batches):
        tri, bi = shared.value
        for b in batches:
            texts = b.column(at)
            lower = _lower(texts)
            if more:
                pred, score, mixed, fit = (b.column(len(names) + i).to_pylist() for i in range(4))
            else:
                pred, score, mixed, fit = ["und"] * len(b), [0.0] * len(b), [""] * len(b), [-np.inf] * len(b)
            for lo, hi, data, off in pieces(lower, 1_000_000):
                ascii_letter = np.add.reduceat(np.append((data > 96) & (data < 123), False), off[:-1], dtype=np.int64) * (np.diff(off) > 0)
                letters = [bool(a) or (t is not None and not t.isascii() and _LETTER.search(t) is not None) for a, t in zip(ascii_letter, texts[lo:hi].to_pylist(), strict=True)]
                bucket, context, begins, doc = grams(data, off)
                if not len(begins):
                    continue
                share, sure, fits = mixtures(word_scores(tri, bi, bucket, context, begins), doc, hi - lo, more is not None)
                top = share.argmax(1)
                for i in np.flatnonzero(letters).tolist():
                    if fits is not None:
                        if not fits[i] > fit[lo + i]:
                            continue
                        fit[lo + i] = float(fits[i])
                    pred[lo + i] = langs[top[i]]
                    score[lo + i] = float(min(1.0, share[i, top[i]] * sure[i]))
                    mixed[lo + i] = ",".join(f"{langs[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i]) if share[i, j] > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string()), pa.array(fit, pa.float64())], [*names, *own])

    kinds = [StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in names]
    return docs.mapInArrow(trimmed(predict), StructType([*kinds, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("langs", StringType()), StructField("fit", DoubleType())]))


def _identified(docs: DataFrame, models: Iterable[Model], text: str) -> DataFrame:
    """Columns c0, c1, ... of docs, whatever their names, with lang_pred, score and langs."""
    names = docs.columns
    d = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted(names))])
    held, none = iter(models), True
    model = next(held, None)
    while model is not None:
        after = next(held, None)
        # None: this model is the only one, so that nothing is compared
        d = _predict(d, model, names.index(text), None if none and after is None else not none)
        if after is not None:
            d = materialize(d, "languages")
        model, none = after, False
    if none:
        d = d.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "langs": F.lit("")})
    return d


def identify(docs: DataFrame, models: Iterable[Model], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (share of that language times its posterior among those of its model, 0 to 1) and langs (those of the mixture with shares).

    `und` with score 0 if the text is null or empty or has no letter, or if no language was learnt. Only the text decides;
    whole texts are read, however long; no row is lost, and none is shuffled. Of several models the one with the best penalised likelihood
    counts. Repeated rows are documents of their own. The three columns replace any of the same name in docs.
    """
    names = docs.columns
    out = _identified(docs, models, text)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c in others(names, ADDED)], *ADDED)


def held_out(key: str = "doc_id") -> Column:
    """Documents that aren't learnt from: those with crc32 of the key, as text, of remainder 2 by 4. A null key isn't held out."""
    return F.coalesce(F.crc32(quoted([key])[0].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all: doc_id, held_out, lang_pred, score, langs. Other columns aren't read."""
    k, t = quoted([key, text])
    models = learn(docs.where(~held_out(key)), per_language, text, lang)
    d = docs.select(k.alias("doc_id"), held_out(key).alias("held_out"), t.alias("text"))
    return identify(d, models).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.0, per_language: int = TRAIN_DOCUMENTS) -> DataFrame:
    """docs without those in no language that is known (`und`) or whose score is below `least`; the same columns, of any names."""
    models = learn(docs.where(~held_out()), per_language)
    names = docs.columns
    out = _identified(docs, models, "text").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
