"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of WINDOW words has one fingerprint: the smallest hash of its K-word grams (the leftmost on a tie). Two equal
windows have the same fingerprint at the same place, so a join on fingerprints finds every shared span of WINDOW words
or more; consecutive windows mostly share theirs, so few are kept. A hit is extended to its whole window and compared word by
word. Items of fewer words are windows of their own length, and are compared the same way with one gram for the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, quoted, without_keys

#: What separates words. Splitting by it takes a twentieth of the time of extracting the words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 8, 5
#: Windows of the benchmark that one pass over the documents broadcasts, and bytes of their words: some 40 MB. A larger benchmark takes more passes.
PASS_WINDOWS, PASS_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, GAP), "")


def _gram(at: str, k: int) -> str:
    """SQL for the hash of the k word hashes from the 0-based place `at`."""
    return f"xxhash64(slice(wh, {at} + 1, {k}))"


#: SQL for the hashes of all K-word grams. The three lowest bits are left for an offset.
_GRAMS = f"if(size(wh) >= {K}, transform(sequence(0, size(wh) - {K}), x -> {_gram('x', K)} & -8L), array())"


def _fingerprint(at: str) -> str:
    """SQL for the smallest gram hash of the window at `at`, the leftmost on a tie; the three lowest bits are its offset."""
    return "least(" + ", ".join(f"gh[{at} + {i}] | {i}L" for i in range(WINDOW - K + 1)) + ")"


def benchmark_windows(benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """The windows of each item: item (its id as string), len, win (its words) and w1, w2 (a digest of win).

    Rows with a null id, a null text or no word give none; rows that share an id are one item.
    """
    b = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = b.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("s"))
    win = starts.select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("win"))
    return win.withColumns({"w1": F.xxhash64("win"), "w2": F.xxhash64(F.lit("w2"), "win")})


def _hits(docs: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """For rows (doc_id, rid, w): rows (doc_id, rid, n_words, s, len, w1, w2). Each document has a row without s as well.

    The expressions over single places stay small, as the JVM does not compile methods of over 8000 bytes.
    """
    d = docs.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("gh", F.expr(_GRAMS))
    # a place s for windows of n words is the number 8 s + n - 1; -1 is the document's own row
    marks = ", ".join(f"if(size(w) >= {n}, sequence({n - 1}L, 8L * (size(w) - {n}) + {n - 1}, 8L), array())" for n in lengths)
    p = d.select("doc_id", "rid", "w", "wh", "gh", F.explode(F.expr(f"concat(array(-1L), {marks})" if lengths else "array(-1L)")).alias("m"))
    p = p.select("doc_id", "rid", "w", "wh", "gh", F.expr("int(shiftright(m, 3))").alias("s"), F.expr("int(m & 7) + 1").alias("len"))
    long, short = f"len = {WINDOW}", [n for n in lengths if n < WINDOW]
    # the window before may have the same fingerprint at the same place: the same hash with an offset one more
    p = p.where(F.expr(f"case when {long} and s > 0 then {_fingerprint('s')} + 1 <> {_fingerprint('s - 1')} else true end"))
    cases = " ".join(f"when len = {n} then {_gram('s', n)}" for n in short)
    p = p.select("doc_id", "rid", "w", "len", "s", F.expr(f"case when s < 0 then -1L when {long} then {_fingerprint('s')} {cases} end").alias("f"))
    p = p.select("doc_id", "rid", "w", "len", F.expr(f"if({long}, shiftright(f, 3), f)").alias("h"), F.expr(f"case when s < 0 then -1 when {long} then s + int(f & 7) else s end").alias("p"))
    same = F.expr("(s0 is null and p < 0) or (len = blen and p - o >= 0 and slice(w, p - o + 1, blen) = win)")
    j = p.join(F.broadcast(wins), (p["h"] == wins["bh"]) & same)
    return j.select("doc_id", "rid", F.when(F.col("s0").isNull(), F.size("w")).alias("n_words"), (F.col("p") - F.col("o")).alias("s"), F.col("blen").alias("len"), "w1", "w2")


def keyed_windows(wins: DataFrame) -> DataFrame:
    """Distinct windows with the hash they are joined by (bh) and the offset of that gram (o); s0 is 0."""
    w = wins.withColumn("wh", F.transform("win", lambda x: F.xxhash64(x))).withColumn("gh", F.expr(_GRAMS))
    long, cases = f"len = {WINDOW}", " ".join(f"when len = {n} then {_gram('0', n)}" for n in range(1, WINDOW))
    k = w.withColumn("f", F.expr(f"case when {long} then {_fingerprint('0')} {cases} end"))
    return k.select(F.expr(f"if({long}, shiftright(f, 3), f)").alias("bh"), F.expr(f"if({long}, int(f & 7), 0)").alias("o"), F.col("len").cast("int").alias("blen"), "win", "w1", "w2", F.lit(0).alias("s0"))


def _found(docs: DataFrame, wins: DataFrame, key: str, text: str, pass_windows: int) -> DataFrame:
    """One row per document, written to the shared folder: doc_id, rid, n_words, n_hit, wins (array of w1, w2 of what occurs in it)."""
    spark = docs.sparkSession
    d = docs.select(quoted([key])[0].alias("doc_id"), F.monotonically_increasing_id().alias("rid"), words(quoted([text])[0]).alias("w"))
    wins = wins.select("len", "win", "w1", "w2").distinct()
    size = F.sum(F.aggregate("win", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))
    found = {r["len"]: r for r in wins.groupBy("len").agg(F.count("*").alias("n"), size.alias("b")).collect()}
    keyed = keyed_windows(wins)
    passes = max(1, -(-sum(r["n"] for r in found.values()) // pass_windows), -(-sum(r["b"] for r in found.values()) // PASS_BYTES))
    nothing = {"o": "int", "blen": "int", "win": "array<string>", "w1": "long", "w2": "long", "s0": "int"}
    own = spark.range(1).select(F.lit(-1).cast("long").alias("bh"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    parts = []
    for i in range(passes):
        part = keyed if passes == 1 else keyed.where(F.pmod("w1", F.lit(passes)) == i)
        parts.append(_hits(d, part.unionByName(own) if i == 0 else part, sorted(found)))
    hits = reduce(DataFrame.unionByName, parts)
    g = hits.groupBy("doc_id", "rid").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", (F.col("s") + F.col("len")).alias("e"))))).alias("spans"),
        F.collect_set(F.when(F.col("s").isNotNull(), F.struct("w1", "w2"))).alias("wins"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.to))).alias("n"), F.greatest(a.to, x.e).alias("to")),
    )
    return materialize(g.select("doc_id", "rid", F.col("n_words").cast("long").alias("n_words"), covered.n.cast("long").alias("n_hit"), "wins"), "hits")


def _items(found: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, rid, item) of each item that has a window in a document; what windows stand for is only looked up for those hit."""
    hit = found.where(F.size("wins") > 0).select("doc_id", "rid", F.explode("wins").alias("w")).select("doc_id", "rid", "w.w1", "w.w2")
    return hit.join(wins.select("w1", "w2", "item").distinct(), ["w1", "w2"]).select("doc_id", "rid", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """One row per document: doc_id, rid, n_words, n_hit (words inside a window of the benchmark), items (sorted ids).

    Null or empty texts have no words; repeated rows count each for themselves; rid tells rows of one doc_id apart. An empty
    benchmark hits nothing. Other columns are not read. Documents aren't shuffled: the benchmark's distinct
    windows, counted first, are broadcast in passes of at most `pass_windows` and PASS_BYTES, and only hits are shuffled, by document.
    """
    wins = benchmark_windows(benchmark)
    found = _found(docs, wins, key, text, pass_windows)
    items = _items(found, wins).groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    return found.join(items, "rid", "left").select("doc_id", "rid", "n_words", "n_hit", F.coalesce("items", none).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Counts and digests by document; contaminated: windows of at least `min_items` items occur in it."""
    c = contamination(docs, benchmark)
    n = F.size("items").cast("long")
    return c.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without rows that hold windows of at least `min_items` items; an item under WINDOW words must occur whole.

    A repeated key goes with any such row of it; a null key stays. Null and empty texts stay. Columns may have any names.
    """
    wins = benchmark_windows(benchmark)
    found = _found(docs, wins, key, text, PASS_WINDOWS)
    if min_items <= 1:
        bad = found.where("n_hit > 0").select("doc_id")
    else:
        bad = _items(found, wins).groupBy("doc_id", "rid").agg(F.count("*").alias("n")).where(F.col("n") >= min_items).select("doc_id")
    return without_keys(docs, key, bad, "contaminated")
