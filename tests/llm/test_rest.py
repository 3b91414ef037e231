"""Language identification, tokens, files, neighbours, chat, mixing, decontamination and the pipeline."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestlake.llm import ann, chat, decontam, langid, mixing, tokenfiles, tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = [(4, "Hello wörld, it's 123!"), (1, None), (7, ""), (7, "a<|endoftext|>B <|ENDOFTEXT|> é é. ÀB ǅ İ"), (9, "Hello world " * 9000), (10, "x" * 70_000), (None, "null key"), (4, "Hello wörld, it's 123!"), (11, "  \n\t  \x1c b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in TEXTS], "doc_id long, text string, n_tokens string")


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, tok):
    got = sorted(map(tuple, tokens.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n := len(ids_of(tok, t)), n > 2048) for i, t in TEXTS), key=str)
    assert tokens.token_counts(docs.where("false"), PATH).count() == 0


def test_resync_joins_to_the_whole(tok):
    rng = np.random.default_rng(1)
    encode = tokens._library(tokens.pieces_of(PATH))
    for _ in range(150):
        s = "".join(rng.choice(["a", "é", " ", "\n", "it's", "<|endoftext|>", "9", "ab cd", "...", "é", "Word, "], rng.integers(0, 300)))
        parts = tokens.resync(encode, s, chunk=int(rng.choice([20, 64])), overlap=int(rng.choice([4, 9])))
        assert [i for x in parts for i in x] == ids_of(tok, s)
        assert np.frombuffer(tokens.pieces_of(PATH).encode(s), "<u2").tolist() == ids_of(tok, s)


def test_token_files(spark, docs, tok):
    manifest = tokenfiles.write_token_files(docs, PATH, length=64)
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(tok, t), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfiles.read_token_files(manifest).collect()), key=lambda r: r[1]) == want
    total = 0
    for r in manifest.collect():
        f = tokenfiles.TokenFile(r["path"])
        for i in range(len(f)):
            ids, mask = f[i]
            assert len(ids) == len(mask) == 64
            total += int(mask.sum())
    assert total == at
    assert tokenfiles.token_files(docs.where("false"), PATH).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype("f4")
    x[5] = x[6] = x[600]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1200, [1.0] * 7 + [None]), (None, [1.0] * 8), (1300, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    for size in (1 << 20, 100):
        got = [tuple(r) for r in ann.nearest(df.where("vec_id % 100 = 0"), df, pass_bytes=size).orderBy("query_id", "rank").collect()]
        want = []
        for q in range(0, 700, 100):
            d = np.sqrt(((x[q].astype(float) - x.astype(float)) ** 2).sum(1))
            near = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
            want += [(q, k + 1, int(i), d[i]) for k, i in enumerate(near)]
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.nearest(df.where("false"), df).count() == 0 and ann.nearest(df, df.where("vec_id < 4")).where("query_id = 1").count() == 3


def test_nearest_of_odd_tables(spark):
    huge = [(1, [1e160, 0.0]), (2, [1e160, 1e150]), (3, [2.0, 3.0]), (4, [-1.7e308, 1.7e308]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>").selectExpr("*", "1 as `a.b`", "2 as query_id", "3 as Rank", "4 as score")
    got = [tuple(r)[:3] for r in ann.nearest(df.where("vec_id = 1"), df).orderBy("rank").collect()]
    assert [g[2] for g in got[:1]] == [2] and len(got) == 5
    assert ann.nearest(df.where("vec_id = 1"), df).where("rank = 1").first()["score"] == pytest.approx(1e150)
    near = [tuple(r) for r in ann.nearest(df.where("vec_id = 3"), df).orderBy("rank").collect()]
    assert [r[2] for r in near[:2]] == [4, 4] and near[0][3] == near[1][3] == pytest.approx(5**0.5)


def lang_rows():
    rng = np.random.default_rng(4)
    words = {"en": "the of and that with from thing water over under".split(), "fr": "le la été déjà une avec pour dans eau où".split(), "de": "der die straße über für nicht schön zeit auch haus".split()}
    return [(i, " ".join(rng.choice(words[k], rng.integers(1, 60))).capitalize() + ".", k) for i, k in enumerate(["en", "fr", "de"] * 60)], words


def test_language(spark):
    rows, words = lang_rows()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", None), (1003, "…—", "fr"), (1003, "Où été", None)]
    mixed = " ".join(words["en"] * 30 + words["de"] * 12)
    df = spark.createDataFrame([*rows, *odd, (1005, mixed, None)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["held_out"]): r for r in langid.language_report(df).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got.values())
    pred = [(r["doc_id"], r["lang_pred"]) for r in langid.language_report(df).collect()]
    assert sum(dict(pred)[i] == k for i, _, k in rows) >= 0.98 * len(rows)
    assert sorted(p for i, p in pred if i in (1000, 1001, 1002)) == ["und"] * 3 and sorted(p for i, p in pred if i == 1003) == ["fr", "und"]
    assert got[(1005, zlib.crc32(b"1005") % 4 == 2)]["langs"].startswith("en:0.7")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + 2
    assert {r["lang_pred"] for r in langid.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages_by_several_models(spark):
    rows, words = lang_rows()
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12", None), (1002, "", "fr"), (1003, "the water " * 40_000, None), (5, rows[5][1], "de"), (None, "été déjà", None)], "doc_id long, text string, lang string")
    df = df.selectExpr("*", "'x' as langs", "2 as Score", "3 as lang_pred", "4 as `a.b`")
    train = df.where(~langid.held_out())
    one = langid.identify(df, langid.learn(train))
    many = langid.identify(df, langid.learn(train, group=1))
    assert one.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score", "langs"] == many.columns
    a, b = (sorted((str(r["doc_id"]), str(r["text"])[:50], r["lang_pred"]) for r in x.collect()) for x in (one, many))
    assert len(a) == len(rows) + 6 and sum(x != y for x, y in zip(a, b, strict=True)) <= 0.02 * len(a)
    assert ("1003", "the water " * 5, "en") in a and ("None", "été déjà", "fr") in b and ("1001", "12", "und") in b
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + 3
    assert langid.language_report(df.where("false")).count() == 0


def plain_mixture(score, rounds=400):
    """Proportions of all subsets of languages by long EM, and the subset of best penalised likelihood."""
    from itertools import combinations

    langs, n = score.shape
    best = None
    for size in range(1, langs + 1):
        for own in combinations(range(langs), size):
            p, w = np.exp(score[list(own)]), np.full(size, 1 / size)
            for _ in range(rounds):
                q = p * w[:, None]
                w = (q / q.sum(0)).mean(1)
            fit = np.log((p * w[:, None]).sum(0)).sum() - langid.WEIGHT / 2 * np.log(n) * (size - 1)
            if best is None or fit > best[0]:
                best = fit, own, w
    return best


def test_mixtures_against_all_subsets():
    rng = np.random.default_rng(9)
    for _ in range(12):
        n, parts = int(rng.integers(80, 300)), rng.choice([0.0, 0.35, 0.65], 4)
        parts = parts / parts.sum() if parts.sum() else np.array([1.0, 0, 0, 0])
        truth = rng.choice(4, n, p=parts)
        score = rng.normal(-6, 1, (4, n)) + 5 * (np.arange(4)[:, None] == truth)
        fit, own, w = plain_mixture(score)
        share, _, got = langid.mixtures(score.astype(np.float32), np.zeros(n, np.int64), 1, True)
        assert tuple(np.flatnonzero(share[0])) == own and np.abs(share[0][list(own)] - w).max() < 0.02 and abs(got[0] - fit) < 0.5


def test_mixtures_by_expectation_maximisation():
    rng = np.random.default_rng(5)
    score = np.log(np.where(rng.random((1, 400)) < 0.7, [[0.9], [0.1], [0.01]], [[0.1], [0.9], [0.01]]))
    share, _, fit = langid.mixtures(score.astype(np.float32), np.zeros(400, np.int64), 1, True)
    assert fit[0] < 0 and share[0, 2] == 0 and abs(share[0].sum() - 1) < 1e-6 and 0.5 < share[0, 0] < 0.95


def test_chat(spark):
    rows = [(1, 0, "user", "hi </turn> #<\\b"), (1, 1, "assistant", "### a: b"), (1, 2, "user", None), (1, 3, "assistant", "\\\\h\n"), (2, None, "assistant", "x"), (2, None, "assistant", "x"), (3, 0, None, "only"), (None, 0, "a:b", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c)
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    x = chat.chat_examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(x) == 2 and x[1]["context"].startswith(x[0]["context"]) and "</turn>" not in x[0]["target"]


def windows(text, item):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    w, g = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for t in (text, item))
    n = min(8, len(g))
    grams = {tuple(g[k : k + n]) for k in range(len(g) - n + 1)} if n else set()
    hit = set()
    for k in range(len(w) - n + 1):
        if tuple(w[k : k + n]) in grams:
            hit |= set(range(k, k + n))
    return len(w), hit


def test_contamination(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d1"], n))
    items = [(i, word(int(n))) for i, n in enumerate(rng.integers(1, 14, 12))] + [(50, None), (51, " .. "), (52, "solo"), (None, "a a a")]
    rows = [(i, word(int(n)) + " solo") for i, n in enumerate(rng.integers(1, 200, 15))] + [(3, items[0][1]), (20, None), (21, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        found = [(str(k), windows(t, x)[1]) for k, x in items if k is not None]
        own = sorted(k for k, h in found if h)
        want.append((i, windows(t, "")[0], len(set().union(*[h for _, h in found])), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), len(own) >= 2))
    assert sorted(map(tuple, decontam.contamination_report(docs, bench).collect()), key=str) == sorted(want, key=str)
    by_pass = decontam.contamination(docs, bench, pass_windows=7)
    assert sorted(r["n_hit"] for r in by_pass.collect()) == sorted(w[2] for w in want)
    assert decontam.contamination_report(docs, bench.where("false")).where("n_items > 0").count() == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_contamination_of_odd_tables(spark):
    rng = np.random.default_rng(12)
    item = "needle one two three four five six seven eight"
    long = " ".join(rng.choice(["a", "b", "c"], 60_000)) + f" {item} " + " ".join(rng.choice(["a", "b", "c"], 60_000))
    docs = spark.createDataFrame([(1, long), (2, ""), (2, None), (None, item), (3, item), (3, "clean"), (4, "x")], "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as n_words", "3 as __bad")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"]) for r in decontam.contamination_report(docs, bench).collect()}
    assert got == {(1, 120_009): (9, 1), (2, 0): (0, 0), (None, 9): (9, 1), (3, 9): (9, 1), (3, 1): (0, 0), (4, 1): (0, 0)}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "4", "None"]
    assert decontam.decontaminate(docs, bench, min_items=2).count() == 7
    none = docs.where("false")
    assert decontam.contamination_report(none, bench).count() == decontam.decontaminate(none, bench).count() == 0


def test_chat_of_odd_tables(spark):
    long = "# </turn> \\\\" * 30_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", "no reply")], "conv_id long, turn int, role string, text string").selectExpr("*", "1 as seq", "2 as `a.b`", "3 as example")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert got[1]["loss_chars"] == 2 * len(long) and got[1]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["n_turns"] == 1
    x = chat.expand(chat.format_chat(df)).collect()
    assert sorted(r["example"] for r in x) == [0, 1] and all(r["conv_id"] == 1 for r in x)
    assert chat.chat_digest(df.where("false")).count() == 0


def test_mixing(spark):
    rows = [(i, "abc"[i % 10 // 5 + (i % 10 == 9)]) for i in range(400)] + [(400 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.pfair_mix(df, {"a": 2, "b": 1, "": 1}, block=4)
    got = out.collect()
    assert len(got) == len(rows) and all(not r["mixed"] for r in got if r["source"] == "c")
    slots = {}
    for r in got:
        if r["slot"] is not None:
            slots.setdefault(r["slot"], set()).add(r["source"] or "")
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[k])) for k in range(8)]  # all three sources last that long
    for n in range(1, 9):
        for k, w in (("a", 0.5), ("b", 0.25), ("", 0.25)):
            assert abs(order[:n].count(k) - w * n) < 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert mixing.pfair_mix(df.where("false")).count() == 0


def test_sources_stay_within_a_block_of_their_exact_weights():
    weights = {"a": 0.33349, "b": 0.66646, "t": 0.00005}
    order, mixed = mixing.schedule({"a": 33349, "b": 66646, "t": 5}, weights)
    assert len(order) == 100_000 and mixed >= 99_998
    for k, w in weights.items():
        had = np.cumsum(np.array(order) == k)
        assert np.abs(had - np.arange(1, len(order) + 1) * w).max() < 1
        assert had[-1] == round(w * 100_000)


def plain_schedule(blocks, weights):
    """Earliest deadline first, looking at every source at every slot."""
    left, out = {k: n for k, n in blocks.items() if n}, []
    while left:
        total, t, had = sum(weights[k] for k in left), 0, dict.fromkeys(left, 0)
        while all(left.values()):
            w = {k: Fraction(weights[k]) / total for k in left}
            free = [k for k in left if math.floor(had[k] / w[k]) <= t]
            k = min(free, key=lambda k: (math.ceil((had[k] + 1) / w[k]), -w[k], k))
            out.append(k)
            had[k], left[k], t = had[k] + 1, left[k] - 1, t + 1
        left = {k: n for k, n in left.items() if n}
    return out


def test_schedules_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        names = list("abcdef")[: rng.integers(1, 7)]
        weights = {k: Fraction(int(rng.integers(1, 40)), int(rng.integers(1, 9))) for k in names}
        blocks = {k: int(rng.integers(0, 30)) for k in names}
        assert mixing.schedule(blocks, weights)[0] == plain_schedule(blocks, weights)


def test_mixing_of_odd_tables(spark):
    rows = [(i % 7 or None, "abcdefgh"[i % 8], i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").selectExpr("*", "'u' as Slot", "'v' as mixed", "'w' as `a.b`", "1 as __nth")
    got = mixing.pfair_mix(df, block=4)
    assert got.columns == ["doc_id", "source", "n", "a.b", "__nth", "block_no", "slot", "place", "mixed"]
    assert sorted(r["n"] for r in got.collect()) == list(range(400)) and len({r["place"] for r in got.collect()}) == 400
    assert mixing.in_order(df).columns == df.columns and mixing.in_order(df).count() == 400
    few = mixing.pfair_mix(df, block=1, own_sources=3, most_blocks=50).collect()
    assert sorted(r["n"] for r in few) == list(range(400)) and len({r["place"] for r in few}) == 400 and max(r["slot"] for r in few) < 60
    with pytest.raises(ValueError):
        mixing.pfair_mix(df, {"a": 0})


def test_sources_beyond_those_the_driver_names_keep_their_own_slots(spark):
    cut = "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', cast(pow(id % 977, 0.5) as int)) end"
    df = spark.range(1500).selectExpr("id doc_id", f"{cut} source")
    weights = {"hot": 2.5, "": 1, "s3": 1, "s17": 0.5, "none": 4, "s20": Fraction(1, 3)}
    for options in ({}, {"temperature": 0.0}, {"weights": weights}):
        got = [sorted(map(tuple, mixing.pfair_mix(df, block=2, own_sources=n, **options).collect()), key=str) for n in (1 << 16, 3)]
        assert got[0] == got[1]
        slots = {}
        for _, source, _, slot, _, _ in got[1]:
            if slot is not None:
                slots.setdefault(slot, set()).add(source or "")
        n = {}
        for r in got[1]:
            n[r[1] or ""] = n.get(r[1] or "", 0) + 1
        own = options.get("weights") or {k: Fraction(max(1, round(v ** options.get("temperature", 0.7) * 1000)), 1000) for k, v in n.items()}
        own = {k: Fraction(str(w)) for k, w in own.items() if k in n}
        assert [{k} for k in plain_schedule({k: -(-n[k] // 2) for k in own}, own)] == [slots[i] for i in range(len(slots))]


def test_a_schedule_of_many_sources():
    names = [f"s{i:05}" for i in range(20_000)]
    order, mixed = mixing.schedule(dict.fromkeys(names, 2), dict.fromkeys(names, 1))
    assert sorted(order) == sorted(names * 2) and order[:20_001] == [*names, names[0]] and mixed >= len(order) - 2


def test_pipeline(spark, tok):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, _ = lang_rows()
    text = dict((i, t) for i, t, _ in rows)
    bench = [(0, "one two three four five six seven eight nine"), (1, "alpha beta gamma delta epsilon zeta eta theta iota")]
    docs = [(i, f"{t} tail{i} end{i} mark{i} note{i} last{i}", k, "ab"[i % 2], 0) for i, t, k in rows]
    docs += [(500, None, "en", "a", 0), (501, "123", "en", "a", 0), (502, docs[0][1], "en", "b", 0), (503, bench[0][1] + " the water " + bench[1][1], "en", "a", 0)]
    sf = "/tmp/checkpoints/pipeline-test"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"] for r in d.collect()})
    assert {500, 501} & seen[0] == set() and {0, 502, 503} <= seen[0]
    assert 502 not in seen[1] and 503 in seen[1] and 503 not in seen[2] and seen[3] <= seen[2]
    out = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    at = 0
    for (i, start, n, crc), own in zip(out, sorted(seen[3]), strict=True):
        ids = [*ids_of(tok, next(x[1] for x in docs if x[0] == own)), 2]
        assert (i, start, n, crc) == (own, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert len(text) == len(rows)


def test_one_whole_item_is_dropped(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = "one two three four five six seven eight nine ten"
    sf = "/tmp/checkpoints/one-item-test"
    spark.createDataFrame([(0, item), (1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    rows = [(1, f"before it {item} and behind"), (2, "one two three four five six seven"), (3, "clean"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()) == [2, 3, 4]


def test_pipeline_of_odd_tables(spark, tok):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, _ = lang_rows()
    long = " ".join(f"water{i}" for i in range(30_000))
    docs = [(i, f"{t} tail{i} end{i} mark{i} note{i} last{i}", k, "ab"[i % 2], 0) for i, t, k in rows]
    docs += [(None, "no id but text", "en", None, 0), (7000, long, None, "a", 0), docs[5], docs[5], (7001, None, None, None, None)]
    sf = "/tmp/checkpoints/odd-pipeline-test"
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(0, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    for table in (docs, []):
        spark.createDataFrame(table, names).selectExpr("*", "1 as slot", "2 as lang_pred", "3 as `a.b`").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        d = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, sf)
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "lang_pred", "a.b"], name
        out = corpus_pipeline.run(spark, sf).collect()
        assert d.count() == len(out) == (len(table) - 1 if table else 0)
        if table:
            got = {r["doc_id"]: r["n_tokens"] for r in out}
            assert got[7000] == len(ids_of(tok, long)) + 1 and None in got and 7001 not in got


def test_a_hot_source_is_kept_whole(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, "a") for i in range(400)] + [(400, "b"), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = corpus_pipeline.mix_sources(spark, docs, "")
    got = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and sorted(got) == list(range(402))
    place = {r["doc_id"]: r["place"] for r in mixing.pfair_mix(docs).collect()}
    assert [place[i] for i in got] == sorted(place.values())


def test_the_mixture_orders_what_follows_it(spark, tok, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/tmp/checkpoints/mixture-order-test"
    words = "water house green seven paper light mouth stone river table".split()
    text = {i: " ".join(f"{words[(i * 7 + j * 3) % 10]}{i * j}" for j in range(12)) for i in range(300)}
    docs = [(i if i < 299 else None, t, "en", "hot" if i % 3 else f"s{i % 5}", 0) for i, t in text.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    place = {r["doc_id"]: r["place"] for r in mixing.pfair_mix(d).collect()}
    mixed = sorted(place, key=place.get)
    at, start = 0, {}
    for i in sorted(place, key=lambda i: (i is not None, i)):
        start[i] = at
        at += len(ids_of(tok, text[299 if i is None else i])) + 1
    found = []
    write = tokenfiles.write_token_files
    monkeypatch.setattr(tokenfiles, "write_token_files", lambda *a, **b: found.append(write(*a, **b)) or found[-1])
    for out in (corpus_pipeline.run(spark, sf), corpus_pipeline.write_tokens(spark, corpus_pipeline.mix_sources(spark, d, sf), sf)):
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert [(r["doc_id"], r["start"]) for r in out.collect()] == [(i, start[i]) for i in mixed]
        listed = [x for r in found[-1].collect() for x in tokenfiles._open(r["path"] + ".docs.arrow").read_all().to_pylist()]
        assert [x["doc_id"] for x in sorted(listed, key=lambda x: x["place"])] == mixed
