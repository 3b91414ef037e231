"""Removal of repeats and near-duplicates against plain Python."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest

from nestlake.llm import neardup, sentences, suffixes

P = "One two three four. Five six, seven eight nine! ten eleven\nTwelve thirteen fourteen? "


def prose(n, seed=1):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) + (". " if rng.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    a, b = prose(300), prose(200, 2)
    near = a.split()
    near[17] = "zz"
    out = [(3, a), (5, a), (5, b), (9, b[:400] + P + a[300:700]), (10, " ".join(near)), (11, None), (12, ""), (12, "   "), (None, a), (None, None), (13, P + P), (14, P.upper()), (15, "x" * 49), (16, "x" * 60), (17, "y" + "x" * 50 + "\0" * 60), (18, "\0" * 51), (19, "a b"), (20, "A  b"), (21, "a b c"), (22, prose(4000, 3) + a), (23, "é" * 30 + b)]
    return out + [(100 + i, b + " " + str(i)) for i in range(20)] + [(22, prose(4000, 3) + a)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, spans string, n long")


def brute_force(rows: list[tuple[int, str]]) -> list[tuple]:
    """`repeats_report` of a few rows in plain Python."""
    cut = {}
    for r, (_, text) in enumerate(rows):
        words = [(m.start(), m.end(), m.group().translate({c: c + 32 for c in range(65, 91)})) for m in re.finditer(rb"[^\x20\x09-\x0D]+".decode("latin1"), text or "")]
        found, run = [], []
        for k, (a, b, w) in enumerate(words):
            run.append((a, w))
            gap = (text[b : words[k + 1][0]] if k + 1 < len(words) else "\n") if w[-1] not in ".!?" else "\n"
            if "\n" in gap:
                found += [run[i : i + sentences.LONGEST] for i in range(0, len(run), sentences.LONGEST)]
                run = []
        cut[r] = found
    spans = {}
    for r, s in cut.items():
        own = []
        for i in range(len(s)):
            j = i + min(sentences.SPAN, len(s))
            while j <= len(s) and sum(map(len, s[i:j])) < sentences.LEAST_WORDS:
                j += 1
            if j <= len(s):
                own.append((i, j))
        if own:
            own[-1] = own[-1][0], len(s)
        spans[r] = [(i, j, tuple(w for part in s[i:j] for _, w in part)) for i, j in own]
    least: dict = {}
    for r, x in spans.items():
        for _, _, g in x:
            if rows[r][0] is not None:
                least[g] = min(least.get(g, rows[r][0]), rows[r][0])
    out = []
    for r, (doc, text) in enumerate(rows):
        s, gone, seen = cut[r], set(), set()
        for i, j, g in spans[r]:
            if g in seen or (doc is not None and doc > least[g]):
                gone |= set(range(i, j))
            seen.add(g)
        at = [0 if i < 0 else s[i][0][0] for i in range(len(s))] + [len(text or "")]
        kept = (text or "")[: at[0]] + "".join((text or "")[at[i] : at[i + 1]] for i in range(len(s)) if i not in gone)
        n, m = len((text or "").encode()), len(kept.encode())
        out.append((doc, n, n - m, sum(i in gone and i - 1 not in gone for i in range(len(s))), hashlib.sha256(kept.encode()).hexdigest(), len(s), len(gone)))
    return out


def test_sentence_spans(docs, rows):
    got = sorted(map(tuple, sentences.repeats_report(docs).collect()), key=str)
    assert got == sorted(brute_force(rows), key=str)
    kept = {(r["doc_id"], len(r["text"])) for r in sentences.remove_repeats(docs).collect()}
    assert (5, 0) in kept and (3, len(rows[0][1])) in kept


def cut_substrings(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        bad = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                bad[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~bad])
        out.append((i, len(b), int(bad.sum()), sum(bool(bad[k]) and not (k and bad[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(docs, rows):
    got = sorted(map(tuple, suffixes.substring_report(docs).collect()), key=str)
    assert got == sorted(cut_substrings(rows), key=str)


@pytest.mark.parametrize("hot", [(0, 100_000), (256, 0), (2, 1)])
def test_substrings_of_hot_anchors(docs, rows, hot):
    got = suffixes._cleaned(docs.select("doc_id", "text"), *hot).collect()
    got = sorted(((r[0], *r[2:], hashlib.sha256(r[1]).hexdigest()) for r in got), key=str)
    assert got == sorted(cut_substrings(rows), key=str)


def test_maximal_repeats():
    assert suffixes.maximal_repeats([], 2) == []
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = [bytes(rng.choice(list(b"ab"), rng.integers(0, 14))) for _ in range(3)]
        every = {}
        for r, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    every.setdefault(t[i:j], []).append((r, i))
        want = []
        for w, where in every.items():
            left = {texts[r][i - 1] if i else ("start", r) for r, i in where}
            right = {texts[r][i + len(w)] if i + len(w) < len(texts[r]) else ("end", r) for r, i in where}
            if len(where) > 1 and (len(left) > 1 or isinstance(next(iter(left)), tuple)) and (len(right) > 1 or isinstance(next(iter(right)), tuple)):
                want.append((w, where))
        assert suffixes.maximal_repeats(texts, 2) == sorted(want)


def test_repeat_groups():
    rng = np.random.default_rng(11)
    n = suffixes.LENGTH
    for _ in range(40):
        base = bytes(rng.integers(0, 3, 90, dtype=np.uint8))
        counts = rng.integers(1, 27, 12)
        cells = []
        for c in counts.tolist():
            x = bytearray(base[: c + n - 1])
            if rng.random() < 0.7:
                x[int(rng.integers(0, len(x)))] = int(rng.integers(0, 3))
            cells.append(bytes(x))
        doc = rng.integers(0, 6, 12)
        got = suffixes.repeat_groups(np.frombuffer(b"".join(cells), np.uint8), np.array([len(x) for x in cells]), counts, doc)
        least = {}
        for x, c, d in zip(cells, counts, doc, strict=True):
            for i in range(c):
                least[x[i : i + n]] = min(least.get(x[i : i + n], d), d)
        want = [least[x[i : i + n]] < d for x, c, d in zip(cells, counts, doc, strict=True) for i in range(c)]
        # what a maximal group covers may be marked by a longer run of windows, each of which repeats as well
        assert got.tolist() == want


def linked(rows, words, percent):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(rows[a][0]), find(rows[b][0])
            up[max(x, y)] = min(x, y)
    at = lambda i, s: None if i is None else find(i) if s else i
    return [(i, len(s), at(i, s), i is None or at(i, s) == i) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, rows, words):
    got = sorted(map(tuple, neardup.near_duplicates(docs, words).collect()), key=str)
    assert got == sorted(linked(rows, words, 80), key=str)


def test_drop_near_duplicates(spark, docs):
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 3 in ids and 10 not in ids and ids.count(None) == 2 and 11 in ids
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_empty_tables(docs):
    none = docs.where("false")
    assert sentences.repeats_report(none).count() == 0 and suffixes.substring_report(none).count() == 0


def test_components(spark):
    from nestlake.llm.components import components

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_passages_go_wherever_they_begin(spark):
    from nestlake.llm import queries

    rng = np.random.default_rng(8)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(n)]
    passage = word(sentences.RUN)
    rows = [(1, " ".join(word(5) + passage + word(40)))]
    rows += [(2 + k, " ".join(word(k) + [w.upper() for w in passage] + word(50 - k))) for k in range(sentences.RUN)]
    rows += [(90, " ".join(["x"] * 200)), (91, " ".join(passage[:25])), (92, None), (93, " ".join([*passage, *word(9), *passage]) + " ")]
    sf = "/tmp/checkpoints/passages-test"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_sentence_spans(spark, sf).collect()}
    assert all(got[2 + k]["n_removed"] > 0 for k in range(sentences.RUN)) and got[1]["n_removed"] == got[91]["n_removed"] == 0
    kept = {r["doc_id"]: r["text"].lower().split() for r in sentences.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run=sentences.RUN).collect()}
    for i, t in rows[1:-4]:
        own, gone = t.lower().split(), len(t.split()) - len(kept[i])
        assert sentences.RUN // 2 < gone <= sentences.RUN and set(own) - set(passage) <= set(kept[i])
        assert got[i]["n_removed"] == 10 * gone and got[i]["n_spans"] == 1
    assert sum(w not in passage for w in kept[93]) == 9 and len(kept[93]) <= 9 + 2 * 50 and 16 <= len(kept[90]) < 200
    same = sentences.remove_repeats(spark.createDataFrame([(1, rows[-1][1])], "doc_id long, text string"), run=sentences.RUN).first()["text"].split()
    assert same[:60] == rows[-1][1].split()[:60] and len(same) < 111 - 25
