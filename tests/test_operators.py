"""Laws of the operators on small tables built from rules."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestlake.functions import codecs, structs
from nestlake.operators import chain, clusters, entries, hist, jagged, select


def test_entries_by_ranges_are_those_of_one_window(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k")).withColumn("k", F.when(F.col("k") != 5, F.col("k")))
    one = sorted(map(tuple, entries.with_entry(df, "k").collect()), key=str)
    many = sorted(map(tuple, entries.with_entry(df, "k", per_range=60).collect()), key=str)
    assert one == many and len({e for _, e in one}) == 500


def test_chunk_sums_of_large_array(spark):
    df = spark.range(1, 10_001).select(F.col("id").alias("entry"), ((F.col("id") - 1) + (F.col("id") - 1) / 17).cast("float").alias("x"))
    sums = [r[1] for r in df.groupBy(entries.chunk_of(1000).alias("c")).agg(F.sum("x")).orderBy("c").collect()]
    assert sums[0] == pytest.approx(528882.3, rel=1e-6) and sums[1] == pytest.approx(1.5877059e6, rel=1e-6) and sums[9] == pytest.approx(1.0058294e7, rel=1e-6)


def test_row_access(spark):
    df = entries.with_entry(spark.range(10), "id")
    assert entries.row_at(df, 10).first()["id"] == 9
    for i in (0, 11):
        with pytest.raises(IndexError):
            entries.row_at(df, i)
    assert entries.slice_rows(df, 5, 4).count() == 0
    assert [r["id"] for r in entries.gather(df, [3, 1, 3]).orderBy("pos").collect()] == [2, 0, 2]
    assert [r["id"] for r in entries.View(df, range(2, 9)).view([1, 3]).rows().orderBy("entry").collect()] == [1, 3]
    assert [r["id"] for r in entries.last_rows(df, 2).orderBy("entry").collect()] == [8, 9]


def test_selectors(spark):
    names = ["nMuon", "Muon_pt", "Muon_eta", "Event/a", "Event/b", "Hit/Hit.x", "Hit/Hit.y"]
    assert list(select.resolve(names, ["nMuon", re.compile("Muon_(pt|eta)$")])) == ["nMuon", "Muon_pt", "Muon_eta"]
    assert select.resolve(names, (re.compile(r"Muon_(pt|eta)"), r"mu_\1")) == {"Muon_pt": "mu_pt", "Muon_eta": "mu_eta"}
    assert select.resolve(names, "Event") == {"Event/a": "a", "Event/b": "b"}
    assert select.resolve(names, "Hit") == {"Hit/Hit.x": "Hit_x", "Hit/Hit.y": "Hit_y"}
    assert list(select.resolve(names, [re.compile("Muon"), "nMuon"])) == ["nMuon", "Muon_pt", "Muon_eta"]
    assert select.normalized("a.a.fCoordinates.fX") == "a_fX"
    with pytest.raises(TypeError):
        select.resolve(names, [3])
    with pytest.raises(KeyError):
        select.resolve(names, "none")


def test_jagged_cells(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0]), (2, []), (3, [5.0])], "id int, x array<double>")
    got = df.select("id", jagged.lengths("x").alias("n"), jagged.total("x").alias("t"), jagged.count_if("x", lambda v: v > 2).alias("c")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 5.0, 2 - 1), (2, 0, 0.0, 0), (3, 1, 5.0, 1)]
    assert jagged.flat(df, "x", "id").count() == 3 and jagged.flat_outer(df, "x", "id").count() == 4
    back = jagged.regroup(jagged.flat(df, "x", "id"), "id", "pos", "value", "x")
    assert sorted(map(tuple, back.collect())) == [(1, [2.0, 3.0]), (3, [5.0])]
    fixed = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],), ([1.0],)], "x array<double>").select(jagged.fixed("x", 2).alias("b"))
    assert [r["b"] for r in fixed.collect()] == [[[1.0, 2.0], [3.0, 4.0]], [], []]


def test_offsets_and_counts(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 5)], "i int, n int")
    o = jagged.offsets(df, "n", "i")
    assert [r["offset"] for r in o.orderBy("i").collect()] == [2, 2, 7]
    assert [r["count"] for r in jagged.counts(o, "offset", "i").orderBy("i").collect()] == [2, 0, 5]


def test_histograms(spark):
    fills = spark.createDataFrame([(-1.5, -1.5, 20.0), (1.5, 1.5, 1.0), (-1.5, 1.5, 20.0), (1.5, -1.5, 1.0)], "x double, y double, w double")
    x, y = hist.Axis("x", 2, -2, 2), hist.Axis("y", 4, -2, 2)
    h = hist.fill(fills, [x], "w")
    assert hist.dense(h, [x]) == ([40.0, 2.0], [800.0, 2.0])
    assert hist.dense(hist.fill(fills, [hist.Axis("x", edges=(-2, 1, 2))], "w"), [hist.Axis("x", edges=(-2, 1, 2))])[0] == [40.0, 2.0]
    assert hist.dense(hist.fill(fills, [x, y], "w"), [x, y])[0] == [20.0, 1.0, 0, 0, 0, 0, 20.0, 1.0]
    odd = spark.createDataFrame([(float("nan"),), (None,), (-9.0,), (2.0,), (0.0,)], "x double")
    assert {r["ix"]: r["entries"] for r in hist.fill(odd, [x]).collect()} == {0: 1, 2: 1, 3: 1}
    assert hist.integral(h, [x]).first()["integral"] == 42.0
    assert {r["ix"]: r["content"] for r in hist.rebin(h, 2, x).collect()} == {1: 42.0}
    assert {r["ix"]: r["content"] for r in hist.merge(h, h).collect()} == {1: 80.0, 2: 4.0}
    m = hist.moments(fills, [x, y], "w").first()
    assert (m["tsumw"], m["tsumw2"], m["tsumwx"], m["tsumwxy"]) == (42.0, 802.0, -57.0, 0.0)


def test_chains(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "entry long, v string")
    b = spark.createDataFrame([(1, "c", 0)], "entry long, v string, more int")
    assert [(r["entry"], r["v"]) for r in chain.chain_entries([a, b]).orderBy("entry").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        chain.chain([a, b], strict=True)
    with pytest.raises(KeyError):
        chain.chain([b, a])
    assert chain.friend_join(a, b).columns == ["entry", "v", "friend_v", "more"]
    assert chain.only(a, "v", "b")["entry"] == 2
    with pytest.raises(LookupError):
        chain.only(a, "v", "z")


def test_keyed_index(spark):
    rows = [(3, 1), (1, 2), (2, 1), (1, 1), (3, 2), (2, 2)]
    df = entries.with_entry(spark.createDataFrame([(i, a, b, i + 0.5) for i, (a, b) in enumerate(rows)], "i int, major int, minor int, val float"), "i")
    index = chain.build_index(df, "major", "minor").orderBy("place").collect()
    assert [r["major"] for r in index] == [1, 1, 2, 2, 3, 3] and [r["row0"] for r in index] == [3, 1, 2, 5, 0, 4]


def test_common_ranges(spark):
    b = spark.createDataFrame([("a", x) for x in range(0, 100, 12)] + [("b", x) for x in range(0, 100, 18)], "name string, boundary long")
    assert sorted(map(tuple, clusters.common_ranges(b).collect())) == [(1, 36), (37, 72)]


def test_codecs(spark):
    for bits in (16, 32, 64):
        k = f"i{bits // 8}"
        x = np.array([0, 1, -1, 2 ** (bits - 2), -(2 ** (bits - 2)), 2 ** (bits - 1) - 1, -(2 ** (bits - 1))], k)
        assert (codecs.np_unzigzag(codecs.np_zigzag(x).view(k)) == x).all()
        assert codecs.np_zigzag(x)[:3].tolist() == [0, 2, 1]
        assert (codecs.np_unsplit(codecs.np_split(x), k) == x).all()
    assert codecs.np_split(np.array([0x04030201, 0x0C0B0A09], "<u4")) == bytes([1, 9, 2, 10, 3, 11, 4, 12])
    for n in (1, 7, 8, 9, 63, 64, 65, 100):
        x = np.arange(n) % 3 == 0
        assert (codecs.np_unpack_bools(codecs.np_pack_bools(x), n) == x).all()
        assert codecs.np_unpack(codecs.np_pack(np.arange(n), 7), 7, n).tolist() == list(range(n))
    f = np.array([1.0, -2.5, 3.14159], np.float32)
    assert np.allclose(codecs.np_untruncate(codecs.np_truncate(f, 16), 16), f, rtol=1e-2)
    assert (codecs.np_untruncate(codecs.np_truncate(f, 32), 32) == f).all()
    assert codecs.np_unquantize(np.array([0, 255]), 8, -1.0, 1.0).tolist() == [-1.0, 1.0]
    df = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (-1,)], "x long")
    z = df.select("x", codecs.unzigzag(codecs.zigzag(F.col("x"))).alias("b"))
    assert all(r["x"] == r["b"] for r in z.collect())


def test_records_and_vectors(spark):
    raw = b"\xff\xff" + (7).to_bytes(4, "big") + (3).to_bytes(2, "big") + (8).to_bytes(4, "big") + (-1).to_bytes(2, "big", signed=True)
    df = spark.createDataFrame([(raw,), (b"",), (None,)], "b binary")
    r = structs.Record("pair", (("a", "i4"), ("b", "i2")), skip=2)
    assert [x["r"] for x in df.select(structs.split_records("b", r).alias("r")).collect()] == [[(7, 3), (8, -1)], [], []]
    v = spark.range(1).select(structs.four_vector(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(5.0)).alias("v"))
    assert v.select(structs.mass("v")).first()[0] == 4.0 and v.select("v.t").first()[0] == 5.0
    m = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "p array<double>").select(structs.symmetric("p", 3)).first()[0]
    assert m == [[1.0, 2.0, 3.0], [2.0, 4.0, 5.0], [3.0, 5.0, 6.0]]
    u = spark.createDataFrame([(0,), (1,), (2,)], "t int").select(structs.variant(F.col("t"), {"_0": F.lit(5), "_1": F.lit("x")}).alias("v"))
    assert [tuple(r["v"]) for r in u.collect()] == [(0, None, None), (1, 5, None), (2, None, "x")]


def test_hashes_and_equality(spark):
    df = spark.createDataFrame([(1, "a", [1]), (1, "a", [1]), (2, "a", None)], "i int, s string, x array<int>")
    h = [r[0] for r in df.select(entries.row_hash("i", "s", "x")).collect()]
    assert h[0] == h[1] != h[2]
    assert entries.same_rows(df, df.orderBy("i")) and not entries.same_rows(df, df.distinct())


def test_members_of_structs_in_cells(spark):
    df = spark.sql("select array(struct(1 a, 'x' b), struct(2 a, 'y' b)) c")
    assert df.select(jagged.member("c", "a").alias("a"), jagged.member("c", "b").alias("b")).first() == ([1, 2], ["x", "y"])


@pytest.mark.parametrize("per_range", [100, 10_000])
@pytest.mark.parametrize("n", [0, 1, 70, 1001])
def test_parts_of_equal_rows(spark, n, per_range):
    df = spark.range(n).selectExpr("(id * 7919) % 1001 k", "id v").repartition(3)
    parts = entries.in_parts(df, 70, "k", per_range=per_range).rdd.glom().collect()
    rows = [tuple(r) for p in parts for r in p]
    assert rows == sorted(tuple(r) for r in df.collect()) and all(len(p) == 70 for p in parts[:-1]) and (n == 0 or len(parts) == -(-n // 70))
