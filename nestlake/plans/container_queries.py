"""Queries that write shared tables into the container and read them back, beside the SQL that they are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries, hist
from ..scratch import fresh_folder
from ..sources import build, datasource
from ..sources.histograms import LAYOUTS, read_hist
from .queries import EV, O, event_items, query, table

CLUSTER = 700
#: Rows of a file of ordered ntuples: full clusters, so that their numbers go on from file to file.
FILE_ROWS = 1_000_000 // CLUSTER * CLUSTER


def _kept(spark: SparkSession, df: DataFrame, name: str, key: str | None = None) -> str:
    """The folder with df as ntuples; with a key, in its order from file to file."""
    folder = fresh_folder(spark, name)
    datasource.write(df if key is None else entries.in_parts(df, FILE_ROWS, key), folder, name, cluster=CLUSTER)
    return folder


def _trees(spark: SparkSession, df: DataFrame, key: str) -> str:
    folder = fresh_folder(spark, "trees")
    build.write_trees(df.repartitionByRange(key).sortWithinPartitions(key), folder, basket=CLUSTER)
    return folder


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def ntuple_round_trip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").drop("o_orderdate")
    return datasource.read(spark, _kept(spark, o, "orders"), "orders")


@query("select c_custkey, c_nationkey, c_acctbal acctbal, c_mktsegment segment from customer")
def ntuple_columns(spark, sf_dir):
    """Only the selected fields are read, two of them under new names."""
    folder = _kept(spark, table(spark, sf_dir, "customer"), "customer")
    return datasource.read(spark, folder, "customer", [re.compile("key$"), (re.compile("c_(acctbal)"), r"\1"), (re.compile("c_mkt"), "")])


@query(f"with {EV} select orderkey, line, qty from ev")
def ntuple_nested(spark, sf_dir):
    return datasource.read(spark, _kept(spark, event_items(spark, sf_dir), "events"), "events", ["orderkey", "line", "qty"])


@query("select vec_id, embedding, label, embedding[1] first from embeddings")
def ntuple_structs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.struct("label", F.col("embedding")[0].alias("first")).alias("s"))
    return datasource.read(spark, _kept(spark, e, "vectors"), "vectors").select("vec_id", "embedding", "s.label", "s.first")


@query(f"with {O} select entry - 1 entry, o_orderkey from o where entry between 601 and 1300")
def ntuple_rows(spark, sf_dir):
    """A range of rows, of which only the clusters are read."""
    folder = _kept(spark, table(spark, sf_dir, "orders").select("o_orderkey"), "orders", "o_orderkey")
    return datasource.read(spark, folder, "orders", entry=True, rows=(600, 1300)).withColumnRenamed("__entry", "entry")


@query(f"with {O} select (entry - 1) // {CLUSTER} chunk, count(*) n, min(entry) - 1 first, max(entry) - 1 last, min(o_orderkey) low from o group by 1")
def ntuple_chunks(spark, sf_dir):
    """The clusters of the files, with their rows."""
    folder = _kept(spark, table(spark, sf_dir, "orders").select("o_orderkey"), "orders", "o_orderkey")
    r = datasource.read(spark, folder, "orders", entry=True, chunk=True)
    return r.groupBy(F.col("__chunk").alias("chunk")).agg(F.count("*").alias("n"), F.min("__entry").alias("first"), F.max("__entry").alias("last"), F.min("o_orderkey").alias("low"))


@query("select count(*) n from events")
def ntuple_count(spark, sf_dir):
    """The number of rows by what the files say of themselves."""
    n = datasource.entry_count(_kept(spark, table(spark, sf_dir, "events").select("event_id"), "events"), "events")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query(f"with {O} select entry - 1 entry, o_orderkey, o_totalprice, o_orderstatus from o")
def tree_columns(spark, sf_dir):
    folder = _trees(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_orderkey")
    return datasource.read(spark, folder, "tree", ["o_orderkey", re.compile("price|status")], entry=True).withColumnRenamed("__entry", "entry")


@query(f"with {EV} select orderkey, qty, price from ev")
def tree_jagged(spark, sf_dir):
    return datasource.read(spark, _trees(spark, event_items(spark, sf_dir).select("orderkey", "qty", "price"), "orderkey"), "tree")


@query("select vec_id, embedding from embeddings")
def tree_vectors(spark, sf_dir):
    return datasource.read(spark, _trees(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id"), "tree")


@query("select printf('%016x', event_id) id, printf('%02x', length(event_type)) || lower(hex(event_type)) kind from events")
def tree_raw(spark, sf_dir):
    """Cells as the bytes that are stored."""
    folder = _trees(spark, table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return datasource.read(spark, folder, "tree", raw=True).select(F.lower(F.hex("event_id")).alias("id"), F.lower(F.hex("event_type")).alias("kind"))


@query("select * from (values ('orders', 'ROOT::RNTuple', 1)) v(path, class, cycle)")
def container_catalog(spark, sf_dir):
    folder = _kept(spark, table(spark, sf_dir, "orders").select("o_orderkey"), "orders", "o_orderkey")
    return datasource.catalog(spark, datasource._paths(folder)[0]).select("path", "class", "cycle")


@query("with b as (select case when l_quantity < 0 then 0 when l_quantity >= 45 then 10 else cast(floor(l_quantity / 45 * 9) as int) + 1 end ix, l_discount w from lineitem), p as (select unnest(range(0, 11)) ix) select cast(p.ix as int) ix, round(coalesce(sum(w), 0), 6) content, round(coalesce(sum(w * w), 0), 6) sumw2 from p left join b using (ix) group by 1")
def hist_stored(spark, sf_dir):
    """A histogram that is filled, put into a file with all its bins, and read from it."""
    axis = hist.Axis("l_quantity", 9, 0, 45)
    content, squares = hist.dense(hist.fill(table(spark, sf_dir, "lineitem"), [axis], "l_discount"), [axis], flow=True)
    b = build.Builder(LAYOUTS)
    x = {"fName": "xaxis", "fNbins": 9, "fXmax": 45.0}
    none = {"fNbins": 1, "fXmax": 1.0}

    def members(out):
        doubles = lambda v: lambda: out.put("i", len(v)).data.extend(build.np.asarray(v, ">f8").tobytes())
        axes = {a: lambda m=m: build.encode(out, b.layouts, "TAxis", m | {"fXbins": doubles([])}) for a, m in (("fXaxis", x), ("fYaxis", none), ("fZaxis", none))}
        return {"fName": "h", "fTitle": "quantity", "fEntries": sum(content), "array": content, "fSumw2": doubles(squares), "fContour": doubles([]), **axes}

    b.object("TH1D", "h", members)
    folder = fresh_folder(spark, "hist")
    fs, top = datasource.pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/h.root") as s:
        s.write(b.finish())
    h = read_hist(spark, f"{folder}/h.root", "h")
    return h.bins.select("ix", F.round("content", 6).alias("content"), F.round("sumw2", 6).alias("sumw2"))


