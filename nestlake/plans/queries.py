"""One query for each operator, over the shared tables, beside the SQL that it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, structs
from ..operators import chain, clusters, entries, hist, jagged, select

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        _found[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An order of line items that is unique within an order.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: a row per order with its line items in parallel arrays."""
    items = jagged.nest(table(spark, sf_dir, "lineitem"), "l_orderkey", ("l_linenumber", "l_quantity", "l_extendedprice"), ITEM_ORDER)
    return items.toDF("orderkey", "line", "qty", "price")


_BY = "order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
EV = f"ev as (select l_orderkey orderkey, list(l_linenumber {_BY}) line, list(l_quantity {_BY}) qty, list(l_extendedprice {_BY}) price from lineitem group by 1)"


def numbered(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return entries.with_entry(table(spark, sf_dir, name), key)


E = "e as (select *, row_number() over (order by event_id) entry from events)"
O = "o as (select *, row_number() over (order by o_orderkey) entry from orders)"  # noqa: E741


@query(f"with {EV} select o_orderkey, len(qty) njets, len(list_filter(qty, lambda x: x > 40)) njets40, o_totalprice from ev join orders on orderkey = o_orderkey where len(qty) > 6")
def event_flagship(spark, sf_dir):
    """Events with more than six nested entries, with two counts over them."""
    ev = event_items(spark, sf_dir).where(F.size("qty") > 6)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ev.join(o, ev["orderkey"] == o["o_orderkey"]).select("o_orderkey", jagged.lengths("qty").alias("njets"), jagged.count_if("qty", lambda x: x > 40).alias("njets40"), "o_totalprice")


# ---- projection ----


@query("select l_orderkey, l_quantity from lineitem")
def select_exact(spark, sf_dir):
    return select.select(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"])


@query("select l_orderkey, l_partkey, l_suppkey from lineitem")
def select_regex(spark, sf_dir):
    return select.select(table(spark, sf_dir, "lineitem"), re.compile(r"(order|part|supp)key$"))


@query("select l_orderkey as key_order, l_partkey as key_part, l_suppkey as key_supp from lineitem")
def select_rename(spark, sf_dir):
    return select.select(table(spark, sf_dir, "lineitem"), (re.compile(r"^l_(.+)key$"), r"key_\1"))


@query("select o_totalprice, o_orderkey, o_custkey, o_orderdate from orders")
def select_union(spark, sf_dir):
    return select.select(table(spark, sf_dir, "orders"), ["o_totalprice", re.compile("key"), "o_totalprice", re.compile("(date|custkey)$")])


@query("select o_orderkey id, o_totalprice price, o_orderstatus status_code from orders")
def select_container(spark, sf_dir):
    """Members of a container without its prefix, a member of a member with both names."""
    o = table(spark, sf_dir, "orders")
    return select.select(o.select(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderstatus").alias("code")).alias("status")).alias("order")), "order")


@query("select o_orderkey as Order_key, o_totalprice as Order_price from orders")
def select_normalized(spark, sf_dir):
    """Paths such as Order/Order.key lose the repeated part."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order/Order.key"), F.col("o_totalprice").alias("Order/Order.price"))
    return select.select(o, "Order")


@query(f"with {E} select value from e where entry = 23")
def cell(spark, sf_dir):
    return entries.cell(numbered(spark, sf_dir, "events", "event_id"), 23, "value")


@query(f"with {E} select entry, event_type from e where entry between 20 and 30")
def cell_slice(spark, sf_dir):
    return entries.cells(numbered(spark, sf_dir, "events", "event_id"), 20, 30, 4)


@query("select o_orderkey, o_totalprice * 0.5 half, o_totalprice > 100000 dear from orders")
def computed_column(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.5).alias("half"), (F.col("o_totalprice") > 100000).alias("dear"))


@query("select c_custkey, c_acctbal bal, length(c_name) + c_nationkey size from customer")
def struct_member(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.struct(F.col("c_acctbal").alias("v")).alias("b"), F.col("c_name").alias("n"), F.col("c_nationkey").alias("k")).alias("s"))
    return s.select("c_custkey", F.col("s.b.v").alias("bal"), (F.length("s.n") + F.col("s.k")).cast("long").alias("size"))


# ---- rows by place ----


@query(f"with {E} select entry from e where value > 50 and event_type = 'purchase'")
def filter_mask_index(spark, sf_dir):
    return entries.mask_index(numbered(spark, sf_dir, "events", "event_id"), (F.col("value") > 50) & (F.col("event_type") == "purchase"))


@query("select event_id, value from events where event_type = 'click' and value < 20")
def filter_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click' and value < 20").select("event_id", "value")


@query(f"with {E} select * from e where entry between 101 and 160")
def slice_range(spark, sf_dir):
    return entries.slice_rows(numbered(spark, sf_dir, "events", "event_id"), 101, 160)


@query(f"with {E} select * from e where false")
def slice_empty(spark, sf_dir):
    return entries.slice_rows(numbered(spark, sf_dir, "events", "event_id"), 5, 4)


@query(f"with {O} select * from o where entry = 42")
def row_at(spark, sf_dir):
    return entries.row_at(numbered(spark, sf_dir, "orders", "o_orderkey"), 42)


@query(f"with {O}, p as (select * from (values (0, 5), (1, 3), (2, 5), (3, 1)) v(pos, i)) select cast(pos as bigint) pos, entry, o_orderkey from p join o on entry = i")
def gather_list(spark, sf_dir):
    return entries.gather(numbered(spark, sf_dir, "orders", "o_orderkey"), [5, 3, 5, 1]).select("pos", "entry", "o_orderkey")


@query(f"with {O} select entry, o_orderkey from o where entry between 14 and 16")
def nested_view(spark, sf_dir):
    v = entries.View(numbered(spark, sf_dir, "orders", "o_orderkey"), range(11, 31)).view(range(3, 11)).view([2, 3, 4])
    return v.rows().select("entry", "o_orderkey")


@query(f"with {O} select entry, o_orderkey from o where entry <= 10")
def first_n(spark, sf_dir):
    return entries.first_rows(numbered(spark, sf_dir, "orders", "o_orderkey"), 10).select("entry", "o_orderkey")


@query(f"with {O} select entry, o_orderkey from o order by entry desc limit 10")
def last_n(spark, sf_dir):
    return entries.last_rows(numbered(spark, sf_dir, "orders", "o_orderkey"), 10).select("entry", "o_orderkey")


@query("select event_id, row_number() over (order by event_id) entry from events")
def enumerate_rows(spark, sf_dir):
    return numbered(spark, sf_dir, "events", "event_id").select("event_id", "entry")


@query(f"with {E} select (entry - 1) // 1000 chunk, min(entry) first, max(entry) last from e group by 1")
def row_chunks(spark, sf_dir):
    return clusters.row_chunks(numbered(spark, sf_dir, "events", "event_id"), 1000)


@query("select count(*) n from events")
def table_length(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"))


@query("select true same, false other")
def table_equality(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(entries.same_rows(n, n.orderBy("n_name")), entries.same_rows(n, n.where("n_nationkey > 1")))], "same boolean, other boolean")


# ---- aggregation ----


@query(f"with {O} select (entry - 1) // 1000 chunk, round(sum(o_totalprice), 2) total from o group by 1")
def chunk_sums(spark, sf_dir):
    o = numbered(spark, sf_dir, "orders", "o_orderkey")
    return o.groupBy(entries.chunk_of(1000).alias("chunk")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select round(sum(value), 4) total from events")
def sum_col(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.sum("value"), 4).alias("total"))


@query("select count(*) filter (value > 50) n from events")
def count_pred(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("value") > 50).alias("n"))


@query("select cast(sum(toxic = 1) as bigint) n_toxic, cast(sum(quality = 1) as bigint) n_good from labels")
def bool_sum(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("n_toxic"), F.sum((F.col("quality") == 1).cast("long")).alias("n_good"))


@query(f"with {E} select event_type, min(entry) first_entry from e group by 1")
def unique_first_seen(spark, sf_dir):
    return entries.first_seen(numbered(spark, sf_dir, "events", "event_id"), "event_type")


@query('select bool_and(value >= 0) every, bool_or(value > 99) "some" from events')
def all_any(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.bool_and(F.col("value") >= 0).alias("every"), F.bool_or(F.col("value") > 99).alias("some"))


@query("select event_type, count(*) n, round(min(value), 6) low, round(max(value), 6) high, round(avg(value), 6) mean, round(stddev_samp(value), 6) spread from events group by 1")
def basic_stats(spark, sf_dir):
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.min("value"), "low"), r(F.max("value"), "high"), r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "spread"))


@query("select sum(n) n from (select count(*) n from orders union all select count(*) from orders)")
def total_length(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return chain.chain([o, o]).agg(F.count("*").cast("decimal(38,0)").alias("n"))


# ---- chains, keys ----


@query("select *, 0 src from nation union all select *, 1 from nation where n_nationkey < 5")
def chain_two(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return chain.chain([n, n.where("n_nationkey < 5")])


@query(f"with {O} select entry, o_orderkey, 0 src from o union all select entry + (select count(*) from o), o_orderkey, 1 from o")
def chain_entry_order(spark, sf_dir):
    o = numbered(spark, sf_dir, "orders", "o_orderkey").select("entry", "o_orderkey")
    return chain.chain_entries([o, o]).select("entry", "o_orderkey", "src")


@query(f"with {O} select row_number() over (order by o_custkey, o_totalprice, entry - 1) - 1 place, o_custkey, o_totalprice, entry - 1 row0 from o")
def index_build(spark, sf_dir):
    return chain.build_index(numbered(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", "o_totalprice").select("place", "o_custkey", "o_totalprice", "row0")


@query(f"with {O}, k as (select o_custkey, min(o_orderkey) o_orderkey from orders group by 1) select entry, o_orderkey, o_custkey, o_totalprice from o where (o_custkey, o_orderkey) in (select o_custkey, o_orderkey from k)")
def index_lookup(spark, sf_dir):
    o = numbered(spark, sf_dir, "orders", "o_orderkey")
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return chain.look_up(o, chain.build_index(o, "o_custkey", "o_orderkey"), keys, "o_custkey", "o_orderkey").select("entry", "o_orderkey", "o_custkey", "o_totalprice")


@query(f"with {E}, {O} select entry, event_id, o_orderkey from e join o using (entry)")
def friend_join(spark, sf_dir):
    e = numbered(spark, sf_dir, "events", "event_id").select("entry", "event_id")
    o = numbered(spark, sf_dir, "orders", "o_orderkey").select("entry", "o_orderkey")
    return chain.friend_join(e, o)


@query("select r_regionkey, r_name from region where r_name = 'ASIA'")
def param_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    row = chain.only(r, "r_name", "ASIA")
    return spark.createDataFrame([row], r.schema)


@query("select distinct n_regionkey k from nation union select r_regionkey from region order by k")
def selector_sets(spark, sf_dir):
    """Union of two sets of boundaries."""
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).union(table(spark, sf_dir, "region").select("r_regionkey")).distinct()


# ---- jagged cells ----


def _ev(expr: str) -> str:
    return f"with {EV} {expr}"


@query(_ev("select orderkey, len(qty) n from ev"))
def jag_len(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.lengths("qty").alias("n"))


@query(_ev("select orderkey, cast(list_sum(qty) as double) total from ev"))
def jag_sum(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.total("qty").alias("total"))


@query(_ev("select orderkey, len(list_filter(qty, lambda x: x > 40)) n from ev"))
def jag_countif(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.count_if("qty", lambda x: x > 40).alias("n"))


@query(_ev("select orderkey, list_transform(qty, lambda x: x > 40) mask from ev"))
def jag_map(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.apply("qty", lambda x: x > 40).alias("mask"))


@query(_ev("select orderkey, list_filter(qty, lambda x: x > 40) large from ev"))
def jag_filter(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.keep("qty", lambda x: x > 40).alias("large"))


@query(_ev("select orderkey, len(list_filter(qty, lambda x: x > 45)) > 0 \"some\", len(list_filter(qty, lambda x: x > 5)) = len(qty) every, len(qty) > 0 filled from ev"))
def jag_any_all(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.any_of("qty", lambda x: x > 45).alias("some"), jagged.all_of("qty", lambda x: x > 5).alias("every"), (F.size("qty") > 0).alias("filled"))


@query(_ev("select orderkey, qty[1] first, qty[3] third from ev"))
def jag_elem(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.element("qty", 1).alias("first"), jagged.element_or_null("qty", 3).alias("third"))


@query("select vec_id, embedding[1:5] head from embeddings")
def jag_slice(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", jagged.part("embedding", 1, 5).alias("head"))


@query(_ev("select orderkey, cast(i - 1 as int) pos, qty[i] \"value\" from (select *, unnest(range(1, len(qty) + 1)) i from ev)"))
def jag_flatten(spark, sf_dir):
    return jagged.flat(event_items(spark, sf_dir), "qty", "orderkey")


@query(_ev("select cast(sum(len(qty)) as bigint) n from ev"))
def jag_total(spark, sf_dir):
    return event_items(spark, sf_dir).agg(F.sum(jagged.lengths("qty")).alias("n"))


@query(_ev("select orderkey, round(qty[i] * price[i], 4) amount from (select *, unnest(range(1, len(qty) + 1)) i from ev) where line[i] = 1"))
def jag_zip(spark, sf_dir):
    z = event_items(spark, sf_dir).select("orderkey", F.explode(jagged.zipped(q="qty", p="price", l="line")).alias("z")).where("z.l = 1")
    return z.select("orderkey", F.round(F.col("z.q") * F.col("z.p"), 4).alias("amount"))


@query(_ev("select orderkey, list_transform(range(1, len(qty) + 1), lambda i: qty[i] + line[i]) \"both\" from ev"))
def jag_zip_map(spark, sf_dir):
    return event_items(spark, sf_dir).select("orderkey", jagged.zip_map("qty", "line", lambda a, b: a + b).alias("both"))


@query(_ev(", f as (select orderkey, list_filter(qty, lambda x: x > 48) big from ev) select orderkey, cast(i - 1 as int) pos, big[i] \"value\" from (select *, unnest(range(1, len(big) + 1)) i from f) union all select orderkey, null, null from f where len(big) = 0"))
def jag_explode_outer(spark, sf_dir):
    f = event_items(spark, sf_dir).select("orderkey", jagged.keep("qty", lambda x: x > 48).alias("big"))
    return jagged.flat_outer(f, "big", "orderkey")


@query("select c_nationkey, len(list(c_custkey)) n from customer group by 1")
def jag_cardinality(spark, sf_dir):
    """The length of a collection as a column of its own."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.size(F.collect_list("c_custkey")).cast("long").alias("n"))


_NESTED = "c as (select l_orderkey, l_linenumber, list(l_quantity order by l_partkey, l_suppkey, l_quantity, l_extendedprice) q from lineitem group by 1, 2), g as (select l_orderkey, list(q order by l_linenumber) qq from c group by 1)"


@query(f"with {_NESTED} select l_orderkey, qq nested, len(qq) n, len(qq[1]) n_first, qq[1][1] first from g")
def jag_nested(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    by_line = li.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))["l_quantity"].alias("q"))
    g = by_line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q")))["q"].alias("nested"))
    return g.select("l_orderkey", "nested", jagged.lengths("nested").alias("n"), F.size(F.col("nested")[0]).cast("long").alias("n_first"), jagged.element(jagged.element("nested", 1), 1).alias("first"))


@query(f"with {EV}, n as (select orderkey, len(qty) n, orderkey // 1000 page from ev) select orderkey, page, n, cast(sum(n) over (partition by page order by orderkey) as bigint) \"offset\" from n")
def offsets_from_counts(spark, sf_dir):
    n = event_items(spark, sf_dir).select("orderkey", F.expr("orderkey div 1000").alias("page"), jagged.lengths("qty").alias("n"))
    back = jagged.counts(jagged.offsets(n, "n", "orderkey", partition_by=["page"]), "offset", "orderkey", partition_by=["page"])
    return back.where("count = n").select("orderkey", "page", "n", "offset")


@query(_ev("select orderkey, qty from ev"))
def regroup_flat(spark, sf_dir):
    flat = jagged.flat(event_items(spark, sf_dir), "qty", "orderkey")
    return jagged.regroup(flat, "orderkey", "pos", "value", "qty")


@query("select vec_id, list_transform(range(0, 16), lambda i: embedding[i * 4 + 1:i * 4 + 4]) blocks from embeddings")
def reshape_fixed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", jagged.fixed("embedding", 4).alias("blocks"))


# ---- histograms ----

QTY, PRICE, TAX = hist.Axis("l_quantity", 12, 0.0, 48.0), hist.Axis("l_extendedprice", edges=(0.0, 1000.0, 20000.0, 40000.0, 60000.0)), hist.Axis("l_tax", 4, 0.0, 0.08)
_IX = "case when l_quantity < 0 then 0 when l_quantity >= 48 then 13 else cast(floor(l_quantity / 48 * 12) as int) + 1 end"
_IY = "cast((l_extendedprice >= 0)::int + (l_extendedprice >= 1000)::int + (l_extendedprice >= 20000)::int + (l_extendedprice >= 40000)::int + (l_extendedprice >= 60000)::int as int)"
_WEIGHT = "(1 + l_linenumber % 3)"
H1 = f"h as (select {_IX} ix, count(*) entries, cast(sum({_WEIGHT}) as double) content, cast(sum({_WEIGHT} * {_WEIGHT}) as double) sumw2 from lineitem group by 1)"
H2 = f"h as (select {_IX} ix, {_IY} iy, count(*) entries, cast(sum({_WEIGHT}) as double) content, cast(sum({_WEIGHT} * {_WEIGHT}) as double) sumw2 from lineitem group by 1, 2)"


def weight():
    """A weight of 1 to 3 for each line item."""
    return F.lit(1) + F.col("l_linenumber") % 3


def _h1(spark, sf_dir):
    return hist.fill(table(spark, sf_dir, "lineitem"), [QTY], weight())


def _h2(spark, sf_dir):
    return hist.fill(table(spark, sf_dir, "lineitem"), [QTY, PRICE], weight())


@query(f"with {H1} select ix, entries, content, sumw2, cast((ix - 1) * 4 as double) x_low, cast(ix * 4 as double) x_high from h where ix between 1 and 12")
def hist1d_uniform(spark, sf_dir):
    return hist.with_edges(hist.inner(_h1(spark, sf_dir), [QTY]), [QTY])


@query(f"select {_IY} ix, count(*) entries, cast(sum({_WEIGHT}) as double) content, cast(sum({_WEIGHT} * {_WEIGHT}) as double) sumw2 from lineitem group by 1")
def hist1d_variable(spark, sf_dir):
    return hist.fill(table(spark, sf_dir, "lineitem"), [PRICE], weight())


@query(f"with {H1} select * from h where ix in (0, 13)")
def hist1d_flow(spark, sf_dir):
    return _h1(spark, sf_dir).where(F.col("ix").isin(0, 13))


@query(f"with {H2} select * from h where ix between 1 and 12 and iy between 1 and 4")
def hist2d(spark, sf_dir):
    return hist.inner(_h2(spark, sf_dir), [QTY, PRICE])


@query("select case when value < 0 then 0 when value >= 100 then 6 else cast(floor(value / 100 * 5) as int) + 1 end ix, case when user_id < 0 then 0 when user_id >= 100 then 5 else cast(floor(user_id / 100.0 * 4) as int) + 1 end iy, case when event_id < 0 then 0 when event_id >= 5000 then 3 else cast(floor(event_id / 5000.0 * 2) as int) + 1 end iz, count(*) entries, cast(count(*) as double) content, cast(count(*) as double) sumw2 from events group by 1, 2, 3")
def hist3d(spark, sf_dir):
    axes = [hist.Axis("value", 5, 0, 100), hist.Axis("user_id", 4, 0, 100), hist.Axis("event_id", 2, 0, 5000)]
    return hist.fill(table(spark, sf_dir, "events"), axes)


@query(f"select {_IX} ix, count(*) entries, cast(count(*) as double) content, cast(count(*) as double) sumw2 from lineitem group by 1")
def hist_unweighted(spark, sf_dir):
    bare = hist.fill(table(spark, sf_dir, "lineitem"), [QTY]).withColumn("sumw2", F.lit(None).cast("double"))
    return hist.unweighted(bare)


@query(f"select cast(sum({_WEIGHT}) as double) tsumw, cast(sum({_WEIGHT} * {_WEIGHT}) as double) tsumw2, cast(sum({_WEIGHT} * l_quantity) as double) tsumwx, cast(sum({_WEIGHT} * l_quantity * l_quantity) as double) tsumwx2 from lineitem where l_quantity >= 0 and l_quantity < 48")
def hist_moments(spark, sf_dir):
    return hist.moments(table(spark, sf_dir, "lineitem"), [QTY], weight())


@query(f"with {H2} select iy, cast(sum(entries) as bigint) entries, sum(content) content, sum(sumw2) sumw2 from h group by 1")
def hist_project(spark, sf_dir):
    return hist.project(_h2(spark, sf_dir), "iy")


@query(f"with {H1} select case when ix < 1 then 0 when ix > 12 then 5 else cast((ix - 1) // 3 + 1 as int) end ix, cast(sum(entries) as bigint) entries, sum(content) content, sum(sumw2) sumw2 from h group by 1")
def hist_rebin(spark, sf_dir):
    return hist.rebin(_h1(spark, sf_dir), 3, QTY)


@query(f"with {H1} select cast(sum(entries) as bigint) entries, sum(content) integral from h where ix between 1 and 12")
def hist_integral(spark, sf_dir):
    return hist.integral(_h1(spark, sf_dir), [QTY])


@query(f"with {H1} select ix, 2 * entries entries, 2 * content content, 2 * sumw2 sumw2 from h")
def hist_merge(spark, sf_dir):
    h = _h1(spark, sf_dir)
    return hist.merge(h, h)


# ---- chunks and clusters ----

_CHUNKS = f"{E}, c as (select 'type' name, (entry - 1) // 12 * 12 + 1 start, cast(sum(length(event_type)) as bigint) zip_bytes, 2.0 ratio from e group by 1, 2 union all select 'props', (entry - 1) // 18 * 18 + 1, cast(sum(length(props)) as bigint), 3.5 from e group by 1, 2)"
_RANGES = "b as (select start - 1 b from c where name = 'type' intersect select start - 1 from c where name = 'props' union select count(*) from e), r as (select b + 1 first, lead(b) over (order by b) last from b qualify last is not null)"


def _chunks(spark, sf_dir):
    e = numbered(spark, sf_dir, "events", "event_id")
    part = lambda name, size, text, ratio: e.groupBy(F.expr(f"(entry - 1) div {size} * {size} + 1").alias("start")).agg(F.sum(F.length(text)).alias("zip_bytes")).select(F.lit(name).alias("name"), "start", "zip_bytes", F.lit(ratio).alias("ratio"))
    ends = e.agg(F.max("entry").alias("boundary")).select(F.explode(F.array(F.lit("type"), F.lit("props"))).alias("name"), "boundary")
    c = part("type", 12, "event_type", 2.0).unionByName(part("props", 18, "props", 3.5))
    return c, c.select("name", (F.col("start") - 1).alias("boundary")).unionByName(ends)


@query(f"with {_CHUNKS}, {_RANGES} select first, last from r")
def cluster_ranges(spark, sf_dir):
    _, boundaries = _chunks(spark, sf_dir)
    return clusters.common_ranges(boundaries)


@query(f"with {_CHUNKS}, {_RANGES} select first range_first, cast(sum(zip_bytes) as bigint) zip_bytes, round(cast(sum(zip_bytes * ratio) as double), 3) raw_bytes from c join r on start between first and last group by 1")
def cluster_bytes(spark, sf_dir):
    c, boundaries = _chunks(spark, sf_dir)
    return clusters.range_bytes(c, clusters.common_ranges(boundaries))


# ---- stored columns ----


@query("select event_id, case when x >= 0 then 2 * x else -2 * x - 1 end z, x back from (select event_id, (event_id % 2001 - 1000) * 1000003 x from events)")
def zigzag(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 2001 - 1000) * 1000003).alias("x"))
    z = x.withColumn("z", codecs.zigzag(F.col("x")))
    return z.select("event_id", "z", codecs.unzigzag(F.col("z")).alias("back"))


@query("select event_id, event_id // 500 page, user_id - lag(user_id, 1, 0) over (partition by event_id // 500 order by event_id) d, user_id back from events")
def delta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("event_id div 500").alias("page"))
    d = codecs.delta(e, "user_id", "event_id", ["page"], "d")
    return codecs.undelta(d, "d", "event_id", ["page"], "back").select("event_id", "page", "d", "back")


@query("with p as (select event_id // 64 page, event_id % 64 place, user_id v from events), n as (select page, count(*) n from p group by 1) select page, j * n + place pos, cast((v >> cast(8 * j as int)) & 255 as int) byte from p join n using (page), range(4) r(j)")
def split4(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.expr("event_id div 64").alias("page"), F.expr("event_id % 64").alias("place"), F.col("user_id").alias("v"))
    n = p.groupBy("page").agg(F.count("*").alias("n"))
    return codecs.split_bytes(p.join(n, "page"), "v", 4, "place", "n", "page")


@query("select event_id, cast(round(value * 255.0 / 1000.0) as bigint) q, cast(0 + round(value * 255.0 / 1000.0) * 1000.0 / 255.0 as float) back from events")
def quant_float(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", codecs.quantized(F.col("value"), 8, 0.0, 1000.0).alias("q"))
    return e.select("event_id", "q", codecs.unquantized(F.col("q"), 8, 0.0, 1000.0).alias("back"))


@query("select event_id, user_id % 3 tag, event_id + 1 place from events")
def switch_split(spark, sf_dir):
    raw = F.format_string("%08x%016x", F.col("user_id") % 3, F.col("event_id"))
    tag, place = codecs.switch_parts(raw)
    return table(spark, sf_dir, "events").select("event_id", tag.alias("tag"), place.alias("place"))


@query("select vec_id, string_agg(printf('%02x', x), '' order by k) bits from (select vec_id, (i - 1) // 8 k, cast(sum(case when embedding[i] > 0 then 1 << cast((i - 1) % 8 as int) else 0 end) as int) x from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings) group by 1, 2) group by 1")
def pack_bools(spark, sf_dir):
    signs = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lower(F.hex(codecs.pack_bits(signs))).alias("bits"))


@query("select vec_id, list_transform(embedding, lambda x: x > 0) signs from embeddings")
def unpack_bools(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), codecs.pack_bits(F.transform("embedding", lambda x: x > 0)).alias("b"))
    return packed.select("vec_id", codecs.unpack_bits(F.col("b"), F.col("n")).alias("signs"))


@query("select event_id, case when event_type in ('click', 'view') then 1 else 2 end tag, case when event_type in ('click', 'view') then user_id end _0, case when event_type not in ('click', 'view') then event_type end _1 from events")
def variant_struct(spark, sf_dir):
    tag = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2)
    v = table(spark, sf_dir, "events").select("event_id", structs.variant(tag, {"_0": F.col("user_id"), "_1": F.col("event_type")}).alias("v"))
    return v.select("event_id", "v.*")


# ---- user-defined structures ----

_V = "v as (select vec_id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, abs(embedding[4])::double + 3 t from embeddings)"


@query(f"with {_V} select vec_id, round(sqrt(x * x + y * y), 6) pt, round(sign(t * t - x * x - y * y - z * z) * sqrt(abs(t * t - x * x - y * y - z * z)), 6) mass from v")
def custom_struct(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    v = table(spark, sf_dir, "embeddings").select("vec_id", structs.four_vector(e(0), e(1), e(2), F.abs(e(3)) + 3).alias("p"))
    return v.select("vec_id", F.round(structs.transverse("p"), 6).alias("pt"), F.round(structs.mass("p"), 6).alias("mass"))


@query("select event_id, cast(user_id as int) a, cast(event_id % 7 as short) b from events union all select event_id, cast(user_id + 1 as int), cast(3 as short) from events where event_id % 2 = 0")
def splitup_udf(spark, sf_dir):
    """One or two records of six bytes in each cell, after two bytes that are skipped."""
    record = structs.Record("pair", (("a", "i4"), ("b", "i2")), skip=2)
    second = F.when(F.col("event_id") % 2 == 0, F.format_string("%08x0003", F.col("user_id") + 1)).otherwise(F.lit(""))
    raw = F.unhex(F.concat(F.lit("ffff"), F.format_string("%08x%04x", F.col("user_id"), F.col("event_id") % 7), second))
    e = table(spark, sf_dir, "events").select("event_id", F.explode(structs.split_records(raw, record)).alias("r"))
    return e.select("event_id", "r.a", "r.b")


@query("with k as (select vec_id, embedding[1:6] p from embeddings), m as (select vec_id, [[p[1], p[2], p[3]], [p[2], p[4], p[5]], [p[3], p[5], p[6]]] m from k) select vec_id, cast(i - 1 as int) i, cast(j - 1 as int) j, m[i][j] v from m, range(1, 4) a(i), range(1, 4) b(j)")
def sym_matrix(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select("vec_id", structs.symmetric("embedding", 3).alias("m"))
    rows = m.select("vec_id", F.posexplode("m").alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "v"))
