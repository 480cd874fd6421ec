"""Queries on the life of a schedule: validation, merging, subsets, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import relations as R
from wayfold.operators import schedule as K
from wayfold.plans.registry import query


def derived(spark, sf_dir) -> K.Schedule:
    """A schedule with known faults, made from the star tables."""
    part, orders = R.load(spark, sf_dir, "part"), R.load(spark, sf_dir, "orders")
    i = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    d = F.when(F.col("i") == 0, 0.0).when(F.col("i") == 1, F.col("p_size") * 40.0).otherwise(F.col("p_retailprice"))
    stops = part.select(F.col("p_partkey").alias("p"), i, "p_size", "p_retailprice").select("p", "i", d.alias("d"))
    trips = orders.select(F.col("o_orderkey").alias("trip"), (F.col("o_custkey") % 27).cast("int").alias("r"), (F.col("o_orderkey") % 2100).alias("p"), (F.col("o_orderkey") % 130).alias("days"))
    j = F.explode(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 50 == 0, 3).otherwise(2))).alias("i")
    t = F.when((F.col("i") == 2) & (F.col("trip") % 77 == 0), -1.0).otherwise(F.col("i") * 60.0)
    times = orders.select(F.col("o_orderkey").alias("trip"), j).select("trip", "i", t.alias("t"))
    return K.Schedule(
        systems=R.load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sy")).where("sy < 4"),
        routes=R.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r"), F.col("n_regionkey").alias("sy")),
        shapes=R.shape_points(spark, sf_dir), patterns=part.select(F.col("p_partkey").alias("p"), (F.col("p_partkey") % 600).alias("s")),
        pattern_stops=stops, trips=trips, stop_times=times,
    )


_V = f"""with {R.POINTS},
len as (select s, sum(l) as length from (select s, coalesce(sqrt(cast((x - lag(x) over w)**2 + (y - lag(y) over w)**2 as double)), 0) as l from points window w as (partition by s order by k)) group by s),
pat as (select p_partkey as p, p_partkey % 600 as s, p_size * 40.0 as d1, p_retailprice as d2 from part),
pl as (select pat.*, length from pat left join len on pat.s = len.s),
tr as (select o_orderkey as trip, o_custkey % 27 as r, o_orderkey % 2100 as p, o_orderkey % 130 as days from orders),
v as (select 'V6' as rule, 'system' as detail, n_nationkey as idx from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 4)
 union all select 'V7', 'shape', p from pl where length is null
 union all select 'V7', 'outside shape', p from pl where greatest(d1, d2) > length + 1
 union all select 'V7', 'backward', p from pl where d1 > d2
 union all select 'V10', 'route', trip from tr where r not in (select n_nationkey from nation)
 union all select 'V10', 'pattern', trip from tr where p not in (select p from pat)
 union all select 'V10', 'stop count', trip from tr where p in (select p from pat) and trip % 50 = 0
 union all select 'V10', 'backward times', trip from tr where trip % 77 = 0
 union all select 'V10', 'days', trip from tr where days <= 0 or days >= 128)
select rule, detail, count(*) as n, cast(sum(idx) as bigint) as ids from v group by all"""


@query("v_all_rules", _V)
def v_all(spark, sf_dir):
    return K.violations(derived(spark, sf_dir)).groupBy("rule", "detail").agg(F.count("*").alias("n"), F.sum("idx").alias("ids"))


_U3 = """with s as (select c_custkey as s, c_nationkey % 5 as feed, c_acctbal > 3000 as native from customer),
n as (select *, row_number() over (order by not native, feed, s) - 1 as new_s from s)
select feed, s, new_s from n"""


@query("u3_merge_rebase", _U3)
def u3(spark, sf_dir):
    c = R.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), (F.col("c_nationkey") % 5).alias("feed"), (F.col("c_acctbal") > 3000).alias("native"))
    p = c.select("feed", F.col("s").alias("p"), "s")
    s, _, _ = K.merge_feeds(c, p, p.select("feed", F.col("p").alias("trip"), "p"))
    return s.select("feed", "s", "new_s")


@query("u3_merge_references", """with s as (select c_custkey as s, c_nationkey % 5 as feed, c_acctbal > 3000 as native from customer),
n as (select *, row_number() over (order by not native, feed, s) - 1 as new_s, row_number() over (order by feed, s) - 1 as new_p from s) select new_p, new_s from n""")
def u3b(spark, sf_dir):
    c = R.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), (F.col("c_nationkey") % 5).alias("feed"), (F.col("c_acctbal") > 3000).alias("native"))
    p = c.select("feed", F.col("s").alias("p"), "s")
    return K.merge_feeds(c, p, p.select("feed", F.col("p").alias("trip"), "p"))[1].select("new_p", "new_s")


@query("u4_subset", "with t as (select o_orderkey as trip, c_nationkey as r, o_orderkey % 2000 as p from orders join customer on o_custkey = c_custkey) select p, count(*) as trips from t where r in (select n_nationkey from nation where n_regionkey = 1) group by p")
def u4(spark, sf_dir):
    nation = R.load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "r")
    o, c = R.load(spark, sf_dir, "orders"), R.load(spark, sf_dir, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("trip"), F.col("c_nationkey").alias("r"), (F.col("o_orderkey") % 2000).alias("p"))
    _, p, t = K.subset(nation, R.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")), t, F.col("n_regionkey") == 1)
    return p.join(t.groupBy("p").agg(F.count("*").alias("trips")), "p")


_VERSIONS = """with a as (select o_custkey, o_orderpriority, arg_max(cast(round(o_totalprice*100) as bigint), o_orderkey) as v from orders where o_orderkey % 2 = 0 group by all),
b as (select o_custkey, o_orderpriority, arg_max(case when o_orderkey % 3 = 0 then cast(round(o_totalprice*100) as bigint) + 1 else cast(round(o_totalprice*100) as bigint) end, o_orderkey) as v from orders where o_orderkey % 4 <> 1 group by all)
select a.o_custkey, a.o_orderpriority, a.v is distinct from b.v as changed from a join b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority"""


def _versions(spark, sf_dir):
    o = R.load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    after = o.where("i % 4 <> 1").withColumn("v", F.when(F.col("i") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return K.changed_keys(o.where("i % 2 = 0"), after, ["o_custkey", "o_orderpriority"], lambda d: F.col("v"))


@query("j10_two_versions", _VERSIONS)
def j10(spark, sf_dir):
    return _versions(spark, sf_dir)


@query("u6_changed_only", _VERSIONS.replace("select a.o_custkey, a.o_orderpriority, a.v is distinct from b.v as changed", "select a.o_custkey, a.o_orderpriority") + " where a.v is distinct from b.v")
def u6(spark, sf_dir):
    return _versions(spark, sf_dir).where("changed").select("o_custkey", "o_orderpriority")


@query("s1_decimated_points", "with p as (select s, k, x, y from (select vec_id as s, k, round(cast(embedding[2*k+1] as double), 2) as x, round(cast(embedding[2*k+2] as double), 2) as y from embeddings, unnest(range(0, 32)) as r(k))) select distinct s % 50 as route, x, y from p where k % 4 = 0")
def s1(spark, sf_dir):
    """Every fourth point of each shape, rounded, once for each route."""
    flat = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y")))
    p = R.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.posexplode(flat).alias("k", "p")).where("k % 4 = 0")
    return p.select((F.col("s") % 50).alias("route"), F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y")).distinct()
