"""Report queries: aggregates, rankings, label look-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wayfold.functions import scalars as S
from wayfold.operators import joins, relations as R
from wayfold.plans.registry import query


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("a1_counts", "select l_returnflag as flag, l_linestatus as status, count(*) as n from lineitem group by all")
def a1(spark, sf_dir):
    return R.load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


_A2 = f"""with {R.SEGMENTS}, v as (select g.trip, g.i % 4 as seg, s.kind, db - da as span, tb - ta as dt, (db - da) * 1000000 / (tb - ta) as v, g.i from segments g join stops s on g.trip = s.trip and g.i = s.i where tb > ta),
r as (select *, row_number() over (partition by kind, seg order by v desc, trip, i) as rn from v)
select kind, seg, trip, span, dt, round(v, 3) as v from r where rn = 1"""


@query("a2_fastest_segment", _A2)
def a2(spark, sf_dir):
    """The fastest trip of each kind and place, the first on a tie; a maximum of a struct, pre-aggregated."""
    st = R.stops(spark, sf_dir)
    seg = R.segments(st.select("trip", "i", "us", "d")).where("tb > ta").join(st.select("trip", "i", "kind"), ["trip", "i"])
    v = (F.col("db") - F.col("da")) * 1_000_000 / (F.col("tb") - F.col("ta"))
    best = F.max(F.struct(v.alias("v"), (-F.col("trip")).alias("t"), (-F.col("i")).alias("j"), (F.col("db") - F.col("da")).alias("span"), (F.col("tb") - F.col("ta")).alias("dt")))
    out = seg.groupBy("kind", (F.col("i") % 4).alias("seg")).agg(best.alias("m"))
    return out.select("kind", "seg", (-F.col("m.t")).alias("trip"), "m.span", "m.dt", F.round("m.v", 3).alias("v"))


@query("a3_label_sets", "select p_brand as label, string_agg(distinct p_type, ',' order by p_type) as types from part group by p_brand")
def a3(spark, sf_dir):
    return R.load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("a5_quantiles", "select event_type, round(median(value), 4) as med, round(quantile_cont(value, 0.9), 4) as p90, max(value) as mx from events group by 1")
def a5(spark, sf_dir):
    return R.load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 4).alias("med"), F.round(F.expr("percentile(value, 0.9)"), 4).alias("p90"), F.max("value").alias("mx"))


_A6 = "with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events) select event_type, " + ", ".join(f"cast(max(value) filter (k = least(n - 1, floor(n * {p})::bigint) + 1) as double) as p{int(p * 100)}" for p in (0.5, 0.95)) + " from r group by 1"


@query("a6_nearest_rank", _A6)
def a6(spark, sf_dir):
    """sorted[min(n - 1, floor(n p))]: ranks by a window over the type, so no array is made."""
    w = Window.partitionBy("event_type")
    r = R.load(spark, sf_dir, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)) + 1, F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("a7_worst_at", "with r as (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) select user_id, value, event_id from r where rn = 1")
def a7(spark, sf_dir):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e")))
    return R.load(spark, sf_dir, "events").groupBy("user_id").agg(best.alias("m")).select("user_id", "m.value", (-F.col("m.e")).alias("event_id"))


_A8 = """with t as (select user_id, event_type, count(*) as trips, cast(sum(cast(round(value*100) as bigint)) as bigint) as drift, max(cast(round(value*100) as bigint)) as mx, min(event_id) as shape from events group by all)
select user_id, cast(sum(trips) as bigint) as trips, max(struct_pack(d := drift, s := -shape)).d as drift, -(max(struct_pack(d := drift, s := -shape)).s) as shape, max(mx) as mx, -(max(struct_pack(m := mx, s := -shape)).s) as worst from t group by 1"""


@query("a8_mixed_rollup", _A8)
def a8(spark, sf_dir):
    """Two different rows of a group in one pass: the one with the most drift, and the one with the largest maximum."""
    t = R.load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("trips"), F.sum(cents("value")).alias("drift"), F.max(cents("value")).alias("mx"), F.min("event_id").alias("shape"))
    out = t.groupBy("user_id").agg(F.sum("trips").alias("trips"), F.max(F.struct("drift", (-F.col("shape")).alias("s"))).alias("a"), F.max(F.struct("mx", (-F.col("shape")).alias("s"))).alias("b"))
    return out.select("user_id", "trips", "a.drift", (-F.col("a.s")).alias("shape"), "b.mx", (-F.col("b.s")).alias("worst"))


@query("a9_best_and_sum", "with t as (select o_custkey as c, o_orderpriority as p, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) as score, count(*) as kinks from orders group by all) select c, arg_max(p, struct_pack(s := score, p := p)) as best, max(score) as score, cast(sum(kinks) as bigint) as kinks from t group by c")
def a9(spark, sf_dir):
    t = R.load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")).agg(F.sum(cents("o_totalprice")).alias("score"), F.count("*").alias("kinks"))
    return t.groupBy("c").agg(F.max(F.struct("score", "p")).alias("m"), F.sum("kinks").alias("kinks")).select("c", F.col("m.p").alias("best"), "m.score", "kinks")


@query("a10_first_per_key", "with r as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) select o_custkey, o_orderkey, o_orderpriority from r where rn = 1")
def a10(spark, sf_dir):
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))
    return R.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(first.alias("m")).select("o_custkey", "m.o_orderkey", "m.o_orderpriority")


@query("a10_grid_dedupe", "with r as (select event_id, row_number() over (partition by user_id, round_even(value / 20, 0) order by value desc, event_id) as rn from events) select event_id from r where rn = 1")
def a10b(spark, sf_dir):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e")))
    return R.load(spark, sf_dir, "events").groupBy("user_id", F.rint(F.col("value") / 20).alias("g")).agg(best.alias("m")).select((-F.col("m.e")).alias("event_id"))


@query("a13_cover_ratio", "select user_id, round(count(*) filter (value < 60) / greatest(count(*), 1), 5) as cover, round(100 * count(*) filter (value > 80) / greatest(count(*), 1), 3) as off from events group by 1")
def a13(spark, sf_dir):
    share = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    return R.load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(share(F.col("value") < 60), 5).alias("cover"), F.round(100 * F.count_if(F.col("value") > 80) / F.greatest(F.count("*"), F.lit(1)), 3).alias("off"))


@query("a15_phase_means", "select event_type, round(avg(value), 4) as mean, max(value) as mx, round(cast(sum(greatest(0, cast(round(value * 100) as bigint) - 5000)) as bigint) / 100.0, 2) as over from events group by 1")
def a15(spark, sf_dir):
    return R.load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("mx"), F.round(F.sum(F.greatest(F.lit(0), cents("value") - 5000)) / 100, 2).alias("over"))


@query("a16_component_median", "select p_brand, median(p_size) as size, round(median(p_retailprice), 2) as price from part group by 1")
def a16(spark, sf_dir):
    return R.load(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_size").alias("size"), F.round(F.median("p_retailprice"), 2).alias("price"))


@query("a17_breakpoints", "select p_type, round(median(p_retailprice), 3) as coordinate, median(p_size) as pixel, count(*) as n from part group by 1 having count(*) >= 3")
def a17(spark, sf_dir):
    return R.load(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.median("p_retailprice"), 3).alias("coordinate"), F.median("p_size").alias("pixel"), F.count("*").alias("n")).where("n >= 3")


@query("a20_fixture_hits", "select p_brand, count(*) filter (p_size <= 10) as hits, count(*) filter (p_size <= 10) >= 5 as passed from part group by 1")
def a20(spark, sf_dir):
    return R.load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 10).alias("hits")).withColumn("passed", F.col("hits") >= 5)


@query("a22_memory_sum", "select p_brand, cast(sum(cast(p_size as bigint) * p_size * 4) as bigint) as bytes, round(cast(sum(cast(p_size as bigint) * p_size * 4) as bigint) / 1048576, 5) as mb from part group by 1")
def a22(spark, sf_dir):
    size = F.sum(F.col("p_size").cast("long") * F.col("p_size") * 4)
    return R.load(spark, sf_dir, "part").groupBy("p_brand").agg(size.alias("bytes")).withColumn("mb", F.round(F.col("bytes") / 1048576, 5))


@query("o2_find_line", """with p as (select p_partkey, p_name, p_size as sy, regexp_replace(upper(p_name), '[\\s\\-]+', '', 'g') as norm from part),
r as (select *, case when norm = 'REDB' then 0 when starts_with(norm, 'REDB') then 1 end as rank from p), s as (select *, row_number() over (order by rank, sy, length(norm), norm, p_partkey) as pos from r where rank is not null)
select pos, p_partkey, rank from s where pos <= 12""")
def o2(spark, sf_dir):
    """Labels that equal or begin with what was typed: twelve rows by rank, system, length, label."""
    norm = S.norm_line(F.col("p_name"))
    rank = F.when(norm == "REDB", 0).when(F.startswith(norm, F.lit("REDB")), 1)
    top = R.load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("sy"), norm.alias("norm"), rank.alias("rank")).where("rank is not null").orderBy("rank", "sy", F.length("norm"), "norm", "p_partkey").limit(12)
    pos = F.row_number().over(Window.orderBy("rank", "sy", F.length("norm"), "norm", "p_partkey")).cast("long")
    return top.select(pos.alias("pos"), "p_partkey", "rank")


@query("o3_topn", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def o3(spark, sf_dir):
    return R.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("o5_top_variants", "with n as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_partkey) as rank from n) select l_suppkey, l_partkey, n, rank from r where rank <= 8")
def o5(spark, sf_dir):
    n = R.load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")).cast("long")
    return n.withColumn("rank", rank).where("rank <= 8")


@query("o7_worst_runs", "with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank from events) select user_id, rank, event_id from r where rank <= 5")
def o7(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    return R.load(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank")).where("rank <= 5")


_WORDS = "words as (select distinct lower(w) as w from (select unnest(string_split(p_name, ' ')) as w from part where p_partkey % 3 = 0))"


def printed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.load(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.lower("w").alias("w")).distinct()


@query("j6_unprinted", f"with {_WORDS} select p_partkey, p_type as label from part where lower(p_type) not in (select w from words)")
def j6(spark, sf_dir):
    p = R.load(spark, sf_dir, "part")
    return p.join(joins.broadcast_if_small(printed_words(spark, sf_dir)), F.lower("p_type") == F.col("w"), "left_anti").select("p_partkey", F.col("p_type").alias("label"))


@query("j7_mislabelled", f"with {_WORDS}, t as (select p_partkey, unnest(string_split(replace(replace(p_name, '/', ' '), '-', ' '), ' ')) as tok from part) select p_partkey, string_agg(distinct lower(tok), ',' order by lower(tok)) as alts from t where lower(tok) in (select w from words) group by 1")
def j7(spark, sf_dir):
    t = R.load(spark, sf_dir, "part").select("p_partkey", F.explode(S.label_tokens(F.col("p_name"))).alias("tok")).select("p_partkey", F.lower("tok").alias("tok"))
    near = t.join(joins.broadcast_if_small(printed_words(spark, sf_dir)), F.col("tok") == F.col("w"), "left_semi")
    return near.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("tok")), ",").alias("alts"))


_J8 = "with n as (select p_partkey as b, string_split(p_name, ' ') as words from part), s as (select a, w from (values (1, ['small']), (2, ['red', 'widget']), (3, ['bolt', 'blue']), (4, ['ring'])) as v(a, w)) select a, b from s join n on list_has_all(words, w)"


@query("j8_token_containment", _J8)
def j8(spark, sf_dir):
    """Parts whose words hold all words of a set: an inverted list of words, then a count of the words found."""
    sets = spark.createDataFrame([(1, ["small"]), (2, ["red", "widget"]), (3, ["bolt", "blue"]), (4, ["ring"])], "a int, w array<string>")
    need = sets.select("a", F.size("w").alias("n"), F.explode("w").alias("word"))
    have = R.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return have.join(F.broadcast(need), "word").groupBy("a", "b", "n").agg(F.count("*").alias("k")).where("k = n").select("a", "b")


@query("j9_default_label", "with n as (select o_custkey, count(*) as n from orders where o_orderpriority = '2-HIGH' group by 1) select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, ''), c_name) as label, coalesce(n, 0) as n from customer left join n on c_custkey = o_custkey")
def j9(spark, sf_dir):
    n = R.load(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    label = F.coalesce(F.nullif(F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit("")), F.col("c_name"))
    c = R.load(spark, sf_dir, "customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


@query("j12_join_by_name", "with old as (select r_name, r_regionkey % 2 = 0 as flag from region where r_regionkey < 4) select r.r_regionkey as sy, r.r_name, coalesce(flag, true) as flag from region r left join old on r.r_name = old.r_name")
def j12(spark, sf_dir):
    r = R.load(spark, sf_dir, "region")
    old = r.where("r_regionkey < 4").select("r_name", (F.col("r_regionkey") % 2 == 0).alias("flag"))
    return r.join(old, "r_name", "left").select(F.col("r_regionkey").alias("sy"), "r_name", F.coalesce("flag", F.lit(True)).alias("flag"))


_J15 = f"with {R.STOPS}, r(run, u0, u1) as (values (0, 100, 300), (1, 250, 500), (2, 700, 900)), p as (select event_id, us // 86400000 as u from stops) select event_id, min(run) as run from p left join r on u between u0 and u1 group by event_id"


@query("j15_run_lookup", _J15)
def j15(spark, sf_dir):
    """The first of a pattern's few ranges that holds a fraction: an array look-up, no join."""
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(a).alias("u0"), F.lit(b).alias("u1")) for r, a, b in ((0, 100, 300), (1, 250, 500), (2, 700, 900))])
    u = F.floor(R.micros_of_day() / 86_400_000)
    e = R.load(spark, sf_dir, "events").select("event_id", u.alias("u"))
    return e.select("event_id", F.get(F.filter(runs, lambda r: F.col("u").between(r["u0"], r["u1"])), F.lit(0))["run"].alias("run"))


@query("p8_combined_selection", "select p_partkey, p_name from part where contains(lower(p_name), 'red') and p_brand in ('Brand#1', 'Brand#2', 'Brand#3') and p_size >= 5")
def p8(spark, sf_dir):
    p = R.load(spark, sf_dir, "part")
    return p.where(F.contains(F.lower("p_name"), F.lit("red")) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("p_size") >= 5)).select("p_partkey", "p_name")


@query("p9_thresholds", f"with {R.SEGMENTS} select trip, i from segments where tb - ta >= 60000000 and (db - da) * 1000000 < 5 * (tb - ta)")
def p9(spark, sf_dir):
    return R.segments(R.stops(spark, sf_dir)).where("tb - ta >= 60000000 and (db - da) * 1000000 < 5 * (tb - ta)").select("trip", "i")


@query("p11_first_prefix", "select min(p_partkey) as p_partkey from part where starts_with(lower(p_name), 'blue')")
def p11(spark, sf_dir):
    return R.load(spark, sf_dir, "part").where(F.startswith(F.lower("p_name"), F.lit("blue"))).agg(F.min("p_partkey").alias("p_partkey"))


@query("p14_ambiguous", "select p_name as label, count(distinct p_brand) as systems from part group by 1 having count(distinct p_brand) > 1")
def p14(spark, sf_dir):
    return R.load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.countDistinct("p_brand").alias("systems")).where("systems > 1")


@query("f4_norm_line", "select p_partkey, regexp_replace(upper(p_name || '-' || p_type), '[\\s\\-]+', '', 'g') as norm from part")
def f4(spark, sf_dir):
    return R.load(spark, sf_dir, "part").select("p_partkey", S.norm_line(F.concat_ws("-", "p_name", "p_type")).alias("norm"))


@query("f5_tokens", "select p_partkey, array_to_string(list_distinct_sorted, ',') as tokens from (select p_partkey, list_sort(list_distinct(regexp_extract_all(upper(p_name || '/' || p_brand), '[A-Z0-9]+'))) as list_distinct_sorted from part)")
def f5(spark, sf_dir):
    return R.load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(S.word_tokens(F.concat_ws("/", "p_name", "p_brand"))), ",").alias("tokens"))


@query("f6_slug", "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('#' || p_brand || ' ' || p_name), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'), '-+', '-', 'g') as slug from part")
def f6(spark, sf_dir):
    return R.load(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat(F.lit("#"), "p_brand", F.lit(" "), "p_name")).alias("slug"))


@query("f9_safe_ratio", "select event_id, case when value - 5 <= 1e-9 then 'inf'::double else round(100 / (value - 5), 5) end as ratio, least(greatest(value, 10), 200) as held from events where true")
def f9(spark, sf_dir):
    e = R.load(spark, sf_dir, "events")
    return e.select("event_id", S.round_scaled(S.safe_ratio(F.lit(100), F.col("value") - 5), 5).alias("ratio"), S.clamp(F.col("value"), 10, 200).alias("held"))


@query("f17_digest", "select p_partkey, left(sha256(p_name || '|' || p_brand), 10) as digest from part")
def f17(spark, sf_dir):
    return R.load(spark, sf_dir, "part").select("p_partkey", F.left(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), F.lit(10)).alias("digest"))


@query("f18_json", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def f18(spark, sf_dir):
    return R.load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f23_getters", "select event_id, coalesce(try_cast(json_extract_string(d, '$.k') as bigint), -1) as k, coalesce(try_cast(json_extract_string(d, '$.rate') as double), 1.5) as rate from (select event_id, case when event_id % 3 = 0 then '{}' when event_id % 3 = 1 then props else '{\"k\": \"?\", \"rate\": 2}' end as d from events)")
def f23(spark, sf_dir):
    """Typed values with defaults, of documents that lack some or hold others."""
    doc = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, F.col("props")).otherwise('{"k": "?", "rate": 2}')
    return R.load(spark, sf_dir, "events").select("event_id", S.getter(doc, "$.k", "bigint", -1).alias("k"), S.getter(doc, "$.rate", "double", 1.5).alias("rate"))


@query("f22_flags", "select event_id, case when value > 400 then 'off-map' when user_id % 7 = 0 then 'downtown' when event_type = 'error' then 'terminus' when value < 5 then 'stalled' when value / 100 > 1.6 then 'detour' else 'direct' end as flag from events")
def f22(spark, sf_dir):
    v = F.col("value")
    return R.load(spark, sf_dir, "events").select("event_id", S.speed_flag(v > 400, F.col("user_id") % 7 == 0, F.col("event_type") == "error", v, v / 100).alias("flag"))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def piles(dist: pd.Series) -> pd.Series:
    """For each stop of a trip: how many stops stand within one unit of it in a row, and whether at an end (0, 2) or not (1)."""
    out = []
    for d in dist:
        d, n = np.asarray(d), len(d)
        rows = []
        for i in range(n - 1):
            far = np.abs(d - d[i]) > 1
            before, behind = np.flatnonzero(far[:i]), np.flatnonzero(far[i + 2 :])
            a = int(before[-1]) + 1 if len(before) else 0
            b = i + 1 + int(behind[0]) if len(behind) else n - 1
            rows.append([b - a + 1, 0 if a == 0 else 2 if b == n - 1 else 1])
        out.append(rows)
    return pd.Series(out)


_W6B = f"""with {R.STOPS}, d as (select trip, i, d // 4000 as d, max(i) over (partition by trip) as last from stops),
p as (select x.trip, x.i, x.last, coalesce((select max(y.i) + 1 from d y where y.trip = x.trip and y.i < x.i and abs(y.d - x.d) > 1), 0) as a,
  coalesce((select min(y.i) - 1 from d y where y.trip = x.trip and y.i > x.i + 1 and abs(y.d - x.d) > 1), x.last) as b from d x where x.i < x.last)
select trip, i, b - a + 1 as pile, cast(case when a = 0 then 0 when b = last then 2 else 1 end as integer) as place from p"""


@query("w6b_pile", _W6B)
def w6b(spark, sf_dir):
    """Stops that stand at the place of one stop; each is measured against that stop, so piles do not chain."""
    st = R.stops(spark, sf_dir).select("trip", F.struct("i", F.floor(F.col("d") / 4000).cast("double").alias("d")).alias("r"))
    s = st.groupBy("trip").agg(F.array_sort(F.collect_list("r")).alias("r")).select("trip", F.posexplode(piles(F.col("r.d"))).alias("i", "p"))
    return s.select("trip", F.col("i").cast("long").alias("i"), F.get("p", F.lit(0)).cast("long").alias("pile"), F.get("p", F.lit(1)).alias("place"))


@query("w11_rank", "select n_nationkey, row_number() over (order by n_name desc) as rank from nation")
def w11(spark, sf_dir):
    return R.load(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n_name"))).cast("long").alias("rank"))
