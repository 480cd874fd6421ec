"""Near-duplicate vectors by a pivot-permutation index: inverted lists of nearest reference points, shared-pivot counts, exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import components, cut

#: Vectors of a tile, of which two meet in a task; longer lists are dealt in several.
TILE = 6000
MOST_PIVOTS = 1 << 15
#: Length of a permutation, and how many pivots of two permutations must be the same for a check.
NEAREST, SHARED = 12, 2


def _usable(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array | list, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.float64).reshape(-1, dims)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _own(vectors: DataFrame) -> DataFrame:
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).withColumn("usable", _usable("embedding") & F.col("vec_id").isNotNull())


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (vec_id, class), classes (class, least, size, dims, vector binary)): equal usable vectors are one class.

    Classes are told by two 64-bit hashes of the components (minus zero as zero) and numbered; least is the least vec_id.
    """
    usable = _own(vectors).where("usable").withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(11), "embedding")})
    sizes = usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    sizes = cut(sizes.withColumn("class", F.monotonically_increasing_id()), "classes")
    named = usable.join(sizes, ["k1", "k2"])

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            off, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            data = [flat[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "least", "size")), pa.array(np.diff(off).astype(np.int32)), pa.array(data, pa.binary())], names=["class", "least", "size", "dims", "vector"])

    first = named.where("vec_id = least").select("class", "least", "size", "embedding").mapInArrow(binary, "class long, least long, size long, dims int, vector binary")
    return named.select("vec_id", "class"), first.dropDuplicates(["class"])


def _thin(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of x, in order, of which no two have that cosine."""
    kept = np.empty((0, x.shape[1]))
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        part = part[(part @ kept.T < threshold).all(axis=1)] if len(kept) else part
        near, own = part @ part.T >= threshold, np.zeros(len(part), bool)
        for i in range(len(part)):
            own[i] = not (near[i, :i] & own[:i]).any()
        kept = np.concatenate([kept, part[own]])
    return kept


def _nearest(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The places of the nearest pivots of each row, the nearest first."""
    s = x @ pivots.T
    k = min(nearest, len(pivots))
    some = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable"), 1).astype(np.int32)


def choose_pivots(classes: DataFrame, count: int, threshold: float, *, nearest: int = NEAREST, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Reference points for each number of dimensions, from 4 * sqrt(count) vectors (`most` at most) by a hash of their ids.

    Of two that would link only the first is kept, so a dense group has few of its own. Those that are near to most of the
    chosen vectors come first: the longest lists are met first, and later ones leave out what was met there.
    """
    take = max(16, min(most, math.isqrt(16 * max(count, 1))))
    rows = classes.orderBy(F.xxhash64("class"), "class").limit(take).select("dims", "vector").toArrow()
    by: dict[int, list[bytes]] = {}
    for d, v in zip(rows.column("dims").to_pylist(), rows.column("vector").to_pylist()):
        by.setdefault(d, []).append(v)
    out = {}
    for d, v in by.items():
        x = unit_rows(v, d)
        kept = _thin(x, threshold)
        held = np.zeros(len(kept), np.int64)
        for at in range(0, len(x), 1000):
            held += np.bincount(_nearest(x[at : at + 1000], kept, nearest).ravel(), minlength=len(kept))
        out[d] = kept[np.argsort(-held, kind="stable")]
    return out


def place_vectors(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """(class, size, dims, near array<int>, vector binary): unit vectors and their permutation, the nearest pivots in order.

    Where no pivot has as many dimensions, all vectors of that many have the one list 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims = batch.column("dims").to_numpy()
                for d in np.unique(dims):
                    own = batch.filter(pa.array(dims == d))
                    x = unit_rows(own.column("vector").to_pylist(), int(d))
                    near = _nearest(x, pivots[d], nearest) if d in pivots else np.zeros((len(x), 1), np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("class", "size", "dims")), lists, pa.array([r.tobytes() for r in x], pa.binary())], names=["class", "size", "dims", "near", "vector"])

    return classes.mapInArrow(run, "class long, size long, dims int, near array<int>, vector binary")


def post_vectors(placed: DataFrame, shared: int = SHARED) -> DataFrame:
    """(dims, pivot, first, class, size, lists, vector): one row for each inverted list that a vector is in.

    lists are a vector's pivots by number and first the least of them. A pair is met in the list of the least pivot that it
    shares; as it shares `shared` pivots, nobody needs its last `shared` - 1 lists.
    """
    own = placed.select("dims", "class", "size", F.array_sort("near").alias("lists"), "vector").withColumn("first", F.element_at("lists", 1))
    return own.withColumn("pivot", F.explode(F.slice("lists", F.lit(1), F.greatest(F.size("lists") - (shared - 1), F.lit(1)))))


def deal_lists(posts: DataFrame, most: int) -> DataFrame:
    """(dims, pivot, n, total, parts): each list of two vectors or more in `total` tiles of about `most` vectors.

    parts gives the first tile and the number of tiles of vectors with one `first` that is less than the pivot, where these
    fill a tile, and under -1 those of all others. The former met one another in the list of their `first`.
    """
    counts = posts.groupBy("dims", "pivot", "first").count()
    part = F.when((F.col("count") >= most) & (F.col("first") < F.col("pivot")), F.col("first")).otherwise(F.lit(-1))
    held = counts.groupBy("dims", "pivot", part.alias("part")).agg(F.sum("count").alias("n")).withColumn("tiles", F.ceil(F.col("n") / most).cast("int"))
    before = Window.partitionBy("dims", "pivot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("base", F.coalesce(F.sum("tiles").over(before), F.lit(0)).cast("int"))
    parts = F.map_from_entries(F.collect_list(F.struct("part", F.struct("base", "tiles"))))
    return held.groupBy("dims", "pivot").agg(F.sum("n").alias("n"), F.sum("tiles").cast("int").alias("total"), parts.alias("parts")).where("n > 1")


def tile_pairs(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """posts with (i, j, tile): every vector once for each pair of tiles of its list in which it can meet a new one."""
    own = posts.join(lists.select("dims", "pivot", "total", "parts"), ["dims", "pivot"])
    big = F.try_element_at("parts", F.col("first"))
    place = F.coalesce(big, F.try_element_at("parts", F.lit(-1)))
    own = own.withColumns({"big": big.isNotNull(), "base": place["base"], "tiles": place["tiles"]}).withColumn("tile", (F.col("base") + F.pmod(F.xxhash64("class"), F.col("tiles"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda t: ~F.col("big") | (t < F.col("base")) | (t >= F.col("base") + F.col("tiles")))
    own = own.withColumn("other", F.explode(others))
    return own.select("dims", "pivot", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "first", "class", "size", "lists", "vector")


def _candidates(mine: np.ndarray, theirs: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which pairs of rows share `shared` pivots and none that is less than this list's."""
    names = np.unique(mine)
    place = np.full(max(int(mine.max()), int(theirs.max())) + 1, len(names), np.int64)
    place[names] = np.arange(len(names))
    held = []
    for rows in (mine, theirs):
        m = np.zeros((len(rows), len(names) + 1), np.float32)
        m[np.arange(len(rows))[:, None], place[rows]] = 1
        held.append(m[:, :-1])
    less = int(np.searchsorted(names, pivot))
    enough = held[0] @ held[1].T >= shared
    return enough & (held[0][:, :less] @ held[1][:, :less].T == 0) if less else enough


def _verify(threshold: float, shared: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The links of one pair of tiles of a list: sums for each class, and a forest with the links' components."""
        dims, pivot, i, j = (k.as_py() for k in key)
        rows = rows.sort_by([("tile", "ascending"), ("first", "ascending")]).combine_chunks()
        get = lambda c: rows.column(c).to_numpy()
        ids, size, head = get("class").astype(np.int64), get("size").astype(np.int64), get("first")
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(-1, dims)
        lists = rows.column("lists").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        need, low = min(shared, lists.shape[1]), x.astype(np.float32)
        first = int((get("tile") == i).sum()) if i != j else len(x)
        # What single precision can be off by; nearer to the threshold the double product decides.
        slack = 1e-6 + 2.4e-7 * dims
        links, label, edges = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for at in range(0, first, 128):
            to, begin = min(at + 128, first), first if i != j else at
            if i == j and head[at] == head[to - 1] < pivot:
                # All of one first list, where they have met.
                begin = int(np.searchsorted(head, head[at], "right"))
            if begin == len(x):
                continue
            hit = _candidates(lists[at:to], lists[begin:], pivot, need)
            if i == j:
                hit &= np.arange(at, to)[:, None] < np.arange(begin, len(x))[None, :]
            if hit.mean() < 0.02:
                a, b = np.nonzero(hit)
                hit[:] = False
                exact = a, b
            else:
                s = low[at:to] @ low[begin:].T
                exact = np.nonzero(hit & (np.abs(s - threshold) <= slack))
                hit &= s >= threshold + slack
            for k in range(0, len(exact[0]), 1 << 16):
                u, v = exact[0][k : k + (1 << 16)], exact[1][k : k + (1 << 16)]
                hit[u, v] = np.einsum("nd,nd->n", x[at + u], x[begin + v]) >= threshold
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            links[at:to] += hit @ size[begin:]
            links[begin:] += size[at:to] @ hit
            for r in some.tolist():
                p, q = at + r, begin + np.flatnonzero(hit[r])
                q = q[label[q] != label[p]]
                if len(q):
                    other, where = np.unique(label[q], return_index=True)
                    edges += [(p, w) for w in q[where].tolist()]
                    label[np.isin(label, other)] = label[p]
        got, e = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([ids[got], ids[e[:, 0]]]), "b": np.concatenate([ids[got], ids[e[:, 1]]]), "n": np.concatenate([links[got], np.zeros(len(e), np.int64)])})

    return run


def near_links(classes: DataFrame, threshold: float, *, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(a, b, n): n > 0 and a = b, a part of the links of class a; n = 0, a link of a spanning forest."""
    pivots = choose_pivots(classes, classes.count(), threshold, nearest=nearest)
    posts = post_vectors(cut(place_vectors(classes, pivots, nearest), "placed"), shared)
    dealt = tile_pairs(posts, cut(deal_lists(posts, TILE), "lists"))
    return cut(dealt.groupBy("dims", "pivot", "i", "j").applyInArrow(_verify(threshold, shared), "a long, b long, n long"), "near")


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class. A class is described by its ordered nearest pivots and stands in the inverted lists of these.
    Pairs that share two pivots or more are verified by cosine in double precision (in single precision where that is
    certain), each in the list of the least pivot it shares; lists are dealt in tiles, and a dense group is met in its first
    list alone. No link below the threshold is given, and one is lost only where two permutations share less than two
    pivots: none of 246,931 in groups, 7 of a million where a third of all rows are one group about the threshold. Pairs are
    summed where they are found: no row is made for a pair but those of a spanning forest. Compared pairs are some
    nearest^2 / pivots of all pairs, and all pairs of a dense group.

    Null, zero and non-finite vectors (or with null components) and rows with a null id link with nothing: n_links 0,
    component_id its own id. Only vectors of as many components compare. Rows that share an id are vectors of their own, with
    links, component and count of their own. An empty table gives no rows; other columns are ignored.
    """
    members, first = vector_classes(vectors)
    classes = cut(first, "vectors")
    found = near_links(classes, threshold)
    joined = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "class")
    lowest = joined.join(classes.select("class", "least"), "class").groupBy("component").agg(F.min("least").alias("low"))
    links = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    known = classes.select("class", "least", "size").join(links, "class", "left").join(joined.join(lowest, "component").select("class", "low"), "class", "left")
    known = known.select("class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    linked = members.join(known, "class").select("vec_id", "n_links", "component_id")
    rest = _own(vectors).where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as component_id from r group by a), n as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id, coalesce(c.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join c on c.a = e.vec_id left join n on n.a = e.vec_id
"""
