"""Hard negatives: anchors of a cluster share lists of candidates, sorted once by an angular upper bound and walked until no more can win."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.llm.common import cut

#: Anchor vectors that one pass broadcasts, in bytes; more anchors take more passes over the table.
PASS_BYTES = 32 << 20
#: Members of a cluster (a larger one is dealt in several) and candidates of one sorted list.
CLUSTER, LIST = 256, 1 << 14
#: Candidates that a walk looks at before it asks again whether it may end.
STEP = 512
#: Components from here on have no exact 64-bit products.
MOST = 1 << 24
_LOWEST = np.iinfo(np.int64).min


def scaled_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", turned: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector array<long>): the rows that take part, with their labels turned and components floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < MOST / scale))
    label = F.col(label_col).cast("long")
    own = F.when(F.coalesce(F.col(id_col) % turned == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), own.alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("vector"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


class Clusters:
    """Anchors of one length in clusters round a few of them: members, their sizes and the widest angle."""

    def __init__(self, vectors: np.ndarray):
        v = vectors.astype(np.float64)
        self.size = np.sqrt((v * v).sum(axis=1))
        self.unit = v / np.maximum(self.size, 1e-300)[:, None]
        k = max(1, math.isqrt(len(v)))
        heads = self.unit[np.linspace(0, len(v) - 1, k).astype(int)]
        near = (self.unit @ heads.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        parts = [x[i : i + CLUSTER] for x in np.split(order, cuts) for i in range(0, len(x), CLUSTER)]
        self.members = parts
        centres = np.array([self.unit[m].mean(axis=0) for m in parts])
        self.centres = centres / np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1e-300)[:, None]
        self.widest = [_angle(self.unit[m] @ c).max() for m, c in zip(parts, self.centres)]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def shared_list(clusters: Clusters, c: int, unit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in descending order of the most that their product with any member's unit vector can be, and that bound."""
    apart = np.maximum(_angle(unit @ clusters.centres[c]) - clusters.widest[c], 0)
    # A little more than the bound, for the rounding of angles.
    bound = size * np.minimum(np.cos(apart) + 1e-7, 1)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class _Best:
    """For each of some targets, its best few candidates: highest score, then least id, then rows without an id."""

    def __init__(self, n: int, few: int):
        self.score = np.full((n, few), _LOWEST, np.int64)
        self.id = np.zeros((n, few), np.int64)
        self.no_id = np.zeros((n, few), bool)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """rows: targets; score: their candidates' scores (targets x candidates, _LOWEST for none), ids ascending."""
        few = self.score.shape[1]
        if score.shape[1] > few:
            # Candidates stand in order of ids, so equal scores are told apart by their places.
            places = score.shape[1]
            some = score != _LOWEST
            if np.abs(score, where=some, out=np.zeros_like(score)).max() < 2**62 // places:
                keyed = np.where(some, score * places + (places - 1 - np.arange(places)), _LOWEST)
                top = np.argpartition(keyed, places - few, axis=1)[:, places - few :]
            else:
                top = np.argsort(score[:, ::-1], axis=1, kind="stable")[:, places - few :]
                top = places - 1 - top
        else:
            top = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        s = np.concatenate([self.score[rows], np.take_along_axis(score, top, 1)], axis=1)
        i = np.concatenate([self.id[rows], ids[top]], axis=1)
        n = np.concatenate([self.no_id[rows], no_id[top]], axis=1)
        # Lowest first: none, low scores, no id, high ids.
        order = np.lexsort((~i, ~n, s), axis=1)[:, ::-1][:, :few]
        for own, new in ((self.score, s), (self.id, i), (self.no_id, n)):
            own[rows] = np.take_along_axis(new, order, 1)


def _walk(anchors: dict, few: int, wants):
    """A task: every list of candidates is walked by every cluster's members; wants says which targets a member has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = anchors["groups"].value
        state = {d: wants(g) for d, g in groups.items()}
        held: dict[int, list] = {d: [] for d in groups}

        def flush(d: int) -> None:
            parts, held[d] = held[d], []
            if not parts:
                return
            ids, no_id, labels = (np.concatenate([p[k] for p in parts]) for k in range(3))
            vec = np.concatenate([p[3] for p in parts])
            g, (best, reach, score_of) = groups[d], state[d]
            clusters, ours = g["clusters"], g["vectors"].astype(np.float64)
            f = vec.astype(np.float64)
            size = np.sqrt((f * f).sum(axis=1))
            unit = f / np.maximum(size, 1e-300)[:, None]
            # Products are exact in doubles up to 2^53; longer ones are made in integers.
            exact = float(np.abs(f).max(initial=0)) * float(np.abs(ours).max(initial=0)) * max(d, 1) < 2**53
            for c, members in enumerate(clusters.members):
                order, bound = shared_list(clusters, c, unit, size)
                for a in range(0, len(order), STEP):
                    most = clusters.size[members] * bound[a] * (1 + 1e-9) + 1e-6
                    going = members[most >= reach(best, members)]
                    if not len(going):
                        break
                    these = order[a : a + STEP]
                    these = these[np.lexsort((ids[these], no_id[these]))]
                    scores = (ours[going] @ f[these].T).astype(np.int64) if exact else g["vectors"][going] @ vec[these].T
                    score_of(best, going, scores, labels[these], ids[these], no_id[these])

        for batch in batches:
            rows = _rows(batch.column("vector"))
            ids = batch.column("vec_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids, labels = ids.fill_null(0).to_numpy(), batch.column("label").to_numpy()
            length = np.array([len(r) for r in rows], np.int64)
            for d in np.unique(length).tolist():
                if d not in groups:
                    continue
                at = np.flatnonzero(length == d)
                held[d].append((ids[at], no_id[at], labels[at], np.array([rows[k] for k in at], np.int64).reshape(len(at), d)))
                if sum(len(p[0]) for p in held[d]) >= LIST:
                    flush(d)
        for d in groups:
            flush(d)
            best = state[d][0]
            target, place = np.nonzero(best.score != _LOWEST)
            if len(target):
                ids = pa.array(best.id[target, place], mask=best.no_id[target, place])
                n = best.score.shape[0] // len(groups[d]["key"])
                out = [pa.array(groups[d]["key"][target // n]), pa.array((target % n).astype(np.int32)), ids, pa.array(best.score[target, place])]
                yield pa.RecordBatch.from_arrays(out, names=["key", "slot", "other", "score"])

    return run


def _for_positives(few: int):
    """One target for each member: the best of its own label, itself among them."""

    def wants(g: dict):
        def reach(best: _Best, members: np.ndarray) -> np.ndarray:
            return best.worst()[members].astype(np.float64)

        def score_of(best: _Best, going: np.ndarray, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
            best.offer(going, np.where(labels[None, :] == g["labels"][going][:, None], scores, _LOWEST), ids, no_id)

        return _Best(len(g["key"]), few), reach, score_of

    return wants


def _for_negatives(few: int, positives: int, low: int, high: int):
    """A target for each positive of a member: the best of other labels within the margin below the positive's score."""

    def wants(g: dict):
        goal = g["goals"]  # members x positives, _LOWEST for none
        has = goal != _LOWEST
        floor = np.where(has, -((-goal * low) // high), 0)

        def needs(best: _Best, members: np.ndarray) -> np.ndarray:
            """The least score that could still enter: infinity where none can."""
            worst = best.worst().reshape(goal.shape)[members]
            return np.where(has[members] & (floor[members] <= goal[members]), np.maximum(floor[members], worst).astype(np.float64), np.inf)

        def reach(best: _Best, members: np.ndarray) -> np.ndarray:
            return needs(best, members).min(axis=1)

        def score_of(best: _Best, going: np.ndarray, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
            other = labels[None, :] != g["labels"][going][:, None]
            for j in range(goal.shape[1]):
                fits = other & has[going, j][:, None] & (scores >= floor[going, j][:, None]) & (scores <= goal[going, j][:, None])
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    best.offer(going[some] * goal.shape[1] + j, np.where(fits[some], scores[some], _LOWEST), ids, no_id)

        return _Best(goal.size, few), reach, score_of

    return wants


def _groups(rows: pa.Table) -> dict:
    """Anchors by length of their vectors."""
    vectors = _rows(rows.column("vector").combine_chunks()) if rows.num_rows else []
    length = np.array([len(v) for v in vectors], np.int64)
    out = {}
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        v = np.array([vectors[k] for k in at], np.int64).reshape(len(at), d)
        out[d] = {"key": rows.column("key").to_numpy()[at], "labels": rows.column("label").to_numpy()[at], "vectors": v, "clusters": Clusters(v)}
        if "goals" in rows.column_names:
            goals = rows.column("goals").combine_chunks().to_pylist()
            width = max((len(goals[k]) for k in at), default=0) or 1
            out[d]["goals"] = np.array([goals[k] + [_LOWEST] * (width - len(goals[k])) for k in at], np.int64).reshape(len(at), width)
    return out


_FOUND = "key long, slot int, other long, score long"


def _best_few(candidates: DataFrame, anchors: DataFrame, few: int, wants, pass_bytes: int) -> DataFrame:
    """(key, slot, other, score, place): the best few candidates of all tasks for every target of every anchor.

    Anchors are broadcast in slices of a counted size, so the table is read once for each slice and never shuffled.
    """
    spark = candidates.sparkSession
    size = anchors.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    parts = []
    for k in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).toArrow()
        shared = {"groups": spark.sparkContext.broadcast(_groups(own))}
        parts.append(cut(candidates.mapInArrow(_walk(shared, few, wants), _FOUND), "lists"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    ranked = found.withColumn("place", F.row_number().over(_window()))
    return ranked.where(F.col("place") <= few)


def _window() -> WindowSpec:
    return Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())


def hard_negatives(vectors: DataFrame, *, every: int = 100, positives: int = 5, few: int = 5, low: int = 80, high: int = 100, pass_bytes: int = PASS_BYTES, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows whose id `every` divides.

    An anchor's positives are its `positives` best rows of its label, itself left out; for each of them come the `few` best
    rows of other labels that score between low / high of the positive's score and all of it. Scores are integer inner
    products; equal ones come in order of ids, rows without an id last.

    Anchors stand in clusters. For each list of candidates and each cluster, the candidates are sorted once by the most that
    they can score with any member (their size times the cosine of their angle to the centre less the cluster's widest
    angle). A member walks that list and stops where the bound says that nothing further can enter its best. Candidates stay
    in their partitions; anchors, a stated share of the table, come in slices of bounded size; each task gives at most a few
    rows for each target, which a window merges.

    Rows with a null label, a null vector, null or non-finite components or components of 2^24 or more after scaling take no
    part. Vectors of different lengths have no score. A row without an id is no anchor. Rows that share an id are rows of
    their own, and equal anchors give their results once each. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(scaled_vectors(vectors, **columns), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = anchors.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.monotonically_increasing_id())
    anchors = cut(anchors, "anchors")
    near = _best_few(rows, anchors, positives + 1, _for_positives(positives + 1), pass_bytes)
    # One row of its own id and its own product with itself is the anchor itself.
    self_score = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)
    mine = near.join(anchors.select("key", "vec_id", self_score.alias("self")), "key")
    is_self = F.coalesce((F.col("other") == F.col("vec_id")) & (F.col("score") == F.col("self")), F.lit(False))
    mine = mine.withColumn("is_self", (F.row_number().over(Window.partitionBy("key").orderBy(is_self.desc())) == 1) & is_self)
    kept = mine.where(~F.col("is_self")).withColumn("place", F.row_number().over(_window())).where(F.col("place") <= positives)
    kept = cut(kept.select("key", (F.col("place") - 1).cast("int").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    goals = kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("goals"))
    # As many targets for each anchor everywhere, so that a target's number tells its anchor.
    padded = anchors.join(goals, "key").withColumn("goals", F.concat("goals", F.array_repeat(F.lit(_LOWEST), F.lit(positives) - F.size("goals"))))
    found = _best_few(rows, cut(padded, "goals"), few, _for_negatives(few, positives, low, high), pass_bytes)
    out = found.join(kept, ["key", "slot"]).join(anchors.select("key", "vec_id", "times"), "key")
    out = out.select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "times"
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("copy", "times")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.rid, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.rid <> b.rid and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by rid order by score desc, other) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, p.other as positive_id, p.score as positive_score, s.other as negative_id, s.score as negative_score,
    row_number() over (partition by p.rid, p.k order by s.score desc, s.other) as rank
  from p join s on s.rid = p.rid and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
