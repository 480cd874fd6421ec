"""Spelling variants, language model scores and hard negatives against plain Python."""

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import corpus
from wayfold.llm import language_model, negatives, spelling

ROWS = corpus()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11: spelling variants ---


def counted(rows, modulus=199, least=6, least_n=5):
    c = Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] and len(b) == len(a) + 1)


def variants(counts, factor=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        n, v = min(((-counts[v], v) for v in vs), default=(0, None))
        form[w] = v if v is not None and -n >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def random_words(seed, n, letters="abcé", longest=14):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, longest)))
        out.append(w)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            out.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return [w for w in out if len(w) >= 6]


def test_near_words_are_those_of_all_pairs(spark):
    words = sorted(set(random_words(3, 250) + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "x" * 300, "x" * 299, "x" * 299 + "y"]))
    got = spelling.near_words(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"))
    have = sorted((r.word, r.near) for r in got.collect())
    assert have == sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(8)
    words = random_words(9, 60)
    texts = [" ".join(rng.choice(words) + rng.choice([" ", ", ", "1", "\n"]) for _ in range(400)).upper() for _ in range(6)] + [f"Commonword {'commonword ' * 40} comonword"] * 5
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "y"), (3, None, "z"), (4, "", "z"), (2, texts[2], "repeated"), (9, "q" * 5000 + " " + "q" * 5000 + "r", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    for modulus in (199, 3):
        got = spelling.spelling_variants(docs, modulus=modulus)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect())) == variants(counted(rows, modulus))


def test_counts_when_dictionaries_are_given_up_early(docs):
    got = {r.word: r.n for r in spelling.word_counts(docs, least_n=1, modulus=5, most=3).collect()}
    assert got == counted(ROWS, 5, least_n=1)


def test_a_third_of_all_words_under_one_stem(spark):
    words = ["commonstem" + w for w in random_words(4, 80)] + random_words(5, 100)
    words = sorted(set(words))
    got = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert sorted((r.word, r.near) for r in got.collect()) == sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_forms_are_followed_to_the_end(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}" if k < 20 else None) for k in range(21)]
    got = {r.word: r.root for r in spelling.follow_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k:02}": "w20" for k in range(20)}


def test_variants_of_nothing(empty, spark):
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short x1 words")], "doc_id long, text string")).count() == 0


# --- 12: language model ---


def dictionary_model(rows, order, modulus=7, rest=2):
    """Counts in dictionaries and probabilities by recursion."""
    tokens = [(d, ["<s>", *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), "</s>"]) for d, t, *_ in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % modulus == rest
    count = [Counter() for _ in range(order + 1)]
    for d, t in tokens:
        if not held(d):
            for k in range(1, order + 1):
                count[k].update(tuple(t[p : p + k]) for p in range(len(t) - k + 1))
    n, v = sum(c for g, c in count[1].items() if g != ("<s>",)), max(len(count[1]) - 1, 0)
    power = []
    for k in range(2, order + 1):
        contexts = Counter(c for g, c in count[k - 1].items() if g != ("<s>",))
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(m * c**mid for c, m in contexts.items()) < len(count[k]) else (low, mid)
        power.append(low)

    def prob(w, h):
        if not h:
            return (count[1][(w,)] + 1) / (n + v + 1)
        c = count[len(h)][h]
        k = c ** power[len(h) - 1]
        return (count[len(h) + 1][(*h, w)] + k * prob(w, h[1:])) / (c + k) if c else prob(w, h[1:])

    scores = []
    for d, t in tokens:
        of = lambda m: sum(math.log10(prob(t[p], tuple(t[max(0, p - m + 1) : p]))) for p in range(1, len(t)))
        scores.append((d, held(d), len(t) - 1, sum(count[1][(w,)] > 0 for w in t[1:]), n, of(1), of(order)))
    return SimpleNamespace(scores=scores, prob=prob, count=count)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r[:4]) + tuple(round(x, 4) for x in r[5:]))


@pytest.mark.parametrize("order, options", [(1, {}), (2, {}), (3, {"block_bytes": 1500, "buckets": 5}), (4, {"buckets": 1})])
def test_scores_are_those_of_a_dictionary_model(docs, order, options):
    got = ordered(map(tuple, language_model.lm_scores(docs, order=order, **options).collect()))
    want = ordered(dictionary_model(ROWS, order).scores)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-3 if order > 1 else 1e-12)


def test_each_state_spreads_one(docs):
    m = dictionary_model(ROWS, 3)
    words = [g[0] for g in m.count[1] if g != ("<s>",)]
    for h in [(), ("<s>",), (b"the",), (b"of", b"the"), ("<s>", b"seven")]:
        assert abs(sum(m.prob(w, h) for w in words) + m.prob("?", h) - 1) < 1e-9


def test_long_texts_are_walked_whole(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(n))) for k, n in enumerate([0, 1, 3, 700, 5000, 20, 1, 0, 511, 512, 513])]
    got = ordered(map(tuple, language_model.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()))
    assert np.allclose([r[6] for r in got], [r[6] for r in ordered(dictionary_model(rows, 3).scores)], rtol=1e-3)


def test_power_of_followers():
    contexts = [(10, 10), (4, 40), (2, 200)]
    b = language_model.follower_power(contexts, 45)
    assert abs(10 + 4 * 10**b + 2 * 100**b - 45) < 1e-6
    assert language_model.follower_power([], 0) < 1e-9


def test_held_out_texts_score_better_than_by_words_alone(spark):
    """A language of fixed successors: what follows is nearly certain, words alone are not."""
    rng = random.Random(6)
    after = {k: [rng.randrange(60) for _ in range(3)] for k in range(60)}

    def text():
        k, out = rng.randrange(60), []
        for _ in range(80):
            out.append(f"w{k}")
            k = rng.choice(after[k])
        return " ".join(out)

    got = language_model.lm_scores(spark.createDataFrame([(k, text()) for k in range(150)], "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 10 and all(r.score > 0.6 * r.base_score for r in got)


def test_scores_of_nothing(empty, spark):
    assert language_model.lm_scores(empty).count() == 0
    only = language_model.lm_scores(spark.createDataFrame([(next(d for d in range(99) if language_model.is_held_out(d, 7, 2)), "a b")], "doc_id long, text string")).first()
    assert (only.train_tokens, only.n_tokens, only.n_known, only.base_score, only.score) == (0, 3, 0, 0.0, 0.0)


# --- 13: hard negatives ---


def mined(rows, every=100, positives=5, few=5):
    ok = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    by = lambda s: (-s[0], s[1] is None, s[1])
    for a, (i, lab, v) in enumerate(ok):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, m == lab) for b, (j, m, w) in enumerate(ok) if b != a and len(w) == len(v)]
        for p, pid, _ in sorted([s for s in scores if s[2]], key=by)[:positives]:
            fits = sorted([s for s in scores if not s[2] and 80 * p <= 100 * s[0] <= 100 * p], key=by)[:few]
            out += [(i, pid, r + 1, nid, p, n) for r, (n, nid, _) in enumerate(fits)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def vectors(seed=4, n=700, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for k in range(n):
        g = 0 if k % 3 == 0 else int(rng.integers(6))
        v = centres[g] + 0.4 * rng.normal(size=dims)
        rows.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(3)) if k % 5 else g, k))
    rows += [(None, rows[5][1], 1, 0), (200, rows[200][1], rows[200][2], 0), (200, rows[17][1], 2, 0), (7, rows[8][1], 1, 0)]
    rows += [(800, None, 1, 0), (900, rows[9][1], None, 0), (1000, [0.0] * dims, 2, 0), (1100, [float("nan")] + [0.1] * (dims - 1), 1, 0), (1200, [float("inf")] * dims, 1, 0), (1300, [None] * dims, 1, 0)]
    rows += [(1400 + k, [1.0, 0.5], k % 2, 0) for k in range(9)] + [(1500, [], 1, 0), (1501, [], 1, 0), (1502, [], 2, 0), (2000, [1000.0] + [0.0] * (dims - 1), 1, 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, score int"


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 300}, {"every": 10, "positives": 3, "few": 2}])
def test_negatives_are_those_of_brute_force(spark, options):
    rows = vectors()
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, **{k: v for k, v in options.items() if k != "pass_bytes"})
    assert sorted(map(tuple, got.collect()), key=lambda r: tuple((x is None, x) for x in r)) == want and len(want) > 20


def test_negatives_among_equal_vectors(spark):
    """A third of all rows are one vector: ties go by id, in small lists."""
    rows = vectors(n=300)
    rows += [(5000 + k, rows[0][1], k % 4, 0) for k in range(150)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect()), key=lambda r: tuple((x is None, x) for x in r)) == mined(rows)


def test_walks_end_before_their_lists(monkeypatch):
    rng = np.random.default_rng(1)
    anchors = (rng.normal(size=(40, 4)) * 50).astype(np.int64)
    clusters = negatives.Clusters(anchors)
    f = (rng.normal(size=(4000, 4)) * rng.exponential(50, size=(4000, 1))).astype(np.int64).astype(float)
    size = np.sqrt((f * f).sum(axis=1))
    unit = f / np.maximum(size, 1e-300)[:, None]
    assert sorted(np.concatenate(clusters.members).tolist()) == list(range(40))
    for c, members in enumerate(clusters.members):
        order, bound = negatives.shared_list(clusters, c, unit, size)
        assert (np.diff(bound) <= 0).all()
        true = (anchors[members] @ f[order].T) / np.maximum(clusters.size[members], 1e-300)[:, None]
        assert (true <= bound + 1e-6 * size[order]).all()
        # Most of the list lies below the tenth best of every member.
        assert (bound < np.sort(true, axis=1)[:, -10].min()).mean() > 0.5


def test_no_vectors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_negatives_sql(spark):
    rows = [r for r in vectors() if r[0] is not None and len(r[1] or []) in (0, 8)]
    con = duckdb.connect()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2).select(F.col("vec_id"), "embedding", "label")
    con.register("embeddings", df.toArrow())
    assert sorted(con.execute(negatives.ORACLE).fetchall()) == sorted(map(tuple, negatives.hard_negatives(df).collect()))
