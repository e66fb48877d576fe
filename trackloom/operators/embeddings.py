"""Vectors of observations (vec_id, embedding, label): neighbours, centroids, votes and galleries.

A label stands for an identity. Its centroid is one row, so tables of centroids are small; whole sets are compared block by block.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.vectors import cosine, dot, unit_vector
from trackloom.operators.islands import fold_sorted
from trackloom.session import broadcast_if_small, ship_package


def _unit(vectors: DataFrame) -> DataFrame:
    return vectors.where("embedding IS NOT NULL").select("vec_id", "label", unit_vector(F.col("embedding")).alias("v"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors nearest to each query by cosine, itself left out; ties (to six digits) by vec_id.

    The stated queries are broadcast (measured) against all vectors in blocks of the vectors' partitions; map tasks keep ``k`` a query.
    """
    if k <= 0:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("rank"))
    asked = broadcast_if_small(_unit(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    pairs = _unit(vectors).join(asked, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean of the unit vectors of each label, at unit length: label, n, centroid."""
    parts = _unit(vectors).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    means = parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    return means.select("label", "n", unit_vector(F.col("mean")).alias("centroid"))


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    return values if len(values) <= k else np.partition(values, len(values) - k)[-k:]


def _block_tops(a: tuple, b: tuple, k: int, rows: int = 512) -> list[tuple]:
    """Of two blocks (labels in order, vec_ids, vectors), for each label of ``a`` below one of ``b``: the ``k`` best products (vec_id null)
    and the ``k`` vectors of ``a`` with the best products."""
    (labels, ids, v), (others, _, w), out = a, b, []
    for label in np.unique(labels):
        own, first = np.flatnonzero(labels == label), np.searchsorted(others, label, "right")
        names, starts = np.unique(others[first:], return_index=True)
        if not len(names):
            continue
        ends = [*starts[1:], len(others) - first]
        tops, bests = [np.empty(0)] * len(names), []
        for at in range(0, len(own), rows):
            products = v[own[at : at + rows]] @ w[first:].T
            tops = [_largest(np.append(t, _largest(products[:, s:e].ravel(), k)), k) for t, s, e in zip(tops, starts, ends)]
            bests.append(np.maximum.reduceat(products, starts, axis=1))
        best = np.concatenate(bests)
        for n, other in enumerate(names):
            out += [(int(label), int(other), None, float(d)) for d in tops[n]]
            out += [(int(label), int(other), int(ids[own[r]]), float(best[r, n])) for r in np.argsort(-best[:, n], kind="stable")[:k]]
    return out


def set_similarity(vectors: DataFrame, k: int = 6, block: int = 4096) -> DataFrame:
    """Every two labels by all their vectors: a < b, ``topk`` (mean of the ``k`` best of all products between the two sets) and
    ``best_topk`` (each vector of a with its best of b; mean of the ``k`` best of these).

    Vectors fall into blocks of about ``block`` by a hash; every two blocks meet in one task, which hands on ``k`` values of each
    label pair. A vector with a missing component has no cosine; vectors of different lengths are not compared.
    """
    known = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = _unit(vectors).where(F.col("label").isNotNull() & known).select("vec_id", F.col("label").cast("bigint").alias("label"), "v")
    blocks = max(1, -(-rows.count() // block))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    pair = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    spread = rows.withColumn("block", mine).withColumn("with", pair)
    placed = spread.select(F.size("v").alias("length"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "label", "vec_id", "v")

    def tops(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        n = table.num_rows
        of, label, ids = (table[c].to_numpy() for c in ("block", "label", "vec_id"))
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        parts = [(label[of == x], ids[of == x], v[of == x]) for x in np.unique(of)]
        same = table["i"][0].as_py() == table["j"][0].as_py()
        found = [x for p in parts for q in parts if same or p is not q for x in _block_tops(p, q, k)]
        return pa.table({c: pa.array([x[m] for x in found], t) for m, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("vec_id", pa.int64()), ("d", pa.float64())))})

    ship_package(vectors.sparkSession)
    few = placed.groupBy("length", "i", "j").applyInArrow(tops, "a bigint, b bigint, vec_id bigint, d double").repartition("a", "b")
    # Products have no vec_id; of a vector only its best product counts.
    once = F.row_number().over(Window.partitionBy("a", "b", "vec_id").orderBy(F.desc("d")))
    single = few.withColumns({"single": F.col("vec_id").isNull(), "o": once}).where("single OR o = 1")
    ranked = single.withColumn("r", F.row_number().over(Window.partitionBy("a", "b", "single").orderBy(F.desc("d")))).where(F.col("r") <= k)
    mean = lambda single: F.round(F.avg(F.when(F.col("single") == single, F.col("d"))), 6)
    kind = vectors.schema["label"].dataType
    return ranked.groupBy("a", "b").agg(mean(True).alias("topk"), mean(False).alias("best_topk")).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "topk", "best_topk")


def centroid_votes(vectors: DataFrame) -> DataFrame:
    """Which centroid the samples of each label are nearest to: label, ref, votes, share."""
    refs = broadcast_if_small(centroids(vectors).select(F.col("label").alias("ref"), F.col("centroid").alias("c")))
    scored = _unit(vectors).join(refs).withColumn("d", dot(F.col("v"), F.col("c")))
    voted = scored.groupBy("vec_id", "label").agg(F.min_by("ref", F.struct(-F.col("d"), "ref")).alias("ref"))
    counts = voted.groupBy("label", "ref").agg(F.count(F.lit(1)).alias("votes"))
    return counts.withColumn("share", F.round(F.col("votes") / F.sum("votes").over(Window.partitionBy("label")), 6))


def centroid_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of every two centroids: a < b."""
    c = centroids(vectors)
    a = c.select(F.col("label").alias("a"), F.col("centroid").alias("ca"))
    b = broadcast_if_small(c.select(F.col("label").alias("b"), F.col("centroid").alias("cb")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("ca"), F.col("cb")), 6).alias("similarity"))


def cleaned_prototypes(vectors: DataFrame, slack: float = 0.05) -> DataFrame:
    """Samples that agree with their centroid at least as the label's median less ``slack``: label, n, n_kept, coherence."""
    refs = broadcast_if_small(centroids(vectors).select(F.col("label").alias("ref"), F.col("centroid").alias("c")))
    near = _unit(vectors).join(refs, F.col("label") == F.col("ref")).select("vec_id", "label", dot(F.col("v"), F.col("c")).alias("coherence"))
    middle = near.groupBy(F.col("label").alias("ref")).agg(F.median("coherence").alias("med"))
    kept = F.col("coherence") >= F.col("med") - slack
    return near.join(middle, F.col("label") == F.col("ref")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("n_kept"), F.round(F.avg(F.when(kept, F.col("coherence"))), 6).alias("coherence")
    )


def part_similarity(vectors: DataFrame, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """Every two labels (a < b) by the parts of their centroids, one part of equal size for each weight: the weighted cosine of the
    parts that both have, the weights scaled to these, less a penalty where the parts disagree; and how many parts both have.

    A part of zeros is missing. Labels with no part in common, or of different lengths, have 0 of 0 parts.
    """
    n = F.size("centroid")
    edge = lambda i: F.floor(i * n / len(weights)).cast("int")
    profiles = centroids(vectors).select("label", F.array(*[F.slice("centroid", edge(F.lit(i)) + 1, edge(F.lit(i + 1)) - edge(F.lit(i))) for i in range(len(weights))]).alias("p"), n.alias("n"))
    a = profiles.select(F.col("label").alias("a"), F.col("p").alias("pa"), F.col("n").alias("na"))
    b = broadcast_if_small(profiles.select(F.col("label").alias("b"), F.col("p").alias("pb"), F.col("n").alias("nb")))
    alike = F.when(F.col("na") == F.col("nb"), F.zip_with("pa", "pb", lambda x, y: cosine(x, y, None)))
    both = a.join(b, F.col("a") < F.col("b")).withColumn("s", F.coalesce(alike, F.array().cast("array<double>")))
    weighed = F.zip_with("s", F.array(*[F.lit(w) for w in weights]), lambda s, w: F.when(s.isNotNull(), F.struct(s.alias("s"), w.alias("w"))))
    known = both.withColumn("k", F.filter(weighed, lambda x: x.isNotNull()))
    total = lambda value: F.aggregate("k", F.lit(0.0), lambda t, x: t + value(x))
    apart = F.greatest(F.array_max("k.s") - F.array_min("k.s") - 0.5, F.lit(0.0))
    score = F.when(F.size("k") > 0, total(lambda x: x["w"] * x["s"]) / total(lambda x: x["w"]) - 0.2 * apart).otherwise(0.0)
    return known.select("a", "b", F.round(score, 6).alias("similarity"), F.size("k").cast("bigint").alias("n_parts"))


class _Gallery:
    def __init__(self, key: tuple, alpha: float) -> None:
        self.key, self.alpha, self.vector, self.n = key, alpha, None, 0

    def step(self, row):
        new = np.asarray(row.v, float)
        similarity = None if self.vector is None else float(self.vector @ new)
        mixed = new if self.vector is None else self.alpha * self.vector + (1 - self.alpha) * new
        length = np.linalg.norm(mixed)
        self.vector = mixed / length if length else mixed
        self.n += 1
        yield (*self.key, int(row.vec_id), self.n, similarity)

    def end(self):
        return ()


def gallery(vectors: DataFrame, alpha: float = 0.9) -> DataFrame:
    """An exponential average per label, kept at unit length, in order of vec_id; and how alike each new vector was to it."""
    rows = _unit(vectors).select("label", "vec_id", "v")
    return fold_sorted(rows, ["label"], ["vec_id"], lambda key: _Gallery(key, alpha), "label bigint, vec_id bigint, n bigint, similarity double")


class _Bank:
    """Prototypes per identity: the first, an average and up to ``size`` different ones."""

    def __init__(self, key: tuple, size: int = 24, least: float = 0.2, new: float = 0.97) -> None:
        self.key, self.least, self.new = key, least, new
        self.first = self.main = None
        self.kept: deque = deque(maxlen=size)

    def step(self, row):
        v = np.asarray(row.v, float)
        if self.first is None:
            self.first = self.main = v
            self.kept.append(v)
            yield (*self.key, int(row.vec_id), 1.0, True, 1)
            return
        sims = np.array([p @ v for p in self.kept])
        top = float(np.sort(sims)[-4:].mean())
        main = float(self.main @ v)
        recent = max(0.65 * main + 0.35 * top, 0.96 * top, 0.92 * float(sims.max()))
        fused = 0.68 * recent + 0.32 * float(self.first @ v)
        if main >= self.least:
            mixed = 0.9 * self.main + 0.1 * v
            self.main = mixed / np.linalg.norm(mixed)
        if sims.max() < self.new:
            self.kept.append(v)
        yield (*self.key, int(row.vec_id), fused, main >= self.least, len(self.kept))

    def end(self):
        return ()


def banked(vectors: DataFrame) -> DataFrame:
    """Each vector against its label's bank as it was then: fused score, whether the average moved, prototypes kept."""
    rows = _unit(vectors).select("label", "vec_id", "v")
    return fold_sorted(rows, ["label"], ["vec_id"], _Bank, "label bigint, vec_id bigint, fused double, moved boolean, n_prototypes bigint")


class _Drift:
    def __init__(self, key: tuple, least: float, rows: int) -> None:
        self.key, self.least, self.rows = key, least, rows
        self.centre, self.n, self.segment = None, 0, 1

    def step(self, row):
        v = np.asarray(row.v, float)
        if self.centre is not None and self.n >= self.rows and float(self.centre @ v) < self.least:
            self.centre, self.n, self.segment = None, 0, self.segment + 1
        mixed = v if self.centre is None else 0.78 * self.centre + 0.22 * v
        self.centre = mixed / (np.linalg.norm(mixed) or 1.0)
        self.n += 1
        yield (*self.key, int(row.vec_id), self.segment)

    def end(self):
        return ()


def drift_segments(vectors: DataFrame, least: float = 0.58, rows: int = 56) -> DataFrame:
    """Segments of a label's vectors: a new one where a vector no longer resembles the running centre of at least ``rows`` before."""
    return fold_sorted(_unit(vectors).select("label", "vec_id", "v"), ["label"], ["vec_id"], lambda key: _Drift(key, least, rows), "label bigint, vec_id bigint, segment bigint")
