"""Vector operators: theme clusters (M2) and semantic search.

Both compare every vector with a set of reference vectors (theme centroids,
query vectors).  The set is counted and taken in blocks of bounded size; a
block is a one-row scalar subquery holding an array of (id, vector) --
evaluated once and shipped with the plan like a broadcast -- so each corpus
vector is scored row-locally: no join, no shuffle of the corpus.  Ranking uses ``row_number() <= k`` with a literal bound (partial
WindowGroupLimit).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REFERENCE_VECTORS = 4096     # centroids / query vectors carried in one block
SIM_DIGITS = 4


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


# cosine divisions use try_divide: a zero vector gives a null similarity
# instead of failing the job under ANSI mode


def _blocks(ref: DataFrame, key: str, limit: int) -> list[DataFrame]:
    """The reference set in blocks of about ``limit`` rows (by the hash of
    their key): one block's array is what a task holds at a time."""
    n = max(1, -(-ref.count() // limit))
    if n == 1:
        return [ref]
    return [ref.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label: (label, centroid array<double>).  Per-dimension
    means are a grouped aggregate with map-side partial sums."""
    ex = vectors.select(label, F.posexplode(as_double(F.col(vec))).alias("i", "x"))
    per = ex.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return (per.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_a"))
            .select(label, F.transform("_a", lambda s: s["m"]).alias("centroid")))


def _ref_array(ref: DataFrame, key: str, vec: str) -> Column:
    packed = ref.select(F.array_sort(F.collect_list(F.struct(
        F.col(key).alias("k"), F.col(vec).alias("v"), norm(F.col(vec)).alias("n")))).alias("refs"))
    return packed.scalar()


def theme_clusters(vectors: DataFrame, label: str = "label", vec: str = "embedding",
                   id_col: str = "vec_id", max_themes: int = MAX_REFERENCE_VECTORS) -> DataFrame:
    """M2 (deterministic variant): each vector joins the theme whose label
    centroid is most cosine-similar (ties -> smaller label)."""
    parts = [_nearest_theme(vectors, c, label, vec, id_col) for c in _blocks(centroids(vectors, label, vec), label, max_themes)]
    best = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            best = best.unionByName(p)
        # one row per vector: the best of its blocks, ties to the smaller label
        best = best.groupBy(id_col, label).agg(F.max("best").alias("best"))
    return best.select(id_col, label, F.col("best.k").alias("theme"), F.round("best.s", SIM_DIGITS).alias("similarity"))


def _nearest_theme(vectors: DataFrame, cents: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    # the scalar subquery is projected first: Spark allows no subquery
    # inside a higher-order function, but a column computed from one is fine
    t = vectors.select(id_col, label, as_double(F.col(vec)).alias("_v"),
                       _ref_array(cents, label, "centroid").alias("_refs"))
    v = F.col("_v")
    nv = norm(v)
    sims = F.transform("_refs", lambda r: F.struct(F.try_divide(dot(v, r["v"]), nv * r["n"]).alias("s"),
                                                   (-r["k"]).alias("neg_k"), r["k"].alias("k")))
    return t.select(id_col, label, F.array_max(sims).alias("best"))


def kmeans_themes(vectors: DataFrame, k: int, vec: str = "embedding", id_col: str = "vec_id",
                  seed: int = 7, max_iter: int = 20) -> DataFrame:
    """M2 (learned variant): pyspark.ml KMeans (cosine distance) over the
    vectors; k is a parameter, so the model is bounded by construction."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = vectors.select(id_col, array_to_vector(as_double(F.col(vec))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(feats)
    return model.transform(feats).select(id_col, F.col("prediction").cast("bigint").alias("theme"))


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding",
                    id_col: str = "vec_id", qid: str = "query_id", qvec: str = "query_vec",
                    max_queries: int = MAX_REFERENCE_VECTORS) -> DataFrame:
    """Cosine top-k corpus vectors per query vector (ties -> smaller id).

    Query vectors are taken in blocks of about ``max_queries``; every corpus
    vector is scored in-row against a block, and the rows are cut to k per
    query with a partial WindowGroupLimit, block by block."""
    parts = [_block_search(vectors, q, k, vec, id_col, qid, qvec) for q in _blocks(queries, qid, max_queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block_search(vectors: DataFrame, queries: DataFrame, k: int, vec: str, id_col: str, qid: str, qvec: str) -> DataFrame:
    refs = _ref_array(queries.select(qid, as_double(F.col(qvec)).alias("_qv")), qid, "_qv")
    t = vectors.select(id_col, as_double(F.col(vec)).alias("_v"), refs.alias("_refs"))
    v = F.col("_v")
    nv = norm(v)
    scored = t.select(id_col, F.explode(F.transform("_refs", lambda r: F.struct(
        r["k"].alias(qid), F.round(F.try_divide(dot(v, r["v"]), nv * r["n"]), SIM_DIGITS).alias("score")))).alias("x"))
    scored = scored.select(F.col(f"x.{qid}").alias(qid), id_col, F.col("x.score").alias("score"))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(id_col))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))
