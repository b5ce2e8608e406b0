"""M2, learned variant: findings grouped by theme from their own words.

Hashed TF-IDF vectors of the texts, seeded spherical k-means, nearest centroid.  The vectors are
written once and each iteration is one pass over them; k x dims numbers are all that reaches the driver.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import explode_rows, tokenize
from tessera.operators.features import DIMS, text_features
from tessera.operators.kmeans import assign, spherical_kmeans
from tessera.session import materialize

SIM_DIGITS = 4


def text_themes(df: DataFrame, id_col: str, text_col: str, k: int = 8, dims: int = DIMS, seed: int = 7,
                iterations: int = 10) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, theme, similarity), centroids).  Texts without words that tell texts apart have no
    theme.  With fewer such texts than ``k`` there are as many themes as texts."""
    features, _ = text_features(df, id_col, text_col, dims)
    features = materialize(features, "theme-features")
    centroids = spherical_kmeans(features, k, id_col, "features", seed=seed, iterations=iterations)
    out = assign(features, centroids, id_col, "features")
    return out.withColumn("similarity", F.round("similarity", SIM_DIGITS)), centroids


def theme_terms(df: DataFrame, themes: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """(theme, rank, term, docs): the terms that mark a theme: found in most of its documents against
    how many of all themes' documents hold them, docs * docs / all docs with the term (ties by term)."""
    terms = explode_rows(df, [id_col], F.array_distinct(tokenize(text_col)), "term")
    per = (terms.join(themes.where("theme is not null").select(id_col, "theme"), id_col)
           .groupBy("theme", "term").agg(F.count(F.lit(1)).alias("docs")))
    per = materialize(per, "theme-terms")
    every = per.groupBy("term").agg(F.sum("docs").alias("all_docs"))
    marks = per.join(every, "term").withColumn("mark", F.col("docs") * F.col("docs") / F.col("all_docs"))
    w = Window.partitionBy("theme").orderBy(F.col("mark").desc(), "term")
    return (marks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("theme", F.col("rank").cast("bigint").alias("rank"), "term", "docs"))
