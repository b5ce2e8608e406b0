"""Request planning (Q1-Q6): turning research requests into search parameters.

All operators are row-local projections (no shuffle).  Rule tables are
small fixed literals compiled into CASE/array expressions, so they need
neither a join nor a broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import has_han, tokenize

# --- fixed values (must equal the reference's rules) -----------------------
DEFAULT_TOP_K = 5            # top_k when the caller gives none
MAX_RESULTS_CAP = 50         # hard upper bound on max_results (no lower bound)
VALID_TIME_RANGES = ("day", "week", "month", "year")
# Time cues -> window, ordered narrowest first.  "historical" means no window.
TIME_CUES = (("breaking", "day"), ("current", "week"), ("news", "week"),
             ("latest", "week"), ("recent", "month"), ("historical", None))
# Topic cues -> topic; anything else is "general".
TOPIC_CUES = (("news", "news"), ("breaking", "news"), ("finance", "finance"),
              ("financial", "finance"), ("market", "finance"), ("stock", "finance"))
# Visual-topic cues that switch image collection on.
VISUAL_CUES = ("image", "images", "chart", "charts", "diagram", "diagrams", "photo",
               "photos", "map", "maps", "graph", "graphs", "infographic",
               "screenshot", "visual", "architecture")
# Multi-angle fan-out: primary, a specific aspect, alternative wording.
ANGLES = (("primary", ""), ("aspect", " analysis"), ("alternative", " overview"))
# ---------------------------------------------------------------------------

_RANGE_WIDTH = {"day": 1, "week": 7, "month": 30, "year": 365}


def build_search_params(requests: DataFrame) -> DataFrame:
    """Q1: request columns -> the parameter set sent to the search backend.

    top_k null -> 5; max_results = min(top_k, 50) with no lower bound;
    time_range kept only when valid; topic/search_depth passed through
    unvalidated; image flags only when include_images is true; answer and
    raw content always off.
    """
    top_k = F.coalesce(F.col("top_k").cast("bigint"), F.lit(DEFAULT_TOP_K).cast("bigint"))
    images_on = F.col("include_images") == F.lit(True)
    return requests.select(
        "query_id", "query",
        F.least(top_k, F.lit(MAX_RESULTS_CAP).cast("bigint")).alias("max_results"),
        F.col("topic"), F.col("search_depth"),
        F.when(F.col("time_range").isin(*VALID_TIME_RANGES), F.col("time_range")).alias("time_range"),
        F.when(images_on, F.lit(True)).alias("include_images"),
        F.when(images_on, F.lit(True)).alias("include_image_descriptions"),
        F.lit(False).alias("include_answer"),
        F.lit(False).alias("include_raw_content"),
    )


def expand_queries(requests: DataFrame, angles=ANGLES) -> DataFrame:
    """Q2: primary + aspect + alternative wording for every request.

    The angle table is a literal array exploded per row: a generator, not a
    join, so it adds no shuffle and no broadcast.
    """
    angle_arr = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(s).alias("suffix"))
                          for a, s in angles])
    return (requests
            .select("*", F.posexplode(angle_arr).alias("angle_pos", "a"))
            .select(*[c for c in requests.columns if c != "query"],
                    F.col("a.angle").alias("angle"),
                    F.col("angle_pos").cast("bigint").alias("angle_pos"),
                    F.concat(F.col("query"), F.col("a.suffix")).alias("query")))


def infer_time_range(requests: DataFrame, cues=TIME_CUES, col: str = "query") -> DataFrame:
    """Q3: the narrowest time window whose cue word occurs in the query.

    "historical" alone means no window; no cue at all also gives null.
    """
    toks = tokenize(col)
    width = F.least(*[F.when(F.array_contains(toks, cue),
                             F.lit(_RANGE_WIDTH.get(rng, 10 ** 6)))
                      for cue, rng in cues])
    by_width = {w: r for r, w in _RANGE_WIDTH.items()}
    out = F.lit(None).cast("string")
    for w, r in sorted(by_width.items(), reverse=True):
        out = F.when(width == w, F.lit(r)).otherwise(out)
    return requests.withColumn("inferred_time_range", out)


def infer_topic(requests: DataFrame, cues=TOPIC_CUES, col: str = "query") -> DataFrame:
    """Q4: news / finance by cue word (first rule wins), else general."""
    toks = tokenize(col)
    out = F.lit("general")
    for cue, topic in reversed(cues):
        out = F.when(F.array_contains(toks, cue), F.lit(topic)).otherwise(out)
    return requests.withColumn("inferred_topic", out)


def wants_images(requests: DataFrame, cues=VISUAL_CUES, col: str = "query") -> DataFrame:
    """Q5: include_images when the request already asks for it or any visual cue occurs."""
    cue_hit = F.arrays_overlap(tokenize(col), F.array(*[F.lit(c) for c in cues]))
    asked = F.coalesce(F.col("include_images"), F.lit(False)) if "include_images" in requests.columns else F.lit(False)
    return requests.withColumn("wants_images", asked | F.coalesce(cue_hit, F.lit(False)))


def detect_script(df: DataFrame, col: str = "query") -> DataFrame:
    """Q6: a query with any Han character gets a Chinese report, else English."""
    return df.withColumn("report_lang", F.when(has_han(col), F.lit("zh")).otherwise(F.lit("en")))
