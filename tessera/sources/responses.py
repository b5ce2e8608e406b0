"""Search responses as JSON text <-> result rows.

Parsing goes through VARIANT (``try_parse_json``) rather than a typed
``from_json`` schema: a typed schema nulls the whole ``results`` array when a
single element is a string or number, and cannot tell bad JSON from ``{}``.
Everything is row-local (``posexplode`` of one response's array), so the
parse never shuffles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
ERR_BAD_JSON = "search failed: invalid JSON response"
ERR_NOT_OBJECT = "search failed: unexpected response type"
ERR_NOT_ITERABLE = "search failed: results is not iterable"
RESULT_FIELDS = ("url", "title", "content", "score", "published_date", "raw_content")
# -----------------------------------------------------------------------------


def _classify(df: DataFrame, json_col: str) -> DataFrame:
    """_kind: bad (not JSON), other (not an object), scalar_results
    (``results`` is a number or boolean: iterating it fails), object."""
    v = F.try_parse_json(F.col(json_col))
    res_type = F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.results", "variant"))
    scalar = ~(res_type.startswith("ARRAY") | res_type.startswith("OBJECT") | (res_type == "STRING")
               | (res_type == "VOID"))
    return (df.withColumn("_v", v)
            .withColumn("_kind", F.when(F.col("_v").isNull(), F.lit("bad"))
                        .when(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("other"))
                        .when(F.coalesce(scalar, F.lit(False)), F.lit("scalar_results"))
                        .otherwise(F.lit("object"))))


def parse_errors(df: DataFrame, json_col: str = "response", key: str = "query_id") -> DataFrame:
    """(key, error) for responses that are not JSON or not a JSON object."""
    c = _classify(df, json_col)
    return (c.filter(F.col("_kind") != "object")
            .select(key, F.when(F.col("_kind") == "bad", F.lit(ERR_BAD_JSON))
                    .when(F.col("_kind") == "scalar_results", F.lit(ERR_NOT_ITERABLE))
                    .otherwise(F.lit(ERR_NOT_OBJECT)).alias("error")))


def parse_results(df: DataFrame, json_col: str = "response", key: str = "query_id") -> DataFrame:
    """Result rows of valid responses, in array order.

    ``results: null`` or missing -> no rows and no error; elements that are
    not objects are dropped before ranking.  Adds boolean ``has_<field>``
    key-presence columns (an explicit JSON null still counts as present).
    """
    c = _classify(df, json_col).filter(F.col("_kind") == "object")
    arr = F.try_variant_get(F.col("_v"), "$.results", "array<variant>")
    objs = F.filter(arr, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    ex = c.select(key, F.posexplode(objs).alias("_pos", "_e"))
    sel = [key, (F.col("_pos") + 1).cast("bigint").alias("rank")]
    for f in RESULT_FIELDS:
        t = "double" if f == "score" else "string"
        sel.append(F.try_variant_get(F.col("_e"), f"$.{f}", t).alias(f))
    for f in ("url", "title", "content"):
        sel.append(F.try_variant_get(F.col("_e"), f"$.{f}", "variant").isNotNull().alias(f"has_{f}"))
    out = ex.select(*sel)
    return out.withColumn("has_snippet", F.col("has_content"))


def parse_responses(df: DataFrame, json_col: str = "response", key: str = "query_id"):
    """-> (results, errors)."""
    return parse_results(df, json_col, key), parse_errors(df, json_col, key)


def results_to_json(results: DataFrame, key: str = "query_id",
                    fields=("url", "title", "snippet", "score", "published_date", "domain")) -> DataFrame:
    """S3: one JSON array per query, rank order kept, non-ASCII unescaped.

    The per-query array is bounded by max_results (<= 50 rows).
    """
    s = F.struct(F.col("rank"), *[F.col(f) for f in fields if f in results.columns])
    return (results.groupBy(key)
            .agg(F.array_sort(F.collect_list(s)).alias("_a"))
            .select(key, F.to_json(F.transform("_a", lambda x: x.dropFields("rank"))).alias("json")))
