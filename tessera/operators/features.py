"""Text features: hashed TF-IDF vectors of unit length.

A token's dimension is its CRC-32 modulo ``dims``, so there is no vocabulary to build or ship.  Texts
are tokenised once, into arrays of dimensions that are written; from these come the document
frequencies (one number for each dimension, combined map-side) and the vectors, row by row.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.session import materialize

DIMS = 512
#: rows whose counts are held as a dense matrix at a time
ROWS = 1024


def token_dims(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """(id, dims array<int>): the dimension of every token of a text; null and empty texts have none."""
    dim = F.transform(tokenize(text_col), lambda t: (F.crc32(t.cast("binary")) % dims).cast("int"))
    return df.select(id_col, F.coalesce(dim, F.array().cast("array<int>")).alias("dims"))


@dataclass(frozen=True)
class TfIdf:
    """Inverse document frequencies of the dimensions, fitted on a corpus."""
    idf: tuple[float, ...]

    @staticmethod
    def fit(tokens: DataFrame, dims: int = DIMS) -> "TfIdf":
        """ln((n + 1) / (df + 1)) from rows of :func:`token_dims`; ``dims`` + 1 numbers reach the driver."""
        n = tokens.count()
        df = (tokens.select(F.explode_outer(F.array_distinct("dims")).alias("dim")).where("dim is not null")
              .groupBy("dim").agg(F.count(F.lit(1)).alias("df")).collect())
        counts = np.zeros(dims)
        counts[[r.dim for r in df]] = [r.df for r in df]
        return TfIdf(tuple(np.log((n + 1) / (counts + 1)).tolist()))

    def transform(self, tokens: DataFrame, id_col: str) -> DataFrame:
        """(id, features array<double>): (1 + ln tf) * idf, divided by the norm; null where all are zero."""
        idf, dims = np.array(self.idf), len(self.idf)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    b = batch.slice(lo, ROWS)
                    lists = b.column(1)
                    sizes = np.diff(lists.offsets.to_numpy())
                    rows = np.repeat(np.arange(b.num_rows), sizes)
                    at = rows * dims + lists.flatten().to_numpy(zero_copy_only=False)
                    tf = np.bincount(at, minlength=b.num_rows * dims).reshape(b.num_rows, dims).astype(float)
                    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
                    norm = np.sqrt((w * w).sum(1))
                    w /= np.where(norm > 0, norm, 1)[:, None]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dims, pa.int32()), pa.array(w.ravel()),
                                                      mask=pa.array(norm <= 0))
                    yield pa.RecordBatch.from_arrays([b.column(0), values], [id_col, "features"])
        kind = tokens.schema[id_col].dataType.simpleString()
        return tokens.select(id_col, "dims").mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def text_features(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> tuple[DataFrame, TfIdf]:
    """Feature rows (id, features) of a corpus, and the fitted frequencies for other texts (requests)."""
    tokens = materialize(token_dims(df, id_col, text_col, dims), "token-dims")
    model = TfIdf.fit(tokens, dims)
    return model.transform(tokens, id_col), model
