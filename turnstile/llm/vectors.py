"""Vectors as rows: validity, exact copies, cosine in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of little-endian floats or doubles as a matrix of doubles."""
    rows = column.to_pylist()
    kind = "<f4" if len(rows[0]) == 4 * dims else "<f8"
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(-1, dims).astype(float)


def vector_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """``vec_id, label, dims, vec, digest`` of every row; ``vec`` (little-endian
    floats where the column holds floats, else doubles) is null where the vector is null, empty, zero, or holds a
    null or a component that is not finite.  Equal vectors have equal
    digests; -0.0 counts as 0.0."""
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    single = df.schema[vec_col].dataType == T.ArrayType(T.FloatType())
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"),
                    F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("dims", T.IntegerType()), T.StructField("vec", T.BinaryType()),
                           T.StructField("digest", T.BinaryType())])

    kind = "<f4" if single else "<f8"

    def run(batches):
        for batch in batches:
            col = batch.column("vec")
            values = pc.fill_null(col.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            vecs, digests = [], []
            for end, n in zip(ends.tolist(), sizes.tolist()):
                own = values[end - n:end] + 0.0
                wide = own.astype(float)
                good = n > 0 and bool(np.isfinite(own).all()) and 0 < float((wide * wide).sum()) < np.inf
                vecs.append(own.astype(kind).tobytes() if good else None)
                digests.append(hashlib.blake2b(vecs[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(sizes.astype(np.int32)),
                 pa.array(vecs, pa.binary()), pa.array(digests, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed in component order, so that equal
    pairs give equal results wherever they are computed."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows."""
    return np.clip(sequential_dot(a, b) / np.sqrt(sequential_dot(a, a) * sequential_dot(b, b)), -1.0, 1.0)
