"""Cosine similarity of embedding columns."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_similarity(a: Column, b: Column) -> Column:
    """Between two array columns of equal length; null if either has no length or none of the elements."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def cosine_distance_to(embedding: Column, query: list[float]) -> Column:
    """Distance of every row's vector to one fixed vector, computed per Arrow batch.

    Rows whose vector is missing, of another dimension, or zero get null.
    """
    import numpy as np

    target = np.asarray(query, dtype="float64")
    length = float(np.sqrt(target @ target))
    size = len(target)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        fits = pa.compute.equal(pa.compute.list_value_length(vectors), size)
        fits = np.asarray(pa.compute.fill_null(fits, False))
        out = np.full(len(vectors), np.nan)
        rows = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype("float64")
        rows = rows.reshape(-1, size)
        norms = np.sqrt((rows * rows).sum(axis=1)) * length
        with np.errstate(divide="ignore", invalid="ignore"):
            out[fits] = np.where(norms > 0, 1.0 - (rows @ target) / norms, np.nan)
        return pa.array(out, mask=np.isnan(out))

    return distance(embedding)
