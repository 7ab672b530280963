"""Vectors that hold NaN, or differ in length."""

import numpy as np
import pyarrow as pa
import pytest

from prismcat.operators.blocks import vector_array
from prismcat.operators.search import top_k_similar


def test_nan_takes_no_place(spark):
    stored = [("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", [float("nan"), 1.0]), ("d", [0.9, 0.1])]
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vec array<double>")
    hits = top_k_similar(queries, spark.createDataFrame(stored, "id string, vec array<double>"), k=2, threshold=0.0)
    assert sorted(r.stored_id for r in hits.collect()) == ["a", "d"]


def test_lengths_must_agree():
    assert vector_array(pa.chunked_array([[[1.0, 2.0], [3.0, 4.0]]])).shape == (2, 2)
    with pytest.raises(ValueError, match="3"):
        vector_array(pa.chunked_array([[[1.0, 2.0], [1.0, 2.0, 3.0]]]))
    assert np.isfinite(vector_array(pa.chunked_array([[[1.0]]]))).all()
