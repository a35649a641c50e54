"""Vectors of texts by signed projections."""

import numpy as np

from clausewise.functions.embed import SignedProjection, embed


def test_vectors_of_odd_texts(spark):
    rows = [(1, "a b b"), (2, "B a b"), (3, None), (4, ""), (5, "..."), (6, "other words")]
    got = {r.id: r.vector for r in embed(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert got[1] == got[2] and len(got[1]) == 256 and got[3] is None and got[4] is None and got[5] is None
    p = SignedProjection()
    assert np.allclose(got[1], p.signs("a") + (1 + np.log(2)) * p.signs("b").astype(float))
    assert abs(np.dot(got[1], got[6])) < np.dot(got[1], got[1])
    assert embed(spark.createDataFrame([], "id int, t string"), "t").count() == 0
