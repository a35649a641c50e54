"""``semantic_topk`` asks every vector, and equals its SQL."""

import math
import random

import duckdb
import pytest

from clausewise.operators import nearest
from clausewise.queries import QUERIES, SQL

KIND = "vec_id long, embedding array<float>, label int"


def both(spark, path, rows):
    """What the query and its SQL give; a NaN as text, since it equals nothing."""
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    columns = ["query_id", "vec_id", "rank", "score"]
    plain = lambda found: sorted(str([str(x) if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x for x in r]) for r in found)
    return plain(QUERIES["semantic_topk"](spark, str(path)).select(*columns).collect()), plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL['semantic_topk']})").fetchall())


def drawn(n, dims, seed, values=None):
    rng = random.Random(seed)
    return [[float(rng.choice(values)) if values else rng.gauss(0, 1) for _ in range(dims)] for _ in range(n)]


def test_every_vector_is_asked(spark, tmp_path):
    rows = [(k, v, 0) for k, v in enumerate(drawn(250, 8, 1))]
    got, want = both(spark, tmp_path, rows)
    assert got == want and len(got) == 250 * 18
    assert {r.query_id for r in QUERIES["semantic_topk"](spark, str(tmp_path)).select("query_id").collect()} == set(range(250))


def test_ties_of_many_tasks_and_blocks(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 16), ("LEAST", 20)):
        monkeypatch.setattr(nearest, name, value)
    rows = [(k, v, 0) for k, v in enumerate(drawn(300, 3, 2, (-1, 0, 1)))]
    got, want = both(spark, tmp_path, rows)
    assert got == want


def test_halves_of_the_last_digit(spark, tmp_path):
    """1 / 128 has a half after its sixth digit."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0], 0), (2, [1.0, 127.0, 15.0, 5.0, 2.0], 0), (3, [-1.0, 127.0, 15.0, 5.0, 2.0], 0)]
    got, want = both(spark, tmp_path, rows)
    assert got == want and "[1, 2, 2, 0.007813]" in got


@pytest.mark.parametrize("odd", [1, 30])
def test_vectors_without_direction_and_ids_that_repeat(spark, tmp_path, odd):
    strange = [[0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], None]
    rows = [(k % 70 if k % 9 else None, v, 0) for k, v in enumerate(drawn(100, 2, 4))]
    rows += [(100 - k, v, 0) for k in range(odd) for v in strange]
    got, want = both(spark, tmp_path, rows)
    assert got == want


def test_copies_few_rows_and_none(spark, tmp_path):
    for k, rows in enumerate(([(k, [1.0, 2.0], 0) for k in range(90)], [(7, [1.0, 2.0], 0), (3, [-1.0, 0.5], 0)], [(1, None, 0), (2, [], 0)], [])):
        got, want = both(spark, tmp_path / str(k), rows)
        assert got == want
