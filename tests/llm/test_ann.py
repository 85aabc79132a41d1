import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import ann

from .helpers import duck, same

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, vb int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 1, 0.5) for i, v in rows], SCHEMA)


def search(df, **options):
    return ann.nearest(df, F.col("vec_id") % 100 == 0, **options)


def test_matches_sql_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(100, [0.5] * 8), (100, [0.5] * 8), (900, rows[3][1])]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [float("inf")] * 8), (2500, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = table(spark, [r for r in rows if r[0] not in (100,)] + [(100, [0.5] * 8)])
    same(search(df, q_block=3, v_block=64), duck(ann.SQL, embeddings=df))


def test_repeated_ids_are_candidates_by_row_and_queries_once(spark):
    got = search(table(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 5), (0, 2, 5)]


def test_other_lengths_never_meet_and_fewer_candidates_are_all_given(spark):
    got = search(table(spark, [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0, 0.0]), (100, [1.0, 1.0, 1.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (100, 1, 2, 2**0.5)]


def test_empty(spark):
    assert search(table(spark, [])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(30, 16)), np.concatenate([rng.normal(size=(500, 16)), np.full((20, 16), 1e-3)])
    holds_nearest(q, v)


def holds_nearest(q, v, k=10):
    row, at, lower, upper = ann.bounds(ann.quantise(q), ann.quantise(v), lambda i, j: np.zeros(np.broadcast(i, j).shape, bool), k)
    for i in range(len(q)):
        d = ann.distances(np.broadcast_to(q[i], v.shape), v)
        mine = row == i
        assert set(np.lexsort((np.arange(len(v)), d))[:k].tolist()) <= set(at[mine].tolist())
        assert (lower[mine] <= d[at[mine]]).all() and (d[at[mine]] <= upper[mine]).all()


def test_bounds_hold_in_many_dimensions():
    """Signs times a scale: quantised without error, so only the room for rounding is left."""
    for dim in (1024, 1040, 2048, 4096):
        for seed in range(6):
            rng = np.random.default_rng([dim, seed])
            sign = rng.choice([-1.0, 1.0], dim)
            holds_nearest(sign[None, :], sign[None, :] * (1 + np.arange(400) * 1e-9)[rng.permutation(400), None])


def test_long_vectors_match_the_plain_distances(spark):
    rng = np.random.default_rng(7)
    sign = rng.choice([-1.0, 1.0], 2048)
    rows = [(i, (sign * (1 + ((i * 37) % 200) * 1e-9)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    got = search(df).collect()
    for query in (0, 100):
        d = ann.distances(np.broadcast_to(x[query], x.shape), x)
        d[query] = np.inf
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)] == np.lexsort((np.arange(200), d))[:10].tolist()


def test_an_id_with_many_vectors_sets_them_all_aside(spark):
    rng = np.random.default_rng(8)
    rows = [(100, rng.normal(size=4).round(3).tolist()) for _ in range(60)] + [(i, (rng.normal(size=4) + 5).round(3).tolist()) for i in range(1, 30)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and all(r.vec_id != 100 for r in got)


def test_squares_that_overflow_take_part(spark):
    rows = [(0, [1e200, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and all(r.score == float("inf") for r in got)


def test_repeated_query_rows_among_many_copies_match_sql(spark):
    rng = np.random.default_rng(6)
    same_vector = [0.5] * 8
    for repeats in (2, 11, 25):
        rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(1, 40)]
        rows += [(100, same_vector)] * repeats + [(101 + i, same_vector) for i in range(40)]
        df = table(spark, rows)
        same(search(df), duck(ann.SQL, embeddings=df))
