import numpy as np
import pytest

from panelforge.llm import cosine_dedup

from .helpers import duck, same

SCHEMA = "vec_id long, embedding array<{}>, label int, own double, cid int, component double, links string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 0.5, 1, 2.5, "x") for i, v in rows], SCHEMA.format(kind))


def clouds(rng, centres, size, dim, noise):
    out = []
    for c in range(centres):
        centre = rng.normal(size=dim)
        out += [centre + noise * rng.normal(size=dim) for _ in range(size)]
    return [v.tolist() for v in out]


def brute(rows, least=0.95):
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    least_of = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(rows[i][0], links[i], least_of[group[i]], rows[i][0] == least_of[group[i]]) for i in range(len(rows))]


def held(got):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=key)


def test_matches_brute_force_and_sql_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(clouds(rng, 12, 14, 16, 0.2)))
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(500 + i, rows[5][1]) for i in range(40)] + [(600, [2 * c for c in rows[5][1]]), (7, rows[9][1]), (7, rows[30][1]), (None, rows[2][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [float("inf")] * 16), (705, [None] + [1.0] * 15), (706, rows[5][1][:8]), (707, rows[5][1][:8]), (None, None)]
    df = table(spark, rows)
    got = cosine_dedup.groups(df)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert held(got) == sorted(brute(rows), key=key)
    same(got, duck(cosine_dedup.SQL, embeddings=df))


def test_blocks_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(cosine_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = list(enumerate(clouds(rng, 2, 150, 12, 0.22)))
    assert held(cosine_dedup.groups(table(spark, rows, "double"))) == sorted(brute(rows))


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosines from 0.95 to 0.951: at least 0.99 of their links are found (the miss is one in a million by design)."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + 0.001 * (i + 1) / 601
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r for r in cosine_dedup.groups(table(spark, rows, "double")).collect()}
    assert sum(got[2 * i + 1].component_id == 2 * i for i in range(600)) >= 594


def test_extreme_values_and_chains(spark):
    """Squares of these components overflow or vanish; the chain links neighbours only."""
    angle = np.deg2rad(15.0)
    rows = [(i, [10.0 ** (300 if i % 2 else -300) * np.cos(i * angle), 10.0 ** (300 if i % 2 else -300) * np.sin(i * angle)]) for i in range(12)]
    got = held(cosine_dedup.groups(table(spark, rows, "double")))
    assert got == [(i, 1 if i in (0, 11) else 2, 0, i == 0) for i in range(12)]


def test_parameters_follow_the_number_of_vectors():
    few, many = cosine_dedup.parameters(500), cosine_dedup.parameters(10**9)
    assert few[0] == 8 and many[0] == 22
    for bits, tables in (few, many):
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= 1e-6
    with pytest.raises(ValueError, match="least cosine"):
        cosine_dedup.parameters(5, 0.0)


def test_empty(spark):
    assert cosine_dedup.groups(table(spark, [])).collect() == []
