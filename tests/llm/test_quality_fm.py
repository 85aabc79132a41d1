import numpy as np
import pyarrow as pa

from panelforge.llm import quality_fm

from .helpers import documents


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sum_of_squares_is_every_pair():
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, 4)))
    index, value = np.array([3, 900, 4100]), np.array([0.5, -1.0, 2.0])
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(3) for j in range(i + 1, 3))
    assert np.isclose(m.raw(1, np.zeros(3, int), index, value)[0], 0.3 + m.w[index] @ value + pairs)


def test_texts_are_scored_alone():
    texts = pa.array(["one two three", None, "", "x" * 5000, "!!! ??? " * 40, "é ü word word"])
    m = quality_fm.Machine(0.0, np.linspace(-1, 1, quality_fm.FEATURES), np.full((quality_fm.FEATURES, 2), 0.1))
    all_at_once = m.scores(texts, pa.nulls(6, pa.float64()))
    one_by_one = [m.scores(texts.slice(i, 1), pa.nulls(1, pa.float64()))[0] for i in range(6)]
    assert np.allclose(all_at_once, one_by_one)


def test_learns_and_scores_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_fm.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_held_out_labels_are_not_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    assert quality_fm.score(docs, labels).orderBy("doc_id").collect() == quality_fm.score(docs, flipped).orderBy("doc_id").collect()


def test_odd_rows_and_labels(spark):
    docs = documents(spark, [(1, None, "a"), (2, "", None), (2, "", None), (3, "z " * 100000, "b"), (None, "text", "c")])
    for labels in (labelled(spark, []), labelled(spark, [(2, 1, 0), (3, 1, 0), (4, None, 1)]), labelled(spark, [(2, 1, 0), (3, 0, 0), (3, 0, 1)])):
        got = quality_fm.score(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_fm.stage(docs, labelled(spark, [])).columns == docs.columns
    assert quality_fm.score(documents(spark, []), labelled(spark, [])).count() == 0


def slow_fit(rows, seed=7):
    """The same draws and steps, feature by feature."""
    rng, n = np.random.default_rng(seed), len(rows)
    label = [r[2] for r in rows]
    share = sum(label) / n
    bias, w, v = float(np.log(share / (1 - share))), {}, rng.normal(0, 0.05, (quality_fm.FEATURES, quality_fm.RANK))
    seen_w, seen_v, seen_b = {}, np.full(v.shape, 1e-4), 1e-4
    for _ in range(quality_fm.EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            some, g_w, g_v, g_b = order[at : at + 64], {}, {}, 0.0
            for i in some:
                index, value, y = rows[i]
                x = dict(zip(index.tolist(), value.astype(float).tolist(), strict=True))
                sums = sum(v[j] * a for j, a in x.items())
                raw = bias + sum(w.get(j, 0.0) * a for j, a in x.items()) + 0.5 * (sums @ sums - sum((v[j] * a) @ (v[j] * a) for j, a in x.items()))
                slope = (1 / (1 + np.exp(-raw)) - y) / len(some)
                g_b += slope
                for j, a in x.items():
                    g_w[j] = g_w.get(j, 0.0) + slope * a
                    g_v[j] = g_v.get(j, 0.0) + slope * a * (sums - v[j] * a)
            for j in g_w:
                a, b = g_w[j] + quality_fm.PENALTY * w.get(j, 0.0), g_v[j] + quality_fm.PENALTY * v[j]
                seen_w[j] = seen_w.get(j, 1e-4) + a**2
                seen_v[j] += b**2
                w[j] = w.get(j, 0.0) - quality_fm.RATE * a / np.sqrt(seen_w[j])
                v[j] = v[j] - quality_fm.RATE * b / np.sqrt(seen_v[j])
            seen_b += g_b**2
            bias -= quality_fm.RATE * g_b / np.sqrt(seen_b)
    return bias, w, v


def test_fit_against_plain_loops():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(90):
        index = np.sort(rng.choice(200, rng.integers(1, 9), replace=False))
        rows.append((index, rng.normal(size=len(index)).astype(np.float32), int(rng.random() < 0.4)))
    got = quality_fm.fit(rows)
    bias, w, v = slow_fit(rows)
    assert np.isclose(got.bias, bias, atol=1e-6)
    assert np.allclose(got.w, [w.get(j, 0.0) for j in range(quality_fm.FEATURES)], atol=1e-5) and np.allclose(got.v, v, atol=1e-5)


def test_statistics_against_plain_counts():
    texts = ["One two, TWO; three! three\n4 5 é", "", "   ", "x" * 50, "a-b #c\n\n?!"]
    for text in texts:
        (_, _, _, index, value), *_ = quality_fm.features(pa.array([text]), pa.nulls(1, pa.float64()))
        got = dict(zip(index.tolist(), value.tolist(), strict=True))
        raw, words = text.encode(), text.lower().split()
        n, m = max(len(raw), 1), max(len(words), 1)
        count = lambda f: sum(1 for b in raw if f(b))
        upper, lower, wide = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: b >= 128)
        letters, symbol = max(upper + lower + wide, 1), count(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?!")
        want = [1, np.log1p(len(raw)) / 10, np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, len(set(words)) / m, min(letters / m / 10, 2), upper / letters, count(lambda b: 48 <= b <= 57) / n * 4]
        want += [count(lambda b: chr(b) in ".,;:?") / m * 2, min(text.count("!") / m, 2), min(symbol / m, 2), min(symbol / n * 4, 2), wide / n, min(text.count("\n") / m * 10, 2), float(not words), float(len(words) < 30)]
        assert np.allclose([got[quality_fm.BUCKETS + i] for i in range(16)], want, atol=1e-6), text


def test_a_labelled_id_on_many_rows_is_one_row_of_the_sample(spark):
    docs = documents(spark, [(1, f"some text {i}", "a") for i in range(300)] + [(2, "bad words", "a"), (3, "other words", "a")])
    labels = labelled(spark, [(1, 1, 0), (2, 0, 1), (3, 1, 0)])
    one = documents(spark, [(2, "bad words", "a"), (3, "other words", "a"), (1, min((f"some text {i}" for i in range(300)), key=lambda t: _hash(spark, t)), "a")])
    a, b = quality_fm.trained(docs, labels, usable=labels["doc_id"] > 0), quality_fm.trained(one, labels, usable=labels["doc_id"] > 0)
    assert np.allclose(a.w, b.w) and a.bias == b.bias


_hashes = {}


def _hash(spark, text):
    if not _hashes:
        _hashes.update({r.t: r.h for r in spark.range(300).selectExpr("concat('some text ', id) as t", "xxhash64(concat('some text ', id)) as h").collect()})
    return _hashes[text]


def test_the_driver_keeps_four_bytes_a_feature(spark, monkeypatch):
    seen, fit = [], quality_fm.fit
    monkeypatch.setattr(quality_fm, "fit", lambda rows: seen.extend(rows) or fit(rows))
    docs = documents(spark, [(i, f"one two w{i} {'good' if i % 2 else 'bad'}", "s") for i in range(60)])
    model = quality_fm.trained(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    assert seen and all(at.itemsize + value.itemsize == 4 for at, value, _ in seen)
    wide = fit([(at.astype(np.int64), value.astype(np.float32), label) for at, value, label in seen])
    assert model.bias == wide.bias and (model.w == wide.w).all() and (model.v == wide.v).all()
