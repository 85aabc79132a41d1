import numpy as np
import pyarrow as pa

from panelforge.llm import toxicity

from .helpers import documents


def test_sequences_see_one_text_only():
    data = np.frombuffer(b"Abcab", np.uint8)
    got = toxicity.sequences(data, np.array([0, 3, 5]))
    text = lambda x: int(x).to_bytes(4, "big").decode()
    assert [text(x) for x in got] == ["   a", "  ab", " abc", "   a", "  ab"]


def test_probabilities_of_seen_bytes_stay_below_one():
    data = np.frombuffer(b"the cat sat on the mat and the dog sat on the log", np.uint8)
    keys, counts = np.unique(toxicity.sequences(data, np.array([0, len(data)])), return_counts=True)
    p, contexts, back = toxicity._interpolated(keys, counts.astype(float), np.full(len(keys), 1 / 256))
    by = np.bincount(np.searchsorted(contexts, keys >> np.uint64(8)), weights=p)
    assert (p > 0).all() and (by <= 1 + 1e-9).all() and (by + back > 0.9).all()


def test_learns_and_scores_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.96
    assert got.loc[got["toxic"] == 1, "predicted"].mean() > 0.8
    assert got.loc[got["toxic"] == 0, "predicted"].mean() < 0.03


def test_held_out_labels_are_not_read(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (toxicity.score(docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.allclose(a, b)


def test_odd_rows_and_labels(spark):
    docs = documents(spark, [(1, None, "a"), (2, "", None), (2, "", None), (3, "z " * 100000, "b"), (None, "text", "c"), (6, "bad words", "a"), (7, "good words", "a")])
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for labels in (table([]), table([(2, 1, 1), (3, 1, 1)]), table([(i, 1, i % 2) for i in range(1, 8)] + [(9, 0, None)])):
        got = toxicity.score(docs, labels).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(documents(spark, []), table([])).count() == 0


def test_texts_are_scored_alone():
    def table(keys, top):
        t = toxicity.kneser_ney(keys, np.ones(len(keys)), np.arange(len(keys)) % 2 * 1.0, top)
        t.ratio = t.ratio.astype(np.float32)
        return t.indexed()

    data, off = np.frombuffer(b"abcdabce xyz", np.uint8), np.array([0, 12])
    words = np.unique(toxicity.sequences_in_words(data, off))
    model = toxicity.Model((table(np.unique(toxicity.sequences(data, off)), 4), table(words[words > 0], 7)))
    texts = pa.array(["abcd" * 30, None, "", "zzz", "é" * 40, "xyz abc"])
    assert np.allclose(model.inputs(texts), np.concatenate([model.inputs(texts.slice(i, 1)) for i in range(6)]))


def test_sequences_in_words_see_one_word_only():
    data = np.frombuffer(b"Ab cd, abcdefgh!ij", np.uint8)
    text = lambda x: int(x).to_bytes(7, "big").decode()
    got = toxicity.sequences_in_words(data, np.array([0, 4, 16, 18]))
    words = [(0, "ab"), (3, "c"), (4, "d"), (7, "abcdefgh"), (16, "ij")]
    want = {at + i: f"      {w[: i + 1]}"[-7:] for at, w in words for i in range(len(w))}
    assert {i: text(x) for i, x in enumerate(got) if x} == want


def slow_kneser_ney(counts, top):
    """(toxic over ordinary, by sequence and for an unseen byte by context), with dictionaries of tuples."""
    levels = {top: set(counts)}
    for n in range(top - 1, 0, -1):
        levels[n] = {s[1:] for s in levels[n + 1]}

    def parts(own, of):
        total, kinds = {}, {}
        for s in own:
            total[s[:-1]] = total.get(s[:-1], 0) + of[s]
            kinds[s[:-1]] = kinds.get(s[:-1], 0) + (of[s] > 0)
        ones, twos = sum(of[s] == 1 for s in own), sum(of[s] == 2 for s in own)
        d = ones / (ones + 2 * twos) if ones else 0.5
        back = {c: d * kinds[c] / total[c] if total[c] else 1.0 for c in total}
        return total, d, back

    lower = None
    for n in range(1, top):
        of = {s: sum(s == t[1:] for t in levels[n + 1]) for s in levels[n]}
        total, d, back = parts(levels[n], of)
        lower = {s: max(of[s] - d, 0) / max(total[s[:-1]], 1) + back[s[:-1]] * (1 / 256 if n == 1 else lower[s[1:]]) for s in levels[n]}
    both = {s: a + b for s, (a, b) in counts.items()}
    total, d, back = parts(levels[top], both)
    shared = {s: max(both[s] - d, 0) / max(total[s[:-1]], 1) + back[s[:-1]] * lower[s[1:]] for s in counts}
    p, spare = [], []
    for kind in (0, 1):
        sums, lost = {}, {}
        for s in counts:
            sums[s[:-1]] = sums.get(s[:-1], 0) + counts[s][kind]
            lost[s[:-1]] = lost.get(s[:-1], 0) + min(counts[s][kind], toxicity.DISCOUNT)
        left = {c: lost[c] / sums[c] if sums[c] else 1.0 for c in sums}
        p.append({s: (counts[s][kind] - min(counts[s][kind], toxicity.DISCOUNT)) / max(sums[s[:-1]], 1) + left[s[:-1]] * shared[s] for s in counts})
        spare.append(left)
    return {s: np.log(p[0][s] / p[1][s]) for s in counts}, {c: np.log(max(spare[0][c], 1e-6) / max(spare[1][c], 1e-6)) for c in spare[0]}


def test_kneser_ney_against_dictionaries():
    rng = np.random.default_rng(4)
    for top in (2, 3, 4, 7):
        counts = {}
        for kind, n in ((0, 150), (1, 400)):
            text = rng.choice([97, 98, 99, 100], n, p=[0.5, 0.3, 0.1, 0.1]).tolist()
            for i in range(n - top):
                counts.setdefault(tuple(text[i : i + top]), [0, 0])[kind] += 1
        number = lambda s: int.from_bytes(bytes(s), "big")
        order = sorted(counts, key=number)
        got = toxicity.kneser_ney(np.array([number(s) for s in order], np.uint64), *(np.array([counts[s][k] for s in order], float) for k in (0, 1)), top)
        ratio, unseen = slow_kneser_ney(counts, top)
        assert np.allclose(got.ratio, [ratio[s] for s in order])
        assert np.allclose(got.unseen, [unseen[c] for c in sorted(unseen, key=number)])


def test_windows_and_means_against_plain_loops():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abc "), 90))
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, 90])
    table = toxicity.kneser_ney(np.unique(toxicity.sequences(data, off))[::2], rng.integers(0, 5, 90)[: len(np.unique(toxicity.sequences(data, off))[::2])].astype(float), rng.integers(1, 5, 90)[: len(np.unique(toxicity.sequences(data, off))[::2])].astype(float))
    table.ratio = table.ratio.astype(np.float32)
    model = toxicity.Model((table.indexed(), toxicity.kneser_ney(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 7)))
    each = table.ratios(toxicity.sequences(data, off)).astype(float)
    windows = [sum(each[lo : lo + 16]) for lo in range(0, 90, 8)]
    best = max(range(len(windows)), key=lambda i: (windows[i], -i))
    second = max(w for i, w in enumerate(windows) if abs(i - best) > 1)
    assert np.allclose(model.inputs(pa.array([text]))[0], [each.mean(), windows[best] / 16, second / 16, 0, 0, 0, np.log1p(len(windows))])


def test_a_labelled_id_on_many_rows_is_one_row_of_the_sample(spark):
    docs = documents(spark, [(1, f"some text {i}", "a") for i in range(300)] + [(2, "bad words", "a"), (3, "other words", "a"), (4, "bad things", "a")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == 303
