import random
import time

import numpy as np
import pyarrow as pa

from panelforge.llm import pseudo_lm
from panelforge.llm.common import word_hashes

from .helpers import documents


def test_scores_are_sums_of_two_sided_log_probabilities():
    net = pseudo_lm.Network.fresh(np.arange(pseudo_lm.VOCABULARY))
    ids, off = np.array([5, 9, 5, 700, 3, 3]), np.array([0, 4, 4, 6])
    total = net.token_scores(ids, off)
    pad = pseudo_lm.VOCABULARY
    for at, around in ((0, [pad, pad, 9, 5]), (2, [5, 9, 700, pad]), (4, [pad, pad, 3, pad])):
        hidden = np.tanh(net.bias + sum(net.embedding[c] * net.places[j] for j, c in enumerate(around)))
        logits = hidden @ net.out + net.out_bias
        want = logits[net.class_of[ids[at]]] - np.log(np.exp(logits).sum()) + net.within[ids[at]]
        assert np.isclose(total[at], want, atol=1e-4)
    probabilities = np.exp(net.within)
    assert np.allclose(np.bincount(net.class_of, weights=probabilities), 1)


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(8)
    net = pseudo_lm.Network.fresh(np.ones(pseudo_lm.VOCABULARY))
    context, wanted = rng.integers(0, 50, (256, 4)), rng.integers(0, pseudo_lm.CLASSES, 256)
    loss = lambda: -np.take_along_axis(net.log_class(net.hidden(context)), wanted[:, None], 1).mean()
    before, trainer = loss(), pseudo_lm.Trainer(net)
    for _ in range(30):
        trainer.step(context, wanted)
    assert loss() < before - 0.5


def test_ordered_text_scores_above_shuffled_text(spark):
    rng = random.Random(9)
    sentence = "the quick brown fox jumps over the lazy dog near the old river bank".split()
    rows = [(i, " ".join(sentence * 20), "s") for i in range(300)]
    shuffled = sentence * 20
    rng.shuffle(shuffled)
    rows += [(1000, " ".join(shuffled), "s"), (1001, None, "s"), (1002, " \n", "s"), (1003, "the quick " * 50000, "s"), (5, rows[5][1], "s")]
    got = {}
    for r in pseudo_lm.score(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0]["mean"] > got[1000][0]["mean"]
    assert got[1001][0].tokens == 0 and got[1001][0]["mean"] is None and got[1002][0].log_likelihood == 0
    assert got[1003][0].tokens == 100000
    assert len(got[5]) == 2 and got[5][0] == got[5][1]


def test_token_steps_keep_texts_apart():
    column = pa.array([np.array([1, 2], np.uint16).tobytes(), b"", np.array([7], np.uint16).tobytes()], pa.binary())
    assert [(lo, ids.tolist(), off.tolist()) for lo, ids, off in pseudo_lm.token_steps(column, 1)] == [(0, [1, 2], [0, 2]), (1, [7], [0, 0, 1])]
    assert sum(len(ids) for _, ids, _ in pseudo_lm.token_steps(column)) == 3


def test_empty(spark):
    assert pseudo_lm.score(documents(spark, [])).count() == 0


def table(spark, texts):
    return spark.createDataFrame([(bytearray(np.array(x, np.uint16).tobytes()),) for x in texts], "ids binary")


def test_every_position_is_a_target_once(spark, monkeypatch):
    ids, off, rounds, load = np.random.default_rng(3).integers(0, pseudo_lm.VOCABULARY, 200), np.array([0, 1, 4, 13, 200]), [], pseudo_lm.Network.load
    monkeypatch.setattr(pseudo_lm.Network, "load", lambda self, flat: rounds.append(len(rounds)) or load(self, flat))
    pseudo_lm.trained(table(spark, np.split(ids, off[1:-1])))
    assert sorted(i for turn in rounds for i in pseudo_lm.masked_at(ids, off, turn).tolist()) == list(range(200))


def test_shards_hold_every_copy(spark):
    texts = [[1, 2, 3]] * 50 + [[4], [5, 6]] + [[]] * 3
    got = pseudo_lm.sharded(table(spark, texts), 7).collect()
    assert sorted(t for r in got for t in documents_of(r)) == sorted(t for t in texts if t)
    assert len(got) == len({r.shard for r in got}) and sum([1, 2, 3] in documents_of(r) for r in got) > 3


def documents_of(row):
    return [x.tolist() for x in np.split(np.frombuffer(row.ids, np.uint16), np.frombuffer(row.ends, np.int64)[:-1])]


def test_the_number_of_shards_grows_with_the_root():
    assert [pseudo_lm.shards_of(n) for n in (1, 4000, 16001, 4 * 10**6, 10**12)] == [1, 1, 3, 32, 29803]


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))), "s") for i in range(400)] + [(1000 + i, "one two three", "s") for i in range(60)]
    scores = []
    for n in (1, 7, 32):
        rng.shuffle(rows)
        scores.append({r.doc_id: r.log_likelihood for r in pseudo_lm.score(documents(spark, rows).repartition(n)).collect()})
    for other in scores[1:]:
        assert all(np.isclose(other[i], x, rtol=1e-9, atol=1e-9) for i, x in scores[0].items())


def slow_step(net, sums, context, wanted):
    """One Adagrad step by plain loops over positions, classes and features."""
    n, grads = len(wanted), {name: np.zeros(getattr(net, name).shape) for name in net.NAMES}
    for c, w in zip(context, wanted, strict=True):
        total = net.bias.astype(float) + sum(net.embedding[i].astype(float) * net.places[j] for j, i in enumerate(c))
        h = np.tanh(total)
        e = np.exp(h @ net.out + net.out_bias)
        d = e / e.sum()
        d[w] -= 1
        d /= n
        grads["out"] += np.outer(h, d)
        grads["out_bias"] += d
        b = (net.out @ d) * (1 - h**2)
        grads["bias"] += b
        for j, i in enumerate(c):
            grads["places"][j] += b * net.embedding[i]
            grads["embedding"][i] += b * net.places[j]
    # the outputs move before the embeddings and places do, all by gradients at the step's beginning
    for name in net.NAMES:
        sums[name] = sums[name] + grads[name] ** 2
        getattr(net, name)[...] -= pseudo_lm.RATE * grads[name] / np.sqrt(sums[name])


def test_a_round_against_plain_loops(spark, monkeypatch):
    """Two shards, averaged by the positions they saw."""
    from copy import deepcopy

    monkeypatch.setattr(pseudo_lm, "EVERY", 1)
    monkeypatch.setattr(pseudo_lm, "TOKENS_A_SHARD", 20)
    rng = np.random.default_rng(12)
    texts = [rng.integers(0, 30, rng.integers(1, 12)).tolist() for _ in range(12)]
    tokenised = table(spark, texts)
    got = pseudo_lm.trained(tokenised)
    flat = np.concatenate([np.array(t) for t in texts])
    start = pseudo_lm.Network.fresh(np.bincount(flat, minlength=pseudo_lm.VOCABULARY))
    shards = int(np.ceil(np.sqrt(len(flat) / 20)))
    assert shards > 1
    by = {}
    for r in pseudo_lm.sharded(tokenised, shards).collect():
        by[r.shard] = [np.array(t) for t in documents_of(r)]
    total, seen = 0.0, 0
    for docs in by.values():
        net = deepcopy(start)
        sums = {name: np.full(getattr(net, name).shape, 1e-3) for name in net.NAMES}
        context, wanted = [], []
        for ids in docs:
            for i, x in enumerate(ids):
                context.append([ids[i + d] if 0 <= i + d < len(ids) else pseudo_lm.VOCABULARY for d in (-2, -1, 1, 2)])
                wanted.append(start.class_of[x])
        slow_step(net, sums, np.array(context), np.array(wanted))
        total, seen = total + net.flat() * len(wanted), seen + len(wanted)
    assert np.allclose(got.flat(), total / seen, atol=2e-5)


def test_classes_are_runs_of_equal_mass():
    counts = np.random.default_rng(2).integers(0, 50, pseudo_lm.VOCABULARY)
    counts[7] = 10**6
    net = pseudo_lm.Network.fresh(counts)
    order = sorted(range(pseudo_lm.VOCABULARY), key=lambda i: (-counts[i], i))
    whole, before = sum(c + 0.5 for c in counts), 0.0
    for i in order:
        middle = before + (counts[i] + 0.5) / 2
        assert net.class_of[i] in {min(int((middle + e) / whole * pseudo_lm.CLASSES), pseudo_lm.CLASSES - 1) for e in (-1e-3, 0, 1e-3)}
        before += counts[i] + 0.5


def test_words_of_one_id_keep_their_own_counts(spark):
    by = {}
    for i in range(100000):
        data = np.frombuffer(f"w{i}".encode(), np.uint8)
        key = int(word_hashes(data, np.array([0, len(data)]))[0][0] >> np.uint64(64 - pseudo_lm.VOCABULARY_BITS))
        if key in by:
            common, rare = by[key], f"w{i}"
            break
        by[key] = f"w{i}"
    rows = [(0, common, "s"), (1, rare, "s")] + [(2 + i, common, "s") for i in range(98)]
    for head in (pseudo_lm.HEAD, 1, 0):
        got = {r.doc_id: r.log_likelihood for r in pseudo_lm.score(documents(spark, rows), head).collect()}
        assert np.isclose(got[0] - got[1], np.log(99), atol=1e-9)


def plain_contexts(ids, off, at):
    doc = np.searchsorted(off, at, "right") - 1
    out = np.full((len(at), 4), pseudo_lm.VOCABULARY)
    for j, d in enumerate((-2, -1, 1, 2)):
        inside = np.flatnonzero((at + d >= off[doc]) & (at + d < off[doc + 1]))
        out[inside, j] = ids[at[inside] + d]
    return out


def plain_scores(net, ids, off, step=8192):
    """Every class's logarithm, and each neighbour scaled where it stands."""
    context, out = plain_contexts(ids, off, np.arange(len(ids))), net.within[ids].copy()
    for lo in range(0, len(ids), step):
        hi = lo + step
        found = np.take_along_axis(net.log_class(net.hidden(context[lo:hi]), np.float64), net.class_of[ids[lo:hi], None], axis=1)[:, 0]
        out[lo:hi] += np.rint(found * (1 << 20)) / (1 << 20)
    return out


def test_scores_form_one_class_a_position_and_stay_equal():
    rng = np.random.default_rng(21)
    net = pseudo_lm.Network.fresh(rng.integers(0, 99, pseudo_lm.VOCABULARY))
    net.places += rng.normal(0, 0.2, net.places.shape).astype(np.float32)
    net.out *= 20
    off = np.concatenate([[0, 0], np.sort(rng.integers(0, 120_000, 400)), [120_000, 120_000]])
    ids = rng.integers(0, pseudo_lm.VOCABULARY, 120_000)
    assert (net.token_scores(ids, off) == plain_scores(net, ids, off)).all()
    some = np.flatnonzero(rng.random(len(ids)) < 0.3)
    assert (pseudo_lm.contexts(ids, off, some) == plain_contexts(ids, off, some)).all()
    assert pseudo_lm.contexts(ids[:0], np.zeros(1, int)).shape == (0, 4)

    def least(run):
        took = []
        for _ in range(5):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: net.token_scores(ids, off)) < 0.85 * least(lambda: plain_scores(net, ids, off))
