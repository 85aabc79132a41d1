import random
import re

import xxhash

from panelforge.llm import simhash
from panelforge.llm.common import spread_join

from .helpers import documents, tuples


def slow(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def union_find(rows):
    ids, fps = [r[0] for r in rows], [slow(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted((ids[i], f"{fps[i]:016x}", min(ids[j] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows)))


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    rows = [(i, base[i % 12] + (f" tail{i}" if i % 2 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "one two"), (106, "É ß ñ"), (107, "a\x0bb\x0cc\x1cd\u2003e"), (108, "long " * 100000), (7, base[7] + " tail7")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = simhash.groups(documents(spark, [(i, t, "s") for i, t in rows]))
    assert tuples(got) == union_find(rows)


def test_links_miss_no_pair(spark):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3, 4)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in sorted(fps)]
    got = {(min(r), max(r)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(a[0], b[0]) for a in signed for b in signed if a[0] < b[0] and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = dict(simhash.components(edges).collect())
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def tasks_of(spark, name, run):
    """What run returns, and how many tasks Spark ran for it."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        got = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return got, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_stars_need_no_round(spark):
    """Rounds that only find that nothing changes made most of the driver's tasks on many small partitions."""
    edges = spark.createDataFrame([(7 * k, 7 * k + i) for k in range(20) for i in range(1, 7)], "a long, b long").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got, tasks = tasks_of(spark, "stars", lambda: dict(simhash.components(edges).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i // 7 * 7 for i in range(140)}
    assert tasks < 200


def test_further_links_join_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    reached = simhash.components(table(pairs[:200]))
    for lo, hi in ((200, 230), (230, 230), (230, 260)):
        reached = simhash.joined(reached, table(pairs[lo:hi]))
        whole = simhash.components(table(pairs[:hi]))
        loops = [(a, a) for a, b in pairs[200:hi] if a == b]
        assert not loops and sorted(reached.collect()) == sorted(whole.collect())


def least_of_near(rows, k=5, least=0.8):
    """The least id of each group of texts that links of a Jaccard similarity of least or more connect, by all pairs."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in set(group))


def mutated(count, seed):
    """Copies of one text with one to six changed words: their similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(count):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            words[at] = f"new{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    return rows


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    df = documents(spark, [(i, t, "s") for i, t in rows])
    got = simhash.stage(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == least_of_near(rows)


def test_stage_links_a_group_of_near_copies(spark, monkeypatch):
    rows = mutated(150, 6)
    want = least_of_near(rows)
    assert 2 < len(want) < 100
    df = documents(spark, [(i, t, "s") for i, t in rows])
    assert sorted(r.doc_id for r in simhash.stage(df).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK", 2000)
    assert sorted(r.doc_id for r in simhash.stage(df).collect()) == want


def test_signatures_follow_the_shingles(spark):
    texts = [(0, "a b c d e f g"), (1, "A  b\tc d e f G"), (2, "a b c"), (3, "a b c d"), (4, None), (5, " "), (6, "x " * 5000)]
    got = {r.rid: r for r in simhash.signatures(spark.createDataFrame(texts, "rid long, text string")).collect()}
    same = lambda i: (got[i].same_a, got[i].same_b, got[i].bands)
    assert same(0) == same(1) and same(2) != same(3) and same(4) == same(5) and got[4].bands == []
    assert len(set(got[0].bands)) == simhash.BANDS and len(got[6].least) == simhash.BANDS * simhash.BAND_ROWS


def test_frequent_keys_join_whole(spark):
    many = spark.range(30000).selectExpr("case when id % 3 < 2 then 7 else id end as k", "id as v").cache()
    one = spark.range(30000).selectExpr("id as k", "id * 2 as w")
    got = spread_join(many, one, "k")
    assert got.count() == 30000 and got.where("w <> k * 2").count() == 0 and sorted(got.columns) == ["k", "v", "w"]


def test_stage_keeps_columns_of_any_name(spark):
    names = ["__rid", "rid", "__group", "of", "doc", "fp", "component_id", "a.b"]
    df = spark.createDataFrame([(i, f"text {i // 2} and more words", *[f"{n} {i}" for n in names]) for i in range(6)], ["doc_id", "text", *names])
    got = simhash.stage(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in df.collect() if r.doc_id % 2 == 0)


def test_empty(spark):
    assert simhash.groups(documents(spark, [])).count() == 0
    assert simhash.stage(documents(spark, [])).count() == 0
