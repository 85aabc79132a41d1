import re
from collections import Counter

from panelforge.llm import source_divergence as sd

from .helpers import duck, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, term string, n long, p double, item int, value string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "t", 2, 0.5, 3, "v") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(words(t), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x for _, x, _ in docs}:
        df, whole, own = Counter(), Counter(), {}
        for found, x, s in docs:
            if x == lang:
                df.update(set(found))
                whole.update(found)
                own.setdefault(s, Counter()).update(found)
        kept = [t for t in df if df[t] >= min_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        of, q = {s: p(c) for s, c in own.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(of[s][t], q[t]), t) for t in kept if own[s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def held(df):
    return sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in df.collect())


ROWS = [
    ("The cat, the CAT and the Éclair", "en", "a"),
    ("the cat sat; cat", "en", "b"),
    ("THE dog and the cat é é", "en", "b"),
    ("the the the the", "en", "c"),
    ("and and Éclair éclair", "en", None),
    (None, "en", "only null"),
    ("", "en", ""),
    ("1 2 3 \x00 \x7f", "en", "digits"),
    ("straße straße", "de", "a"),
    ("straße", "de", "b"),
    ("Straße", "de", "b"),
    ("日本 日本", None, "a"),
    ("日本", None, "b"),
    ("日本 x", None, "b"),
    ("alone", "xx", "a"),
    ("nothing kept", "xx", "b"),
    ("the " * 50000 + "and", "en", "long"),
] + [("cat cat", "en", "twice")] * 2


def test_matches_plain_loops_and_sql(spark):
    df = table(spark, ROWS)
    got = sd.audit(df)
    assert held(got) == brute(ROWS)
    same(got, duck(sd.SQL, documents=df))


def test_blocks_of_sources_flushes_and_joined_groups(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 3)
    monkeypatch.setattr(sd, "FLUSH", 2)
    monkeypatch.setattr(sd, "MAX_GROUPS", 1)
    rows = [(f"common w{i % 7} w{i % 3} only{i % 11}", "en", f"s{i % 9}") for i in range(120)]
    assert held(sd.audit(table(spark, rows))) == brute(rows)


def test_only_the_first_ranks_of_terms(spark):
    rows = [(" ".join(f"a{chr(0x100 + k)}" for k in range(300)), "en", "s")] * 3 + [("b", "en", "t")] * 3
    got = sd.audit(table(spark, rows), top=20)
    assert held(got) == brute(rows, top=20) and got.where("part = 'term'").groupBy("source").count().collect()[0]["count"] <= 20


def test_long_division(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (0, 10**9), (4 * 10**15, 5 * 10**15), (7 * 10**12, 7 * 10**12 + 1), (2, 7)]
    got = spark.createDataFrame(cases, "c long, of long").select("c", "of", sd.frequency(F.col("c"), F.col("of")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.of for r in got)


def test_empty(spark):
    assert held(sd.audit(table(spark, []))) == []
