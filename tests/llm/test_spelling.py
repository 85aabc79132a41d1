import random
import re
import zlib
from collections import Counter

from panelforge.llm import spelling

from .helpers import duck, same

SCHEMA = "doc_id long, text string, lang string, source string, word string, n double, key string, node int, root long, form double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "w", 0.5, "k", 1, 2, 2.5) for i, t in rows], SCHEMA)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def held(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus(seed=1):
    rng = random.Random(seed)
    letters = "abcé÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "abababab", "babababa"]
    words = list(base)
    for w in base:
        for _ in range(12):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    rows = []
    for k in range(160):
        rows.append((k, " ".join(rng.choice(base if rng.random() < 0.8 else words) for _ in range(60))))
    rows += [(1000 + k, " ".join(words) + " ŸlanĀd AbÉcab") for k in range(6)]
    return rows


def test_matches_brute_force_and_sql(spark):
    rows = corpus() + [(None, "abcabcabc " * 9), (3, None), (4, ""), (5, "x1 _ 2"), (6, "long" * 5000 + " " + "long" * 5000), (6, "long" * 5000 + " " + "long" * 5000), (7, ("long" * 5000 + " ") * 2)]
    df = table(spark, rows)
    got = spelling.variants(df)
    want = brute([r for r in rows if not r[1] or "longlong" not in r[1]])
    long = "long" * 5000
    assert [r for r in held(got) if len(r[0]) < 1000] == want and len(want) > 300
    assert [(r[0] == long, r[3]) for r in held(got) if len(r[0]) >= 1000] == [(True, 6)] or zlib.crc32(f"6:{long}".encode()) % 199 == 0 or zlib.crc32(f"7:{long}".encode()) % 199 == 0
    same(got.where("length(word) < 1000"), duck(spelling.SQL, documents=table(spark, [r for r in rows if not r[1] or "longlong" not in r[1]])))


def test_deleted_code_points_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 3)
    rows = [(i, "governmeñt Government parliament " * 5) for i in range(1500)]
    got = held(spelling.variants(table(spark, rows)))
    assert got == brute(rows) and sum(len(r[0]) == 9 for r in got) >= 3


def test_chains_of_forms_end_at_the_root(spark):
    words = {"abcdefgh": 3200, "abcdefg": 640, "abcdef": 128, "abcdex": 25, "abcdxx": 5}
    rows = [(2 * i, (w + " ") * 5) for i, w in enumerate(w for w, n in words.items() for _ in range(n // 5))]
    got = held(spelling.variants(table(spark, rows)))
    assert got == brute(rows)


def test_an_entry_for_every_kind_of_edit(spark):
    pairs = [("abcdefg", "abcdef"), ("abcdef", "abcdefz"), ("xbcdef", "ybcdef"), ("qabcdef", "abcdef"), ("abxcdef", "abcdef"), ("àbcdef", "ÿbcdef")]
    rows = [(2 * k + 1, " ".join(w for p in pairs for w in p)) for k in range(40)]
    assert held(spelling.variants(table(spark, rows))) == brute(rows)


def test_empty(spark):
    assert held(spelling.variants(table(spark, []))) == []
    assert held(spelling.variants(table(spark, [(1, None), (2, "short words only")]))) == []
