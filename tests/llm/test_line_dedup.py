import time
from collections import defaultdict

from panelforge.llm import line_dedup

from .helpers import documents, duck, same, tuples


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, source in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            bare = line.strip(" \t\r")
            if bare:
                sites[bare].add(source)
                first[bare] = min(first.get(bare, (10**9, 0)), (i, p))
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        kept = [x for p, x in enumerate(text.split("\n")) if not (b := x.strip(" \t\r")) or len(sites[b]) < least or first[b] == (i, p)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force_around_the_threshold(spark):
    rows = []
    for n in range(1, 16):
        rows += [(100 * n + k, f"own {n} {k}\n  menu {n}\t\n\nend", f"site{k}") for k in range(n)]
    rows += [(5000, None, "x"), (5001, "", None), (5002, "menu 15", None), (5003, "long " * 200000 + "\nmenu 14", "y")]
    got = line_dedup.spread(documents(spark, rows), 10).select("doc_id", "text")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 10)


def test_registered_sql(spark):
    rows = [(i, f"same line\nown {i}\nsame line", f"s{i % 12}") for i in range(40)]
    df = documents(spark, rows)
    same(line_dedup.spread(df), duck(line_dedup.SQL, documents=df))


def test_stage_keeps_columns_and_drops_emptied_documents(spark):
    rows = [(i, "boiler", f"s{i}") for i in range(12)] + [(20, "mine", "s"), (21, "", "s"), (22, None, "s")]
    df = documents(spark, rows)
    got = line_dedup.stage(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 20, 21, 22]


def test_boilerplate_with_blank_lines_between_goes(spark):
    df = documents(spark, [(i, "boiler A\n\n \t\n\x0b\nboiler B", f"s{i}") for i in range(12)])
    assert [r.doc_id for r in line_dedup.stage(df).collect()] == [0]


def test_columns_of_any_name_are_kept(spark):
    names = ["__removed", "__drop", "__own", "__id", "__row", "__lines", "doc", "drop", "own", "row", "pos", "key", "first", "site", "sites", "lines", "removed", "a.b"]
    rows = [(i, f"boiler\nown {i}", f"s{i}", *[f"{n} {i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = line_dedup.stage(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"boiler\nown {i}" if i == 0 else f"own {i}", *r[2:]) for i, r in enumerate(rows)]


def test_repeated_rows_are_cleaned_alike(spark):
    rows = [(30, "boiler\nmine", "s7")] * 3 + [(i, "boiler", f"s{i}") for i in range(10, 20)]
    got = line_dedup.spread(documents(spark, rows)).where("doc_id = 30").collect()
    assert [r.text for r in got] == ["mine"] * 3


def test_empty(spark):
    assert tuples(line_dedup.spread(documents(spark, []))) == []


def many_lines(n, sites=11):
    """Equal texts of n lines, each with one line of its own in the middle."""
    lines = [f"menu {k}" for k in range(n)]
    return [(i, "\n".join([*lines[: n // 2], f"own {i}", *lines[n // 2 :]]), f"s{i}") for i in range(sites)]


def test_a_text_of_many_boilerplate_lines_is_cleaned_in_linear_time(spark):
    line_dedup.spread(documents(spark, many_lines(50))).collect()
    rows = many_lines(200_000)
    df = documents(spark, rows)
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.spread(df).collect()}
    assert time.perf_counter() - began < 20
    assert {i: r.text for i, r in got.items()} == dict(brute(rows, 10))
    assert {r.removed for r in got.values()} == {0, 200_000}


def test_more_boilerplate_than_a_broadcast_holds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 3)
    rows = many_lines(40) + [(100 + i, "menu 1\nown", f"s{i % 3}") for i in range(30)]
    got = line_dedup.spread(documents(spark, rows)).select("doc_id", "text")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 10)
