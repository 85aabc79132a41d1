import random

from panelforge.llm import decontaminate

from .helpers import documents, duck, same


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def world(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    tests = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 12, 20, 40, 80, 300])]
    tests += [(20, None), (21, "..."), (None, tests[5][1]), (5, tests[5][1])]
    rows = [(0, None, "s"), (1, "", "s"), (2, "w1", "s"), (2, "w1", "s")]
    for i, (_, text) in enumerate(tests[:10]):
        own = text.split()
        for cut in (0, 1, 2, 4):
            some = own[:]
            for k in range(cut):
                some[(k * 7) % len(some)] = "changed"
            rows.append((100 + 10 * i + cut, "Lead in, " * 50 + ", ".join(some).upper() + " and more" * (400 if i == 6 else 10), "s"))
    return documents(spark, rows), items(spark, tests)


def test_matches_sql(spark):
    docs, tests = world(spark)
    same(decontaminate.contained(docs, tests), duck(decontaminate.SQL, documents=docs, benchmark=tests))


def test_items_that_are_joined_give_the_same(spark, monkeypatch):
    docs, tests = world(spark)
    whole = sorted(map(tuple, decontaminate.contained(docs, tests).collect()), key=str)
    left = sorted(map(str, decontaminate.stage(docs, tests).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 10)
    assert sorted(map(tuple, decontaminate.contained(docs, tests).collect()), key=str) == whole
    out = decontaminate.stage(docs, tests)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == left


def test_stage_drops_what_holds_an_item_and_keeps_the_rest(spark):
    docs, tests = world(spark)
    found = {r.doc_id for r in decontaminate.contained(docs, tests).collect()}
    got = decontaminate.stage(docs, tests)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in found)


def test_empty(spark):
    docs, tests = world(spark)
    assert decontaminate.contained(documents(spark, []), tests).count() == 0
    assert decontaminate.contained(docs, items(spark, [])).count() == 0
    assert decontaminate.stage(docs, items(spark, [])).count() == docs.count()
