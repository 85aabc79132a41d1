import corpus_pipeline
from panelforge.llm import decontaminate, line_dedup, mixing, quality_fm

from .helpers import SF, duck, same
from .test_line_dedup import brute
from .test_simhash import least_of_near


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    kept = stages["quality classifier"](spark, docs, SF).cache()
    wanted = {r.doc_id for r in quality_fm.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted and kept.columns == docs.columns

    lines = stages["line dedup"](spark, kept, SF).cache()
    rows = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    cleaned = dict(brute(rows, 10))
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, t in cleaned.items() if t == dict((a, b) for a, b, _ in rows)[i] or (t or "").split()}

    one = stages["SimHash near-dedup"](spark, lines, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == least_of_near([(r.doc_id, r.text) for r in lines.collect()])

    clean = stages["benchmark decontamination"](spark, one, SF).cache()
    tests = [set(decontaminate.shingles_of(w, min(5, len(w)))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := decontaminate.words_of(r.text))]
    holds = lambda words: any(len(s & decontaminate.shingles_of(words, 5)) >= 0.8 * len(s) for s in tests)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not holds(decontaminate.words_of(r.text)))

    same(stages["source mixing"](spark, clean, SF), duck(mixing.SQL, documents=clean))
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(clean.select("doc_id").collect())


def test_line_stage_follows_lengths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in line_dedup.stage(docs).collect():
        assert r.text is None or r.n_chars == len(r.text)


def folder(spark, tmp_path, rows, labels=(), items=()):
    """Tables with odd rows and columns named like the stages' own."""
    names = ["doc", "rid", "drop", "removed", "__rid", "size", "a.b"]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *[f"{n} {i}" for n in names]) for i, t, s in rows], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    item = "which of these seven words is the odd one out"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, "", None), (4, own(4), "a"), (4, own(4), "a"), (None, own(5), None), (6, own(6) + " " + item, "b"), (7, "long word " * 60000, "b")]
    rows += [(100 + i, "menu\n\nfooter", f"s{i}") for i in range(12)] + [(200 + i, "menu\n" + own(200 + i), f"s{i}") for i in range(12)]
    d = folder(spark, tmp_path, rows, items=[(1, item), (2, None), (None, "")])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        seen[name] = docs
    ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0) for r in seen[name].collect())
    assert len(ids("quality classifier")) == len(rows)
    kept = {i for _, i in ids("line dedup")}
    assert {100} == {i for i in kept if 100 <= i < 112} and all(200 + i in kept for i in range(12))
    one = [i for _, i in ids("SimHash near-dedup")]
    assert one.count(4) == 1 and 1 in one and 2 not in one and 3 not in one and len([r for r in seen["SimHash near-dedup"].collect() if r.doc_id is None]) == 1
    assert 6 not in {i for _, i in ids("benchmark decontamination")}
    assert all(r["a.b"] == f"a.b {r.doc_id}" for r in docs.collect() if r.doc_id is not None)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, d).collect()) == sorted(i for _, i in ids("benchmark decontamination"))


def test_empty_tables_go_through_every_stage(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, []))
    assert out.count() == 0 and {"doc_id", "size", "source_size", "target", "taken"} <= set(out.columns)
