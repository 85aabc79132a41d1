from panelforge.llm import mixing

from .helpers import documents, duck, same


def test_matches_sql_with_nulls_ties_repeats_and_a_hot_source(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    rows += [(1, "w w", "hot"), (1, "w w", "hot"), (700, None, "hot"), (701, "", "void"), (702, "x " * 30000, "s1"), (703, "a b", None), (None, "c d e", None)]
    df = documents(spark, rows)
    same(mixing.copies(df), duck(mixing.SQL, documents=df))


def test_targets_share_everything_and_takes_come_near(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}") for i in range(2000)]
    got = mixing.copies(documents(spark, rows)).toPandas()
    by = got.groupby(got["doc_id"] % 5).agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - got["size"].to_numpy().sum()) < 1e-6
    assert (abs(by["taken"] - by["target"]) <= 9).all()
    assert (got["taken"] <= 3 * got["size"]).all()


def test_reruns_agree_and_a_weight_column_counts(spark):
    df = documents(spark, [(i, "w " * 5, f"s{i % 3}") for i in range(300)])
    a = mixing.copies(df, weight="size").orderBy("doc_id").collect()
    assert a == mixing.copies(df.repartition(5), weight="size").orderBy("doc_id").collect()


def test_empty(spark):
    assert mixing.copies(documents(spark, [])).count() == 0
