from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowcascade.operators import wide as W


def test_many_values_are_numbered_in_order(spark):
    names = [f"v{i:05d}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names[::-1] * 2] + [(None,)], "name string")
    table = W.number_values(df.repartition(7), "name")
    assert [tuple(r) for r in table.orderBy("code").collect()] == list(zip(names, range(5000)))


def test_codes_and_values_come_back(spark):
    df = spark.createDataFrame(
        [(1, "b"), (2, "a"), (3, None), (4, "new"), (5, "a")], "id int, `the.label` string")
    table = W.number_values(df.filter("id < 4"), "the.label")
    coded = W.encode_by_table(df, "the.label", table)
    assert {r["id"]: r["label_code"] for r in coded.collect()} == {1: 1, 2: 0, 3: -1, 4: -1, 5: 0}
    back = W.decode_by_table(coded, "label_code", table)
    assert {r["id"]: r["label"] for r in back.collect()} == {1: "b", 2: "a", 3: None, 4: None, 5: "a"}
    assert back.columns == ["id", "the.label", "label_code", "label"]


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(1, 30), (2, 10), (3, None), (4, 99), (5, 20)], "id int, v int")
    table = W.number_values(df.filter("v < 50"), "v")
    got = {r["id"]: r["hot"] for r in W.one_hot_sparse(df, "v", table, "hot").collect()}
    assert all(v.size == 3 for v in got.values())
    assert {i: (v.indices.tolist(), v.values.tolist()) for i, v in got.items()} == {
        1: ([2], [1.0]), 2: ([0], [1.0]), 3: ([], []), 4: ([], []), 5: ([1], [1.0])}


def test_a_million_categories(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    table = W.number_values(df, "v")
    row = W.one_hot_sparse(df.filter("v = 999999"), "v", table, "hot").first()
    want = df.filter("v < 999999").count()
    assert row["hot"].size == 1_000_000 and row["hot"].indices.tolist() == [want]
    assert table.agg(F.count_distinct("code"), F.max("code")).first() == (1_000_000, 999_999)


def test_an_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    table = W.number_values(df, "v")
    assert table.count() == 0
    assert W.encode_by_table(df, "v", table).first()["label_code"] == -1


def test_vectors_carry_no_names_of_their_places(spark):
    df = spark.range(2000).select("id")
    hot = W.one_hot_sparse(df, "id", W.number_values(df, "id"), "hot")
    assert len(hot.schema.json()) < 1000        # the schema is on the driver


def test_sum_of_vectors_by_place(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "z")], "id int, v string")
    table = W.number_values(spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v")
    hot = W.one_hot_sparse(df, "v", table, "the.hot")
    total = W.sum_vectors(hot, "the.hot", 3)
    assert total.dtypes == [("code", "int"), ("total", "double")]
    assert sorted(map(tuple, total.collect())) == [(0, 1.0), (1, 2.0), (2, 0.0)]


def test_sum_of_sparse_and_dense_vectors(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 0.0, 2.5]),), (None,),
                                (Vectors.sparse(3, [1, 2], [4.0, 0.5]),)], ["v"])
    assert sorted(map(tuple, W.sum_vectors(df, "v", 3).collect())) == [
        (0, 1.0), (1, 4.0), (2, 3.0)]


def test_sum_of_vectors_without_known_values(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    hot = W.one_hot_sparse(df, "v", W.number_values(df, "v"), "hot")
    assert W.sum_vectors(hot, "hot", 0).collect() == []
