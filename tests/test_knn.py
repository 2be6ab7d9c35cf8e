import random

from civicspark.operators import retrieval


def nearest(spark, rows, queries, k, parts, **more):
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(parts)
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in retrieval.knn(v, q, k, **more).collect())


def test_ties_go_to_the_least_key(spark):
    rng = random.Random(3)
    rows = [(f"c{i:04d}", [1.0, 0.0, 0.0]) for i in range(400)] + [(f"x{i}", [rng.random() + 0.1, rng.random() + 0.1, 1.0]) for i in range(200)]
    rng.shuffle(rows)
    want = [(1, i + 1, f"c{i:04d}", 1.0) for i in range(5)]
    for parts in (1, 4):
        assert nearest(spark, rows, [(1, [2.0, 0.0, 0.0])], 5, parts) == want


def test_queries_in_batches(spark):
    rng = random.Random(6)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    queries = [(i, rows[i][1]) for i in range(25)]
    whole = nearest(spark, rows, queries, 3, 3)
    assert len(whole) == 75 and nearest(spark, rows, queries, 3, 3, batch=4) == whole
    assert nearest(spark, rows, [], 3, 1) == []


def test_more_queries_than_a_batch_holds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    q = spark.range(20_050).selectExpr("id AS query_id", "array(cast(1 as float), cast(0 as float)) AS embedding")
    got = retrieval.knn(v, q, 1)
    assert got.where("vec_id = 1").count() == 20_050
