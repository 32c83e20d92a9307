"""Recall of the nearest neighbours on whole tables of several shapes, depth of the tree."""

import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import nearest as K


def table_of(spark, vectors):
    rows = pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()})
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def made(kind, n, width, draw):
    if kind == "uniform":
        return draw.normal(0, 1, (n, width))
    centres = draw.normal(0, 1, (60, width))
    vectors = centres[draw.integers(0, 60, n)] + draw.normal(0, 0.25, (n, width))
    if kind == "hot copies":
        vectors[draw.random(n) < 0.9] = vectors[0]
    return vectors


@pytest.mark.parametrize("kind", ["uniform", "clustered", "hot copies"])
def test_recall_and_depth(spark, monkeypatch, kind):
    monkeypatch.setattr(K, "SAMPLE", 2000)
    monkeypatch.setattr(K, "LEAF_ROWS", 100)
    monkeypatch.setattr(K.fit, "__defaults__", (2000,))
    monkeypatch.setattr(K.deepen, "__defaults__", (100,))
    vectors = made(kind, 8000, 16, np.random.default_rng(7))
    table = table_of(spark, vectors)
    got = {}
    for r in K.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    recall = {}
    for q in range(0, 8000, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -2
        want = np.lexsort((np.arange(8000), -near))[:5]
        assert len(got[q]) == 5
        recall[q] = len(set(want) & set(got[q])) / 5
    distinct = [v for q, v in recall.items() if not (vectors[q] == vectors[0]).all()]
    assert np.mean(list(recall.values())) >= 0.95 and np.mean(distinct) >= 0.93
    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    tree, own, _ = K.fit(rows, 5)
    counts = {r.leaf: r["count"] for r in own.groupBy("leaf").count().collect()}
    large = [leaf for leaf, n in counts.items() if n > 100]
    assert sum(counts.values()) == 8000
    # Only equal vectors make a leaf larger.
    assert not large or kind == "hot copies" and all(own.filter(F.col("leaf") == leaf).select("vector").distinct().count() < 100 for leaf in large)


def test_fewer_candidates_than_leaves_visited(spark):
    table = spark.createDataFrame([(i, [float(i == k) for k in range(9)]) for i in range(9)], "vec_id long, embedding array<double>")
    got = K.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_visits_come_in_bounded_blocks():
    """However many leaves queries visit, a task holds a block of visits; the tree travels without its list of centres."""
    batch = pd.DataFrame({"id": [7, 8, 9], "vector": [np.array([1.0, 0.0]), np.array([0.0, 1.0]), np.array([1.0, 1.0])]})
    blocks = list(K.visits_of(batch, lambda point: list(range(int(point[0] > 0) * 25 + 5)), most=16))
    assert [len(b) for b in blocks] == [16, 16, 16, 16, 1]
    together = pd.concat(blocks)
    assert together.groupby("id")["leaf"].apply(list).to_dict() == {7: list(range(30)), 8: list(range(5)), 9: list(range(30))}
    assert all((v == batch.set_index("id")["vector"][i]).all() for i, v in zip(together["id"], together["vector"]))
    tree = K.Tree(np.eye(80))
    assert tree.__getstate__()["centres"] is None
    assert (pickle.loads(pickle.dumps(tree)).assign(np.eye(80)) == tree.assign(np.eye(80))).all()
