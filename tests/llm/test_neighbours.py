"""Vantage-point trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string"


def by_hand(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted((-float(q @ x), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out[i] = [j for _, j in near]
    return out


def found(spark, rows, k=5, every=4, **more):
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % every == 0, k, **more).collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append(r["vec_id"])
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TREE", 100)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    x = np.float32(np.concatenate([centres[i % 6] + rng.normal(size=8) * 0.2 for i in range(500)] + [rng.normal(size=8) for _ in range(200)]).reshape(-1, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, factor=1.0) == by_hand(rows, 5, 4)


def test_recall_of_the_default(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = by_hand(rows, 20, 20)
    got = found(spark, rows, 20, 20)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95


def test_copies_ties_and_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [1.0, 1.0]), (41, [1.0, -1.0]), (44, [2.0, 0.0]), (48, [-0.0, 1.0]), (52, [0.0, 1.0])]
    rows += [(60, None), (64, []), (68, [0.0, 0.0]), (72, [1.0, None]), (76, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 2.0]), (84, [1.0, 2.0, 3.0])]
    want = by_hand(rows, 5, 4)
    assert found(spark, rows, factor=1.0) == {q: v for q, v in want.items() if v}


def test_few_and_no_rows(spark):
    assert found(spark, [(0, [1.0]), (4, [2.0]), (5, [3.0])]) == {0: [5, 4], 4: [5, 0]}
    assert found(spark, []) == {} and found(spark, [(0, None)]) == {}


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_tree_prunes_by_the_factor(factor):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 3)) + c for c in np.eye(3) * 30])
    tree, q = neighbours.VantageTree(x, np.sqrt((x**2).sum(1).max())), x[::50]
    score, row = tree.search(q, 3, np.full(len(q), np.inf), factor)
    best = np.argsort(-(q @ x.T), 1, kind="stable")[:, :3]
    assert (row == best).mean() >= (1.0 if factor == 1 else 0.8)


def test_queries_that_go_everywhere_meet_trees_in_bounded_groups(spark, monkeypatch):
    for name, value in (("TREE", 100), ("QUERIES", 60), ("SENT", 64)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.float32(np.random.default_rng(3).normal(size=(900, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sizes, groups = [], neighbours._groups

    def watched(*given):
        index, sent = groups(*given)
        sizes.extend(r["count"] for r in sent.groupBy("tree", "part").count().collect())
        return index, sent

    monkeypatch.setattr(neighbours, "_groups", watched)
    assert found(spark, rows, 5, 2, factor=1.0) == by_hand(rows, 5, 2)
    assert sum(sizes) > 2000 and max(sizes) <= 2 * 60


def test_no_array_holds_all_queries_of_a_tree(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32, raising=False)
    compare, seen = neighbours.VantageTree._compare, []
    monkeypatch.setattr(neighbours.VantageTree, "_compare", lambda self, rows, active: (seen.append(len(active)), compare(self, rows, active)))
    x = np.random.default_rng(4).normal(size=(300, 4))
    _, row = neighbours.VantageTree(x, np.sqrt((x**2).sum(1).max())).search(x, 3, np.full(300, np.inf), 1.0)
    assert (row == np.argsort(-(x @ x.T), 1, kind="stable")[:, :3]).all() and max(seen) <= 32


def test_slices_of_repeated_rows():
    first, copies = np.array([5, 0, 9, 2]), np.array([3, 4, 0, 1])
    got = list(neighbours.expanded(first, copies, 3))
    assert [len(e) for e, _ in got] == [3, 3, 2]
    assert [(e, t) for entry, tree in got for e, t in zip(entry.tolist(), tree.tolist())] == [
        (0, 5), (0, 6), (0, 7), (1, 0), (1, 1), (1, 2), (1, 3), (3, 2)]
    assert list(neighbours.expanded(first[:0], copies[:0], 3)) == []
