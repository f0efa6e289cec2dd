"""Mixing: targets by filling, thresholds near them, edge cases."""

import random

import pytest

from llm import mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The rule as it is said: reshare what is above until none is."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total >= most * sizes[n]}
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        for n in over:
            target[n] = float(most * sizes[n])
        left -= sum(target[n] for n in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", None, "tiny" if i < 30 else "c"])
        rows.append((i, "w " * rng.randrange(1, 40), source))
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \n", None), (1003, "x " * 3000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, keep=["doc_id", "source"]).collect()
    assert sorted(map(tuple, mixing.mix(df.repartition(7), keep=["doc_id", "source"]).collect())) == sorted(map(tuple, out))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes)
    for source, size in sizes.items():
        own = [r for r in out if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - want[source]) <= 1e-9 * want[source] for r in own)
        longest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= longest / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in out)


def test_larger_budgets_contain_smaller_ones(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    small = {r["doc_id"]: r["taken"] for r in mixing.mix(df, ["doc_id"], share=(1, 4)).collect()}
    large = {r["doc_id"]: r["taken"] for r in mixing.mix(df, ["doc_id"], share=(3, 4)).collect()}
    assert 0 < sum(small.values()) < sum(large.values()) and all(small[i] <= large[i] for i in small)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size string, extra int"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "x", 1), (2, "", None, "x", 2)], schema)
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2
    twins = spark.createDataFrame([(None, "a b", "s", "x", 1)] * 4 + [(7, "c d", "s", "x", 1)], schema)
    out = mixing.mix(twins)
    assert out.columns == ["doc_id", "text", "source", "extra", "size", "source_size", "target", "taken"]
    rows = out.collect()
    assert len({r["taken"] for r in rows if r["doc_id"] is None}) == 1 and {r["target"] for r in rows} == {15.0}
