"""The n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import jaccard


def sets_by_hand(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(n, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def classes_by_hand(rows, percent=80):
    sets = [(i, sets_by_hand(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def of(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = of(i), of(j)
                parent[max(x, y)] = min(x, y)
    return {i: of(i) for i in parent}


def near_copies(seed, groups=25, size=6):
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 12, 60, 150]))]
        if g % 3 == 0:
            words[2:2] = passage
        for _ in range(rng.randrange(1, size)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed) + [(1, ""), (2, None), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "x " * 4000), (8, "X " * 3999)]
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes_by_hand(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(sets_by_hand(t)) for i, t in rows}


def test_a_large_group_is_split_over_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 8)
    rng, base = random.Random(3), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == classes_by_hand(rows)


def test_frequent_lists_only_change_the_order(spark, monkeypatch):
    rows = near_copies(5)
    monkeypatch.setattr(jaccard, "frequent_grams", lambda docs, n: np.unique(np.concatenate(
        [jaccard.shingles(jaccard.words_of(t, True), 5)[::3] for _, t in rows])))
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == classes_by_hand(rows)


def test_ids_that_repeat_or_lack_and_extra_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 9), (1, text, 9), (None, text, 9), (2, text, 9), (3, "other words", 9)]
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1), (3, 1, 3)], key=str)


def test_empty_table(spark):
    assert jaccard.join_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299), (299, 300)]
    found = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["class"] for r in found}
    assert len(found) == len(got) == 41 + 60 + 2
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(60)} == {100} and got[300] == 299


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.sampled_from([50, 80, 100]))
def test_tree_finds_all_links(sets, percent):
    sets = [sorted(s) for s in sets]
    tree = jaccard.Tree(sets)
    for s in sets:
        both = [len(set(s) & set(t)) for t in sets]
        want = [j for j, (b, t) in enumerate(zip(both, sets)) if 100 * b >= percent * (len(s) + len(t) - b)]
        assert sorted(tree.linked(s, percent, lambda ids: False)) == want


@given(st.integers(1, 500), st.integers(1, 500))
def test_bounds(n, m):
    least = jaccard.needed(n, m, 80)
    assert 100 * least >= 80 * (n + m - least) and not 100 * (least - 1) >= 80 * (n + m - least + 1)
    assert jaccard.prefix_length(n, 80) == n - -(-80 * n // 100) + 1


def test_an_id_with_two_texts_links_by_both(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, near = " ".join(words), " ".join(f"v{i}" for i in range(60)), " ".join([*(f"v{i}" for i in range(59)), "else"])
    rows = [(5, a), (5, b), (3, a), (9, near)]
    for given in (rows, rows[::-1], rows + rows):
        out = jaccard.join_classes(spark.createDataFrame(given, "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["component_id"]) for r in out} == {(5, 3), (3, 3), (9, 3)} and len(out) == len(given)


def test_a_large_group_of_near_copies_meets_before_prefixes_are_joined(spark, monkeypatch):
    seen, write = [], jaccard.materialise

    def counted(df, purpose):
        out = write(df, purpose)
        seen.append((purpose, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    rng, rows = random.Random(4), []
    for i in range(150):  # the n-grams that all share are frequent, so the prefixes begin with each one's own
        words = [f"w{k}" for k in range(120)]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["component_id"] for r in out} == {0}
    assert max(n for purpose, n in seen if purpose in ("jaccard-pairs", "jaccard-blocks")) <= 300


@pytest.mark.parametrize("size", [2, 512])
def test_prefixes_alone_lead_to_all_links(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "TREE_SETS", size)
    rows = near_copies(7)
    out = jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == classes_by_hand(rows)


def test_all_nodes_of_paired_classes_meet_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 4)
    sizes, pairs = {1: 3, 2: 30, 3: 12, 4: 1, 5: 2}, [(1, 2), (2, 3), (2, 4), (4, 5)]
    members = [(100 * c + i, c) for c, n in sizes.items() for i in range(n)]
    met = jaccard.meetings(spark.createDataFrame(pairs, "class_l long, class_r long"), spark.createDataFrame(members, "node long, class long"))
    blocks = {}
    for r in met.collect():
        blocks.setdefault(r["block"], ([], []))[r["host"]].append((r["node"], r["class"]))
    together = {frozenset((h, g)) for guests, hosts in blocks.values() for h, _ in hosts for g, _ in guests}
    assert together >= {frozenset((a, b)) for x, y in pairs for a, c in members for b, d in members if (c, d) == (x, y)}
    assert max(max(map(len, both)) for both in blocks.values()) <= 14 and len(blocks) > 20


@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1))
def test_min_hashes_of_equal_sets_are_equal_and_come_from_the_set(a, b):
    a, b = (np.array(sorted(x), np.uint64) for x in (a, b))
    assert len(set(jaccard.ORDERS.tolist())) == 2 * jaccard.ROUNDS and (jaccard.ORDERS % 2 == 1).all()
    assert set(jaccard.min_hashes(a).tolist()) <= {int(g) * int(f) % 2**64 for g in a for f in jaccard.ORDERS}
    joined = np.minimum(jaccard.min_hashes(a), jaccard.min_hashes(b))
    assert (jaccard.min_hashes(np.union1d(a, b)) == joined).all()


def test_plans_of_components_do_not_grow_by_the_step(spark, monkeypatch):
    leaves, write = [], jaccard.materialise

    def counted(df, purpose):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, purpose)

    monkeypatch.setattr(jaccard, "materialise", counted)
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {(r["node"], r["class"]) for r in jaccard.components(chain).collect()} == {(i, 0) for i in range(13)}
    assert max(leaves) <= 2
    leaves.clear()
    star = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(0, 3), (4, 4)], "a long, b long")
    assert {(r["node"], r["class"]) for r in jaccard.components(star).collect()} == {(i, 0) for i in range(9)}
    assert len(leaves) == 1


def test_blocks_name_the_smallest_class_that_links_lead_to(spark):
    a, b = list(range(10)), list(range(50, 60))
    sets = [(9, 9, a), (8, 8, a[:9]), (7, 3, a), (4, 3, b), (5, 5, b[1:]), (6, 6, [80, 81])]
    for hosts in ((True,) * 6, (False, True, False, True, True, True)):
        rows = [(block, node, c, grams, host) for (node, c, grams), host in zip(sets, hosts) for block in (1, 2)]
        members = spark.createDataFrame(rows, "block long, node long, class long, grams array<long>, host boolean")
        got = sorted((r["a"], r["b"]) for r in jaccard.block_links(members, 80).collect())
        assert got == sorted([(9, 3), (8, 3), (5, 3)] * 2)
