"""Equality-join matching against brute force."""

import random

import pytest

from mandigrid.operators import locate, matching
from mandigrid.plans import reference_tables as tables


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def sample(seed, n, letters="abc", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
                   for _ in range(n)})


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 5])
def test_near_pairs(rows, k):
    left, right = sample(1, 90), sample(2, 90)
    got = matching.near_pairs(rows([(x,) for x in left], "a string"),
                              rows([(x,) for x in right], "b string"), "a", "b", k).collect()
    want = {(a, b, distance(a, b)) for a in left for b in right if distance(a, b) <= k}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_pairs_within_blocks_and_case(rows):
    a = rows([("x", "Abc"), ("y", "Abc"), ("x", None)], "s string, a string")
    b = rows([("x", "abd"), ("y", "zzzz")], "s string, b string")
    assert [tuple(r) for r in matching.near_pairs(a, b, "a", "b", 1, ["s"]).collect()] == [
        ("x", "Abc", "abd", 1)]
    assert matching.near_pairs(a, b, "a", "b", 1, ["s"], fold=False).isEmpty()


def test_names_that_share_most_of_their_letters(rows):
    """A common prefix must not pair everything with everything."""
    names = rows([(f"Customer#{i:09}",) for i in range(300)], "a string")
    got = {tuple(r) for r in matching.near_pairs(names, names, "a", "a", 1).collect()}
    assert len(got) == sum(distance(f"{i:03}", f"{j:03}") <= 1
                           for i in range(300) for j in range(300))


def test_containing_pairs(rows):
    left, right = sample(3, 60, "ab", 6), sample(4, 60, "ab", 6)
    got = matching.containing_pairs(rows([(x,) for x in left], "a string"),
                                    rows([(x,) for x in right], "b string"), "a", "b").collect()
    want = {(a, b) for a in left for b in right if a in b or b in a}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_assign_once_against_brute_force(rows):
    left, right = sample(5, 40, "abcd", 6), sample(6, 40, "abcd", 6)
    pairs = matching.candidates(rows([(x,) for x in left], "a string"),
                                rows([(x,) for x in right], "b string"), "a", "b", 2)
    numbered = pairs.withColumn("tie", matching.pair_number()).collect()
    scored = [(-r.similarity, r.distance, r.tie, r.left_name, r.right_name) for r in numbered]
    got = {(r.left_name, r.right_name) for r in matching.assign_once(pairs).collect()}
    want = set()
    for *_, a, b in sorted(scored):  # from the best on, each name once
        if not any(a == x or b == y for x, y in want):
            want.add((a, b))
    assert got == want
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})


def test_assign_once_needs_few_rounds_on_ties(spark, rows, monkeypatch):
    """60 by 60 names, all equally good: every name finds a partner."""
    pairs = rows([(f"l{i}", f"r{j}", 0.5, 1) for i in range(60) for j in range(60)],
                 "left_name string, right_name string, similarity double, distance int")
    folders, taken = [], matching.shared_dir

    def noted(*args):
        folders.append(taken(*args))
        return folders[-1]

    monkeypatch.setattr(matching, "shared_dir", noted)
    assert matching.assign_once(pairs).count() == 60
    fs = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    listed = fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)
    assert sum("taken" in f.getPath().getName() for f in listed) < 15


def test_candidates_carry_the_distance_they_were_found_by(rows):
    got = matching.candidates(rows([("ABc",)], "a string"), rows([("Abc",)], "b string"), "a", "b", 1, fold=False)
    assert [r.distance for r in got.collect()] == [1]


def test_assign_once_without_candidates(rows):
    pairs = matching.candidates(rows([("abcdef",)], "a string"), rows([("uvwxyz",)], "b string"),
                                "a", "b", 1)
    assert matching.assign_once(pairs).isEmpty()


def test_canonical_spelling(rows):
    names = ["Daspur"] * 4 + ["Daspor"] + ["Kharagpur"] * 9
    df = rows([("S", "D", x) for x in names], "state string, district string, taluk string")
    got = {r.taluk: r.canonical for r in matching.canonical_spelling(
        df, "taluk", ["state", "district"]).collect()}
    assert got == {"Daspur": "Daspur", "Daspor": "Daspur", "Kharagpur": "Kharagpur"}
    fixed = matching.canonicalise(df, "taluk", ["state", "district"])
    assert fixed.groupBy("taluk").count().count() == 2 and fixed.count() == len(names)


def test_top_candidate(rows):
    df = rows([("k", 0.5, "b"), ("k", 0.9, "z"), ("k", 0.9, "a")], "k string, s double, n string")
    assert tuple(matching.top_candidate(df, "k", "s", "n").first()) == ("k", "a", 0.9)


def test_pin_overrides_address(rows):
    markets = rows([(1, "515571", "Anantapur", "Hindupur"), (2, "999999", "A", "B"),
                    (3, None, "A", "B"), (4, "515571", None, None)],
                   "id int, pin string, district string, taluk string")
    postal = rows([("515571", "Hindupur", "Ananthapur"), ("515571", "", "Chittoor"),
                   ("515571", "Penukonda", "Ananthapur")],
                  "pin string, taluk string, district string")
    got = {r.id: (r.pin_district, r.pin_taluk) for r in locate.best_by_pin(markets, postal, "id")
           .collect()}
    assert got == {1: ("Ananthapur", "Hindupur"), 4: ("Chittoor", None)}


def test_location_lookup(rows):
    locations = rows([("Goa_Mapusa", "North Goa", "Bardez"), ("Nagaland_Dimapur", "Dimapur", "D"),
                      ("Goa_Ponda(Grain)", "South Goa", "Ponda")],
                     "location_key string, district string, taluk string")
    obs = rows([("Goa", "Mapusa"), ("Goa", "Mapusa(Fruit)"), ("Nagaland", "Dimapur Town"),
                ("Goa", "Ponda(Grain)"), ("Goa", "Unknown")], "state string, market string")
    for place in (locate.add_location, locate.add_location_rowwise):
        got = {r.market: r.district for r in place(obs, locations).collect()}
        assert got == {"Mapusa": "North Goa", "Mapusa(Fruit)": "North Goa",
                       "Dimapur Town": "Dimapur", "Ponda(Grain)": "South Goa", "Unknown": None}


def test_boundary_alternates(rows):
    shapes = rows([("Orissa", "Odisa|Utkal"), ("Keral", None), ("Delhi", None)],
                  "name_1 string, varname_1 string")
    states = rows([("Odisha",), ("Kerala",), ("NCT of Delhi",)], "state string")
    got = {r.name_1: r.state for r in tables.match_state_boundaries(shapes, states).collect()}
    assert got == {"Orissa": "Odisha", "Keral": "Kerala", "Delhi": "NCT of Delhi"}
