"""The address rules by example, and against trying every name on every address."""

import random
import re

from mandigrid.operators import addresses

NAMES = ["East Godavari", "Guntur", "Kota", "West Godavari", "Bundi", "Goa"]
TALUKS = ["Tenali", "Mangalagiri", "Tenali Town"]


def test_district_rules(rows):
    expected = {
        "Main Rd , Dist West Godavari": ("West Godavari", 1),  # a contained name, the longest
        "Gunturr Xdist , Z": ("Guntur", 1),
        # words around "dist"; compass words allow one edit only
        "Main Rd , Dist West Godavar": ("West Godavari", 2), "Guntar Dist , Elsewhere": ("Guntur", 2),
        "Main Rd , Dist West Godava": (None, None),
        "Tadepalligudem WG Station": ("West Godavari", 3), "Old E Godavari Fort": ("East Godavari", 3),
        "Mill Street , Guntor": ("Guntur", 4),  # a word of the last part, one edit
        "Anaj , Mandi": (None, None),  # lookalikes are not districts
        "Mill , Khada": (None, None), "": (None, None), None: (None, None),
    }
    names = rows([("S", d) for d in [*NAMES, "", None]], "state string, district string")
    out = addresses.assign_districts(rows([("S", a) for a in expected] + [(None, "Guntur")], "state string, address string"), names,
                                     ["address"]).collect()
    assert len(out) == len(expected) + 1
    assert {r.address: (r.district, r.rule_0) for r in out if r.state} == expected
    assert [r.district for r in out if not r.state] == [None]


def test_taluk_rules(rows):
    postal = rows([("S", "Guntur", t) for t in TALUKS] + [("S", "Kota", "Ladpura"), ("S", "Goa", ""), ("S", "Goa", None)],
                  "state string, district string, taluk string")
    cases = [
        ("Guntur", "Tenalii Mandal , Guntur", None, None, "Tenali", 1), (None, "Big Street", None, "Tenali Market", "Tenali", 2),
        (None, "Old Tenali Town , X", None, None, "Tenali Town", 3), (None, "Tenali Road , Mangalagiri", None, None, "Mangalagiri", 3),
        (None, "Near Mangalgirri , X", None, None, "Mangalagiri", 4), (None, "Near Station , X", None, None, None, None),
        (None, None, None, "Tenali", None, None),
        # taluks of the district only, unless it has none
        ("Kota", "Old Tenali , X", None, None, None, None), ("Kota", "Old Ladpura , X", None, None, "Ladpura", 3),
        ("Goa", "Old Tenali , X", None, None, "Tenali", 3),
        # the words that told the district are taken out, if they are there once
        ("Guntur", "Fort Tenali Dist , X", "Fort Tenali", None, None, None),
        ("Guntur", "Tenali Dist Tenali , X", "Tenali", None, "Tenali", 3),
    ]
    texts = rows([(i, "S", *c[:4]) for i, c in enumerate(cases)] * 2, "id int, state string, district string, address string, told string, market string")
    out = addresses.find_taluks(texts, postal).collect()
    assert len(out) == 2 * len(cases)
    assert {r.id: (r.taluk, r.taluk_rule) for r in out} == {i: c[4:] for i, c in enumerate(cases)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    grams = lambda x: [f"$${x.lower()}$$"[i:i + 3] for i in range(len(x) + 2)]
    left, right = grams(a), grams(b)
    shared = sum(min(left.count(g), right.count(g)) for g in set(left))
    return shared / (len(left) + len(right) - shared)


def allowance(phrase, default):
    low = phrase.lower()
    return 2 if re.search("upper|lower", low) else 1 if re.search("west|east", low) else default


def every_name(address, names):
    """(district, rule) by comparing all names."""
    held = [n for n in names if n in address]
    if held:
        return min(held, key=lambda n: (-len(n), n)), 1
    window = re.search(r"((?:\w+\s+){0,2})\S*(?:dist|dt)\S*((?:\s+\w+){0,2})", address, re.I)

    def best(phrases, default):
        found = [(-similarity(p, n), n) for p in phrases for n in names
                 if distance(p.lower(), n.lower()) <= allowance(p, default)
                 and not (default == 1 and p == "Mandi" and n in ("Bundi", "Banda", "Gonda"))]
        return min(found)[1] if found else None

    near = best([w.strip() for w in window.groups()], 2) if window else None
    if near:
        return near, 2
    for n in sorted(names):
        w = n.split()
        if len(w) == 2 and any(f" {i} " in address for i in (
                f"{w[0][0]} {w[1][0]}".lower(), f"{w[0][0]} {w[1][0]}", w[0][0] + w[1][0], f"{w[0][0]} {w[1]}")):
            return n, 3
    word = best([w for w in address.split(", ")[-1].split(" ") if w != "Khada"], 1)
    return (word, 4) if word else (None, None)


def test_rules_find_what_trying_every_name_finds(rows):
    rand = random.Random(1)
    names = sorted({*NAMES, *("".join(rand.choice("abcdeg") for _ in range(rand.randint(4, 9))).title() for _ in range(25)),
                    "Upper Abed", "Lower Bead", "Deaf Cab", "Bad Ace"})
    texts = set()
    for _ in range(400):
        name = rand.choice(names)
        for _ in range(rand.randrange(4)):
            i = rand.randrange(len(name) + 1)
            name = name[:i] + rand.choice(["", "a", " ", "x"]) + name[i + rand.randrange(2):]
        texts.add(rand.choice(["Mill , {}", "Mill , Dist {}", "{} Dist , Mill", "Old {} Fort", "{} Distt", "Mill {} , Khada Mandi", "D C {}",
                               "x B A Fort {}"]).format(name))
    texts = sorted(texts)
    out = addresses.find_districts(rows([("S", t) for t in texts] * 2 + [("T", texts[0])], "state string, address string"),
                                   rows([("S", d) for d in names] * 2, "state string, district string")).collect()
    got = {r.address: (r.district, r.rule) for r in out}
    assert len(out) == len(got)
    want = {t: every_name(t, names) for t in texts}
    assert {t: got.get(t, (None, None)) for t in texts} == want
    assert {rule for _, rule in want.values()} == {1, 2, 3, 4, None}
