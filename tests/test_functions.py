from datetime import date

from pyspark.sql import functions as F

from mandigrid.functions import dates, keys, missing, similarity, text
from mandigrid.plans.reference_tables import staff_total


def test_find_pin(evaluate):
    got = evaluate(text.find_pin("x"), ["Vill X 515 571 AP", "PIN-515571", "no code", "12345"])
    assert got == ["515571", "515571", None, None]


def test_normalize_address(evaluate):
    got = evaluate(text.normalize_address("x", "st"), [
        ("Main Rd., DISST West Godavari-534001, Andhra Pradesh", "Andhra Pradesh"),
        ("Rajendra Nagar Pin 800016,Purnea", "Bihar"),
        ("newDelhi(Market)", None),
        (None, "Bihar"),
    ], "x string, st string")
    assert got == ["Main Rd , Dist West Godavari", "Rajendra Nagar , Purnia",
                   "New Delhi Market", None]


def test_initials(evaluate):
    got = evaluate(text.to_initials("x"), ["West Godavari", "Kurnool", "24 Parganas",
                                           "North And Middle"])
    assert got == [[" w g ", " W G ", " WG ", " W Godavari "], [], [],
                   [" n a m ", " N A M ", " NAM ", " N And Middle "]]


def test_established(evaluate):
    got = evaluate(dates.established("x"), ["0", "5", "72", "12", "196", "1968", "x", None])
    years = [v and v.year for v in got]
    assert years == [None, 2005, 1972, 2012, 1960, 1968, None, None]


def test_fuzzy_match(evaluate):
    got = evaluate(similarity.fuzzy_match("a", "b"), [
        ("Purnea", "Purnia"), ("East X", "West X"), ("Junagarh", "Junagadh"),
        ("Upper West", "Uppr Wst")], "a string, b string")
    assert got == [True, False, True, True]


def test_ngram_similarity(evaluate):
    got = evaluate(similarity.ngram_similarity("a", "b"), [
        ("spam", "SPAM"), ("spam", "span"), ("aaaa", "aaa"), ("abc", "xyz")],
        "a string, b string")
    # "aaaa" and "aaa" both repeat the trigram "aaa": 2 x $$a.., aaa once, ..a$$
    assert got[0] == 1.0 and got[3] == 0.0
    assert got[1] == 3 / (6 + 6 - 3)
    assert got[2] == 5 / (6 + 5 - 5)


def test_origin_split(evaluate):
    state, market = text.split_origin("x")
    got = evaluate(F.struct(state, market), ["Kerala_Manjeri", "Kerala"])
    assert [tuple(g) for g in got] == [("Kerala", "Manjeri"), ("Kerala", "Kerala")]


def test_cases(evaluate):
    values = ["delhi-west", "O'BRIEN nagar", "K.V.rangareddy", "abc  def"]
    assert evaluate(text.title("x"), values) == [v.title() for v in values]
    assert evaluate(text.capitalize("x"), values) == [v.capitalize() for v in values]
    import string
    assert evaluate(text.capwords("x"), values) == [string.capwords(v) for v in values]


def test_tidy_punctuation(evaluate):
    got = evaluate(text.tidy_punctuation("x"), ["A (b )", "A ()", "A   B ,C", "A , B,"])
    assert got == ["A (b)", "A ", "A B, C", "A, B"]


def test_market_without_district(evaluate):
    got = evaluate(text.market_without_district("m", "d"), [
        ("Udaipur (Grain)", "Udaipur"), ("Kota", "Bundi"), ("Kota,", "Kota"), ("Kota", None)],
        "m string, d string")
    assert got == ["Grain", "Kota", "Kota", "Kota"]


def test_missing(evaluate):
    assert evaluate(missing.number("x"), ["1.5", "NR", "*", " ", "NaN", None]) == [
        1.5, None, None, None, None, None]
    assert evaluate(text.per_kg("x"), ["985.5", "NR"]) == [9.855, None]
    assert evaluate(missing.marker_as_null("x"), [" * ", "n.a.", " a "]) == [None, None, "a"]
    assert evaluate(missing.zero_as_null("x"), [0.0, 2.0], "x double") == [None, 2.0]
    kept = evaluate(missing.has_tonnage("x"), [None, 0.0, float("nan"), 5.0], "x double")
    assert [bool(k) for k in kept] == [False, False, False, True]
    assert evaluate(staff_total("a", "b"), [("3", "4"), ("*", "4"), ("NA", None)],
                    "a string, b string") == [7.0, None, None]


def test_dates(evaluate):
    assert evaluate(dates.bulletin_date("x"), ["26/10/2015", "2015-10-26", "?"]) == [
        date(2015, 10, 26), date(2015, 10, 26), None]
    assert evaluate(dates.prepend_century("x"), ["59", "99", "58", "0"]) == [
        1959, 1999, 2058, 2000]
    assert evaluate(dates.round_percent("x"), [0.5, 1.49, 2.5], "x double") == [1, 1, 3]


def test_keys(evaluate):
    assert evaluate(keys.collection_key("x", "market", "varieties"), ["Pearl Millet"]) == [
        "market.pearl.millet.varieties"]
    assert evaluate(keys.file_key("x"), ['"Live Stock,  Poultry"']) == ["Live-Stock-Poultry"]
    assert evaluate(keys.stack_key("x"), ["Barley (Jau)", "Rose(Loose)"]) == [
        "Barley_Jau", "Rose_Loose"]
    assert evaluate(keys.series_id(F.lit("state"), "x", F.lit("Rice")), ["Goa"]) == [
        "state.Goa.Rice.avg"]
