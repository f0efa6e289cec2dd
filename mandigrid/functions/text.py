"""Text functions for names and addresses."""

import string
from itertools import chain

from pyspark.sql import Column, functions as F

from mandigrid.fixed_values import (
    ADDRESS_CORRECTIONS, CITY_ALIASES, CITY_SUMMARY_ROWS, DISTRICT_WORD_SPELLINGS, NOT_REPORTED,
)
from mandigrid.functions.missing import col

_MARK = "\u0001"  # never part of a name
# ASCII punctuation but the comma, and digits: none of it belongs to an address
_NOT_ADDRESS = (string.punctuation + string.digits).replace(",", "")
_PIN_WORD = r"(?i)\sPin\s"
_JOINED_WORDS = r"(?<=[a-z])(?=[A-Z])"


def strip(c) -> Column:
    """Without white space at both ends.

    Only before a line separator at the very end, where ``$`` also stands, is a pattern needed.
    """
    c = col(c)
    return F.when(F.substring(c, -1, 1).isin("\u0085", "\u2028", "\u2029"),
                  F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def replace_whole(c, mapping: dict) -> Column:
    """Whole-value replacement from a small fixed table; other values stay."""
    c = col(c)
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def replace_patterns(c, patterns: dict) -> Column:
    """Regular expressions applied one after the other, in the table's order."""
    c = col(c)
    for pattern, replacement in patterns.items():
        c = F.regexp_replace(c, pattern, replacement)
    return c


def capwords(c) -> Column:
    """Single blanks, each blank-separated word capitalised."""
    return F.initcap(squeeze(c))


def capitalize(c) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def title(c) -> Column:
    """Every letter that follows a non-letter is upper case, all others lower."""
    parted = F.regexp_replace(col(c), r"([^\p{L}\s])(?=\p{L})", "$1" + _MARK + " ")
    return F.replace(F.initcap(parted), F.lit(_MARK + " "), F.lit(""))


def tidy_punctuation(c) -> Column:
    """No blank before a closing bracket, no empty brackets, single blanks, and commas that
    follow their word directly, with one blank after those that were set off and none at the end.
    """
    closed = F.replace(F.regexp_replace(col(c), r"\s(?=\))", ""), F.lit("()"), F.lit(""))
    parts = F.split(F.regexp_replace(closed, r"\s+", " "), r" ,\s*", -1)
    return F.regexp_replace(F.array_join(parts, ", "), r"\s*,$", "")


def correct_address(c, state) -> Column:
    """The state's own spelling table, literal replacements in order."""
    tables = F.create_map(*chain.from_iterable(
        (F.lit(name), F.array(*[F.array(F.lit(wrong), F.lit(right))
                                for wrong, right in table.items()]))
        for name, table in ADDRESS_CORRECTIONS.items()))
    own = F.coalesce(F.try_element_at(tables, col(state)), F.array().cast("array<array<string>>"))
    return F.aggregate(own, col(c), lambda text, pair: F.replace(text, pair[0], pair[1]))


def normalize_address(c, state) -> Column:
    """An address without punctuation, digits, the word Pin and its own state.

    Commas survive, set off by blanks, because they separate address parts.
    """
    state = col(state)
    letters = F.replace(F.translate(col(c), _NOT_ADDRESS, " " * len(_NOT_ADDRESS)), F.lit(","), F.lit(" , "))
    own = F.replace(F.regexp_replace(letters, _PIN_WORD, " "), F.coalesce(state, F.lit("")), F.lit(""))
    ended = F.rtrim(F.rtrim(own, F.lit(string.whitespace)), F.lit(","))
    words = capwords(F.regexp_replace(ended, _JOINED_WORDS, " "))
    return correct_address(replace_patterns(words, DISTRICT_WORD_SPELLINGS), state)


def words_around(markers, reach) -> str:
    """Pattern of up to ``reach`` words before and after a word that holds a marker."""
    before, after = (rf"((?:{word}){{0,{reach}}})" for word in (r"\w+\s+", r"\s+\w+"))
    return rf"(?i){before}\S*(?:{'|'.join(markers)})\S*{after}"


def find_pin(c) -> Column:
    """The first six-digit code, else the first one written as 3 + 3 digits."""
    c = col(c)
    solid = F.regexp_extract(c, r"\d{6}", 0)
    parted = F.regexp_extract(c, r"\d{3}\s\d{3}", 0)
    return F.coalesce(F.nullif(solid, F.lit("")),
                      F.nullif(F.regexp_replace(parted, r"\s", ""), F.lit("")))


def to_initials(c) -> Column:
    """Four spellings of the initials of a name of two or three words.

    Names of one word, and names with digits, have none.
    """
    words = F.split(squeeze(c), " ")

    def capital(i):
        return F.get(words, i).rlike(r"^[A-Z]\w")

    def plain(i):
        return F.get(words, i).rlike(r"^\w+$")

    two = capital(0) & plain(0) & capital(1)
    count = F.when(two & plain(1) & capital(2), 3).otherwise(2)
    letters = F.transform(F.slice(words, F.lit(1), count), lambda w: F.substring(w, 1, 1))
    spaced = F.array_join(letters, " ")
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    forms = F.array(F.lower(spaced), spaced, F.array_join(letters, ""), F.concat_ws(" ", F.get(letters, 0), rest))
    spellings = F.transform(forms, lambda s: F.concat(F.lit(" "), s, F.lit(" ")))
    usable = two & ~col(c).rlike(r"^\s|\d")
    return F.when(usable, spellings).otherwise(F.array().cast("array<string>"))


def split_origin(c):
    """(state, market) from ``State_Market``; a single part stands for both."""
    parts = F.split(col(c), "_")
    state = F.trim(F.get(parts, 0))
    market = F.trim(F.coalesce(F.get(parts, 1), F.get(parts, 0)))
    return state, market


def per_kg(c) -> Column:
    """Price per quintal as price per kilogram; 'not reported' is NULL."""
    c = F.trim(col(c))
    return F.when(c != NOT_REPORTED, c.try_cast("double") / 100)


def market_without_district(market, district) -> Column:
    """The market name with its district's name and separator taken out.

    If nothing is left the district's name is used.
    """
    market, district = col(market), col(district)
    quoted = F.concat(F.lit(r"\Q"), district, F.lit(r"\E\W"))
    cut = F.trim(F.regexp_replace(market, quoted, F.lit("")))
    cut = F.regexp_replace(cut, r"^,+|,+$", "")
    cut = F.regexp_replace(cut, r"^\(+", "")
    cut = F.regexp_replace(cut, r"[()]+$", "")
    return (F.when(district.isNull() | ~F.contains(market, district), market)
            .otherwise(F.coalesce(F.nullif(cut, F.lit("")), district)))


def city_name(c) -> Column:
    return capitalize(replace_whole(c, CITY_ALIASES))


def is_summary_row(c) -> Column:
    return col(c).rlike(CITY_SUMMARY_ROWS)


def product_heading(c) -> Column:
    """Table headings without the blanks, dashes and stars of their layout."""
    return replace_patterns(c, {r"/\s*": "/", r"-\s*|\s*[*@]": ""})
