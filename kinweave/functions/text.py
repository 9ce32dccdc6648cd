"""Cleaning of names, phones, dates, addresses and identifiers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from kinweave.config import SETTINGS

# Results depend on these exact lists.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "smt", "shri", "kum"]
JUNK_PHONES = ["9999999999", "8888888888", "7777777777", "6666666666", "9876543210", "1234567890"]
ABBREVIATIONS = {
    "rd": "road", "ngr": "nagar", "st": "street", "crs": "cross", "lyt": "layout",
    "apt": "apartment", "opp": "opposite", "mg": "mg",
}
ADDRESS_NOISE = ["no", "house", "flat", "door"]
DATE_PATTERNS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "d.M.yyyy"]
TOKEN_ALIASES = {"mohd": "mohammed", "md": "mohammed"}
SOUND_RULES = [
    ("ksh", "x"), ("ck", "k"), ("q", "k"), ("ph", "f"), ("ow", "u"),
    ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"),
    ("gh", "g"), ("ch", "c"), ("jh", "j"), ("w", "v"), ("z", "j"),
    ("ee", "i"), ("oo", "u"), ("aa", "a"),
]


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, with ``x`` computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def name_tokens(raw: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z]+", " "), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(HONORIFICS))


def phone(raw: Column) -> Column:
    """+91 and ten digits, or null for what is no plausible mobile number."""
    def local(digits: Column) -> Column:
        return (
            F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10))
            .when((F.length(digits) == 11) & digits.startswith("0"), F.substring(digits, 2, 10))
            .otherwise(digits)
        )

    def checked(number: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(number, ""))) > 2
        return F.when(number.rlike("^[6-9][0-9]{9}$") & ~number.isin(JUNK_PHONES) & varied, F.concat(F.lit("+91"), number))

    return once(once(F.regexp_replace(raw, "\\D", ""), local), checked)


def email(raw: Column) -> Column:
    folded = F.lower(F.regexp_replace(raw, "^\\s+|\\s+$", ""))
    return once(folded, lambda x: F.when(x.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), x))


def birth_date(raw: Column) -> Column:
    """The first pattern that gives a date from 1900 to today."""
    squeezed = F.initcap(F.regexp_replace(F.regexp_replace(raw, "^\\s+|\\s+$", ""), "\\s+", " "))
    known = lambda day: F.when(day.between(F.lit("1900-01-01").cast("date"), F.current_date()), day)
    day = lambda x, pattern: once(F.to_date(F.try_to_timestamp(x, F.lit(pattern))), known)
    return once(squeezed, lambda x: F.coalesce(*[day(x, pattern) for pattern in DATE_PATTERNS]))


def _address_words(raw: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def _pin(words: Column) -> Column:
    return F.get(F.filter(words, lambda w: w.rlike("^[0-9]{6}$")), F.lit(0))


def address_pin(raw: Column) -> Column:
    return _pin(_address_words(raw))


def address(raw: Column) -> Column:
    longer = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])

    def told(words: Column) -> Column:
        rest = once(F.coalesce(_pin(words), F.lit("")), lambda pin: F.filter(words, lambda w: (w != pin) & ~w.isin(ADDRESS_NOISE)))
        return F.array_join(F.transform(rest, lambda w: F.coalesce(F.try_element_at(longer, w), w)), " ")

    return once(once(_address_words(raw), told), blank_to_null)


def pincode(raw_address: Column, given: Column) -> Column:
    return F.coalesce(blank_to_null(given), address_pin(raw_address))


def hashed_id(raw: Column, salt: str = SETTINGS.salt) -> Column:
    value = F.upper(F.regexp_replace(blank_to_null(raw), "\\s", ""))
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 24)


def sound_key(token: Column) -> Column:
    """Consonant skeleton under which spellings of a name agree."""
    def spelled(word: Column) -> Column:
        word = F.coalesce(*[F.when(word == short, F.lit(full)) for short, full in TOKEN_ALIASES.items()], word)
        for old, new in SOUND_RULES:
            word = F.replace(word, F.lit(old), F.lit(new))
        return word

    # the first letter stays, vowels after it go
    bare = F.regexp_replace(once(F.regexp_replace(F.lower(token), "[^a-z]", ""), spelled), "(?<!^)[aeiouy]", "")
    return F.regexp_replace(bare, "(.)\\1+", "$1")


def masked_phone(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 3), F.repeat(F.lit("*"), F.greatest(F.length(x) - 7, F.lit(0))), F.right(x, F.lit(4)))


def masked_email(x: Column) -> Column:
    user = F.substring_index(x, "@", 1)
    return F.concat(
        F.substring(user, 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(user) - 2, F.lit(1))),
        F.lit("@"), F.substring_index(x, "@", -1),
    )


def title_case(x: Column) -> Column:
    """Capital after every character that is no letter."""
    parts = F.regexp_extract_all(x, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def spoken_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[._]+", " "), "\\s+", " "))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.split(x, " "))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 where one is missing."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of white-space words; 0 where one is missing."""
    return set_overlap(word_set(a), word_set(b))


def date_relation(a: Column, b: Column) -> Column:
    """same, swapped (day and month), different, or null where one is missing."""
    return F.when(a == b, "same").when(crossed_dates(a, b), "swapped").when(a.isNotNull() & b.isNotNull(), "different")


def crossed_dates(a: Column, b: Column) -> Column:
    """Whether day and month of one are month and day of the other."""
    return (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b)) & (F.year(a) == F.year(b))


def as_of(x: Column) -> Column:
    """A point in time to the second; a zone is dropped. Null for what is no time."""
    return F.date_trunc("second", x.try_cast("timestamp_ntz")).cast("timestamp_ntz")


def register(spark: SparkSession) -> None:
    """Make the similarity functions callable from SQL."""
    from kinweave.functions.similarity import jaro_udf, jaro_winkler_udf, name_similarity_udf

    spark.udf.register("kw_jaro", jaro_udf)
    spark.udf.register("kw_jaro_winkler", jaro_winkler_udf)
    spark.udf.register("kw_name_similarity", name_similarity_udf)
