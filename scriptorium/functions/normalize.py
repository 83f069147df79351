"""Record-level scalars: slugs, ids, filters, lists and requests, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, _col, squash, words

MIN_ABSTRACT_BYTES = 200


def slug(label: Column | str) -> Column:
    """Runs of other characters than ASCII letters and digits become a dash, none at either end."""
    return F.regexp_replace(F.lower(F.regexp_replace(_col(label), "[^A-Za-z0-9]+", "-")), "^-|-$", "")


def fixed(number: Column | str, places: int) -> Column:
    """A number with so many decimals as C prints it: by its exact binary value, ties to the even digit.

    format_string rounds half up from the shortest decimal form: 0.125 and 0.345 have other last digits there.
    """
    return F.call_function("format_number", _col(number).cast("double"), F.lit("0." + "0" * places))


def strip_version(identifier: Column | str) -> Column:
    """What follows the last /abs/, without a version at its end."""
    return F.regexp_replace(F.regexp_replace(_col(identifier), "^.*/abs/", ""), "^(.+)v[0-9]+$", "$1")


def year_month_of_id(identifier: Column | str) -> Column:
    """The first day of the month in an id that begins YYMM after any slash; null if it has none."""
    tail = F.regexp_extract(_col(identifier), "([^/]*)$", 1)
    year, month = F.substring(tail, 1, 2), F.substring(tail, 3, 2)
    valid = tail.rlike("^[0-9]{4}") & month.between("01", "12")
    whole = F.when(year >= "91", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    return F.when(valid, F.make_date(F.try_to_number(whole, F.lit("9999")).cast("int"), F.try_to_number(month, F.lit("99")).cast("int"), F.lit(1)))


def retained(identifier: Column | str, title: Column | str, abstract: Column | str, published: Column | str) -> Column:
    """Whether a record has an id, a title, a date and an abstract of over 200 bytes, all squashed."""
    some = lambda x: F.coalesce(squash(x), F.lit("")) != ""
    long = F.coalesce(F.octet_length(squash(abstract)), F.lit(0)) > MIN_ABSTRACT_BYTES
    return some(identifier) & some(title) & long & _col(published).isNotNull()


def contains_word(text: Column | str, phrase: str) -> Column:
    """Whether a lower-cased phrase stands in the lower-cased text with no letter or digit on either side."""
    escaped = re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", phrase.lower())
    return F.lower(_col(text)).rlike(rf"(?<![\p{{L}}\p{{Nd}}]){escaped}(?![\p{{L}}\p{{Nd}}])")


def in_categories(categories: Column | str, wanted: list[str]) -> Column:
    """Whether a category is one of those wanted or lies under one."""
    if not wanted:
        return F.lit(True)
    return F.exists(_col(categories), lambda c: F.greatest(*[(c == w) | c.startswith(w + ".") for w in wanted], F.lit(False)))


def split_list(text: Column | str) -> Column:
    """The non-blank parts between commas, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), ",", -1), squash_ends), lambda x: x != "")


def squash_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


# What may stand before a keyword (a number with a sign behind it, or a bullet), and what encloses it.
_NUMBER, _BULLET, _QUOTES = "[0-9]+[.)]", "[-*•]", "\"'`"


def parse_keywords(answer: Column | str) -> Column:
    """Five keywords out of a model's answer, or none: at most six words each, distinct, in order.

    Of a part only what follows its last colon counts, without a number or bullet and quotes before it and
    without quotes and full stops behind it. Digits that no dot or bracket follows are part of the keyword.
    """
    parts = F.transform(F.split(F.coalesce(_col(answer), F.lit("")), "[,;\n]", -1), lambda x: squash_ends(F.regexp_replace(x, "^.*:", "")))
    begun = F.transform(parts, lambda x: F.regexp_replace(x, f"^({_NUMBER}|{_BULLET})?{BLANKS}*[{_QUOTES}]*", ""))
    bare = F.transform(begun, lambda x: F.lower(F.regexp_replace(x, f"[{_QUOTES}.]+$", "")))
    good = F.array_distinct(F.filter(bare, lambda x: F.size(words(x)).between(1, 6)))
    return F.when(F.size(good) >= 5, F.slice(good, 1, 5)).otherwise(F.array().cast("array<string>"))


MIN_KEYWORDS, MIN_WORDS, KEYWORD_WORDS = 5, 100, 6
#: More words between commas than keywords have.
LONG_PART = f"(?:[^,{BLANKS[1:-1]}]++{BLANKS}++){{{KEYWORD_WORDS}}}[^,{BLANKS[1:-1]}]"


def input_mode(raw: Column | str) -> Column:
    """A struct (mode, valid, counter) of what was typed in: keywords, abstract or empty.

    Short parts between commas, or one short text, are keywords, and five are wanted; anything else is an
    abstract of at least 100 words.
    """
    raw = F.coalesce(_col(raw), F.lit(""))

    def told(x: Column) -> Column:  # text and number of words, each computed once
        text, n = x["text"], x["n"]
        parts = split_list(text)
        # a long part is found where it begins, and the parts of a text that has one aren't asked for
        listed = F.when(text.rlike(LONG_PART), False).otherwise(F.size(parts) >= 1)
        short = F.when(text.contains(","), listed).otherwise(n <= KEYWORD_WORDS)
        mode = F.when(text == "", "empty").when(short, "keywords").otherwise("abstract")
        valid = F.when(text == "", False).when(short, F.size(parts) >= MIN_KEYWORDS).otherwise(n >= MIN_WORDS)
        counter = F.when(text == "", "").when(short, F.format_string(f"%d / {MIN_KEYWORDS} keywords", F.size(parts))).otherwise(F.format_string(f"%d / {MIN_WORDS} words", n))
        return F.struct(mode.alias("mode"), valid.alias("valid"), counter.alias("counter"))

    return F.get(F.transform(F.array(F.struct(squash_ends(raw).alias("text"), F.size(words(raw)).alias("n"))), told), F.lit(0))


def rebuilt_abstract(positions: Column | str) -> Column:
    """A text from a map of word to the places where it stands."""
    placed = F.transform(F.map_entries(_col(positions)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    return F.array_join(F.transform(F.array_sort(F.flatten(placed)), lambda x: x["w"]), " ")


# The words that decide whether a message asks for an action.
QUESTION_STARTERS = ["how", "what", "why", "which", "where", "when", "who", "is", "are", "does"]
ACTION_VERBS = """
run execute start launch harvest crawl scrape download fetch delete remove rename
install update change set build rebuild schedule register open browse search google
""".split()
MODAL_PREFIXES = ["can you ", "could you ", "would you ", "will you ", "can we ", "could we "]
OVERVIEW_WORDS = ["gap", "trend", "emerging", "communit", "topic", "area", "overview", "summary", "corpus", "this project"]


def asks_for_action(message: Column | str) -> Column:
    """'execute' for a message that carries code or begins with an action verb, else 'none'."""
    text = squash_ends(F.coalesce(_col(message), F.lit("")))
    lower = F.lower(text)
    code = text.contains("```") | lower.contains("sudo ") | lower.contains("rm -rf") | F.exists(F.split(text, "\n", -1), lambda x: squash_ends(x).startswith("$ "))
    first = lambda x: F.regexp_replace(F.coalesce(F.get(words(x), F.lit(0)), F.lit("")), r"^\P{L}+|\P{L}+$", "")
    polite = F.regexp_replace(lower, "^please ", "")
    asked = F.regexp_replace(polite, "^(" + "|".join(MODAL_PREFIXES) + ")", "")
    return F.when(text == "", "none").when(code, "execute").when(first(lower).isin(QUESTION_STARTERS), "none").when(first(asked).isin(ACTION_VERBS), "execute").otherwise("none")


def wants_overview(message: Column | str) -> Column:
    """Whether a message is about the corpus as a whole."""
    lower = F.lower(_col(message))
    return F.greatest(*[lower.contains(w) for w in OVERVIEW_WORDS])
