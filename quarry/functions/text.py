"""Identifier tokens, stems and query terms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried, and the synonym lexicon.
RU_SUFFIXES = (
    "иями ями ами ого его ому ему ыми ими иях ять ует ает ится иться ость есть иям ять ать ять еть ить оть ути ешь ишь ете ите ёт ет ит ат ят ем им "
    "ом ам ям ах ях ов ев ей ой ая яя ое ее ие ые ий ый а я о е у ю ы и ь й"
).split()
EN_SUFFIXES = "ingly edly ing ed ies es s ly ers er e".split()
REFLEXIVE = ("ся", "сь")
LEXICON = {
    "frontend": ("web", "ui", "client"),
    "backend": ("server", "api"),
    "send": ("fetch", "post", "request"),
    "отправ": ("fetch", "post", "send"),
    "create": ("new", "make"),
    "созда": ("create", "new"),
    "error": ("ошибк", "fail"),
    "ошибк": ("error", "fail"),
    "user": ("пользовател",),
    "пользовател": ("user",),
    "token": ("токен",),
    "токен": ("token",),
    "order": ("заказ",),
    "заказ": ("order",),
    "invoice": ("счёт", "счет", "bill"),
    "счёт": ("invoice", "bill"),
    "счет": ("invoice", "bill"),
    "payment": ("оплат", "платёж", "платеж"),
    "оплат": ("payment", "pay"),
    "price": ("цен",),
    "цен": ("price", "cost"),
    "discount": ("скидк",),
    "скидк": ("discount",),
}
#: Words up to this length stay whole, and a cut leaves at least MIN_STEM.
WHOLE, MIN_STEM = 4, 3
BYTES_PER_TOKEN = 4

IDENT = r"[\p{L}\p{Nd}_]+"
BOUNDARY = r"(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})|(?<=[^\p{Lu}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: Identifiers without an inner boundary: one candidate, no fold.
PLAIN = r"^(\p{Lu}?[^\p{Lu}\p{Nd}_]*|\p{Nd}+)$"


def idents(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENT), F.lit(0))


def without_reflexive(word: Column) -> Column:
    reflexive = reduce(lambda a, b: a | b, (F.endswith(word, F.lit(s)) for s in REFLEXIVE))
    return F.when(reflexive, F.left(word, F.length(word) - 2)).otherwise(word)


def stem(word: Column, base: Column | None = None) -> Column:
    """One suffix off: the first of its list that leaves three characters; by a CASE, not a pattern, for order is not longest match.

    ``base`` is the word :func:`without_reflexive` where that is a column already, so that each test reads it."""
    base = without_reflexive(word) if base is None else base

    def first(suffixes: list[str]) -> Column:
        case = None
        for s in dict.fromkeys(suffixes):
            fits = F.endswith(base, F.lit(s)) & (F.length(base) - len(s) >= MIN_STEM)
            cut = F.left(base, F.length(base) - len(s))
            case = F.when(fits, cut) if case is None else case.when(fits, cut)
        return case.otherwise(base)

    kept = (F.length(word) <= WHOLE) | ~F.rlike(word, F.lit(r"^\p{L}"))
    latin = F.rlike(word, F.lit(r"^[\x00-\x7F]"))
    # Suffixes of the second list all end in a small Cyrillic letter.
    return F.when(kept, word).when(latin, first(EN_SUFFIXES)).when(~F.rlike(base, F.lit("[а-яё]$")), base).otherwise(first(RU_SUFFIXES))


def short_stem(word: Column) -> Column:
    """:func:`stem` with its suffixes as data: a small plan for few words, where the CASE's many branches take longer to plan than to run."""
    base = without_reflexive(word)

    def first(suffixes: list[str]) -> Column:
        fits = F.filter(F.array(*map(F.lit, dict.fromkeys(suffixes))), lambda s: F.endswith(base, s) & (F.length(base) - F.length(s) >= MIN_STEM))
        return F.left(base, F.length(base) - F.coalesce(F.length(F.get(fits, F.lit(0))), F.lit(0)))

    kept = (F.length(word) <= WHOLE) | ~F.rlike(word, F.lit(r"^\p{L}"))
    return F.when(kept, word).when(F.rlike(word, F.lit(r"^[\x00-\x7F]")), first(EN_SUFFIXES)).otherwise(first(RU_SUFFIXES))


def candidates(ident: Column) -> Column:
    """The identifier, then each underscore segment and its camel-case parts, lower-cased."""
    segments = F.filter(F.split(ident, "_", -1), lambda s: s != "")
    parts = F.transform(segments, lambda s: F.concat(F.array(s), F.split(s, BOUNDARY, -1)))
    return F.transform(F.concat(F.array(ident), F.flatten(parts)), F.lower)


def folded_tokens(ident: Column) -> Column:
    """Tokens of one identifier: each new candidate, followed by its stem where that differs."""

    def add(seen: Column, word: Column) -> Column:
        cut = short_stem(word)
        return F.when(F.array_contains(seen, word), seen).otherwise(F.concat(seen, F.when(cut == word, F.array(word)).otherwise(F.array(word, cut))))

    return F.aggregate(F.filter(candidates(ident), lambda c: c != ""), F.array().cast("array<string>"), add)


def ident_tokens(ident: Column) -> Column:
    """:func:`folded_tokens`, with a short way for identifiers without an inner boundary."""
    low = F.lower(ident)
    return F.when(F.rlike(ident, F.lit(PLAIN)), F.array_distinct(F.array(low, short_stem(low)))).otherwise(folded_tokens(ident))


def expand(terms: Column) -> Column:
    """Distinct terms, each followed by its synonyms; a term first met as a synonym is not expanded."""
    lexicon = F.create_map(*(x for k, v in LEXICON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def add(seen: Column, term: Column) -> Column:
        more = F.array_except(F.coalesce(F.try_element_at(lexicon, term), F.array().cast("array<string>")), F.array_append(seen, term))
        return F.when(F.array_contains(seen, term), seen).otherwise(F.concat(F.array_append(seen, term), more))

    return F.aggregate(F.array_distinct(terms), F.array().cast("array<string>"), add)


def query_terms(text: Column) -> Column:
    return expand(F.flatten(F.transform(idents(text), ident_tokens)))


def grep_terms(text: Column) -> Column:
    """Words of more than three letters or digits, lower-cased, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda t: F.length(t) > 3)


def token_estimate(n_bytes: Column) -> Column:
    """Tokens that so many bytes stand for: a quarter, rounded down."""
    return F.floor(n_bytes / BYTES_PER_TOKEN).cast("long")


def strip_code(line: Column, language: Column) -> Column:
    """A line without string literals and without what follows a comment mark."""
    bare = F.regexp_replace(line, r"""`[^`]*`|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", "")
    return F.when(language == "python", F.substring_index(bare, "#", 1)).otherwise(F.substring_index(bare, "//", 1))


def lines_of(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def passage_text(*fields: str) -> Column:
    """Non-empty fields, each with a line end."""
    return F.array_join(F.transform(F.filter(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)), lambda x: x != ""),
        lambda x: F.concat(x, F.lit("\n"))), "")
