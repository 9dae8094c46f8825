"""The tokens of an identifier in plain Python, for Arrow functions: what :func:`quarry.functions.text.folded_tokens` gives."""

from __future__ import annotations

import re
import unicodedata

from quarry.functions.text import EN_SUFFIXES, MIN_STEM, REFLEXIVE, RU_SUFFIXES, WHOLE

#: A word without an inner boundary, which most identifiers are.
_PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё][a-zß-öø-ÿа-яё]*|[0-9]+)\Z")


def _by_end(suffixes: list[str]) -> dict[str, tuple[str, ...]]:
    """Suffixes by their last letter, in the order in which they are tried."""
    return {c: tuple(s for s in dict.fromkeys(suffixes) if s[-1] == c) for c in {s[-1] for s in suffixes}}


_EN, _RU = _by_end(EN_SUFFIXES), _by_end(RU_SUFFIXES)
_ASCII_BOUNDARY = re.compile("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[^A-Z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def stem(word: str) -> str:
    if len(word) <= WHOLE or not (word[0].isalpha() and unicodedata.category(word[0])[0] == "L"):
        return word
    base = word[:-2] if word.endswith(REFLEXIVE) else word
    for suffix in (_EN if word[0] < "\x80" else _RU).get(base[-1], ()):
        if len(base) - len(suffix) >= MIN_STEM and base.endswith(suffix):
            return base[: -len(suffix)]
    return base


def parts(segment: str) -> list[str]:
    """Camel-case parts, and digits apart from the rest."""
    if segment.isascii():
        return _ASCII_BOUNDARY.split(segment)
    kinds = [unicodedata.category(c) for c in segment]
    at = [0]
    for i in range(1, len(segment)):
        a, b, c = kinds[i - 1], kinds[i], kinds[i + 1] if i + 1 < len(kinds) else ""
        if (a == "Nd") != (b == "Nd") or b == "Lu" and (a not in ("Lu", "Nd") or c == "Ll" and a == "Lu"):
            at.append(i)
    return [segment[x:y] for x, y in zip(at, [*at[1:], len(segment)], strict=True)]


def tokens(ident: str) -> list[str]:
    """Each new candidate, followed by its stem where that differs."""
    if _PLAIN.match(ident):
        word = ident.lower()
        cut = stem(word)
        return [word] if cut == word else [word, cut]
    found: list[str] = []
    segments = [s for s in ident.split("_") if s]
    for candidate in [ident, *(x for s in segments for x in (s, *parts(s)))]:
        word = candidate.lower()
        if word and word not in found:
            cut = stem(word)
            found += [word] if cut == word else [word, cut]
    return found
