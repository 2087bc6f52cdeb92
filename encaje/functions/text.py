"""Text scalars: Column in, Column out, no Python on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaje import lexicon

# Unicode meaning of the short classes, spelled so that no JVM flag is needed.
# The common ranges stand first because the JVM tests a class from the left.
_SPACE = r"\x20\x09-\x0d\x1c-\x1f\x{85}\p{Z}"
_WORD = r"a-zA-Z0-9_\p{L}\p{N}"
SPACE = f"[{_SPACE}]"
NOT_SPACE = f"[^{_SPACE}]"
WORD = f"[{_WORD}]"
_EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
# Every character of _SPACE, one by one.
SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0e), *range(0x1c, 0x20), 0x85, 0xa0, 0x1680,
                           *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def portable(pattern: str) -> str:
    r"""Spell out ``\w \s \S \d \b`` as explicit Unicode classes."""
    inside = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
    outside = {"w": WORD, "s": SPACE, "S": NOT_SPACE, "d": r"\p{Nd}", "b": _EDGE}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            out.append((inside if in_class else outside).get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def ignoring_case(pattern: str) -> str:
    """A portable pattern that matches any case, accents included."""
    return "(?iu)" + portable(pattern)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Binding it as a lambda variable keeps the optimizer from inlining a costly
    expression into a loop over array elements.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def clean_lower(c: Column) -> Column:
    return F.lower(c)


def clean_email(c: Column) -> Column:
    # A run with an "@" inside is always dropped whole; anchoring at its start
    # keeps the scan linear on long runs without one.
    run_start = f"(?<!{NOT_SPACE})"
    run = f"{NOT_SPACE}[^{_SPACE}@]*+@{NOT_SPACE}+"
    return let(c, lambda t: F.when(
        F.contains(t, F.lit("@")), F.regexp_replace(t, run_start + run, " ")).otherwise(t))


def clean_url(c: Column) -> Column:
    # Every match holds one of the two; most texts have neither.
    return let(c, lambda t: F.when(
        F.contains(t, F.lit("http")) | F.contains(t, F.lit("www")),
        F.regexp_replace(t, portable(lexicon.URL), " ")).otherwise(t))


def clean_phone(c: Column) -> Column:
    return F.regexp_replace(c, portable(lexicon.PHONE), " ")


def clean_space(c: Column) -> Column:
    # Single blanks are left as they are, which is most of them.
    return F.regexp_replace(c, f"[{_SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " ")


def clean_chars(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{_WORD}{_SPACE}{lexicon.KEPT_PUNCTUATION}]", "")


def clean(c: Column) -> Column:
    """All cleaning steps in their fixed order, then trimmed."""
    for step in (clean_lower, clean_email, clean_url, clean_phone, clean_space, clean_chars):
        c = step(c)
    return F.trim(c)


def words(c: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD + "{2,}"), F.lit(0))


def ngrams(tokens: Column, longest: int = 2, shortest: int = 1) -> Column:
    """All 1-grams, then all 2-grams and so on, each in text order.

    ``shortest`` leaves out shorter ones. Longer grams over a null token are left out.
    """

    def grams(w: Column) -> Column:
        out = w if shortest == 1 else F.array().cast("array<string>")
        for n in range(2, longest + 1):
            gram = w
            for k in range(1, n):
                rest = F.slice(w, k + 1, F.greatest(F.size(w) - F.lit(k), F.lit(0)))
                gram = F.zip_with(gram, rest, lambda a, b: F.concat(a, F.lit(" "), b))
            if n < shortest:
                continue
            # zip_with pads the shorter side with null; a null gram ran off the end.
            out = F.concat(out, F.filter(gram, lambda g: g.isNotNull()))
        return out

    return let(tokens, grams)


def find_all(c: Column, patterns: list[str]) -> Column:
    """All matches of each pattern in turn, patterns in their given order.

    A pattern with a group yields the group, any other the whole match. The
    patterns are written in lower case; texts in lower case, like cleaned ones,
    are searched without ignoring case.
    """

    def found(spell: Callable[[str], str]) -> Column:
        lists = [F.regexp_extract_all(c, F.lit(spell(p)), F.lit(1 if _has_group(p) else 0))
                 for p in patterns]
        return lists[0] if len(lists) == 1 else F.concat(*lists)

    if not all(_ONE_CASE.fullmatch(p) for p in patterns):
        return found(ignoring_case)
    return F.when(_is_lower(c), found(portable)).otherwise(found(ignoring_case))


def first_of(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, trimmed; else an empty string."""
    tries = [F.nullif(F.regexp_extract(c, ignoring_case(p), 1), F.lit("")) for p in patterns]
    return strip(F.coalesce(*tries, F.lit("")))


def first_match(c: Column, pattern: str) -> Column:
    """The first whole match, trimmed; else an empty string."""
    return strip(F.regexp_extract(c, ignoring_case(pattern), 0))


def _has_group(pattern: str) -> bool:
    return "(" in pattern.replace("(?", "").replace("\\(", "")


def section(c: Column, headers: list[str], stops: list[str],
            word_boundary: bool = False) -> Column:
    """From the first header, in any case, up to the first later stop word or the end.

    The header is kept. ``word_boundary`` asks for whole words; by default a
    header inside a longer word counts too. Texts in lower case, like cleaned
    ones, need no pattern that ignores case; for plain words that is left out,
    and only places where a word can begin are looked at.
    """
    edge = _EDGE if word_boundary else ""
    head, stop = (f"{edge}(?:{'|'.join(w)}){edge}" for w in (headers, stops))
    found = F.regexp_extract(c, f"(?isu){head}.*?(?={stop}|\\z)", 0)
    if not word_boundary and all(_PLAIN.fullmatch(w) for w in [*headers, *stops]):
        found = F.when(_is_lower(c), F.regexp_extract(c, _plain_section(headers, stops), 0)).otherwise(found)
    return strip(found)


def _is_lower(c: Column) -> Column:
    """Whether a text is in lower case, without the two letters that ignoring case takes for an "s" and an
    "i" although they are lower case."""
    return (F.lower(c) == c) & ~F.contains(c, F.lit("ſ")) & ~F.contains(c, F.lit("ı"))


# Patterns whose letters are in lower case, but for whole ranges and short classes.
_ONE_CASE = re.compile(r"(?:A-Z|\\.|[\x00-@\[\]-\x7fñáéíóúü])*")
_PLAIN = re.compile("[a-zñáéíóúü ]+")  # words in lower case, without signs that a pattern gives a meaning


def _plain_section(headers: list[str], stops: list[str]) -> str:
    """The pattern of a section of a text in lower case: from letter to letter that a stop word can begin with."""
    heads, ends = ("".join(sorted({w[0] for w in words})) for words in (headers, stops))
    return (f"(?s)(?=[{heads}])(?:{_by_letter(headers)})[^{ends}]*+"
            f"(?:(?!{_by_letter(stops)}).[^{ends}]*+)*+")


def _by_letter(words: list[str]) -> str:
    """Alternatives that part by letters, so that few are tried; of several that match the first listed one does."""
    groups: dict[str, list[str]] = {}
    for i, w in enumerate(words):
        if not any(w.startswith(earlier) for earlier in words[:i]):  # that one matches first
            groups.setdefault(w[:1], []).append(w[1:])
    return "|".join(letter + (rest[0] if len(rest) == 1 else f"(?:{_by_letter(rest)})")
                    for letter, rest in groups.items())


def weighted(parts: list[tuple[Column, int]], keywords: list[Column],
             keyword_times: int = lexicon.KEYWORD_WEIGHT) -> Column:
    """Join the parts, each repeated by its weight, then the keywords, by one space.

    Empty parts and absent keyword lists leave no trace.
    """
    none = F.array().cast("array<string>")
    texts = [c for c, times in parts for _ in range(times)]
    joined = F.array_join(F.concat(*[F.coalesce(k, none) for k in keywords]), " ")
    texts += [joined] * keyword_times
    return F.array_join(F.filter(F.array(*texts), lambda x: x != ""), " ")
