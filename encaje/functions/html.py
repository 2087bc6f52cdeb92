"""Reading HTML with Column functions only.

A page becomes an array of small structs, one per tag or piece of text. Element
selection walks that array inside the row, so a page is never exploded and
nothing is shuffled.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.functions.text import let, strip

_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<[!?][^>]*>"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    # possessive, so that no number of quoted values makes the matcher recurse
    r"""|</?[a-z][^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>"""
    r"|</?[a-z][^<>]*+>"  # a quote that never closes: the tag ends at its first >
    r"|[^<]+|<"
)
_CLASS = r"""(?is)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ENTITY = r"&#[xX]?[0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"

_COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "ndash", "mdash", "hellip", "eacute",
           "aacute", "iacute", "oacute", "uacute", "ntilde", "euro", "laquo", "raquo")

OPEN, CLOSE, SINGLE, TEXT, OTHER = 1, -1, 2, 0, 9


def _from_codepoint(n: Column) -> Column:
    """One character; numbers that are no character become U+FFFD."""
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    safe = F.when(valid, n).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _windows_1252() -> dict[int, str]:
    """Code points 128 to 159 as browsers read them."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


def _constant_map(entries: dict) -> Column:
    """A map the optimizer folds into one constant."""
    text = "\x01".join(f"{k}\x02{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def unescape(c: Column) -> Column:
    """Decode character references; unknown names stay, without their semicolon."""
    names = _constant_map({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
    # a map is searched entry by entry, so the few names that pages use come first
    common = _constant_map({k: html5[f"{k};"] for k in _COMMON})
    windows = _constant_map(_windows_1252())

    def decode(p: Column) -> Column:
        name = F.regexp_extract(p, "^&([a-zA-Z][a-zA-Z0-9]*);?$", 1)
        digits = F.regexp_extract(p, "^&#([0-9]{1,9});?$", 1)
        hexes = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]{1,7});?$", 1)
        number = F.when(digits != "", F.try_to_number(digits, F.lit("999999999")).cast("bigint")
                        ).when(hexes != "", F.conv(hexes, 16, 10).cast("bigint"))
        named = F.coalesce(F.try_element_at(common, name), F.try_element_at(names, name),
                           F.concat(F.lit("&"), name))
        numbered = F.coalesce(F.try_element_at(windows, number.cast("string")),
                              _from_codepoint(number))
        return (F.when(~F.startswith(p, F.lit("&")), p)
                .when(number.isNotNull(), numbered)
                .when(name != "", named)
                .otherwise(p))

    pieces = F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decode), "")
                  ).otherwise(c)


def html_tokens(html: Column) -> Column:
    """``array<struct<kind, name, cls, text>>`` of a page.

    Comments, declarations, scripts and styles keep their place as OTHER, so
    that the texts around them stay separate.
    """
    # A "<" that starts no markup is text.
    safe = F.regexp_replace(html, r"<(?![a-zA-Z/!?])", "&lt;")
    raw = F.regexp_extract_all(safe, F.lit(_TOKEN), F.lit(0))

    def read(t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        dropped = tag.isin("script", "style")
        cls = F.when(
            t.rlike(r"(?i)\sclass\s*="),
            F.concat(*[F.regexp_extract(t, _CLASS, g) for g in (1, 2, 3)]))
        kind = (F.when(~t.startswith("<"), TEXT)
                .when((tag == "") | dropped, OTHER)
                .when(t.startswith("</"), CLOSE)
                .when(t.endswith("/>") | tag.isin(lexicon.VOID_TAGS), SINGLE)
                .otherwise(OPEN))
        text = F.when(~t.startswith("<"), strip(unescape(t)))
        return F.struct(kind.alias("kind"), tag.alias("name"), cls.alias("cls"),
                        text.alias("text"))

    return F.transform(raw, read)


def text_of(tokens: Column, joiner: Column | None = None) -> Column:
    """The stripped, non-empty texts of a token array, by default joined by blanks."""
    joiner = F.lit(" ") if joiner is None else joiner
    texts = F.filter(tokens, lambda t: (t["kind"] == TEXT) & (t["text"] != ""))
    return F.call_function("array_join", F.transform(texts, lambda t: t["text"]), joiner)


def _first_element(tokens: Column, tags: list[str], class_pattern: str) -> Column:
    """Position of the first fitting start tag, 0 if there is none."""
    pattern = "(?iu)" + class_pattern

    def fits(t: Column) -> Column:
        return (t["kind"].isin(OPEN, SINGLE) & t["name"].isin(tags)
                & F.coalesce(t["cls"].rlike(pattern), F.lit(False)))

    return F.coalesce(F.array_position(F.transform(tokens, fits), True), F.lit(0)).cast("int")


def _element_ends(tokens: Column, starts: Column) -> Column:
    """For each start position, that of the tag closing the element, 0 if none does.

    One walk over the tags keeps the stack of open elements: an end tag closes
    everything up to its own start tag, and is ignored if no such element is open.
    """
    tags = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t["kind"].alias("kind"), t["name"].alias("name"),
                                                  (i + 1).alias("pos"))),
        lambda t: t["kind"].isin(OPEN, CLOSE))
    state = F.struct(
        F.array().cast("array<string>").alias("stack"),
        F.transform(starts, lambda s: F.lit(-1)).alias("depths"),
        F.transform(starts, lambda s: F.lit(0)).alias("ends"),
        F.lit(0).alias("waiting"))

    def opened(acc: Column, t: Column) -> Column:
        """Push; remember the depth of the elements asked for."""
        here = F.array_contains(starts, t["pos"])
        size = F.size(acc["stack"])
        return F.struct(
            F.concat(acc["stack"], F.array(t["name"])).alias("stack"),
            F.when(here, F.zip_with(starts, acc["depths"], lambda s, d: F.when(
                s == t["pos"], size).otherwise(d))).otherwise(acc["depths"]).alias("depths"),
            acc["ends"].alias("ends"),
            F.when(here, acc["waiting"] + 1).otherwise(acc["waiting"]).alias("waiting"))

    def closed(acc: Column, t: Column) -> Column:
        """Pop; note the end of the elements that were on the part popped."""
        back = F.array_position(F.reverse(acc["stack"]), t["name"]).cast("int")
        stack = F.when(back > 0, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - back)
                       ).otherwise(acc["stack"])

        def note(new: Column) -> Column:
            ends = F.zip_with(acc["depths"], acc["ends"], lambda d, e: F.when(
                (e == 0) & (d >= 0) & (F.size(new) <= d), t["pos"]).otherwise(e))
            return F.struct(
                new.alias("stack"), acc["depths"].alias("depths"),
                F.when(acc["waiting"] > 0, ends).otherwise(acc["ends"]).alias("ends"),
                acc["waiting"].alias("waiting"))

        return let(stack, note)

    def step(acc: Column, t: Column) -> Column:
        return F.when(t["kind"] == OPEN, opened(acc, t)).otherwise(closed(acc, t))

    return F.aggregate(tags, state, step, lambda acc: acc["ends"])


def element_texts(tokens: Column, wanted: list[tuple[list[str], str, str]]) -> Column:
    """For each (tags, class pattern, joiner), the text of the first such element.

    An entry is null if the page has no such element, and empty if it has no text.
    """
    joiners = F.array(*[F.lit(joiner) for _, _, joiner in wanted])
    starts = F.array(*[_first_element(tokens, tags, cls) for tags, cls, _ in wanted])

    def cut(starts: Column, ends: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            single = F.get(tokens, start - 1)["kind"] == SINGLE
            end = F.get(ends, i)
            last = F.when(end > 0, end).otherwise(F.size(tokens))
            return (F.when(start == 0, F.lit(None).cast("string"))
                    .when(single, F.lit(""))
                    .otherwise(text_of(F.slice(tokens, start, last - start + 1),
                                       F.get(joiners, i))))

        return F.transform(starts, one)

    none = F.transform(joiners, lambda j: F.lit(None).cast("string"))
    return let(starts, lambda s: F.when(
        F.exists(s, lambda at: at > 0),
        let(_element_ends(tokens, s), lambda e: cut(s, e))).otherwise(none))
