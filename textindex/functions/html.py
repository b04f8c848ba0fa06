"""HTML title, visible text and links as column expressions.

A page is cut once, from left to right, into an array of lexemes: comments, raw-text
elements (``script``, ``title``, ``textarea`` and their like, whole), tags with their
quoted attributes, and runs of text. So a ``>`` in an attribute ends no tag, and
nothing inside a comment or a raw element can pass for one. Title, text and links
are taken from that array.

The body begins where a tree builder would begin it: at the body tag, at the first tag
that does not belong to the head, or at the first text outside it.

Divergences from a tree builder, by design: block-level tags and comments become a
space (a tree's text would glue ``<li>a</li><li>b</li>`` into ``ab``), and
script/style/noscript are dropped at any depth. A title that is not closed takes the
rest of the page, as in a tree.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textindex.functions.text import WHITESPACE_CLASS, collapse_whitespace, trim_go

_SP = r"[ \t\n\r\f]"
_END = r"(?=[ \t\n\r\f/>])"

# Named character references come from the standard library's table of them; those of
# its names that lack the semicolon may also be written without one.
_NAMED = {name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")}
_UNCLOSED = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
# The references that pages mostly use, looked up before the table.
_FREQUENT = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
REFERENCE_PATTERN = r"&(?:#[0-9]++;?|#[xX][0-9A-Fa-f]++;?|[A-Za-z][A-Za-z0-9]*+;?)"
ATTRIBUTE_REFERENCE_PATTERN = r"&(?:#[0-9]++;?|#[xX][0-9A-Fa-f]++;?|[A-Za-z][A-Za-z0-9]*+[;=]?)"

# What numeric references 128-159 stand for.
_WINDOWS_1252 = ("€ \x81 ‚ ƒ „ … † ‡ ˆ ‰ Š ‹ Œ \x8d Ž \x8f \x90 ‘ ’ “ ” • – — ˜ ™ š › œ \x9d ž Ÿ")

# Tags that separate text blocks (replaced by a space).
BLOCK_TAGS = ("address article aside blockquote br dd div dl dt figcaption figure footer "
              "form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody "
              "td tfoot th thead tr ul").split()
# Elements whose content is text up to their own end tag, of which the
# first three are never shown, and the tags that may stand before the body.
HIDDEN_TAGS = "script style noscript".split()
RAW_TAGS = HIDDEN_TAGS + "textarea title iframe xmp noembed noframes".split()
HEAD_TAGS = HIDDEN_TAGS + "html head title meta link base basefont bgsound noframes template".split()

# What follows a tag's name: quotes count only where a value begins.
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+)"""
_ATTRIBUTES = rf"(?:[^>=]++|={_SP}*+{_VALUE}?+)*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*+(?:>|\z)|</[^A-Za-z][^>]*+(?:>|\z)"
_RAW = (rf"<({'|'.join(RAW_TAGS)}){_END}{_ATTRIBUTES}>"
        rf".*?(?:</\1{_END}[^>]*+(?:>|\z)|\z)")
_TAG = rf"</?[A-Za-z][^ \t\n\r\f/>]*+{_ATTRIBUTES}(?:>|\z)"
LEXEME_PATTERN = rf"(?is){_COMMENT}|{_RAW}|{_TAG}|[^<]++|<"
NAME_PATTERN = r"^<(/?[A-Za-z][^ \t\n\r\f/>]*)"
ATTRIBUTE_PATTERN = rf"[^ \t\n\r\f/>=<][^ \t\n\r\f/>=]*+(?:{_SP}*+={_SP}*+{_VALUE}?+)?+"
HREF_PATTERN = rf"(?is)^href(?:{_SP}*=|$)"
# What stands for a tag within a line, so that no reference forms across it; a code
# point that is no character.
_SEAM = "\ufdd0"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_array(values: list[str]) -> Column:
    """An array literal, folded once: joined by a character that no value has."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def _named(body: Column, names: list[str], texts: dict[str, str]) -> Column:
    return F.element_at(F.map_from_arrays(_literal_array(names), _literal_array([texts[n] for n in names])), body)


def _character(number: Column) -> Column:
    """The character of a code point; U+FFFD for those that are none."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    mapped = F.get(_literal_array(_WINDOWS_1252.split(" ")), (number - 128).cast("int"))
    return (F.when(number.between(128, 159), mapped).when(valid, plain)
            .otherwise(F.lit("�")))


def _reference(ref: Column, attribute: bool) -> Column:
    """What one reference stands for, with or without its semicolon.

    A name that lacks it counts up to the longest that may, so ``&copy2020`` is the
    sign and a year; in an attribute only if no letter, digit or ``=`` follows.
    """
    body = F.regexp_replace(ref, "^&|[;=]$", "")
    hexed = F.conv(F.regexp_extract(body, "^#[xX]0*([0-9A-Fa-f]{1,8})$", 1), 16, 10)
    plain = F.regexp_extract(body, "^#0*([0-9]{1,9})$", 1)
    number = F.coalesce(F.nullif(hexed, F.lit("")), F.nullif(plain, F.lit(""))).cast("bigint")
    begun = F.regexp_extract(body, "^(?:" + "|".join(_UNCLOSED) + ")", 0)
    rest = F.substring(ref, F.length(begun) + 2, F.length(ref))
    partly = F.when((begun != "") & (rest == "" if attribute else F.lit(True)),
                    F.concat(_named(begun, _UNCLOSED, html5), rest))
    named = F.coalesce(F.when(ref.endswith(";"), _named(body, list(_NAMED), _NAMED)), partly, ref)
    out = F.when(F.startswith(body, F.lit("#")),
                 F.when(body.rlike("^#[xX]?0+$") | number.isNull(), F.lit("�")).otherwise(_character(number)))
    for name, text in _FREQUENT.items():
        out = out.when(ref == name, F.lit(text))
    return out.otherwise(named)


def decode_entities(c, attribute: bool = False) -> Column:
    """Character references resolved in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    pattern = ATTRIBUTE_REFERENCE_PATTERN if attribute else REFERENCE_PATTERN

    def decoded(text: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                            lambda r: _reference(r, attribute))
        joined = F.array_join(F.zip_with(pieces, found, lambda p, r: F.concat(
            p, F.coalesce(r, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)

    return _once(_col(c), decoded)


def lexemes(html) -> Column:
    """The page cut into ``(lex, name)``: what is written, and a tag's name in lower case
    (with its slash, if it ends an element; empty for text and comments)."""
    return F.transform(
        F.regexp_extract_all(_col(html), F.lit(LEXEME_PATTERN), F.lit(0)),
        lambda x: F.struct(x.alias("lex"), F.when(F.startswith(x, F.lit("<")), F.lower(
            F.regexp_extract(x, NAME_PATTERN, 1))).otherwise(F.lit("")).alias("name")))


def _is_text(lex: Column) -> Column:
    return ~F.startswith(lex, F.lit("<")) | (lex == "<")


def _inner(lex: Column) -> Column:
    """What is inside a raw-text element."""
    return F.regexp_replace(F.regexp_replace(lex, rf"(?is)^<[A-Za-z]+{_ATTRIBUTES}>", ""),
                            rf"(?is)</(?:{'|'.join(RAW_TAGS)}){_END}[^>]*+>?$", "")


def title_of(parts: Column) -> Column:
    """C8 of a page's ``lexemes``."""
    first = F.get(F.filter(parts, lambda p: p["name"] == "title"), F.lit(0))["lex"]
    return F.when(parts.isNotNull(), F.coalesce(trim_go(decode_entities(_inner(first))), F.lit("")))


def _body(parts: Column) -> Column:
    """The lexemes from the one on that opens the body."""
    opens = F.transform(parts, lambda p: F.when(
        p["name"] != "", ~F.startswith(p["name"], F.lit("/")) & ~p["name"].isin(HEAD_TAGS)).otherwise(
        _is_text(p["lex"]) & F.rlike(p["lex"], F.lit(f"(?!{WHITESPACE_CLASS})."))))
    return _once(F.array_position(opens, True).cast("int"), lambda at: F.when(
        at > 0, F.slice(parts, at, F.size(parts))).otherwise(F.filter(parts, lambda p: F.lit(False))))


def text_of(parts: Column) -> Column:
    """C9 of a page's ``lexemes``."""
    spaced = ["", *HIDDEN_TAGS, *BLOCK_TAGS, *["/" + t for t in BLOCK_TAGS]]
    shown = F.transform(_body(parts), lambda p: F.when(_is_text(p["lex"]), p["lex"])
                        .when(p["name"].isin(spaced), F.lit(" "))
                        .when(p["name"].isin(RAW_TAGS), _inner(p["lex"])).otherwise(F.lit(_SEAM)))
    return collapse_whitespace(F.replace(decode_entities(F.array_join(shown, "")), F.lit(_SEAM), F.lit("")))


def hrefs_of(parts: Column) -> Column:
    """C11 of a page's ``lexemes``: the first ``href`` of every ``a`` tag."""
    def value(tag: Column) -> Column:
        found = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE_PATTERN), F.lit(0)),
                               lambda a: F.rlike(a, F.lit(HREF_PATTERN))), F.lit(0))
        bare = F.regexp_replace(found, rf"(?is)^href(?:{_SP}*={_SP}*)?", "")
        return decode_entities(F.regexp_replace(bare, r"""(?s)^"(.*?)"?$|^'(.*?)'?$""", "$1$2"), attribute=True)

    return F.filter(F.transform(F.filter(parts, lambda p: p["name"] == "a"), lambda p: value(p["lex"])),
                    lambda h: h.isNotNull())


def html_title(html) -> Column:
    """Text of the first <title>, entities decoded, trimmed ('' if none)."""
    return _once(lexemes(html), title_of)


def visible_text(html) -> Column:
    """The body's visible text with whitespace runs collapsed to one space."""
    return _once(lexemes(html), text_of)


def has_min_content(text, min_bytes: int = 100) -> Column:
    """Keep pages whose cleaned text has at least ``min_bytes`` UTF-8 bytes."""
    return F.octet_length(_col(text)) >= F.lit(min_bytes)


def hrefs(html) -> Column:
    """C11: every ``<a href>`` value in document order, quoted either way or bare,
    entities decoded."""
    return _once(lexemes(html), hrefs_of)
