"""Plain text of HTML by native expressions.

Markup is cut into tokens by one pattern that never goes back: quoted attribute values may hold ``>``, scripts and styles run
to their own end tag, comments and declarations to theirs. Whatever has no end takes the rest of the text as one token, so no
token is looked for twice; what is left of an unclosed comment or section is then cut again by a pattern without them. The
time is linear in the text. Block tags are line breaks; entities are looked up in a hashed table that is one literal.

``strip_html_exact`` is an Arrow UDF over the standard library's parser, whose text this is equal to (but that an entity in the name of a
tag stays one there if the name ends with a NUL); nothing here uses it.
"""

from __future__ import annotations

import html.entities
import json
import zlib
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import let, strip

# Tags that break a line, at both their ends.
BLOCK_TAGS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr")

# -- tokens ------------------------------------------------------------------------------------------------------------

#: White space, what ends a name, and what may come between attributes.
_S = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NAME_END = r"[\t\n\r\f />\x00]"
_GAP = rf"(?:{_S}|/(?!>))*+"
_ATTRIBUTE = rf"(?<=['\"/]|{_S})(?!{_S})([^/>](?:(?!{_S})[^/=>])*+)(?:{_S}*=+{_S}*('[^']*+'|\"[^\"]*+\"|(?!['\"])(?:(?!{_S})[^>])*+))?+{_GAP}"
_REST = rf"{_GAP}(?:{_ATTRIBUTE.replace('([^/>]', '(?:[^/>]', 1).replace('(' + chr(39), '(?:' + chr(39), 1)})*+"


def _raw(name: str) -> str:
    """An element whose content is no markup, with its end tag or to the end of the text."""
    return rf"<{name}(?={_NAME_END}){_REST}>(?:[^<]++|<(?!/{_S}*+{name}{_S}*+>))*+(?:</{_S}*+{name}{_S}*+>|\z)"


_COMMENT = rf"<!--(?:[^-]++|-(?!-{_S}*+>))*+(?:--{_S}*+>|\z)"
_SECTION = rf"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-z0-9])(?:[^\]]++|\](?!{_S}*+\]{_S}*+>))*+(?:\]{_S}*+\]{_S}*+>|\z)"
_CONDITION = rf"<!\[(?:if|else|endif)(?![-_.a-z0-9])(?:[^\]]++|\](?!{_S}*+>))*+(?:\]{_S}*+>|\z)"
#: What may have no end: comment, section, condition. The letters say which of them there are.
_OPEN = {"c": _COMMENT, "s": _SECTION, "i": _CONDITION}
#: Beginnings of those, for the markup behind one that has no end: text.
_BEGIN = {"c": "<!--", "s": r"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-z0-9])", "i": r"<!\[(?:if|else|endif)(?![-_.a-z0-9])"}


def _pattern(gone: str = "") -> str:
    """The pattern of tokens, without the kinds in ``gone``, which the text is known not to close.

    A token that begins as markup and has no end is text and stops before the next ``>``, so what ends with one is markup.
    """
    there = "|".join(p for k, p in _OPEN.items() if k not in gone)
    not_there = "".join(rf"|{_BEGIN[k]}[^>]*+" for k in gone)
    tag = rf"<[a-z](?:(?!{_NAME_END}).)*+{_REST}/?>"
    return rf"(?is)[^<]++|{_raw('script')}|{_raw('style')}|{tag}{not_there}|{there}|</[^>]*+>|<[!?][^>]*+>|<[a-z](?:(?!{_NAME_END}).)*+(?=\x00)|<[a-z/!?][^>]*+|<".replace("||", "|")


def tokens(raw: Column) -> Column:
    """The tokens of markup, whose texts together are the markup.

    Only the last one can be a comment, section or condition without an end. It is cut again by a pattern that does not
    know that kind; at most once for each kind.
    """
    # By the sum of the kinds that are gone: 1 for comments, 2 for sections, 4 for conditions.
    patterns = F.array(*[F.lit(_pattern("".join(k for bit, k in enumerate(_OPEN) if mask >> bit & 1))) for mask in range(8)])

    def unclosed(t: Column, gone: Column) -> Column:
        """The kind of a last token without an end, or 0."""
        out = F.lit(0)
        for bit, (k, end) in enumerate((("c", "--"), ("s", rf"\]{_S}*\]"), ("i", r"\]"))):
            out = F.when((gone.bitwiseAND(1 << bit) == 0) & t.rlike(rf"(?is)^{_BEGIN[k]}(?!.*{end}{_S}*>$)"), 1 << bit).otherwise(out)
        return F.when(F.startswith(t, F.lit("<!")), out).otherwise(0)

    def again(s: Column, _: Column) -> Column:
        def more(kind: Column) -> Column:
            gone = s["gone"] + kind
            head = F.slice(s["all"], 1, F.size(s["all"]) - 1)
            cut = F.regexp_extract_all(F.element_at(s["all"], -1), F.get(patterns, gone), F.lit(0))
            return F.when(kind == 0, s).otherwise(F.struct(F.concat(head, cut).alias("all"), gone.alias("gone")))

        return let(unclosed(F.element_at(s["all"], -1), s["gone"]), more)

    def whole(found: Column) -> Column:
        last = F.element_at(found, -1)
        # Hardly any text ends in the midst of a comment.
        slow = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.struct(found.alias("all"), F.lit(0).alias("gone")), again)["all"]
        return F.when((F.size(found) > 0) & F.startswith(last, F.lit("<!")), slow).otherwise(found)

    return let(F.regexp_extract_all(raw, F.lit(_pattern()), F.lit(0)), whole)


# -- entities ----------------------------------------------------------------------------------------------------------

#: An entity, a run without ampersands, or an ampersand that begins none.
_ENTITY = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{1,31};|&(?:SHORT)|[^&]+|&"
#: Entities that need no semicolon, the longest first, as the shortest of two that fit is not meant.
_SHORT = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
#: Entities that most texts have no others than: replaced in turn, the ampersand last, as it may begin another.
COMMON = ("lt", "gt", "quot", "nbsp", "copy", "middot", "apos", "amp")
#: What numbers stand for that are no characters of their own: the standard's table for 128 to 159, from the code page itself.
_WINDOWS = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160))
#: Buckets of the table of names.
_BUCKETS = 4096


@cache
def _table() -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for k, v in html.entities.html5.items():
        buckets[zlib.crc32(f"&{k}".encode()) % _BUCKETS][f"&{k}"] = v
    return json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))


def _named(name: Column) -> Column:
    """What ``name`` (with its ampersand) stands for, or null: a bucket by its CRC-32, then one of a few names.

    The table is a constant expression, which is computed once as the plan is made.
    """
    table = F.from_json(F.lit(_table()), "array<map<string,string>>")
    return F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % _BUCKETS).cast("int")), name)


def _numbered(token: Column) -> Column:
    """The character of a numeric entity."""
    digits = F.regexp_replace(F.regexp_extract(token, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    hexadecimal = token.rlike("^&#[xX]")
    number = F.when(F.length(digits) > 8, F.lit(str(0x110000))).when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")

    # From UTF-32, as a number beyond the basic plane is two units of UTF-16.
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    # Controls and characters that are none vanish, but for the white space among them.
    none = (number.between(1, 31) & ~number.isin(9, 10, 12, 13)) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number == 11) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(bad, "\ufffd").when(number.between(128, 159), F.substring(F.lit(_WINDOWS), number.cast("int") - 127, F.lit(1))).when(none, "").otherwise(plain)


def _resolved(t: Column) -> Column:
    """unescape of what costs nothing to name again: within a lambda another one is set up anew for each element, so the
    only one here is for texts with uncommon entities."""
    pattern = _ENTITY.replace("SHORT", "|".join(_SHORT))
    # A name that is none may begin with one that needs no semicolon.
    head = lambda e: F.regexp_extract(e, "^&(?:" + "|".join(_SHORT) + ")", 0)
    headed = lambda e: F.when(head(e) != "", F.concat(_named(head(e)), F.substring(e, F.length(head(e)) + 1, F.length(e)))).otherwise(e)

    def one(e: Column) -> Column:
        return F.when(~F.startswith(e, F.lit("&")), e).when(F.startswith(e, F.lit("&#")) & (F.length(e) > 2), _numbered(e)).otherwise(F.coalesce(_named(e), headed(e)))

    left = simple = t
    for k in COMMON:
        left = F.replace(left, F.lit(f"&{k};"), F.lit(""))
        simple = F.replace(simple, F.lit(f"&{k};"), F.lit(html.entities.html5[f"{k};"]))
    slow = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one), "")
    return F.when(~F.contains(t, F.lit("&")), t).when(F.contains(left, F.lit("&")), slow).otherwise(simple)


def unescape(text: Column) -> Column:
    """With the character or characters of each entity in its place."""
    return let(text, _resolved)


# -- text --------------------------------------------------------------------------------------------------------------

_BREAK = r"[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
_BLOCKS = "|".join(BLOCK_TAGS)
#: A start or end tag that breaks a line.
_BREAKS = rf"(?is)^<(?:/{_S}*+(?:{_BLOCKS}){_S}*+>|/?(?:{_BLOCKS}){_NAME_END})"
_RAW = rf"(?is)^<(?:script|style)(?={_NAME_END}){_REST}>"


def _content(t: Column, tags: bool = False) -> Column:
    """The content of a script or style as it is, or nothing if it has no end; ``tags``: between its tags."""

    def of(name: str) -> Column:
        end = rf"(?i)</{_S}*+{name}{_S}*+>$"
        inner = F.regexp_replace(t, end, "")
        closed = F.concat(inner, F.lit(f"</{name}>")) if tags else F.regexp_replace(inner, _RAW, "")
        return F.when(t.rlike(end), closed).otherwise(F.regexp_extract(t, _RAW, 0) if tags else F.lit(""))

    return F.when(F.lower(F.substring(t, 1, 7)) == "<script", of("script")).otherwise(of("style"))


def _lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.array_join(F.filter(F.transform(F.split(text, _BREAK), strip), lambda x: x != ""), "\n")


def _text_of(t: Column) -> Column:
    """Of a token; one that begins with ``<`` and does not end with ``>`` is text, or a script without an end."""
    raw = F.startswith(F.lower(F.substring(t, 1, 3)), F.lit("<s")) & t.rlike(_RAW)
    markup = F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">"))
    return F.when(raw, _content(t)).when(markup, F.when(t.rlike(_BREAKS), "\n").otherwise("")).otherwise(_resolved(t))


def strip_html(raw: Column) -> Column:
    """The text of markup: a line break at each block tag, lines stripped and without empty ones."""
    return _lines(F.array_join(F.transform(tokens(raw), _text_of), ""))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.parts.append("\n" * (tag in BLOCK_TAGS))

    handle_endtag = lambda self, tag: self.handle_starttag(tag, [])


def python_strip_html(raw: str) -> str:
    parser = _Text()
    parser.feed(raw)
    parser.close()
    return "\n".join(x for x in map(str.strip, "".join(parser.parts).splitlines()) if x)


@F.pandas_udf(StringType())
def strip_html_exact(raw: pd.Series) -> pd.Series:
    return raw.map(python_strip_html, na_action="ignore")


# -- containers --------------------------------------------------------------------------------------------------------

#: Bytes of markup that are put aside at once: adding to a text copies it.
_ASIDE = 4096
_CLASS = rf"(?is)^<div(?={_NAME_END}){_GAP}(?:(?<=['\"/]|{_S})class(?={_S}|[/=>])((?:{_S}*=+{_S}*('[^']*+'|\"[^\"]*+\"|(?!['\"])(?:(?!{_S})[^>])*+))?+){_GAP}|{_ATTRIBUTE})*+>$"


def _has_class(t: Column, name: str) -> Column:
    """Whether the last class attribute of a start tag of a div has ``name``."""
    value = F.regexp_replace(F.regexp_extract(t, _CLASS, 2), "(?s)^(['\"])(.*)\\1$", "$2")
    return (F.regexp_extract(t, _CLASS, 1) != "") & _resolved(value).rlike(rf"(?:^|{_S})\Q{name}\E(?:{_S}|$)")


#: An end tag by its name alone, or with anything behind it.
_END = rf"(?is)^</(?:{_S}*+([a-z][-.a-z0-9:_]*+){_S}*+>$|([a-z](?:(?!{_NAME_END}).)*+).*$)"


def _piece(t: Column) -> Column:
    """What a parser hands on of a token within a container: markup without comments, text without entities."""
    end = F.when(t.rlike(_END), F.lower(F.regexp_replace(t, _END, "</$1$2>"))).otherwise("")
    raw = F.startswith(F.lower(F.substring(t, 1, 3)), F.lit("<s")) & t.rlike(_RAW)
    markup = F.when(F.startswith(t, F.lit("</")), end).when(F.startswith(t, F.lit("<!")) | F.startswith(t, F.lit("<?")), "").otherwise(t)
    return F.when(raw, _content(t, True)).when(F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")), markup).otherwise(_resolved(t))


def container_html(raw: Column, name: str) -> Column:
    """The markup within the first div of class ``name`` and within later ones; null if there is none.

    A div tag changes the depth by one; a pass over the tokens holds the depth and what is kept, in texts of bounded length.
    """

    def change(t: Column) -> Column:
        """2 for a div of that class, 1 for another, -1 for the end of one."""
        start = F.when(~t.rlike(rf"(?is)^<div(?={_NAME_END}){_REST}>$"), 0).when(t.rlike("(?i)class") & _has_class(t, name), 2).otherwise(1)
        end = F.when(t.rlike(rf"(?is)^</(?:{_S}*+div{_S}*+>|div{_NAME_END})"), -1).otherwise(0)
        here = lambda text, c: F.when(F.startswith(F.lower(F.substring(t, 1, len(text))), F.lit(text)) & F.endswith(t, F.lit(">")), c)
        return F.coalesce(here("</", end), here("<div", start), F.lit(0))

    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("aside"))

    def step(s: Column, x: Column) -> Column:
        inside = s["depth"] > 0
        depth = F.when(inside, s["depth"] + F.signum(x["c"]).cast("int")).when(x["c"] == 2, 1).otherwise(0)
        keep, full = inside & (depth > 0), F.octet_length(s["now"]) >= _ASIDE
        now = F.when(keep, F.concat(F.when(full, "").otherwise(s["now"]), _piece(x["t"]))).otherwise(s["now"])
        return F.struct(depth.alias("depth"), now.alias("now"), F.when(keep & full, F.concat(s["aside"], F.array(s["now"]))).otherwise(s["aside"]).alias("aside"))

    def within(found: Column) -> Column:
        changes = F.transform(found, lambda t: F.struct(t.alias("t"), change(t).alias("c")))
        kept = let(F.aggregate(changes, begin, step), lambda s: F.concat(F.array_join(s["aside"], ""), s["now"]))
        return F.nullif(kept, F.lit(""))

    # Most markup has no such name in it.
    return F.when(F.contains(raw, F.lit(name)) | F.contains(raw, F.lit("&")), let(tokens(raw), within))
