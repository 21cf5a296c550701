"""Folding, normalising and matching of text.

``fold`` and ``casefold`` are native expressions whose tables are made from the rule itself, character by character; ASCII
texts, which are most, are only lower-cased. ``fold_exact`` is an Arrow UDF of the rule, which also takes Hangul apart. All
functions that fold take the fold to use.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain as flatten

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Fold = Callable[[Column], Column]


def python_fold(text: str) -> str:
    """Case folding, compatibility decomposition, and no combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: Where characters are that a rule may change: not the unified ideographs, and not the syllables of Hangul.
_LETTERS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x10000, 0x12000), range(0x16000, 0x17000), range(0x1BC00, 0x20000), range(0x2F800, 0x2FA20))


#: Characters that become several and are common, and what stands for the others while it is not known whether there are any.
OFTEN, MARK = "ß…", "\ue000"


def _native(rule: Callable[[str], str]) -> Fold:
    """The expression of a rule that maps each character by itself, on lower-case text."""
    one, gone, several = {}, [], {}
    for c in map(chr, flatten(*_LETTERS)):
        if c.lower() != c or (to := rule(c)) == c:
            continue
        if len(to) == 1:
            one[c] = to
        elif to:
            several[c] = to
        else:
            gone.append(c)
    often = [(c, several.pop(c)) for c in OFTEN if c in several]
    source, target = "".join([*one, *several, *gone]), "".join(one.values()) + MARK * len(several)

    def slowly(text: Column) -> Column:
        """By character; the table is searched for those only that are no ASCII."""
        table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
        parts = F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, F.coalesce(F.try_element_at(table, c), c)).otherwise(c))
        return F.translate(F.array_join(parts, ""), "".join([*one, *gone]), "".join(one.values()))

    def mapped(text: Column) -> Column:
        return let(F.translate(text, source, target), lambda t: F.when(F.contains(t, F.lit(MARK)), slowly(text)).otherwise(t))

    def apply(text: Column) -> Column:
        low = F.lower(text)
        for c, to in often:
            low = F.replace(low, F.lit(c), F.lit(to))
        # Most texts are ASCII once their Latin letters are; only the others need the large table.
        latin = [c for c in one if c < "\u0180"]
        rest = lambda t: F.when(_is_ascii(t), t).otherwise(mapped(t))
        return F.when(_is_ascii(text), F.lower(text)).otherwise(let(F.translate(low, "".join(latin), "".join(map(one.get, latin))), rest))

    return lambda text: let(text, apply)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` has it within a lambda, for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Of the rule of python_fold, and of str.casefold.
fold, casefold = _native(python_fold), _native(str.casefold)


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    return text.map(python_fold, na_action="ignore")


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once a row, also where later filters, sorts and projections use them.

    They are made by a generator, which no filter on them is pushed below: pushed into a projection, a filter would
    repeat their expressions. They are computed even where nothing uses them. Columns of those names are replaced.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))) if columns else df


#: All that str.isspace holds of.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Kept where pressed against a letter or digit, so that c++, c#, .net and node.js stay whole.
KEPT = "+#."


#: A token of normalised text: letters and digits with what is kept among them, and one of those before them.
_TOKEN = rf"[{KEPT}]?[0-9a-z][0-9a-z{KEPT}]*"


def normalize(text: Column, fold: Fold = fold) -> Column:
    """The tokens of the folded text between single spaces; signs are kept where they are pressed against a token."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(_TOKEN), F.lit(0)), " ")


def python_normalize(text: str) -> str:
    """``normalize`` for the few terms of a configuration."""
    flat = re.sub(rf"[^0-9a-z\s{KEPT}]", " ", python_fold(text))
    return " ".join(re.sub(rf"(?<![0-9a-z{KEPT}])[{KEPT}]+(?![0-9a-z])", " ", flat).split())


def occurs(haystack: Column, forms: Iterable[str]) -> Column:
    """Whether a form is in the normalised ``haystack`` with no letter or digit next to it; false without forms."""
    own = sorted(f for f in forms if f)
    return haystack.rlike(r"(?<![0-9a-z])(?:" + "|".join(re.escape(f) for f in own) + r")(?![0-9a-z])") if own else F.lit(False)


def tokens(text: Column, fold: Fold = fold) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("[0-9a-z]+"), F.lit(0))


def joined_tokens(text: Column, fold: Fold = fold) -> Column:
    """The tokens between single spaces, with one at both ends, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(text, fold), " "), F.lit(" "))


def contains_phrase(joined: Column, needle: Column) -> Column:
    """Of two values of joined_tokens; one without tokens is in none."""
    return (F.length(needle) > 2) & F.contains(joined, needle)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis for what is cut; limits of 0 and below cut nothing."""
    if limit <= 0:
        return text
    head = F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def humanize_slug(slug: Column) -> Column:
    words = F.filter(F.split(F.replace(slug, F.lit("_"), F.lit("-")), "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def company_and_title(text: Column) -> tuple[Column, Column]:
    """The two sides of the first colon, stripped; both null if there is none or a side is blank."""
    at = F.locate(":", text)
    company = strip(F.substring_index(text, ":", 1))
    title = strip(F.substring(text, at + 1, F.length(text)))
    good = (at > 0) & (company != "") & (title != "")
    return F.when(good, company), F.when(good, title)


def defuse_formula(cell: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def markdown_text(text: Column) -> Column:
    return F.regexp_replace(collapse(text), r"([\\\[\]])", r"\\$1")


def markdown_destination(url: Column) -> Column:
    safe = F.replace(F.replace(url, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.when(url.rlike("[()<> ]"), F.concat(F.lit("<"), safe, F.lit(">"))).otherwise(url)
