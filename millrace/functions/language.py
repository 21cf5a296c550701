"""Language by function words, for short texts where a guess is worse than none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

# Function words of each language; some are in two of them.
STOPWORDS = {
    "en": "the and for with you are our this that will have your from who about their was were they them then",
    "fr": "le la les des une un dans pour avec vous nous est et au aux du que qui sur par ce sont votre notre",
    "de": "und der die das mit für von den ist wir sie ein eine auf im zu dem nicht auch bei sind werden",
    "es": "el la los las una con para que por del en un se su como más al este son nuestro tus",
}
MIN_TOKENS, MIN_HITS, MIN_MARGIN = 12, 3, 2


_ANY = sorted({w for words in STOPWORDS.values() for w in words.split()})


def _hits(words: Column, language: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*STOPWORDS[language].split())))


def detect_language(text: Column) -> Column:
    """The language with most function words; null for a short text or one without a clear lead."""
    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿſ]+"), F.lit(0)), lambda words: F.when(F.size(words) >= MIN_TOKENS, let(F.filter(words, lambda w: w.isin(*_ANY)), _clear_lead)))


def _clear_lead(known: Column) -> Column:
    """``known``: the words that are function words of some language."""
    ranked = F.sort_array(F.array(*[F.struct(_hits(known, k).alias("hits"), F.lit(k).alias("language")) for k in STOPWORDS]), asc=False)
    return let(ranked, lambda r: F.when((r[0]["hits"] >= MIN_HITS) & (r[0]["hits"] - r[1]["hits"] >= MIN_MARGIN), r[0]["language"]))
