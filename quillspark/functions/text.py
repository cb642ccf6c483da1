"""Text functions, all inside the JVM but for general entity decoding."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Every character that Unicode counts as white space.
WS = r"(?U)[\s\x1c-\x1f\x85]"
#: Entities decoded without leaving the JVM, the ampersand last.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
#: Function words; negations stay out of the list, as they carry sentiment.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can
    could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if
    in into is it its itself just me more most my myself of off on once only or other our ours ourselves out over own same she should so
    some such than that the their theirs them themselves then there these they this those through to too under until up very was we were
    what when where which while who whom why will with would you your yours yourself yourselves""".split()
)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """All HTML entities decoded; null stays null."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


#: A reference as the standard writes it, semicolon and all.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(StringType())
def decode_ended_entities(texts: pd.Series) -> pd.Series:
    """HTML entities decoded that end in a semicolon; what browsers guess beyond (``&amp`` at the end of a cut text) stays as it is."""
    decoded = lambda m: html.unescape(m[0]) if m[1] is None or m[1] + ";" in html5 else m[0]
    return texts.map(lambda t: _REFERENCE.sub(decoded, t) if isinstance(t, str) else None)


def decode_common_entities(text: Column) -> Column:
    for entity, char in COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_text(text: Column, all_entities: bool = True, mojibake_compat: bool = True, ended_only: bool = False) -> Column:
    """Entities decoded, tags and product marks made spaces, quotes made plain, white space collapsed.

    Entities come first, so that escaped tags go too. Texts without an ampersand never reach
    Python. ``mojibake_compat`` also turns every U+00E2 into an apostrophe, as broken
    encodings of quotes begin with it; that garbles French. ``ended_only`` leaves entities
    without a semicolon alone.
    """
    if all_entities:
        decode = decode_ended_entities if ended_only else decode_entities
        text = F.when(F.contains(text, F.lit("&")), decode(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)
    else:
        text = decode_common_entities(text)
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.regexp_replace(text, r"\[\[ASIN:[^\]]*\]\]", " ")
    text = F.translate(text, ("â" if mojibake_compat else "") + "’‘", "'" * (3 if mojibake_compat else 2))
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def ascii_ratio(text: Column) -> Column:
    """Share of code points below 128; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", "")) / n).otherwise(0.0)


def char_len(text: Column) -> Column:
    return F.length(text).cast("int")


def token_len(text: Column) -> Column:
    """Number of tokens between white space."""
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda t: t != "")).cast("int")


def concat_title(title: Column, text: Column) -> Column:
    return F.when(title != "", F.concat(title, F.lit(". "), text)).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters with inner contractions; a word touching other letters or digits is none.

    What is neither ASCII nor a letter or digit becomes a space, other non-ASCII an
    underscore, so that word ends mean the same in every regular-expression dialect.
    """
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "_")
    return F.regexp_extract_all(folded, F.lit(r"\b[a-z]+(?:'[a-z]+)?\b"), F.lit(0))


def drop_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Order and repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def ngrams(words: Column, n_max: int = 2) -> Column:
    """All runs of 1 to ``n_max`` words, joined by spaces; built after stop words went, so they bridge them.

    ``words`` stands outside every lambda, so it is not evaluated again for each run; give it
    a column of its own (as ``document_terms`` does) to have it evaluated once.
    """
    out = runs = words
    for n in range(2, n_max + 1):
        rest = F.greatest(F.size(words) - n + 1, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), rest), F.slice(words, F.lit(n), rest), lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, runs)
    return out
