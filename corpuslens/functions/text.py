"""Text normalisation as native column expressions (no Python UDFs).

Python's ``re`` character classes are Unicode-aware, Java's and RE2's are ASCII by default.
The classes below reproduce Python's ``\\w \\d \\s \\S`` exactly for every code point, so the
same pattern strings work in Spark (Java regex) and in DuckDB (RE2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-compatible regex classes (must stay exactly as written).
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
# A run of characters that are neither word nor space characters.
PUNCT_RUN = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]+"

# URL, mention, hashtag and number patterns used by the four profiles.
URL_HTTP = "http" + NON_SPACE + "+"
URL_HTTP_OR_WWW = "http" + NON_SPACE + "+|www\\." + NON_SPACE + "+"
MENTION = "@" + WORD + "+"
# Characters after '#' that unwrap a hashtag (lower-cased text; long s matches 's' case-insensitively).
HASHTAG_UNWRAP = "#([0-9a-z_çğıöşüſ])"
NUMBER_INT = DIGIT + "+"
NUMBER_DECIMAL = DIGIT + "+([.,]" + DIGIT + "+)?"
SPACE_RUN = SPACE + "+"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
# The same runs without those that are one plain space, which becoming one space leaves as they are.
NON_WORD_RUN_TO_CHANGE = r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*| [^\p{L}\p{N}_]+"

PROFILES = ("minhash", "predict", "classical", "basic")


def collapse_ws(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim (Python ``re.sub(r'\\s+',' ',t).strip()``)."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def strip(c: Column) -> Column:
    """Python ``str.strip()``: every kind of white space goes at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_minhash(c: Column) -> Column:
    t = F.lower(c)
    t = F.regexp_replace(t, URL_HTTP, "URL")
    t = F.regexp_replace(t, MENTION, "@USER")
    t = F.regexp_replace(t, NUMBER_INT, "NUM")
    # punctuation runs become spaces and spaces collapse: one run of what is no word character
    return F.trim(F.regexp_replace(t, NON_WORD_RUN_TO_CHANGE, " "))


def normalize_predict(c: Column) -> Column:
    t = F.lower(c)
    t = F.regexp_replace(t, URL_HTTP_OR_WWW, " <url> ")
    t = F.regexp_replace(t, MENTION, "@user")
    t = F.regexp_replace(t, HASHTAG_UNWRAP, "$1")
    return collapse_ws(t)


def normalize_classical(c: Column, max_chars: int | None = None) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, URL_HTTP_OR_WWW, "<url>")
    t = F.regexp_replace(t, MENTION, "<user>")
    t = F.replace(t, F.lit("#"), F.lit(""))
    t = F.regexp_replace(t, NUMBER_DECIMAL, "<num>")
    t = collapse_ws(t)
    return truncate(t, max_chars)


def normalize_basic(c: Column, max_chars: int | None = None) -> Column:
    t = F.regexp_replace(c, URL_HTTP, "URL")
    t = F.regexp_replace(t, MENTION, "@USER")
    t = collapse_ws(t)
    return truncate(t, max_chars)


def truncate(c: Column, max_chars: int | None) -> Column:
    """Prefix by characters (code points); ``None`` or ``<= 0`` keeps the whole text."""
    if not max_chars or max_chars <= 0:
        return c
    return F.substring(c, 1, max_chars)


def normalize(c: Column, profile: str, max_chars: int | None = None) -> Column:
    """One entry point for the four named profiles."""
    if profile == "minhash":
        return truncate(normalize_minhash(c), max_chars)
    if profile == "predict":
        return truncate(normalize_predict(c), max_chars)
    if profile == "classical":
        return normalize_classical(c, max_chars)
    if profile == "basic":
        return normalize_basic(c, max_chars)
    raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")


def words(c: Column) -> Column:
    """Whitespace split of already-collapsed text; ``''`` gives ``['']`` like Python ``[''.join]``."""
    return F.split(c, " ")


def word_tokens(c: Column) -> Column:
    """Lower-cased whole-word tokens: split on runs of non-word characters, empties removed."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda x: F.length(x) > 0)


def split_words(c: Column) -> Column:
    """Python ``str.split()`` of normalised text: single-space split with empties removed."""
    return F.filter(F.split(c, " "), lambda x: F.length(x) > 0)


def word_ngrams(w: Column, n: int) -> Column:
    """Consecutive ``n``-word strings of a word array (empty when it has fewer than n words).

    Built with ``arrays_zip`` of shifted slices, so the lambda reads only its own element: even
    if Catalyst inlines ``w`` (e.g. when pushing a filter through the projection), the work
    stays linear in the text length.
    """
    if n == 1:
        return w
    size = F.size(w)
    parts = [w.alias("c0")] + [F.slice(w, i + 1, F.greatest(size, F.lit(1))).alias(f"c{i}") for i in range(1, n)]
    z = F.slice(F.arrays_zip(*parts), 1, F.greatest(size - (n - 1), F.lit(0)))
    return F.transform(z, lambda s: F.concat_ws(" ", *[s[f"c{i}"] for i in range(n)]))


def shingles(w: Column, k: int = 4) -> Column:
    """Word k-shingles from a word array; at most k words give one shingle (the joined words)."""
    return F.when(F.size(w) <= k, F.array(F.array_join(w, " "))).otherwise(word_ngrams(w, k))
