"""Many phrases in one pass over a text, and boolean queries on the result.

The phrases of a catalogue are compiled into one trie-shaped regular expression that looks, at the start of
every token, for the longest phrase beginning there. The shorter ones that begin there too are its prefixes
by whole tokens, so the phrase found names them all. A text's findings become a bit set over the
catalogue's codes, and any number of ``(any of A) AND (any of B) AND NOT (any of C)`` queries are evaluated
on the bits, all in the JVM.

Phrases match by whole tokens: text and phrases are lower-cased and cut at runs of characters other than
letters, digits and underscore. Null texts match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.keywords import norm_term

TOKEN = r"\p{L}\p{N}_"
BITS = 63  # codes a long holds, without its sign


@dataclass(frozen=True)
class Phrases:
    """A compiled catalogue: ``codes`` in bit order, and the codes that each phrase stands for."""

    pattern: str
    codes: tuple[str, ...]
    masks: dict[str, tuple[int, ...]]

    @property
    def width(self) -> int:
        return -(-len(self.codes) // BITS)

    def mask(self, codes: Iterable[str]) -> tuple[int, ...]:
        words = [0] * self.width
        for code in codes:
            at = self.codes.index(code)
            words[at // BITS] |= 1 << at % BITS
        return tuple(words)


def _alternatives(phrases: list[str]) -> str:
    """A pattern for the longest of the phrases, sorted, sharing their common beginnings."""
    if phrases == [""]:
        return f"(?![{TOKEN}])"
    parts = []
    for first in sorted({p[:1] for p in phrases}, key=lambda c: (c == "", c)):  # the end of a phrase comes last
        rest = sorted({p[1:] for p in phrases if p[:1] == first})
        lead = f"[^{TOKEN}]++" if first == " " else first
        parts.append(lead + (_alternatives(rest) if first else f"(?![{TOKEN}])"))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def compile_phrases(entries: Iterable[tuple[str, str]]) -> Phrases:
    """Phrases of ``(code, term)`` entries; a term may stand for several codes. Terms without a token are left out."""
    entries = [(code, norm_term(term)) for code, term in entries]
    codes = tuple(dict.fromkeys(code for code, _ in entries))
    phrases = sorted({p for _, p in entries if p})
    empty = Phrases("", codes, {})
    masks = {}
    for p in phrases:
        own = [code for code, q in entries if q and (p == q or p.startswith(q + " "))]
        masks[p] = empty.mask(own)
    pattern = f"(?<![{TOKEN}])(?=({_alternatives(phrases)}))" if phrases else "(?!)()"
    return Phrases(pattern, codes, masks)


def phrase_bits(text: Column, phrases: Phrases) -> Column:
    """The bit set, an array of longs, of the codes whose phrases a text holds; one pass over the text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(phrases.pattern), F.lit(1))
    names = F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, f"[^{TOKEN}]+", " ")))
    if not phrases.masks:
        return F.array(*[F.lit(0).cast("long")] * phrases.width)
    # phrases hold letters, digits, underscores and blanks only; one parsed expression is quicker than many calls
    table = F.expr("map(" + ", ".join(f"'{p}', {_literal(m)}" for p, m in phrases.masks.items()) + ")")
    none = F.array(*[F.lit(0).cast("long")] * phrases.width)
    return F.aggregate(names, none, lambda acc, p: F.zip_with(acc, table[p], lambda x, y: x.bitwiseOR(y)))


def overlap(a: Column, b: Column) -> Column:
    """Have two bit sets a code in common?"""
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) != 0), lambda x: x)


def _literal(mask: tuple[int, ...]) -> str:
    return "array(" + ", ".join(f"{w}L" for w in mask) + ")"


def matching(bits: Column, phrases: Phrases, queries: list[tuple[int, list[list[str]], list[str]]]) -> Column:
    """Numbers, in the order given, of the queries ``(number, any-of sets, excluded codes)`` that a bit set fulfils."""
    table = F.expr("array(" + ", ".join(
        f"named_struct('number', {number}, 'sets', array({', '.join(_literal(phrases.mask(s)) for s in sets)}), "
        f"'none', {_literal(phrases.mask(none))})" for number, sets, none in queries) + ")")
    met = F.filter(table, lambda q: F.forall(q["sets"], lambda s: overlap(bits, s)) & ~overlap(bits, q["none"]))
    return F.transform(met, lambda q: q["number"])


def match_queries(df: DataFrame, text_col: str, phrases: Phrases, queries: list[tuple[int, list[list[str]], list[str]]],
                  name: str = "matched") -> DataFrame:
    """The rows of ``df`` that fulfil a query, with the array ``name`` of the numbers of those they fulfil."""
    # exploding keeps Catalyst from copying the pass over the text into the filters and lambdas that read its result
    bits = df.select("*", F.explode_outer(F.array(phrase_bits(F.col(text_col), phrases))).alias("_bits"))
    some = bits.where(F.exists("_bits", lambda w: w != 0))  # most texts hold no phrase at all
    return some.withColumn(name, matching(F.col("_bits"), phrases, queries)).drop("_bits").where(F.size(name) > 0)
