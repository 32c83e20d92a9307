"""Substring and whole-word joins as equi-joins.

``a LIKE '%' || b || '%'`` between two tables has no equi-key, so Spark would compare all pairs.
Here each term gives one anchor (five letters of it, three if it is shorter, or its longest word)
and each text its distinct anchors; the join is on the anchor and the real test runs on the candidates only. A term
has exactly one anchor and a text each anchor once, so a (term, text) pair comes out at most once.
The term side is written first, so that its size is known and not guessed: up to ``FEW_TERMS`` of
:func:`contains_join` are broadcast, and the texts, each of which has as many anchors as letters, are never
shuffled; otherwise the optimizer decides by the session's broadcast threshold, or both sides shuffle by anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import quote_literal
from factloom.session import cut_lineage

# Letters that are frequent in names and paths; an anchor avoids them where it can.
_COMMON = "etaoinsr/._"
#: So many terms, with so many letters in all, are broadcast: some tens of MB as a hash table.
FEW_TERMS, FEW_LETTERS = 100_000, 4_000_000


def grams(text: Column, size: int = 3) -> Column:
    """Distinct overlapping pieces of ``size`` characters, in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1)))


def _weight(gram: Column) -> Column:
    return F.length(F.translate(gram, _COMMON, ""))


def anchor_gram(term: Column, size: int = 3) -> Column:
    """The piece of the term with the fewest frequent letters."""
    pieces = F.transform(grams(term, size), lambda g: F.struct(_weight(g).alias("w"), g.alias("g")))
    return F.array_max(pieces)["g"]


def contains_join(
    texts: DataFrame,
    terms: DataFrame,
    text: str = "haystack",
    term: str = "term",
    on: Sequence[str] = (),
    short_terms: bool = True,
) -> DataFrame:
    """All pairs of rows where ``texts.text`` contains ``terms.term``, each pair once.

    ``on`` names further columns that must be equal; apart from those the inputs share no column.
    Terms of one and two characters are served unless ``short_terms`` says that there are none.
    """

    terms = cut_lineage(terms, "terms")
    n, letters = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(term)), F.lit(0))).first()
    few = n <= FEW_TERMS and letters <= FEW_LETTERS

    def part(size: int, chosen: DataFrame) -> DataFrame:
        left = texts.withColumn("_anchor", F.explode(grams(F.col(text), size)))
        right = chosen.withColumn("_anchor", anchor_gram(F.col(term), size))
        right = F.broadcast(right) if few else right
        return left.join(right, ["_anchor", *on]).filter(F.contains(F.col(text), F.col(term))).drop("_anchor")

    long = F.length(term) >= 5
    out = part(5, terms.filter(long)).unionByName(part(3, terms.filter(~long & (F.length(term) >= 3))))
    if short_terms:
        for size in (2, 1):
            out = out.unionByName(part(size, terms.filter(F.length(term) == size)))
    return out


def words(text: Column) -> Column:
    """Distinct maximal runs of word characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))


def anchor_word(term: Column) -> Column:
    """The longest word of the term."""
    found = F.transform(words(term), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(found)["w"]


def word_join(texts: DataFrame, terms: DataFrame, text: str = "line", term: str = "needle", on: Sequence[str] = ()) -> DataFrame:
    """Pairs where the literal ``term`` occurs in ``text`` bounded by non-word characters.

    ``on`` names further columns that must be equal.
    Every word of a term bounded that way is a whole word of the text, hence the anchor. Terms
    without any word character go by their first character.
    """
    bounded = F.concat(F.lit(r"(^|\W)"), quote_literal(F.col(term)), F.lit(r"(\W|$)"))
    left = texts.withColumn(
        "_anchor",
        F.explode(
            F.concat(
                words(F.col(text)),
                F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\W)"), F.lit(1))),
            )
        ),
    )
    right = cut_lineage(terms, "terms").filter(F.length(term) > 0).withColumn(
        "_anchor", F.coalesce(anchor_word(F.col(term)), F.substring(term, 1, 1))
    )
    return (
        left.join(right, ["_anchor", *on])
        .filter(F.contains(F.col(text), F.col(term)))
        .filter(F.regexp_like(F.col(text), bounded))
        .drop("_anchor")
    )
