"""Text normalisation for categories and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German letters and the ASCII spelling they are folded to.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def stripped(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` alone only starts a word after a space: ``city-trip`` must become ``City-Trip``.
    """
    words = F.split(text, r"(?<=\P{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def normalised_question(text: Column) -> Column:
    """Lower-case, strip, fold umlauts."""
    folded = stripped(F.lower(text))
    for letter, spelling in UMLAUTS:
        folded = F.replace(folded, F.lit(letter), F.lit(spelling))
    return folded
