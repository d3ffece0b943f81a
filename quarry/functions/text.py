"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A number with thousands commas, words that scale a figure, and conjunctions that divide a question.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
SCALES = [("billion", 1e9), ("bn", 1e9), ("million", 1e6), ("mm", 1e6), ("thousand", 1e3)]
CONJUNCTIONS = ["and", "versus", "vs", "vs.", "compared to", "as well as"]

#: Unicode's blanks.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: A figure in running text: a number, perhaps with a dollar before and a unit after it.
FIGURE = rf"(?iu)\$?{NUMBER}[\t\n\f\r ]?(?:billion|million|thousand|bn|mm|%)?"
SCALED = "(?iu)" + "|".join(word for word, _ in SCALES)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")

def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value as printf does: 412.15 is a little under, so 412.1; Java's format says 412.2."""

    @F.pandas_udf("string")
    def form(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{x:.{places}f}").astype(object)

    return form(value.cast("double"))



def squeeze(text: Column) -> Column:
    """Runs of ASCII white space as one blank, and no blanks of any kind (Unicode's Zs) at the ends."""
    return F.btrim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(BLANKS))


def excerpt(text: Column, most: int = 240) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(most)), r" [^ ]*$", ""), F.lit("…")))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def digest_id(text: Column, n: int, bits: int = 256) -> Column:
    return F.left(F.sha2(text, bits) if bits == 256 else F.sha1(text), F.lit(n))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def route(query: Column, relationship: list[str], multi: list[str]) -> Column:
    """Keyword route of a question: relationship before multi_hop before simple, on the space-padded lower-case text."""
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    has = lambda words: F.coalesce(*[F.when(padded.contains(w), True) for w in words], F.lit(False))
    return F.when(has(relationship), "relationship").when(has(multi), "multi_hop").otherwise("simple")


def parts(query: Column, most: int = 3) -> Column:
    """The question and the parts that conjunctions divide it into, without blanks and ` ?.` around them, distinct whatever their case, at most `most`."""
    words = "|".join(c.replace(".", "[.]").replace(" ", r"\s") for c in sorted(CONJUNCTIONS, key=len, reverse=True))
    cut = F.filter(F.transform(F.split(query, rf"(?i)\s+(?:{words})\s+"), lambda p: F.btrim(p, F.lit(" ?."))), lambda p: F.length(p) > 0)
    every = F.concat(F.array(query), cut)
    low = F.transform(every, F.lower)
    first = F.filter(F.transform(every, lambda p, i: F.struct(p.alias("p"), (F.array_position(low, F.lower(p)) == i + 1).alias("new"))), lambda x: x["new"])
    return F.slice(F.transform(first, lambda x: x["p"]), 1, most)


def figures(text: Column) -> Column:
    """Figures in order, without blanks around them and commas or stops after them."""
    return F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0)), lambda t: F.rtrim(F.trim(t), F.lit(",.")))


def groundable(figure: Column) -> Column:
    """Whether a figure says enough to be looked up: money, a share, a scaled number, or three digits and more."""
    return figure.rlike("[$%]") | figure.rlike(SCALED) | (F.length(digits(figure)) >= 3)


def arithmetic_claims(text: Column, tolerance: float = 0.02) -> Column:
    """Array of (claim, ok) for each `A op B = C` in a text; a claim that can't be computed isn't wrong."""
    pattern = r"(-?\d[\d,]*(?:\.\d+)?)\s*([-+*/])\s*(-?\d[\d,]*(?:\.\d+)?)\s*=\s*(-?\d[\d,]*(?:\.\d+)?)"

    def check(claim: Column) -> Column:
        side = lambda i: F.replace(F.regexp_extract(claim, pattern, i), F.lit(",")).cast("double")
        a, op, b, c = side(1), F.regexp_extract(claim, pattern, 2), side(3), side(4)
        value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(F.try_divide(a, b))
        return F.struct(claim.alias("claim"), F.coalesce(F.abs(value - c) <= tolerance * F.greatest(F.lit(1.0), F.abs(c)), F.lit(True)).alias("ok"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), check)
