"""Spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter stands in the word an odd number of times. One replaced letter flips two bits
of it (none if both share a bit), one inserted or deleted letter flips one. The mask's 27 bits are three bands of nine, and of at most two
flips some band has none: words meet in a join on an equal band. The length filter is part of the key (a word asks at its own length and at
one more), and so are two letters at either end, as one edit leaves the first two or the last two as they are. What meets is verified by
mask, ends and edit distance within the join, so that only true pairs come out of it, each once, by the first band and end that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: A run of letters; shorter ones than LEAST can't become words.
LETTERS, LEAST = r"[A-Za-zÀ-ÿ]", 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by how often they stand in texts; neighbours in this order go to different bands, so that bands tell words apart about equally well.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: Bits of a band.
BAND = 9


def lowered(run: Column) -> Column:
    """A-Z as a-z, other letters as they are. lower() does that to ASCII texts."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def damaged(run: Column, ident: Column, every: int) -> Column:
    """run, or, if `every` divides the crc32 of `<ident>:<run>`, run without the code point that this number chooses."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, support: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the words of all texts with `least` code points and `support` occurrences or more. Counts combine before the shuffle."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    words = runs.select("id", lowered(F.col("run")).alias("run")).select(damaged(F.col("run"), F.col("id"), every).alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def mask(word: str) -> Column:
    """Parities of the letters of a column of words as 27 bits; letters beyond a-z share bits with others."""
    place = f"CASE WHEN ascii(c) < 128 THEN instr('{COMMON}', c) - 1 ELSE ascii(c) % {3 * BAND} END"
    return F.expr(f"aggregate(transform(split({word}, ''), c -> {place}), 0, (m, p) -> m ^ shiftleft(1, (p % 3) * {BAND} + p div 3))")


def keyed(made: DataFrame, longer: list[int]) -> DataFrame:
    """made with c (twice the band, and one more for the last letters) and key (that band, these letters, and the length and what each of `longer` adds)."""
    each = made.withColumn("c", F.explode(F.array(*map(F.lit, range(6))))).withColumn("more", F.explode(F.array(*map(F.lit, longer))))
    band = F.expr(f"shiftright(mask, (c div 2) * {BAND}) & {2**BAND - 1}")
    end = F.when(F.col("c") % 2 == 0, F.substring("word", 1, 2)).otherwise(F.substring("word", -2, 2))
    return each.withColumn("key", F.xxhash64(F.col("len") + F.col("more"), band, end)).drop("more", "len")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): of words (word, n) each pair that differs by one inserted, deleted or replaced code point, once. Words have 4 code points or more."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = cut(words.repartition(parts, "word").select("word", "n", mask("word").alias("mask"), F.char_length("word").alias("len")))
    stored = keyed(made, [0]).select("c", "key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    asked = keyed(made, [0, 1]).select("c", "key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    a, b, c, flips = F.col("a"), F.col("b"), asked["c"], F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    same = lambda band: F.shiftright(flips, BAND * band).bitwiseAND(2**BAND - 1) == 0
    first = F.when(same(0), 0).when(same(1), 2).otherwise(4) + F.when(F.substring(a, 1, 2) == F.substring(b, 1, 2), 0).otherwise(1)
    one_way = (F.char_length(a) < F.char_length(b)) | (a < b)
    meets = (asked["c"] == stored["c"]) & (asked["key"] == stored["key"])
    return asked.join(stored, meets & (F.bit_count(flips) <= 2) & one_way & (c == first) & (F.levenshtein(a, b, 1) == 1)).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), followed to the end. Ends twice as far away come into reach each round; a form has twice its word's n, so paths are short."""
    found = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, support: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """One row per word of all texts: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n, of equal ones the first in code-point order, if that n is `ratio` times the word's own or
    more; root is where forms lead to, the word itself where there is none. Null and empty texts have no words; a null id counts as the
    empty text in the choice of damaged runs; repeated rows count as often as they stand; texts of any length are read whole, other
    columns are not read. An empty table gives no rows.
    """
    words = cut(vocabulary(docs, id_col, text_col, least, support, every))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.low")).alias("near_n"))
    large = F.col("near_n") >= ratio * F.col("n")
    told = cut(told.select("word", "n", "n_near", F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n")))
    ends = roots(told.where(F.col("form").isNotNull()).select("word", "form"))
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
