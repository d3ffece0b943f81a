"""Exact deduplication by content-defined chunk recipes, with DataFrame functions alone.

A text is normalised (each run of white space becomes one space) and cut into chunks where its own content says so. A chunk has an
address (64-bit hash) and a digest (SHA-256). Over all distinct chunks, addresses with several digests are looked for; a chunk's
verified identifier is its address and the ordinal of its digest among those of the address (1 for all but such addresses), so that
chunks with equal addresses and unequal contents stay apart. A document's recipe is the ordered list of its chunks' identifiers;
documents are equal when their recipes are. Texts are read once to find equal documents, and never moved for that: what is kept of
them and shuffled are addresses, digests and recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, cut, spread_join, unused

#: A chunk is at least LEAST characters and ends after the first word that ends in one of these, or at MOST characters.
ENDS, LEAST, MOST = "[.!?:;|%$#&]", 512, 4096


def normal(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def chunks(norm: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Chunks in order; together they are the text. Empty text: no chunk."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{least},{most}}}?{ENDS} |.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, sha (binary), and recipe (array of address and ordinal; empty: empty text)."""
    norm = docs.select(F.col(id_col).alias("id"), normal(text_col).alias("norm"))
    part = lambda c: F.struct(F.xxhash64(c).alias("address"), F.unhex(F.sha2(c, 256)).alias("digest"))
    rows = cut(norm.select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.transform(chunks(F.col("norm")), part).alias("parts")))
    each = rows.select(F.explode("parts").alias("p")).select("p.address", "p.digest")
    # combines map-side: a chunk of very many documents is one row from each task
    unsure = cut(each.groupBy("address").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("address"))
    item = lambda address, ordinal: F.struct(address.alias("address"), ordinal.alias("ordinal"))
    if unsure.isEmpty():
        return rows.select("id", "sha", F.transform("parts", lambda p: item(p["address"], F.lit(1))).alias("recipe"))
    known = each.join(unsure, "address", "left_semi").groupBy("address", "digest").agg(F.count("*").alias("n"))
    known = known.withColumn("ordinal", F.row_number().over(Window.partitionBy("address").orderBy("digest")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    placed = numbered.select("row", F.posexplode("parts").alias("pos", "p")).select("row", "pos", "p.address", "p.digest")
    told = spread_join(placed.join(unsure, "address", "left_semi"), known, ["address", "digest"], "n").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("told"))
    ordinal = lambda i: F.coalesce(F.try_element_at("told", i), F.lit(1))
    return numbered.join(told, "row", "left").select("id", "sha", F.transform("parts", lambda p, i: item(p["address"], ordinal(i))).alias("recipe"))


def groups_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, keep_id, group_size) of each row."""
    made = recipes(docs, id_col, text_col).withColumn("mark", F.xxhash64("recipe"))
    groups = made.groupBy("mark", "recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("n", F.col("group_size"))
    return spread_join(made, groups, ["mark", "recipe"], "n").select("id", "sha", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id of the rows with an equal recipe; kept is true for rows with that id. Null text counts as empty. A null
    id loses against any other; a group of null ids alone has a null keep_id and kept true. Repeated rows (equal id and text) count
    one by one in group_size, each has its row, and all are kept or none. Ids repeated over different texts are told apart by text.
    Texts of any length are cut whole. An empty table gives no rows.
    """
    out = groups_of(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 500_000) -> DataFrame:
    """docs without rows whose text an earlier id has; of rows equal in id and text one stays. All columns and names stay.

    The rows to drop are found first, and an anti-join takes them out. If there are `most` or fewer they are broadcast and no text moves;
    else texts move once. Nulls, empty and long texts and an empty table are as in exact_groups().
    """
    ident, none, sha = names = unused(docs, "_id", "_none", "_sha")
    keys = lambda i, s: [F.coalesce(i, F.lit(-1)).alias(ident), i.isNull().alias(none), s.alias(sha)]
    found = cut(groups_of(docs.select(id_col, text_col), id_col, text_col).groupBy("id", "sha").agg(F.first("keep_id").alias("keep_id"), F.count("*").alias("rows")))
    goes = ~F.col("id").eqNullSafe(F.col("keep_id"))
    listed = lambda cond: (lambda d: F.broadcast(d) if d.count() <= most else d)(found.where(cond).select(*keys(F.col("id"), F.col("sha"))))
    marked = docs.select("*", *keys(F.col(id_col), F.unhex(F.sha2(normal(text_col), 256))))
    once = marked.join(listed(goes | (F.col("rows") > 1)), names, "left_anti")
    again = ~goes & (F.col("rows") > 1)
    if found.where(again).isEmpty():
        return once.select(*docs.columns)
    return once.union(marked.join(listed(again), names, "left_semi").dropDuplicates(names)).select(*docs.columns)
