"""Chat formatting with a grammar round trip, with DataFrame functions alone.

A conversation is rendered as `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. A deterministic parser reads the rendered text back:
it cuts at `<|im_start|>`, takes the role up to the first line feed and the text up to the first `<|im_end|>`, after which only a
line feed may follow, and undoes escapes. Conversations whose recovered turns differ from their source are escaped and rendered again
until they are identical. The escape puts one more tilde into each `<~*|` (and writes a role's line feed as `<n`), so that escaped
content has no control string and each escape can be undone; one escape is enough, and a second mismatch raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(~*)([|n])", r"<~$1$2"), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n"), F.lit("\n")), r"<~(~*)([|n])", r"<$1$2")


def render(turns: Column) -> Column:
    """The text of an array of (role, text)."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))))


def raw_turns(formatted: Column) -> Column:
    """Array of (role, text) as they stand in a rendered text, escaped; a piece that the grammar doesn't allow has a null role and text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        head, rest = F.substring_index(piece, "\n", 1), F.expr("1")
        rest = piece.substr(F.length(head) + 2, F.length(piece))
        text = F.substring_index(rest, END, 1)
        fits = F.concat(head, F.lit("\n"), text, F.lit(END + "\n")) == piece
        return F.struct(F.when(fits, head).alias("role"), F.when(fits, text).alias("text"))

    return F.transform(pieces, turn)


def parse(formatted: Column) -> Column:
    """Array of (role, text) recovered from a rendered text."""
    return F.transform(raw_turns(formatted), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chat(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, n_source, formatted (the text), loss (array of start and length, in code points: the texts of trained_role), escaped.

    Null text and null role count as empty. Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows
    have a defined place and each is a turn of its own. Rows of a null conv_id are one conversation. A conversation is one value, as its
    digest needs it whole; turns are numbered by running length and gathered by conversation over one exchange, and all that follows is
    done in the row, in one pass over the turns. Other columns are left aside, and an empty table gives no rows.
    """
    around = len(START) + 1 + len(END) + 1
    turn = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda role, text: F.coalesce(F.sum(F.length(role) + F.length(text) + around).over(before), F.lit(0)).cast("int")
    placed = turn.withColumn("at", ahead(F.col("role"), F.col("text"))).withColumn("safe_at", ahead(escape_role(F.col("role")), escape(F.col("text"))))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "safe_at"))).alias("items"))
    plain = F.transform("items", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    safe = F.transform("items", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    first = whole.select("conv_id", "items", plain.alias("turns")).withColumn("formatted", render(F.col("turns")))
    first = first.withColumn("escaped", ~parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    again = first.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("formatted")))
    same = ~F.col("escaped") | parse(F.col("formatted")).eqNullSafe(F.col("turns"))
    again = again.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be read back"))))
    span = lambda at, role, text: F.struct((at + F.lit(len(START) + 1) + F.length(role)).alias("start"), F.length(text).alias("length"))
    own = F.filter("items", lambda t: t["role"] == trained_role)
    loss = F.transform(own, lambda t: F.when(F.col("escaped"), span(t["safe_at"], escape_role(t["role"]), escape(t["text"]))).otherwise(span(t["at"], t["role"], t["text"])))
    return again.select("conv_id", F.size("turns").cast("long").alias("n_source"), "formatted", loss.alias("loss"), "escaped")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chat()'s output: turns and the text under the loss mask, as digests."""
    turns = parse(F.col("formatted"))
    said = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    under = F.concat_ws("", F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))))
    return formatted.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), under.alias("under"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars"
    )
