"""From documents to chunks: blocks, pages, sections, packing, identifiers and hash embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import digest_id, tokens

BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "td", "th", "blockquote", "pre", "section", "article"}
HIDDEN = {"script", "style", "noscript", "template"}


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block_seq, text): paragraphs between blank lines."""
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\n\s*\n")).alias("block_seq", "text"))
    return cut.select("id", F.col("block_seq").cast("long").alias("block_seq"), F.trim("text").alias("text")).where("text <> ''")


class _Blocks(HTMLParser):
    """Innermost blocks of a page; a table is one block, its cells joined by bars."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool]] = []
        self.text, self.rows, self.hidden, self.depth = [], [], 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if self.depth:
            if text and self.rows:
                self.rows[-1].append(text)
        elif text:
            self.out.append((text, False))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "table":
            self.flush()
            self.depth += 1
        elif tag == "tr" and self.depth:
            self.flush()
            self.rows.append([])
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.depth:
            self.flush()
            self.depth -= 1
            if not self.depth:
                rows = [" | ".join(r) for r in self.rows if r]
                self.rows = []
                if rows:
                    self.out.append(("\n".join(rows), True))
        elif tag in BLOCKS or tag == "tr":
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def parse_html(html: str) -> list[tuple[str, bool]]:
    """(text, is_table) of a page, in order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block_seq, text, is_table)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, text, table) for i, html in zip(b["id"], b["html"], strict=True) for n, (text, table) in enumerate(parse_html(html or ""))]
            yield pd.DataFrame(rows, columns=["id", "block_seq", "text", "is_table"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id long, block_seq long, text string, is_table boolean")


def pages(blocks: DataFrame, size: int = 3000) -> DataFrame:
    """blocks with page: by the characters of the document's blocks before it."""
    before = Window.partitionBy("id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("page", (F.floor(F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / size) + 1).cast("long"))


def carry_sections(blocks: DataFrame, heading: str = r"(?i)^\s*item\s+\d+[a-z]?\.") -> DataFrame:
    """blocks with section: the last heading at or before each."""
    upto = Window.partitionBy("id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("text").rlike(heading), F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(120)))
    return blocks.withColumn("section", F.last(title, ignorenulls=True).over(upto))


def oversize_windows(blocks: DataFrame, target: int, overlap: int) -> DataFrame:
    """(id, block_seq, part, text): blocks cut into windows of 4 * target characters that overlap by 4 * overlap."""
    step = 4 * (target - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    cut = blocks.select("id", "block_seq", "text", F.posexplode(starts).alias("part", "start"))
    return cut.select("id", "block_seq", F.col("part").cast("long").alias("part"), F.trim(F.col("text").substr(F.col("start") + 1, F.lit(4 * target))).alias("text")).where("text <> ''")


def pack_blocks(blocks: DataFrame, target: int) -> DataFrame:
    """(id, chunk_seq, first_seq, last_seq, n_chars): blocks gathered in order while their token estimates stay within target; a table is a chunk of its own.

    An ordered fold over a document's blocks, in the row.
    """
    item = F.struct("block_seq", F.length("text").alias("n"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("t"), F.coalesce("is_table", F.lit(False)).alias("alone"))
    zero = F.expr("named_struct('done', cast(array() as array<struct<first:bigint,last:bigint,n:int>>), 'first', cast(null as bigint), 'last', cast(null as bigint), 'n', 0, 't', 0, 'alone', false)")

    def close(a: Column) -> Column:
        return F.when(a["first"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"), a["n"].alias("n")))))

    def step(a: Column, b: Column) -> Column:
        new = a["first"].isNull() | b["alone"] | a["alone"] | (a["t"] + b["t"] > target)
        return F.struct(F.when(new, close(a)).otherwise(a["done"]).alias("done"), F.when(new, b["block_seq"]).otherwise(a["first"]).alias("first"), b["block_seq"].alias("last"), F.when(new, b["n"]).otherwise(a["n"] + b["n"]).alias("n"), F.when(new, b["t"]).otherwise(a["t"] + b["t"]).alias("t"), b["alone"].alias("alone"))

    whole = blocks.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    packed = whole.select("id", F.posexplode(F.aggregate("items", zero, step, close)).alias("chunk_seq", "c"))
    return packed.select("id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("c.first").alias("first_seq"), F.col("c.last").alias("last_seq"), F.col("c.n").cast("long").alias("n_chars"))


def chunk_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with chunk_id: 24 hex digits over id and text."""
    return docs.withColumn("chunk_id", digest_id(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col(text_col)), 24))


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """(id, dim, value): each token adds its sign to the dimension its MD5 gives; normalised. Sparse rows, zero dimensions left out.

    Tokens are hashed and added up by document and dimension, which combines map-side; a document's dims values are one row, and its norm is found there.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    high = F.conv(F.substring(F.md5("token"), 1, 16), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.substring(F.md5("token"), 1, 1) >= "8", 1).otherwise(-1)
    sums = words.select("id", F.pmod(high, F.lit(dims)).cast("int").alias("dim"), sign.alias("v")).groupBy("id", "dim").agg(F.sum("v").alias("v")).where("v <> 0")
    whole = sums.groupBy("id").agg(F.collect_list(F.struct("dim", "v")).alias("vs"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # at most dims entries
    return whole.select("id", "norm", F.inline("vs")).select("id", "dim", F.round(F.col("v") / F.col("norm"), 6).alias("value"))


def clean(text: Column) -> Column:
    """Hard spaces as spaces, runs of blanks as one, at most two line feeds in a row, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def parsed(raw: DataFrame) -> DataFrame:
    """(id, block_seq, text, is_table) of raw documents (id, content, content_type): html by its parser, all else by blank lines; texts cleaned, empty ones gone."""
    html = html_blocks(raw.where("content_type = 'html'"), "id", "content")
    plain = text_blocks(raw.where("content_type <> 'html' or content_type is null"), "id", "content").withColumn("is_table", F.lit(False))
    return html.unionByName(plain).withColumn("text", clean(F.col("text"))).where("text <> ''")


def packed_blocks(blocks: DataFrame, target: int, overlap: int) -> DataFrame:
    """(id, chunk_seq, page, section, text): chunks of blocks (id, block_seq, text, is_table, page, section), in order.

    A table is a chunk of its own. A new section or a full chunk (token estimates beyond target) begins the next one, and a block that is larger than
    target becomes windows that overlap. Page is that of a chunk's first block. Chunk numbers of one document are found by one pass over
    its blocks' sizes in a task; texts are joined after that.
    """
    import pandas as pd

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_seq", kind="stable")
        out, chunk, size, section, closed = [], 0, 0, None, True
        for tokens_, table, own in zip(pdf["tokens"], pdf["is_table"], pdf["section"], strict=True):
            alone = bool(table) or tokens_ > target
            if not closed and (alone or own != section or size + tokens_ > target):
                closed = True
            if closed:
                chunk, size = chunk + 1, 0
            size, section, closed = size + tokens_, own, alone
            out.append(chunk)
        return pd.DataFrame({"id": pdf["id"], "block_seq": pdf["block_seq"], "chunk": out})

    sized = blocks.select("id", "block_seq", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"), F.coalesce("is_table", F.lit(False)).alias("is_table"), F.coalesce("section", F.lit("")).alias("section"))
    kind = blocks.schema["id"].dataType.simpleString()
    numbers = sized.groupBy("id").applyInPandas(number, f"id {kind}, block_seq long, chunk long")
    step = 4 * (target - overlap)
    large = ~F.coalesce(F.col("is_table"), F.lit(False)) & (F.greatest(F.lit(1), F.floor(F.length("text") / 4)) > target)
    starts = F.when(large, F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))).otherwise(F.array(F.lit(0)))
    cut = blocks.join(numbers, ["id", "block_seq"]).select("id", "block_seq", "chunk", "page", "section", "text", large.alias("large"), F.posexplode(starts).alias("part", "start"))
    piece = F.when(F.col("large"), F.trim(F.col("text").substr(F.col("start") + 1, F.lit(4 * target)))).otherwise(F.col("text"))
    items = cut.select("id", "chunk", "part", "block_seq", "page", "section", piece.alias("text")).where("text <> ''")
    joined = items.groupBy("id", "chunk", "part").agg(F.sort_array(F.collect_list(F.struct("block_seq", "text"))).alias("b"), F.min_by("page", "block_seq").alias("page"), F.min_by("section", "block_seq").alias("section"))
    order = Window.partitionBy("id").orderBy("chunk", "part")
    return joined.select("id", (F.row_number().over(order) - 1).cast("long").alias("chunk_seq"), "page", F.coalesce("section", F.lit("")).alias("section"), F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def context(rows: DataFrame, labels: dict[str, str] | None = None) -> Column:
    """One sentence that says where a chunk is from: ticker, kind of document, title, section and date, as far as known."""
    kind = F.coalesce(*[F.when(F.col("doc_type") == k, v) for k, v in (labels or {}).items()], F.col("doc_type"))
    own = lambda c, a, b: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))).otherwise("") if c in rows.columns else F.lit("")
    # fixed value: the frame of the sentence
    return F.concat(F.lit("This excerpt is from "), "ticker", F.lit("'s "), kind, own("title", ' titled "', '"'), own("section", ', section "', '"'), own("filing_date", ", filed ", ""), F.lit("."))


def ingested(raw: DataFrame, known: DataFrame, target: int = 500, overlap: int = 100, labels: dict[str, str] | None = None) -> DataFrame:
    """New chunks of raw documents (id, ticker, doc_type, title, content, content_type): parsed, paged, sectioned, packed, with context, identifier and token estimate.

    Chunks whose identifier `known` (chunk_id) has, or that repeat in the batch, are left out; of repeated ones the first stays.
    """
    blocks = carry_sections(pages(parsed(raw)))
    chunks = packed_blocks(blocks, target, overlap).join(raw.select("id", "ticker", "doc_type", "title"), "id")
    made = chunk_ids(chunks, "id", "text").withColumn("context", context(chunks, labels)).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long"))
    first = made.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk_seq"))).where("k = 1").drop("k")
    return first.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")


def ingest_stats(raw: DataFrame, chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """(ticker, docs, chunks_total, chunks_new, chunks_skipped) of a batch."""
    of = lambda df, name: df.groupBy("ticker").agg(F.count("*").alias(name))
    out = of(raw, "docs").join(of(chunks, "chunks_total"), "ticker", "left").join(of(fresh, "chunks_new"), "ticker", "left").na.fill(0, ["chunks_total", "chunks_new"])
    return out.withColumn("chunks_skipped", F.col("chunks_total") - F.col("chunks_new"))


def same_dimension(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """vectors as they are; a vector of another length ends the job with an error."""
    return vectors.withColumn(column, F.when((F.size(column) == dims) | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"not {dims} dimensions: "), F.size(column).cast("string"))).cast(vectors.schema[column].dataType)))
