"""Many phrases in many texts at once: words meet phrases by equality, so the time hardly depends on how many phrases there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.functions.text import tokens
from quarry.sources.tables import cut

#: Bits of the filter for each phrase, and of all at most (16 MB, whatever the input); words of a phrase that it sees.
BITS_EACH, BITS, SEEN = 32, 1 << 27, 8
#: Bits of one row of Spark's bitmaps.
ROW = 32_768


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def marks(flat: pa.StringArray, starts: np.ndarray, sizes: list[int], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each size the places of flat, lists of words that begin at starts, where a list has so many more words, and the filter's bit of each such run."""
    coded = flat.dictionary_encode()
    word = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, "u8")
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(flat))
    run, seen = np.zeros(len(flat), "u8"), 0
    for size in sorted(sizes):
        while seen < min(size, SEEN, len(run)):
            run[: len(run) - seen] = mixed(run[: len(run) - seen] * np.uint64(0x9E3779B97F4A7C15) + word[seen:])
            seen += 1
        at = np.nonzero(left >= size)[0]
        yield size, at, mixed(run[at] + np.uint64(size)) % np.uint64(bits)


def lists(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.StringArray, np.ndarray]]:
    """Parts of a batch (first column any, second lists of words) of about `size` words: the part, its words in a row, and where each list begins, with the end."""
    ends, at = batch.column(1).offsets.to_numpy().astype(np.int64), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        part = batch.slice(at, upto - at)
        yield part, part.column(1).flatten(), ends[at : upto + 1] - ends[at]
        at = upto


def bitmap(phrases: DataFrame, sizes: list[int], bits: int) -> np.ndarray:
    """The filter as bytes: phrases (phrase, ws) set their bits in tasks; BITS / 8 bytes at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, starts in lists(batch):
                for size, at, bit in marks(flat, starts, sizes, bits):
                    own = np.isin(at, starts[:-1][np.diff(starts) == size])
                    yield pa.RecordBatch.from_pydict({"bit": bit[own].astype(np.int64)})

    bit = phrases.select("phrase", "ws").mapInArrow(run, "bit long").select((F.col("bit") + 1).alias("bit"))
    rows = bit.groupBy(F.bitmap_bucket_number("bit").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b")).collect()
    out = np.zeros(-(-bits // ROW) * (ROW // 8), "u1")
    for r in rows:
        out[(r["row"] - 1) * (ROW // 8) :][: len(r["b"])] = np.frombuffer(r["b"], "u1")
    return out


def hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase, at) of texts (id, text) and phrases (phrase): each place, by words from 0, where all words of a phrase stand in a row; case and signs between don't count.

    The phrases set bits of a filter of bounded size. Runs of as many words as some phrase has stay where they are if their bit isn't set;
    the others, which are the hits and few more, are joined to the phrases by equality. Phrases without words, nulls and empty texts give
    nothing; phrases equal in words are found each.
    """
    p = cut(phrases.where("phrase is not null").select("phrase", tokens(F.col("phrase")).alias("ws")).where(F.size("ws") > 0).distinct())
    sizes = [r["n"] for r in p.select(F.size("ws").alias("n")).distinct().collect()]
    bits = min(BITS, max(ROW, BITS_EACH * p.count()))
    spark = texts.sparkSession
    filled = spark.sparkContext.broadcast(bitmap(p, sizes, bits))
    schema = StructType([texts.schema["id"], StructField("at", LongType()), StructField("gram", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, starts in lists(batch):
                words = None
                for size, at, bit in marks(flat, starts, sizes, bits):
                    at = at[(filled.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype("u1")) & 1 > 0]
                    if not len(at):
                        continue
                    words = flat.to_pylist() if words is None else words
                    row = np.searchsorted(starts, at, "right") - 1
                    gram = [" ".join(words[i : i + size]) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at - starts[row]), pa.array(gram, pa.string())], schema=arrow)

    found = texts.where("text is not null").select("id", tokens(F.col("text")).alias("ws")).mapInArrow(run, schema)
    return found.join(p.select(F.array_join("ws", " ").alias("gram"), "phrase"), "gram").select("id", "phrase", "at")
