"""Substring deduplication by level-wise doubling.

A window is `words` consecutive words. Levels have lengths that double up to it (7, 13; or 7, 13, 25, 50). A level takes from each window
of the next length the one of its own length with the smallest hash, so equal windows choose alike. Where that is found in two
documents, and there alone, windows are extended to the next length, until the wanted one is reached or no candidates survive.

Documents are dealt into groups of a few MB. A level sends each group's distinct hashes, packed by range of the hash, and gets one
bit back for each: whether another group, or an earlier document, has it. A window that is in every document is thus one entry from
each group, and never a row for each document. Texts are shuffled once; later levels read that exchange again. Work and rows are
linear in the input: a group touches the ranges that it has hashes in, and tasks are as many as the input's size asks for. Columns
besides id and text pass through as Arrow arrays, as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.llm.common import arrow_schema, cut, lean, utf8

#: Odd multiplier of the rolling hashes.
STEP = 0x9E3779B97F4A7C15
PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
ENTRIES = "g long, bucket long, ids binary, firsts binary"
ANSWERS = "g long, bucket long, bits binary"
_SCHEMAS = {
    "entries": pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary()), ("firsts", pa.binary())]),
    "answers": pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]),
}
#: Shorter windows than this are in too many texts to tell anything apart.
LEAST = 6


def lengths(words: int) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last is `words`, the others are LEAST or more."""
    out = [words]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word: shape (2, n)."""
    flat = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8")
    return flat.reshape(-1, 2).T


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Rolling hashes of each `length` consecutive columns of h, by doubling."""
    power = lambda k: np.uint64(pow(STEP, k, 1 << 64))
    out, have, block, size = None, 0, h, 1
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, have = block, size
            else:
                n = h.shape[1] - have - size + 1
                out, have = out[:, :n] * power(size) + block[:, have : have + n], have + size
        rest >>= 1
        if rest:
            n = block.shape[1] - size
            block, size = block[:, :n] * power(size) + block[:, size : size + n], size * 2
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeds(h: np.ndarray, words: int, half: int) -> np.ndarray:
    """For each window of `words` words the smallest hash of the windows of `half` words in it, mixed once more (the smallest ones alone would crowd the low ranges)."""
    x, span = mixed(windows(h[:1], half)[0]), words - half + 1
    n, out, have = len(x) - span + 1, x, 1
    while have * 2 <= span:  # minima over doubling spans
        out, have = np.minimum(out[: len(out) - have], out[have:]), have * 2
    return mixed(np.minimum(out[:n], out[span - have : span - have + n]))


class Group:
    """The documents of one group, end to end; windows that would cross from one into the next are left out."""

    def __init__(self, table: pa.Table):
        self.texts = table["text"].to_pylist()
        self.ids, self.split = table["doc_id"].to_numpy().astype("i8"), [t.split() for t in self.texts]
        sizes = [len(w) for w in self.split]
        self.ends, self.row = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.hashes = word_hashes(list(chain.from_iterable(self.split)))

    def starts(self, length: int) -> np.ndarray:
        """Where a window of that length begins."""
        n = max(0, len(self.row) - length + 1)
        return np.flatnonzero(self.row[:n] == self.row[length - 1 :])

    def docs(self, at: np.ndarray) -> np.ndarray:
        return self.ids[self.row[at]]


def found(values: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each hash, of `buckets` equal ones; sorted hashes have sorted ranges."""
    return (((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype("i8")


def table_of(schema: str, *columns: list) -> pa.Table:
    return pa.table(list(columns), schema=_SCHEMAS[schema])


def packed(g: int, values: list[np.ndarray], firsts: np.ndarray, buckets: int) -> pa.Table:
    """Rows of entries, one for each range that has a key; values[0] holds sorted distinct keys and gives the ranges."""
    bucket = found(values[0], buckets)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(bucket)]
    ids = np.concatenate([v.view("u1").reshape(len(v), -1) for v in values], axis=1) if len(bucket) else None
    rows = [(ids[a:b].tobytes(), firsts[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] if len(bucket) else []
    return table_of("entries", [g] * len(rows), bucket[starts].tolist(), [r[0] for r in rows], [r[1] for r in rows])


def unpacked(answers: pa.Table, level: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """A flag for each of the sorted distinct keys that packed() was given at that level."""
    bucket, out = found(keys, buckets), np.zeros(len(keys), bool)
    own = answers.filter(pa.array(answers["level"].to_numpy() == level))
    asked = own["bucket"].to_numpy()
    lows, highs = np.searchsorted(bucket, asked, "left"), np.searchsorted(bucket, asked, "right")
    for a, b, bits in zip(lows.tolist(), highs.tolist(), own["bits"].to_pylist(), strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(bits, "u1"), count=b - a).astype(bool)
    return out


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their smallest and largest document, and each input's place among them."""
    order = np.lexsort((docs, keys))
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), "i8")
    place[order] = np.cumsum(new) - 1
    d = docs[order]
    return k[starts], d[starts], d[np.r_[starts[1:], len(k)] - 1] if len(k) else d, place


def among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def survivors(group: Group, answers: pa.Table | None, level: int, levels: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the length after this level's begin that all levels before left over, and their seeds; at the last level, the windows left over and two hashes of each."""
    at, alive = group.starts(levels[0]), None
    for k in range(level + 1):
        if k == len(levels) - 1:
            break
        at = group.starts(levels[k + 1])
        if not len(at):
            break
        seed = seeds(group.hashes, levels[k + 1], levels[k])[at]
        if alive is not None:
            kept = among(seed, alive)
            at, seed = at[kept], seed[kept]
        if k == level:
            return at, seed
        keys, _, _, place = distinct(seed, group.docs(at))
        at = at[unpacked(answers, k, keys, buckets)[place]]
        if k + 2 < len(levels):
            alive = np.unique(mixed(mixed(windows(group.hashes[:1], levels[k + 1])[0][at])))
    if not len(at):
        return at, np.zeros((2, 0) if level == len(levels) - 1 else 0, "u8")
    return at, windows(group.hashes, levels[-1])[:, at]


def send_seeds(table: pa.Table, answers: pa.Table | None, level: int, levels: list[int], buckets: int) -> pa.Table:
    group = Group(table)
    at, seed = survivors(group, answers, level, levels, buckets)
    keys, low, high, _ = distinct(seed, group.docs(at))
    return packed(group_of(table), [keys], (low != high).astype("u1"), buckets)


def group_of(table: pa.Table) -> int:
    return table["g"][0].as_py() if table.num_rows else 0


def answer_seeds(entries: pa.Table) -> pa.Table:
    """Bit: the seed is in another group, or in two documents of its own."""
    keys = [np.frombuffer(x, "<u8") for x in entries["ids"].to_pylist()]
    own = [np.frombuffer(x, "u1") for x in entries["firsts"].to_pylist()]
    _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    flags = (count[place] > 1) | np.concatenate(own).astype(bool)
    return answered(entries, flags, [len(k) for k in keys])


def answered(entries: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    return table_of("answers", entries["g"].to_pylist(), entries["bucket"].to_pylist(), [np.packbits(x).tobytes() for x in parts])


def send_windows(table: pa.Table, answers: pa.Table | None, level: int, levels: list[int], buckets: int) -> pa.Table:
    group = Group(table)
    at, full = survivors(group, answers, level, levels, buckets)
    keys, low, _, place = distinct(mixed(full[0]), group.docs(at))
    check = np.zeros(len(keys), "u8")
    check[place] = full[1]
    return packed(group_of(table), [keys, check.astype("<u4")], low, buckets)


def answer_windows(entries: pa.Table) -> pa.Table:
    """Bit: an earlier document of another group has the window. Keys are 96 bits."""
    raw = [np.frombuffer(x, np.dtype([("k", "<u8"), ("c", "<u4")])) for x in entries["ids"].to_pylist()]
    low = np.concatenate([np.frombuffer(x, "<i8") for x in entries["firsts"].to_pylist()])
    both = np.concatenate(raw)
    order = np.lexsort((low, both["c"], both["k"]))
    s = both[order]
    new = np.r_[True, s[1:] != s[:-1]]
    first = low[order][np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    flags = np.empty(len(s), bool)
    flags[order] = low[order] > first
    return answered(entries, flags, [len(x) for x in raw])


def repeated(table: pa.Table, answers: pa.Table, levels: list[int], buckets: int) -> tuple[Group, list[np.ndarray]]:
    """For each document, which of its words are covered by a window that also starts in an earlier document."""
    group, words, last = Group(table), levels[-1], len(levels) - 1
    at, full = survivors(group, answers, last, levels, buckets)
    docs = group.docs(at)
    keys, low, _, place = distinct(mixed(full[0]), docs)
    earlier = unpacked(answers, last, keys, buckets)[place] | (docs > low[place])
    edge = np.zeros(len(group.ends) and int(group.ends[-1]) + words + 1, "i4")
    edge[at[earlier]] += 1
    edge[at[earlier] + words] -= 1
    covers = np.split(np.cumsum(edge)[: len(edge) - words - 1] > 0, group.ends[:-1])
    return group, covers


def scanned(docs: DataFrame, words: int, group_mb: float, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """What substring_dedup() returns, and the columns of docs named in `rest` as c0, c1, ..."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = int(size / (group_mb * 1e6)) + 1
    buckets = max(24, int(size / 25e6) + 1)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    by_group, by_bucket = max(cores, int(size / 8e6) + 1), max(cores, int(size / 25e6) + 1)  # tasks of some MB at any size
    top = F.lit((1 << 63) - 1)
    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]
    # dealt by id and text, so that the rows of one id (or of none) don't all meet in one group
    base = docs.select(F.pmod(F.xxhash64(F.coalesce(id_col, top), text_col), F.lit(groups)).alias("g"), F.coalesce(F.col(id_col), top).cast("long").alias("doc_id"), F.col(id_col).isNull().alias("no_id"), utf8(text_col).alias("text"), *kept).repartition(by_group, "g")

    def to_group(fn: Callable, answers: DataFrame | None, schema: str | StructType) -> DataFrame:
        if answers is None:
            return base.groupBy("g").applyInArrow(lean(lambda t: fn(t, None)), schema)
        return base.groupBy("g").cogroup(answers.repartition(by_group, "g").groupBy("g")).applyInArrow(lean(fn), schema)

    def ask(level: int, answers: DataFrame | None) -> DataFrame:
        send, answer = (send_windows, answer_windows) if level == last else (send_seeds, answer_seeds)
        sent = to_group(lambda t, a: send(t, a, level, levels, buckets), answers, ENTRIES)
        new = sent.repartition(by_bucket, "bucket").groupBy("bucket").applyInArrow(lean(answer), ANSWERS).withColumn("level", F.lit(level))
        return new if answers is None else answers.union(new)

    levels = lengths(words)
    last, answers = len(levels) - 1, None
    for level in range(last + 1):
        answers = ask(level, answers)
        if level + 1 < last:  # further levels will read these answers, if any candidate survives
            answers = cut(answers)
            if answers.where((F.col("level") == level) & F.hex("bits").rlike("[1-9A-F]")).isEmpty():
                break
    made = StructType.fromDDL("doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
    schema = StructType([*made.fields, *(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(rest))])
    arrow = arrow_schema(schema)

    def without(table: pa.Table, answers: pa.Table) -> pa.Table:
        group, covers = repeated(table, answers, levels, buckets)
        left = [[w for w, gone in zip(s, c, strict=True) if not gone] if c.any() else s for s, c in zip(group.split, covers, strict=True)]
        text = [b"".join(p for p, gone in zip(PIECE.findall(t), c, strict=True) if not gone) if c.any() else t for t, c in zip(group.texts, covers, strict=True)]
        columns = [
            [None if none else i for i, none in zip(group.ids.tolist(), table["no_id"].to_pylist(), strict=True)], [t.decode("utf-8", "replace") for t in text], [len(s) for s in group.split],
            [int(c.sum()) for c in covers], [hashlib.sha256(b" ".join(x)).hexdigest() for x in left],
        ]
        made = [pa.array(x, f.type) for x, f in zip(columns, arrow, strict=False)]
        return pa.table([*made, *(table[f"c{k}"].cast(arrow.field(f"c{k}").type) for k in range(len(rest)))], schema=arrow)

    return to_group(without, answers, schema)


def substring_dedup(docs: DataFrame, words: int = 13, group_mb: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (without the removed words, what is left as it stood), n_words, n_removed, kept_sha256.

    A word goes if a window of `words` words around it also starts in a document with a smaller id. Windows are judged on the input.
    Null and empty texts, and texts of fewer words, lose nothing. Rows with a null id count as one document after all others. Repeated
    rows (equal id) are one document to this rule, so neither removes from the other. An empty table gives no rows.
    """
    return scanned(docs, words, group_mb, id_col, text_col, [])


def drop_repeats(docs: DataFrame, words: int = 13, group_mb: float = 2.0, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with the removed words gone from their texts, and size_col (if there) counted anew for texts that changed.

    All rows, columns and names stay, and columns of any type keep their values. Nulls, empty and long texts, repeated rows and an empty
    table are as in substring_dedup().
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    out = scanned(docs, words, group_mb, id_col, text_col, rest)
    made = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")} | {c: F.col(f"c{k}") for k, c in enumerate(rest)}
    if size_col in rest:
        made[size_col] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[size_col].dataType)).otherwise(made[size_col])
    return out.select(*[made[c].alias(c) for c in docs.columns])
