"""Packing of documents into sequences by patterns, after a non-negative least squares fit.

Documents are tokenised and cut into pieces once, in parallel; what goes to the driver is the histogram of piece lengths, of as many
bins as a sequence has tokens, whatever the input. There, all patterns of two and three lengths that fill a sequence exactly are
enumerated (under size * size / 12 + size of them), repeat counts are fitted to the histogram by non-negative least squares and rounded
with a carry, so that what one pattern loses the next one gets; what is left is packed best fit first, by whole groups of equal
sequences. The plan (which ranks of which length take which place) goes to the tasks, where each piece finds its place by its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, cut, map_rows

SEQUENCE = 2048
#: Repeats of patterns are rounded to whole groups, of which there are about this many at most, so that a plan stays small whatever the input.
GROUPS = 20_000
#: The rule by which byte-level BPE vocabularies of this family cut a text before merging (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    """A byte-level BPE file of the tokenizers library, run by tiktoken, which gives the same ids several times faster; added tokens in a text are one id, as there."""
    import json

    import tiktoken

    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks, special = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    else:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}  # how such files write bytes
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def library(path: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a text. Runs of white space of about a million signs are more than tiktoken's rule can match; such a text goes through the tokenizers library itself."""
    try:
        return encoding(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "u4")


def pieces(ids: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences at its end, and what remains first."""
    n = len(ids)
    if n <= size:
        return [(0, n)]
    first = n % size
    return [(0, first)] * bool(first) + [(at, size) for at in range(first, n, size)]


def tokenised(docs: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece."""

    def run(x: dict[str, list]) -> dict[str, list]:
        rows = []
        for ident, text in zip(x["doc_id"], x["text"], strict=True):
            ids = np.append(ids_of(text or "", path), end_id).astype("<u4")
            rows += [(ident, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(pieces(ids, size))]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths (0: none), longest first, that fill a sequence, all of them in the histogram; sorted, so that neighbours differ little."""
    have = counts > 0
    have[0], have[size:] = False, False
    lengths = np.flatnonzero(have)
    large = lengths[2 * lengths >= size]
    large = large[have[size - large]]
    out = [np.stack([large, size - large, np.zeros_like(large)], axis=1)]
    for x in lengths:  # x >= y >= z
        y = lengths[(lengths <= x) & (2 * lengths >= size - x) & (lengths < size - x)]
        y = y[have[size - x - y]]
        out.append(np.stack([np.full(len(y), x), y, size - x - y], axis=1))
    rows = np.concatenate(out).astype("i8")
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 with the sum over patterns of x times lengths used close to target: accelerated projected gradient."""
    size = len(target)
    used = rows > 0
    forward = lambda x: np.bincount(rows.ravel(), weights=(x[:, None] * used).ravel(), minlength=size)
    back = lambda r: (r[rows] * used).sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(forward(y) - target))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: list[int], groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) by patterns, the longest lengths first; takes them from `left`. What a pattern's repeats are off by is carried to the next one."""
    unit, carry, out = max(1, int(x.sum() // groups)), 0.0, []
    for i in range(len(rows) - 1, -1, -1):
        carry += x[i]
        if 2 * carry < unit:
            continue
        lengths = [v for v in rows[i].tolist() if v]
        n = min(unit * int(carry / unit + 0.5), *(left[v] // lengths.count(v) for v in lengths))
        if n > 0:
            out.append((tuple(lengths), n))
            carry -= n
            for v in lengths:
                left[v] -= n
    return out


def pack_plan(counts: np.ndarray, size: int = SEQUENCE) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths, repeats): how often a sequence of these lengths is made, all pieces of the histogram (index: length) having a place; and how many of its first entries are patterns."""
    left = counts.tolist()
    plan = [((size,), left[size])] if left[size] else []
    left[size] = 0
    rows = patterns(np.array(left), size)
    if len(rows):
        target = np.array([0.0, *left[1:]])
        plan += rounded(rows, nnls(rows, target), left)
    by_pattern = len(plan)
    # what is left: best fit, longest first, for groups of equal sequences at once; rooms[r] holds groups with r tokens free
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(size + 1, bool)
    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            fits = np.flatnonzero(room[v:])
            if len(fits):
                r = v + int(fits[0])
                lengths, have = rooms[r].pop()
                take = min(n, have)
                if take < have:
                    rooms[r].append((lengths, have - take))
                room[r] = bool(rooms[r])
            else:  # a new sequence takes as many of this length as go in
                k = min(size // v, n)
                lengths, take, r = (v,) * (k - 1), n // k, size - v * (k - 1)
                n -= take * (k - 1)
            rooms.setdefault(r - v, []).append(((*lengths, v), take))
            room[r - v] = True
            n -= take
    return plan + [g for groups in rooms.values() for g in groups], by_pattern


def slots(plan: list[tuple[tuple[int, ...], int]], size: int = SEQUENCE) -> dict[str, np.ndarray]:
    """The plan by place: for a length, the first rank that takes it, its sequence, and where in the sequence it is; sorted by length and rank."""
    base, next_rank, rows = 0, np.zeros(size + 1, "i8"), []
    for lengths, n in plan:
        at = 0
        for v in lengths:
            rows.append((v, next_rank[v], base, at))
            next_rank[v] += n
            at += v
        base += n
    a = np.array(rows, "i8").reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone. Repeated rows and null ids are pieces as any other, each with a place of its own. A
    text of any length is cut, whole, into pieces. Which of several pieces of one length takes which place follows their order in the
    checkpointed table of pieces. Columns of other names are left aside. An empty table gives no rows.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cutted = cut(tokenised(docs, path, end_id, size, id_col, text_col))
    counts = np.zeros(size + 1, "i8")
    for length, n in cutted.groupBy("length").count().collect():  # at most `size` rows
        counts[length] = n
    salts = max(16, int(counts.sum() // 200_000))  # a length that many documents share is ranked in parts, dealt by the place of a row
    salted = cutted.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("r", F.row_number().over(in_part) - 1).join(parts, ["length", "salt"]).select(*cols, (F.col("before") + F.col("r")).alias("rank"))
    place = slots(pack_plan(counts, size)[0], size)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(place["key"], (length << 44) + rank, "right") - 1
            more = [pa.array(place["sequence"][i] + rank - place["rank"][i]), pa.array(place["offset"][i])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], schema=arrow)

    return ranked.mapInArrow(run, schema)
