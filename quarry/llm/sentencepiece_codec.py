"""SentencePiece encoding and decoding by batched numpy Viterbi.

Chunks that are not yet known are grouped by length, and all of a length advance together, one character at a time: the hashes of
their substrings are looked up among the sorted hashes of the pieces, the best start is a vectorised maximum (starts in order, later
ones only if strictly better) and is stored as a backpointer. Each result is checked: the pieces found must spell the chunk. Where they
don't, as a substring has the hash of another piece, that chunk is encoded again by looking the substrings themselves up.
"""

from __future__ import annotations

import functools
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows
from quarry.llm.lexicon import MARK, Lexicon, chunks, load

BASE = 0x9E3779B97F4A7C15
#: Chunks remembered in a worker, and cells (chunks times characters) of a batch.
REMEMBERED, CELLS = 300_000, 100_000


def code_points(texts: list[str]) -> np.ndarray:
    """Texts of one length as a matrix, spread over 64 bits."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), -1).astype("u8") + np.uint64(1)
    x = (x ^ (x >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


class Codec:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known, self.raw = lexicon, {}, lexicon.raw_bytes()
        keys, ids, scores = [], [], []
        by_length: dict[int, list[str]] = {}
        for p in lexicon.pieces:
            by_length.setdefault(len(p), []).append(p)
        for n, pieces in by_length.items():
            h = np.zeros(len(pieces), "u8")
            for column in code_points(pieces).T:
                h = h * np.uint64(BASE) + column
            keys.append(h + np.uint64(n))
            ids += [lexicon.pieces[p][0] for p in pieces]
            scores += [lexicon.pieces[p][1] for p in pieces]
        self.keys = np.concatenate(keys)
        order = np.argsort(self.keys)
        self.keys, self.ids, self.scores = self.keys[order], np.array(ids, "i4")[order], np.array(scores)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 21, bool)  # by the upper bits of a hash: most substrings need no search
        self.maybe[self.keys >> np.uint64(43)] = True

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts of one length, each with its mark."""
        x = code_points(texts)
        m, n = x.shape
        every = np.arange(m)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        start, piece = np.zeros((n + 1, m), "i4"), np.full((n + 1, m), -1, "i4")
        prefix = np.zeros((n + 1, m), "u8")
        for e in range(1, n + 1):
            prefix[e] = prefix[e - 1] * np.uint64(BASE) + x[:, e - 1]
        power = np.array([pow(BASE, k, 1 << 64) for k in range(self.lexicon.longest + 1)], "u8")
        for e in range(1, n + 1):
            first = max(0, e - self.lexicon.longest)
            key = prefix[e] - prefix[first:e] * power[e - first : 0 : -1, None] + np.arange(e - first, 0, -1, dtype="u8")[:, None]
            at = np.flatnonzero(self.maybe[key >> np.uint64(43)])
            wanted = key.ravel()[at]
            i = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[i] == wanted
            at, i = at[there], i[there]
            new, ids = np.full(key.shape, -np.inf), np.full(key.shape, -1, "i4")
            new.ravel()[at] = best[first:e].ravel()[at] + self.scores[i]
            ids.ravel()[at] = self.ids[i]
            lone = np.flatnonzero(ids[-1] < 0)
            new[-1, lone] = best[e - 1, lone] + self.lexicon.unknown
            top = new.argmax(axis=0)  # of equal ones the earliest start
            best[e], start[e], piece[e] = new[top, every], top + first, ids[top, every]
        out: list[list[int]] = []
        for text, starts, ids in zip(texts, start.T.tolist(), piece.T.tolist(), strict=True):
            path, e = [], n
            while e:
                if ids[e] >= 0:
                    path.append(ids[e])
                else:
                    path += [self.lexicon.byte_ids[b] for b in reversed(text[starts[e] : e].encode())]
                e = starts[e]
            path.reverse()
            if self.spelt(path) != text.replace(MARK, " ").encode():
                path = self.encode_plain(text)
            out.append(path)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of one text, by the same rule, without hashes."""
        own, best, back = self.lexicon, [0.0], [(0, -1)]
        for e in range(1, len(text) + 1):
            top = (-np.inf, 0, -1)
            for a in range(max(0, e - own.longest), e):
                piece = own.pieces.get(text[a:e])
                if piece and best[a] + piece[1] > top[0]:
                    top = (best[a] + piece[1], a, piece[0])
            if text[e - 1] not in own.pieces and best[e - 1] + own.unknown > top[0]:
                top = (best[e - 1] + own.unknown, e - 1, -1)
            best.append(top[0])
            back.append(top[1:])
        path, e = [], len(text)
        while e:
            a, piece = back[e]
            path += [piece] if piece >= 0 else [own.byte_ids[b] for b in reversed(text[a:e].encode())]
            e = a
        return path[::-1]

    def spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def learn(self, wanted: set[str]) -> None:
        """Encode chunks (without marks) that aren't known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for c in wanted - self.known.keys():
            by_length.setdefault(len(c), []).append(c)
        for n, group in by_length.items():
            step = max(1, CELLS // (n + 1))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                ids = self.encode_batch([MARK + c for c in part])
                flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
                ends = (4 * np.cumsum([0, *map(len, ids)])).tolist()
                self.known |= {c: flat[a:b] for c, a, b in zip(part, ends, ends[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Without the space that the first mark stands for."""
        return self.spelt(ids.tolist()).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(load(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array). Null and empty texts have no ids; repeated rows give equal rows, a null id its own row; texts of any length are cut whole; other columns are not read; an empty table gives no rows."""

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "ids": [i.tolist() for i in codec(path).encode([t or "" for t in x["text"]])]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>", rows=1000)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give the empty text. Space marks in a source text come back as spaces."""

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "text": [codec(path).decode(np.array(i or [], "<u4")) for i in x["ids"]]}

    return map_rows(encoded, run, "doc_id long, text string", rows=1000)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), same (whether decoding gives the text). Rows as in encode()."""

    def run(x: dict[str, list]) -> dict[str, list]:
        own = codec(path)
        texts = [t or "" for t in x["text"]]
        ids = own.encode(texts)
        return {"doc_id": x["doc_id"], "n_pieces": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids], "same": [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_pieces long, ids_crc32 long, same boolean", rows=1000)
