"""Token counts by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a chunk by their ends, longest first; dynamic programming carries the
best score and its number of pieces to each end, and no path. Ties follow the tokenizer: of equal scores at an end the earliest start
stays, as later ones must be strictly better. Counts of chunks are remembered in each worker, up to a bound.
"""

from __future__ import annotations

import functools

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows
from quarry.llm.lexicon import MARK, Lexicon, chunks, load

#: Remembered chunks of a worker.
REMEMBERED = 300_000


class Counter(dict):
    """From a chunk (without its mark) to its pieces and its score."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.single = lexicon, {p for p in lexicon.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in lexicon.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, chunk: str) -> tuple[int, float]:
        out = self.count(MARK + chunk)
        if len(chunk) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = out
        return out

    def count(self, text: str) -> tuple[int, float]:
        best, number = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        at = 0  # ends up to here are settled

        def settle(upto: int) -> None:
            for end in range(at + 1, upto + 1):
                if text[end - 1] not in self.single and best[end - 1] + self.lexicon.unknown > best[end]:
                    best[end], number[end] = best[end - 1] + self.lexicon.unknown, number[end - 1] + len(text[end - 1].encode())

        for last, (length, score) in self.automaton.iter(text):
            if last > at:
                settle(last)
                at = last
            new = best[last + 1 - length] + score
            if new > best[last + 1]:
                best[last + 1], number[last + 1] = new, number[last + 1 - length] + 1
        settle(len(text))
        return number[-1], best[-1]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(load(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, score (of the best cut of the whole text).

    Null and empty texts have 0 tokens and a score of 0. Repeated rows give equal rows, a null id its own row; texts of any length
    are cut whole; other columns are not read. An empty table gives no rows.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        known = counter(path)
        counts, scores = [], []
        for text in x["text"]:
            got = [known[c] for c in chunks(text or "")]
            counts.append(sum(g[0] for g in got))
            scores.append(sum(g[1] for g in got) + 0.0)
        return {"doc_id": x["doc_id"], "n_tokens": counts, "score": scores}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, score double")
