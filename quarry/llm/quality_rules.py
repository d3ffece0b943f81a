"""Quality rules: base counts, then line labels from a linear-chain conditional random field.

Each line of a document is content or boilerplate. The field's weights are trained here: lines of labelled good documents start as
content and lines of bad ones as boilerplate, a first field is fitted, its best paths relabel the lines of bad documents (which also
hold proper lines), and the field is fitted again. Viterbi decoding then labels every line of every document, and a document is kept
if the content lines hold at least `share` of its word characters and it passes the base rules.

Training runs on the driver over a bounded sample of labelled rows: at most `each` stretches of LINES lines of each label, from at most
`each` documents of it, so that a document of a million lines takes no more time than others. All else covers all documents and
whole texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, labelled, map_rows, one_each, utf8

SYMBOLS, BLANKS, UPPER, LOWER = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b < 58)
FEATURES = 17
#: Lines of a stretch to train on.
LINES = 256


def repeat_words(words: list[bytes], span: int = 3) -> int:
    """Words in a window of `span` words that the text has twice or more, the first included."""
    if len(words) < span + 1:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], "i8")
    key = w[: len(w) - span + 1]
    for k in range(1, span):
        _, place = np.unique(key, return_inverse=True)
        key = place * len(ids) + w[k : len(w) - span + 1 + k]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(w) + 1, "i8")
    often = np.flatnonzero(count[place] > 1)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + span, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def word_chars(data: bytes) -> int:
    """Code points outside white space; continuation bytes don't begin one."""
    return len(data.translate(None, BLANKS + bytes(range(128, 192))))


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, seen, again = data.split(), set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return len(words), word_chars(data), len(data) - len(data.translate(None, SYMBOLS)), again, repeat_words(words)


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each line that has a word: features as bits of an integer (lowest: bias), and its word characters."""
    bits, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, count = len(line), len(words)
        upper, lower = n - len(line.translate(None, UPPER)), n - len(line.translate(None, LOWER))
        symbols, digits = n - len(line.translate(None, SYMBOLS)), len(line.translate(None, NOT_DIGIT))
        marks, low = line.count(b"!"), line.lower()
        flags = (
            True, b"|" in line, line.count(b"|") * 6 > count, symbols > 0.02 * n, symbols > 0.08 * n, symbols > 0.2 * n, upper > lower, upper * 4 > lower,
            marks * 40 > n, digits * 5 > n, b"http" in low or b"www." in low or b"@" in line, count < 4, count > 40, line in seen,
            words[-1][-1:] in b".!?:;", len(set(words)) * 2 < count, b"copyright" in low or b"license" in low or b"cookie" in low,
        )
        seen.add(line)
        bits.append(sum(1 << i for i, f in enumerate(flags) if f))
        sizes.append(word_chars(line))
    return np.array(bits, "<i4"), np.array(sizes, "i8")


def expand(bits: np.ndarray) -> np.ndarray:
    return (bits[..., None] >> np.arange(FEATURES)) & 1


class Field:
    """Two labels (0 content, 1 boilerplate): w scores label 1 against 0 from a line's features, t[a, b] a step from a to b."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def decode(self, bits: np.ndarray) -> np.ndarray:
        """Best path by Viterbi; ties go to content."""
        score = (expand(bits) @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b, back = 0.0, score[0] if score else 0.0, []
        for s in score[1:]:
            from_b, to_b = b + t10 > a + t00, b + t11 > a + t01
            back.append((from_b, to_b))
            a, b = (b + t10 if from_b else a + t00), (b + t11 if to_b else a + t01) + s
        state, path = b > a, []
        for from_b, to_b in reversed(back):
            path.append(state)
            state = to_b if state else from_b
        return np.array([*path, state][::-1][: len(score)], bool)


def train(lines: list[np.ndarray], paths: list[np.ndarray], steps: int = 120, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Gradient ascent (with per-weight step sizes) on the conditional log-likelihood, by forward and backward sums over all sequences at once."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    lines, paths = [lines[i] for i in order], [paths[i] for i in order]
    size = np.array([len(x) for x in lines])
    alive = [int((size > k).sum()) for k in range(int(size[0]))]  # sequences that have a line k
    x = [expand(np.array([lines[i][k] for i in range(n)])) for k, n in enumerate(alive)]
    y = [np.array([paths[i][k] for i in range(n)], int) for k, n in enumerate(alive)]
    w, t, total = np.zeros(FEATURES), np.zeros((2, 2)), float(size.sum())
    sums = [np.zeros(FEATURES), np.zeros((2, 2))]
    for _ in range(steps):
        s = [f @ w for f in x]
        fore = [np.stack([np.zeros_like(s[0]), s[0]], axis=1)]
        for k in range(1, len(x)):
            n = alive[k]
            step = np.logaddexp(fore[-1][:n, 0, None] + t[0], fore[-1][:n, 1, None] + t[1])
            step[:, 1] += s[k]
            fore.append(step)
        gw, gt = np.zeros(FEATURES), np.zeros((2, 2))
        back = np.zeros((alive[-1], 2))
        for k in range(len(x) - 1, -1, -1):
            n = alive[k]
            if len(back) < n:
                back = np.concatenate([back, np.zeros((n - len(back), 2))])
            joint = fore[k] + back
            z = np.logaddexp(joint[:, 0], joint[:, 1])
            gw += x[k].T @ (y[k] - np.exp(joint[:, 1] - z))
            if k:
                ahead = back.copy()
                ahead[:, 1] += s[k]
                pair = fore[k - 1][:n, :, None] + t[None] + ahead[:, None, :] - z[:, None, None]
                np.add.at(gt, (y[k - 1][:n], y[k]), 1)
                gt -= np.exp(pair).sum(axis=0)
                back = np.stack([np.logaddexp(t[a, 0] + ahead[:, 0], t[a, 1] + ahead[:, 1]) for a in range(2)], axis=1)
        for value, grad, seen in ((w, gw / total - l2 * w, sums[0]), (t, gt / total - l2 * t, sums[1])):
            seen += grad**2
            value += rate * grad / (np.sqrt(seen) + 1e-8)
    return Field(w, t)


def stretches(bits: np.ndarray, lines: int = LINES) -> list[bytes]:
    return [bits[at : at + lines].tobytes() for at in range(0, len(bits), lines)]


def fit(docs: DataFrame, labels: DataFrame, each: int = 1500, column: str = "quality") -> Field | None:
    """None without labelled documents of both kinds that have a line; then all lines are content."""
    known = labelled(labels, column, each)
    sample = one_each(docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(known), "doc_id"), ["text", "y"])  # at most 2 * each rows
    rows = map_rows(sample, lambda x: {"doc_id": x["doc_id"], "y": x["y"], "parts": [stretches(line_features(t)[0]) for t in x["text"]]}, "doc_id long, y int, parts array<binary>")
    parts = cut(rows.select("doc_id", "y", F.posexplode("parts").alias("at", "bits")))
    some = reduce(DataFrame.union, [parts.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(each) for y in (0, 1)])
    got = sorted((r["doc_id"], r["y"], r["at"], bytes(r["bits"])) for r in some.collect())
    lines = [np.frombuffer(b, "<i4") for *_, b in got]
    bad = [y == 0 for _, y, _, _ in got]
    if len(set(bad)) < 2:
        return None
    paths = [np.full(len(x), b) for x, b in zip(lines, bad, strict=True)]
    first = train(lines, paths)
    paths = [first.decode(x) if b else p for x, b, p in zip(lines, bad, paths, strict=True)]
    return train(lines, paths)


def apply_rules(docs: DataFrame, field: Field | None, share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, content_share.

    Null and empty texts have no words, fail the base rules and are not kept; their content_share is 1. Repeated rows give equal rows.
    Paths that score alike go to content, a share of exactly `share` is kept, and texts of any length are read whole. A null id has its
    row; other columns are not read. An empty table gives no rows.
    """

    def one(data: bytes) -> tuple:
        counts = base_counts(data)
        bits, sizes = line_features(data)
        junk = field.decode(bits) if field is not None and len(bits) else np.zeros(len(bits), bool)
        content = float(sizes[~junk].sum() / sizes.sum()) if len(sizes) else 1.0
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        return (*counts, failed, not failed and content >= share, content)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

    def run(x: dict[str, list]) -> dict[str, list]:
        rows = [one(t) for t in x["text"]]
        return {"doc_id": x["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), run, schema)
