"""Quality classifier by co-training of two views.

The content view sees a document's words: the words themselves and their shapes (letters, capitals, digits, signs), each as a share of
all words, and how many words and pairs of words repeat. The metadata view sees what is known of the page without its text: language,
source and length. Each is fitted to labelled documents; then, in each round, both score every unlabelled document in tasks, the ones
that a view is most sure of become labels of the other one, and both are fitted again. Both are calibrated on labelled documents kept
aside, and a logistic model over the two calibrated views scores every document.

The labelled sample is bounded by `each` ids of each label, and what a view teaches by `teach` documents of each class and round; the
search for these covers all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, filter_rows, labelled, map_rows, one_each, release
from quarry.llm.learn import Rows, logistic, sigmoid

#: Numbers of features: words, shapes, and 64 for what a text is as a whole.
WORDS, SHAPES, WHOLE = 1 << 16, 1 << 12, 64
CONTENT, META = WHOLE + SHAPES + WORDS, 4096
#: Letters become a or A, digits 0, bytes beyond ASCII a; other signs and white space stay.
SHAPE = bytes(97 if 97 <= b < 123 or b > 127 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
RUNS = re.compile(rb"(?s)(.)\1+")
FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words remembered by a worker. A share of 1 counts as this much.
REMEMBERED, SCALE = 300_000, 8.0


class Shapes(dict):
    """Features of words' kinds of signs, by these signs one by one; there are few, and each is worked out once."""

    def __missing__(self, signs: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[signs] = at = WHOLE + zlib.crc32(RUNS.sub(rb"\1", signs)) % SHAPES
        return at


SHAPE_AT = Shapes()


def places(word: bytes) -> tuple[int, int]:
    """Features of a word: itself, in lower case, and its shape: the kinds of its signs, runs of one kind as one."""
    return WHOLE + SHAPES + zlib.crc32(word.lower()) % WORDS, SHAPE_AT[word.translate(SHAPE)]


def whole(words: list[bytes], distinct: int) -> dict[int, float]:
    n = len(words)
    if not n:
        return {}
    pairs = len(set(zip(words, words[1:], strict=False)))
    return {0: math.log10(n), 1 + min(9, 10 * distinct // n): 1.0, 12 + min(9, 10 * pairs // max(1, n - 1)): 1.0, 24 + min(15, sum(map(len, words)) // n): 1.0}


def content_view(text: bytes) -> dict[int, float]:
    words = text.split()
    counts = Counter(words)
    out = whole(words, len(counts))
    for w, k in counts.items():
        for at in places(w):
            out[at] = out.get(at, 0.0) + SCALE * k / len(words)
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> dict[int, float]:
    size = "unknown" if n_chars is None else int(2 * math.log2(1 + max(0, n_chars)))
    return {zlib.crc32(x.encode()) % META: 1.0 for x in (f"lang {lang}", f"source {source}", f"size {size}", f"lang {lang} size {size}")}


class Adds(dict):
    """What each word adds to a score, worked out when first asked for."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w.tolist()

    def __missing__(self, word: bytes) -> float:
        at, shape = places(word)
        self[word] = adds = self.w[at] + self.w[shape]
        return adds


class ContentScorer:
    """The content view's raw score of a text; what a word adds is remembered."""

    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b, self.adds = w, b, None

    def __getstate__(self) -> dict:
        return {"w": self.w, "b": self.b, "adds": None}

    def __call__(self, text: bytes) -> float:
        if self.adds is None or len(self.adds) > REMEMBERED:
            self.adds = Adds(self.w)
        words = text.split()
        total = sum(map(self.adds.__getitem__, words))
        return self.b + SCALE * total / max(1, len(words)) + sum(self.w[i] * v for i, v in whole(words, len(set(words))).items())


def fields(docs: DataFrame) -> list[F.Column]:
    """The columns the views read; a table without lang, source or n_chars has nulls there."""
    own = {"text": F.coalesce("text", F.lit("")).cast("binary")}
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "n_chars": "long"}
    return [(own[c] if c in own else F.col(c).cast(kinds[c]) if c in docs.columns else F.lit(None).cast(kinds[c])).alias(c) for c in FIELDS]


class Model:
    """Two views' weights and biases, the scales that calibrate them, and the weights of their combination."""

    def __init__(self, content: tuple[np.ndarray, float], meta: tuple[np.ndarray, float], joint: np.ndarray, scales: np.ndarray):
        self.content, self.meta, self.joint, self.scales = ContentScorer(*content), meta, joint, scales

    def raw(self, x: dict[str, list]) -> np.ndarray:
        w, b = self.meta
        meta = [b + sum(w[k] for k in metadata_view(*m)) for m in zip(x["lang"], x["source"], x["n_chars"], strict=True)]
        return np.stack([[self.content(t or b"") for t in x["text"]], meta], axis=1) if x["text"] else np.zeros((0, 2))

    def score(self, x: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of each view, and the score."""
        logits = self.raw(x) * self.scales[:, 0] + self.scales[:, 1]
        return logits, sigmoid(logits @ self.joint[:2] + self.joint[2])


def rows_of(packed: list[bytes]) -> Rows:
    """Rows of features as pack() wrote them."""
    cut_ = [np.frombuffer(b, "<i4") for b in packed]
    return Rows([a[: len(a) // 2] for a in cut_], [a[len(a) // 2 :].view("<f4") for a in cut_])


def pack(features: dict[int, float]) -> bytes:
    return np.array(list(features), "<i4").tobytes() + np.array(list(features.values()), "<f4").tobytes()


def dense(x: np.ndarray) -> Rows:
    return Rows([np.arange(x.shape[1])] * len(x), list(x))


def featured(docs: DataFrame, ids: DataFrame) -> list[tuple]:
    """(doc_id, y, content features, metadata features) of one row of each of ids (doc_id, y), a small table of one row an id."""
    sample = one_each(docs.select(*fields(docs)).join(F.broadcast(ids), "doc_id"), [*FIELDS[1:], "y"])

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"doc_id": x["doc_id"], "y": x["y"], "a": [pack(content_view(t or b"")) for t in x["text"]], "b": [pack(metadata_view(*m)) for m in zip(x["lang"], x["source"], x["n_chars"], strict=True)]}

    got = (tuple(r) for r in map_rows(sample, run, "doc_id long, y int, a binary, b binary").collect())
    return sorted(((i, y, bytes(a), bytes(b)) for i, y, a, b in got), key=lambda r: r[:2])


def sure(docs: DataFrame, labels: DataFrame, model: Model, teach: int, rate: float, certain: float) -> DataFrame:
    """(doc_id, y) of the unlabelled documents that a view is surest of: at most `teach` of either class and view, in the classes' proportion, over `certain`. y has two bits for each view: what it says, and whether it is sure."""

    def run(x: dict[str, list]) -> dict[str, list]:
        p = sigmoid(model.raw(x))
        return {"doc_id": x["doc_id"], "p0": p[:, 0].tolist(), "p1": p[:, 1].tolist()}

    scored = map_rows(docs.select(*fields(docs)).where("doc_id is not null"), run, "doc_id long, p0 double, p1 double")
    free = cut(scored.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.max("p0").alias("p0"), F.max("p1").alias("p1")))
    out = []
    for v in range(2):
        p = F.col(f"p{v}")
        top = lambda cond, order, y, n: free.where(cond).orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(max(1, n)).select("doc_id", F.lit(y).alias("y"))
        out += [top(p > certain, p.desc(), 3 << 2 * v, int(teach * max(rate, 1 - rate) * rate)), top(p < 1 - certain, p.asc(), 2 << 2 * v, int(teach * max(rate, 1 - rate) * (1 - rate)))]
    return reduce(DataFrame.union, out).groupBy("doc_id").agg(F.sum("y").cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, each: int = 4000, teach: int = 1000, rounds: int = 2, certain: float = 0.9, column: str = "quality") -> Model:
    """Of labels, id and `column` (1: good). Without labelled rows of both kinds every document scores 0.5."""
    got = featured(docs, labelled(labels, column, each))
    y = np.array([r[1] for r in got])
    if len(set(y.tolist())) < 2:
        return Model((np.zeros(CONTENT), 0.0), (np.zeros(META), 0.0), np.zeros(3), np.array([[1.0, 0.0], [1.0, 0.0]]))
    aside = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in got])
    base = np.flatnonzero(~aside)
    rate = float(y[base].mean()) if len(base) else 0.5
    taught: list[dict[int, tuple]] = [{}, {}]  # what each view was taught by the other, by document
    models: list[tuple] = [(), ()]
    one = np.array([[1.0, 0.0], [1.0, 0.0]])
    for step in range(rounds + 1):
        for v, dims in enumerate((CONTENT, META)):
            own = [*(got[i] for i in base), *taught[v].values()]
            models[v] = logistic(rows_of([r[2 + v] for r in own]), np.array([r[1] for r in own], float), dims, l2=1e-4, steps=150)
        if step == rounds:
            break
        now = Model(models[0], models[1], np.zeros(3), one)
        for i, said, *views in featured(docs, cut(sure(docs, labels, now, teach, rate, certain))):
            for v in range(2):
                if said >> 2 * v & 2:
                    taught[1 - v].setdefault(i, (i, said >> 2 * v & 1, *views))
    held = np.flatnonzero(aside)
    held = held if len(set(y[held].tolist())) == 2 else np.arange(len(y))
    raw = np.stack([rows_of([got[i][2 + v] for i in held]).dot(models[v][0]) + models[v][1] for v in range(2)], axis=1)
    scales = np.ones((2, 2))
    for v in range(2):
        w, b = logistic(dense(raw[:, v : v + 1]), y[held].astype(float), 1, l2=1e-3)
        scales[v] = w[0], b
    w, b = logistic(dense(raw * scales[:, 0] + scales[:, 1]), y[held].astype(float), 2, l2=1e-3)
    release()
    return Model(models[0], models[1], np.array([*w, b]), scales)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, content_score, metadata_score, score, accepted (score at least 0.5).

    Null and empty texts have no content features and are scored by the rest; null metadata is a value of its own, and so is that of a
    table without such columns. Repeated rows score alike, a null id has its row (and teaches no view), texts of any length are read
    whole, columns beyond those of documents are not read, and an empty table gives no rows.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        logits, p = model.score(x)
        return {"doc_id": x["doc_id"], "content_score": sigmoid(logits[:, 0]).tolist(), "metadata_score": sigmoid(logits[:, 1]).tolist(), "score": p.tolist(), "accepted": (p >= 0.5).tolist()}

    return map_rows(docs.select(*fields(docs)), run, "doc_id long, content_score double, metadata_score double, score double, accepted boolean")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without those that score under `least`; all columns stay. Nulls, empty and long texts, repeated rows and an empty table are as in score()."""
    cols = [c for c in FIELDS if c in docs.columns]

    def run(x: dict[str, list]) -> list[bool]:
        n = len(x["text"])
        full = {c: x.get(c, [None] * n) for c in FIELDS} | {"text": [t.encode() if t else b"" for t in x["text"]]}
        return (model.score(full)[1] >= least).tolist()

    return filter_rows(docs, run, cols)
