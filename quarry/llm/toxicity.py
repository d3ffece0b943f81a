"""Toxicity by weak supervision.

Many voters look at a document, and each votes or abstains. Lexicon voters are terms (words, beginnings of words, beginnings that stand
twice or three times) that labelled training documents show to be tied to toxicity; of the terms that begin alike the strongest votes.
One more voter, silence, votes where no lexicon voter does, and pattern voters see shouting, exclamation marks, runs of signs and
repeated letters. Labels choose the voters, and tell at the end which class is which; they are no voter themselves.

A generative label model over the votes of every training document, labelled or not, estimates how often each voter votes in either
class by expectation maximisation, then how voters correlate beyond what the class explains; voters tied to others count less. Its
sums are taken in tasks, over distinct patterns of votes. The share of toxic documents is that among the labelled training rows, and what
a lone vote says to begin with is how often its voter is right there. The posterior labels of a bounded sample train a sparse linear classifier
over terms and votes, which scores every document.

Nothing is learnt from held-out rows (crc32 of the id, mod 5, is 0), neither from their labels nor from their texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, labelled, map_rows, one_each, release, utf8
from quarry.llm.learn import Rows, logistic, sigmoid

#: A word to this operator: letters of ASCII and bytes beyond it, so signs stuck to a word don't hide it.
WORD = re.compile(rb"[a-z\x80-\xff]+")
LONG_RUN = re.compile(rb"([a-z])\1\1")
#: Lengths of word beginnings, so that inflected and joined forms of one stem count together.
STARTS = (4, 6, 7)
PATTERNS = 6
#: Words remembered by a worker.
REMEMBERED = 300_000


def low_words(text: bytes) -> Counter:
    return Counter(WORD.findall(text.decode("utf-8", "replace").lower().encode()))


def starts_of(word: bytes) -> list[bytes]:
    return [b"%d<%s" % (n, word[:n]) for n in STARTS if len(word) >= n]


def terms_of(text: bytes) -> set[bytes]:
    """Words; their beginnings of the lengths in STARTS, marked as such; and those beginnings that stand two and three times or more."""
    words = low_words(text)
    starts: Counter = Counter()
    for w, k in words.items():
        for s in starts_of(w):
            starts[s] += k
    return words.keys() | starts.keys() | {b"2*" + s for s, n in starts.items() if n > 1} | {b"3*" + s for s, n in starts.items() if n > 2}


def patterns_of(text: bytes) -> list[bool]:
    letters = len(text.translate(None, bytes(range(65)))) or 1
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    n = len(text) or 1
    return [
        capitals > 0.5 * letters,
        text.count(b"!") > 0.01 * n,
        len(text) - len(text.translate(None, b"#*$%&|<>")) > 0.05 * n,
        bool(LONG_RUN.search(text.lower())),
        b"!!!" in text,
        b"?!" in text,
    ]


class Scanner:
    """Which terms of a vocabulary a text has; equal to terms_of(text) & vocabulary. What a word can contribute is remembered."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.terms = set(vocabulary)
        self.starts = {t.rpartition(b"*")[2] for t in self.terms if b"<" in t}
        self.known: dict[bytes, tuple] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "starts": self.starts, "known": {}}

    def of_word(self, word: bytes) -> tuple:
        got = (word in self.terms, [s for s in starts_of(word) if s in self.starts])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = got = got if got[0] or got[1] else ()
        return got

    def __call__(self, text: bytes) -> set[bytes]:
        out, starts = set(), {}
        known, of_word = self.known, self.of_word
        for w, k in low_words(text).items():
            got = known.get(w)
            if got is None:
                got = of_word(w)
            if got:
                if got[0]:
                    out.add(w)
                for s in got[1]:
                    starts[s] = starts.get(s, 0) + k
        for s, k in starts.items():
            out |= {s, b"2*" + s} if k == 2 else {s, b"2*" + s, b"3*" + s} if k > 2 else {s}
        return out & self.terms


class Voters:
    """Numbers of the voters: lexicon terms, then patterns, then silence. A lexicon has the share of toxic documents among those with a term."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.of = {t: i for i, t in enumerate(lexicon)}
        self.trust = np.array([*lexicon.values()])
        self.n = len(lexicon) + PATTERNS + 1

    def votes(self, text: bytes, terms: set[bytes]) -> list[int]:
        said = sorted(self.of[t] for t in terms if t in self.of)
        first = len(self.of)
        return said + [first + i for i, v in enumerate(patterns_of(text)) if v] + ([] if said else [self.n - 1])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def strength(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Signed root of the likelihood ratio of a term in `a` of n1 and `b` of n0 documents; positive: more often in the first."""
    n, k = float(n1 + n0), a + b
    part = lambda have, want: F.when(have > 0, have * F.log(have / want)).otherwise(0.0)
    ratio = part(a, k * n1 / n) + part(b, k * n0 / n) + part(n1 - a, (n - k) * n1 / n) + part(n0 - b, (n - k) * n0 / n)
    root = F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))
    return F.when(a * n0 >= b * n1, root).otherwise(-root)


def weighed(sample: DataFrame, least: int) -> DataFrame:
    """(term, a, b, z) of the terms that `least` texts or more of a sample (text, y) have: texts of y = 1 and of y = 0 with it, and its strength. Equal texts count once."""
    once = cut(sample.groupBy("text").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = map_rows(once, lambda x: {"y": x["y"], "terms": [list(terms_of(t)) for t in x["text"]]}, "y int, terms array<binary>")
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= least)
    return counts.select("term", "a", "b", F.when(F.lit(bool(n.get(0)) and bool(n.get(1))), strength(F.col("a"), F.col("b"), n.get(1, 0) or 1, n.get(0, 0) or 1)).otherwise(0.0).alias("z"))


def stem(term: bytes) -> bytes:
    """What voters are told apart by: the first four bytes of the word."""
    return term.rpartition(b"*")[2].rpartition(b"<")[2][: STARTS[0]]


def discovered(terms: DataFrame, rate: float) -> float:
    """The strength from which on at most `rate` of the terms (z) are expected to be there by chance, by Benjamini and Hochberg's rule; infinite if there is none.

    It falls with the share of terms that tell something and rises with the number of terms looked at, so it needs no change with the sample's size.
    """
    steps = terms.groupBy(F.floor(F.greatest("z", F.lit(0.0)) * 100).alias("step")).agg(F.count("*").alias("n")).collect()  # strengths in hundredths: some thousand rows
    total, above, least = sum(r["n"] for r in steps), 0, math.inf
    for r in sorted(steps, key=lambda r: -r["step"]):
        above += r["n"]
        if r["step"] > 0 and 0.5 * math.erfc(r["step"] / 100 / math.sqrt(2)) <= rate * above / total:
            least = r["step"] / 100
    return least


def lexicon(sample: DataFrame, least: int = 5, share: float = 0.03, rate: float = 0.01, balance: float | None = None) -> dict[bytes, float]:
    """Of the terms that tell toxic texts of (text, y) from others, `rate` of them at most by chance, and that `share` of the toxic ones have, the strongest of each stem.

    With each the share of toxic texts among those that have it, where `balance` of all texts are toxic (by default as in the sample). As a
    voter says toxic, it must be right more often than not: terms under one half are left out.
    """
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.countDistinct("text").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    balance = (n1 + 0.5) / (n1 + n0 + 1) if balance is None else balance
    terms = cut(weighed(sample, least))
    toxic, clean = balance * (F.col("a") + 0.5) / (n1 + 1), (1 - balance) * (F.col("b") + 0.5) / (n0 + 1)
    kept = terms.where((F.col("z") >= discovered(terms, rate)) & (F.col("a") >= F.lit(max(least, share * n1)))).withColumn("trust", toxic / (toxic + clean))
    best: dict[bytes, tuple] = {}
    for r in sorted(kept.where("trust >= 0.5").collect(), key=lambda r: (-r["z"], len(r["term"]), bytes(r["term"]))):  # at most a few for each toxic text
        best.setdefault(stem(bytes(r["term"])), (bytes(r["term"]), r["trust"]))
    return dict(best.values())


class LabelModel:
    """Share of the toxic class, and of each voter: how often it votes in either class and what its vote weighs. A voter that doesn't vote abstains: that says nothing."""

    def __init__(self, prior: float, rates: np.ndarray, weight: np.ndarray):
        self.prior, self.rates, self.weight = prior, rates, weight
        self.says = weight * np.log(rates[0] / rates[1])

    def posterior(self, votes: Iterable[list[int]]) -> np.ndarray:
        base = np.log(self.prior / (1 - self.prior))
        return sigmoid(np.array([base + self.says[v].sum() for v in (np.asarray(v, int) for v in votes)]))


def first_guess(votes: Iterable[list[int]], n: int, trust: np.ndarray | None = None) -> np.ndarray:
    """Before anything is known: two lexicon votes or more are likely toxic, one is as its voter is trusted, none isn't. A voter that never votes beside another stays near that guess."""
    trust = np.full(n - PATTERNS - 1, 0.3) if trust is None else trust
    lexical = [[k for k in v if k < n - PATTERNS - 1] for v in votes]
    return np.array([0.02 if not v else trust[v[0]] if len(v) == 1 else 0.95 for v in lexical])


def moments(votes: list[list[int]], count: list[int], post: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Sums over documents: of the posterior, of the votes, of both, and of its square."""
    m, c = np.asarray(count, float), post * np.asarray(count, float)
    out = {"n": np.array([m.sum(), c.sum(), (c * post).sum()]), "v": np.zeros(n), "pv": np.zeros(n)}
    flat = np.fromiter((k for v in votes for k in v), int)
    size = [len(v) for v in votes]
    out["v"] += np.bincount(flat, weights=np.repeat(m, size), minlength=n)
    out["pv"] += np.bincount(flat, weights=np.repeat(c, size), minlength=n)
    return out


def pairs(votes: list[list[int]], count: list[int], n: int) -> np.ndarray:
    """How many documents two voters both voted on."""
    out = np.zeros(n * n)
    for v, k in zip(votes, count, strict=True):
        a = np.asarray(v, int)
        out[(a[:, None] * n + a[None, :]).ravel()] += k
    return out


def summed(patterns: DataFrame, fn) -> dict[int, float]:  # noqa: ANN001
    """Sum over tasks of the vectors that fn(votes, counts) gives for the rows of patterns; what comes back is as long as a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = fn(b.column(0).to_pylist(), b.column(1).to_pylist())
                total = x if total is None else total + x
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["k", "x"])

    return {r["k"]: r["x"] for r in patterns.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}


def vector(sums: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    out[list(sums)] = list(sums.values())
    return out


def rates_of(s: np.ndarray, n: int, balance: float | None = None) -> tuple[float, np.ndarray]:
    """Prior (`balance` if it is known) and rates from moments as one vector (3 totals, then v, then pv)."""
    total, toxic = s[0], s[1]
    v, pv = s[3 : 3 + n], s[3 + n :]
    return float(np.clip(toxic / max(total, 1) if balance is None else balance, 0.001, 0.999)), np.stack([(pv + 0.1) / (toxic + 1), (v - pv + 0.1) / (total - toxic + 1)])


def weights_of(s: np.ndarray, both: np.ndarray, n: int, tied: float = 0.5) -> np.ndarray:
    """1 for a voter on its own; one whose residuals (what the class doesn't explain) correlate with others' by more than `tied` counts as its share of them. Silence is tied to all by what it is, and counts whole."""
    total, toxic, square = s[:3]
    v, pv = s[3 : 3 + n], s[3 + n :]
    _, (r1, r0) = rates_of(s, n)
    mean = np.outer(pv, r1) + np.outer(v - pv, r0)
    fit = square * np.outer(r1, r1) + (toxic - square) * (np.outer(r1, r0) + np.outer(r0, r1)) + (total - 2 * toxic + square) * np.outer(r0, r0)
    cov = (both.reshape(n, n) - mean - mean.T + fit) / max(total, 1)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    ties = cov / spread / spread[:, None]
    np.fill_diagonal(ties, 0)
    ties[-1, :] = ties[:, -1] = 0
    return 1 / (1 + np.where(ties > tied, ties, 0).sum(axis=0))


def label_model(patterns: DataFrame, n: int, steps: int = 12, settled: float = 1e-3, balance: float | None = None, trust: np.ndarray | None = None) -> LabelModel:
    """From (votes array<int>, n long), the patterns of votes and how many documents have each: accuracies first, then correlations, then accuracies again with those.

    Most documents have the vote of silence alone. Unless `balance` fixes the share of the toxic class, that share can grow with each step
    until they are all toxic. `trust` has what a lone vote of each lexicon voter says to begin with.
    """

    def sums(model: LabelModel | None) -> np.ndarray:
        def fn(votes: list, count: list) -> np.ndarray:
            post = first_guess(votes, n, trust) if model is None else model.posterior(votes)
            m = moments(votes, count, post, n)
            return np.concatenate([m["n"], m["v"], m["pv"]])

        return vector(summed(patterns, fn), 3 + 2 * n)

    model, weight = None, np.ones(n)
    for phase in range(2):
        for _ in range(steps):
            s = sums(model)
            prior, rates = rates_of(s, n, balance)
            new = LabelModel(prior, rates, weight)
            still = model is not None and abs(new.prior - model.prior) < settled and float(np.abs(new.rates - model.rates).max()) < settled
            model = new
            if still:
                break
        if not phase:
            weight = weights_of(sums(model), vector(summed(patterns, lambda v, c: pairs(v, c, n)), n * n), n)
            if weight.min() > 1 - 1e-9:
                break
    return model


class Model:
    """Weights of terms, of voters, and a bias."""

    def __init__(self, voters: Voters, terms: dict[bytes, float], votes: np.ndarray, bias: float):
        self.voters, self.terms, self.by_vote, self.bias = voters, terms, votes.tolist(), bias
        self.scan = Scanner([*terms, *voters.of])

    def score(self, text: bytes) -> float:
        have = self.scan(text)
        raw = self.bias + sum(self.by_vote[v] for v in self.voters.votes(text, have)) + sum(self.terms.get(t, 0.0) for t in sorted(have))
        return float(sigmoid(np.array(raw)))


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, votes) of every row."""
    scan = Scanner(voters.of)
    return map_rows(docs.select("doc_id", utf8("text").alias("text")), lambda x: {"doc_id": x["doc_id"], "votes": [voters.votes(t, scan(t)) for t in x["text"]]}, "doc_id long, votes array<int>")


def posteriors(votes: DataFrame, model: LabelModel) -> DataFrame:
    """(doc_id, p) of (doc_id, votes)."""
    return map_rows(votes, lambda x: {"doc_id": x["doc_id"], "p": model.posterior(x["votes"]).tolist()}, "doc_id long, p double")


def fit(docs: DataFrame, labels: DataFrame, each: int = 4000, least: int = 5, screen: float = 3.0, l1: float = 0.02) -> Model:
    """Voters from at most `each` labelled documents of each label, the label model from all training documents, the classifier from at most `each` of either posterior class.

    The classifier's penalty is l1 over the root of its sample's size. Without toxic or without other training rows, or without a lexicon voter, every document scores under 0.5.
    """
    known = labelled(labels.where(held_out() == F.lit(False)), "toxic", each)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(held_out() == F.lit(False))
    by_id = lambda ids, col: cut(one_each(own.select("doc_id", utf8("text").alias("text")).join(F.broadcast(ids), "doc_id"), ["text", col]))
    said = labels.where(held_out() == F.lit(False)).agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.count("toxic").alias("n")).first()
    balance = ((said["a"] or 0) + 0.5) / (said["n"] + 1)
    voters = Voters(lexicon(by_id(known, "y").select("text", "y"), least, balance=balance))
    nothing = Model(voters, {}, np.zeros(voters.n), -5.0)
    if not voters.of:
        return nothing
    votes = cut(voted(own, voters))
    labels_of = label_model(cut(votes.groupBy("votes").agg(F.count("*").alias("n"))), voters.n, balance=balance, trust=voters.trust)
    post = posteriors(votes, labels_of)
    means = {r["y"]: r["p"] for r in post.join(F.broadcast(known), "doc_id").groupBy("y").agg(F.avg("p").alias("p")).collect()}
    if means.get(1, 1.0) < means.get(0, 0.0):  # labels tell which class is which
        post = post.withColumn("p", 1 - F.col("p"))
    post = cut(post.where("doc_id is not null").groupBy("doc_id").agg(F.max("p").alias("p")))
    shares = post.agg(F.avg((F.col("p") >= 0.5).cast("int")).alias("s")).first()["s"]
    side = lambda cond: post.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    sample = by_id(reduce(DataFrame.union, [side("p >= 0.5"), side("p < 0.5")]), "p").select("text", "p")
    vocabulary = [bytes(r["term"]) for r in weighed(sample.select("text", (F.col("p") >= 0.5).cast("int").alias("y")), least).where(F.abs("z") > screen).select("term").orderBy("term").collect()]
    place, scan = {t: voters.n + i for i, t in enumerate(vocabulary)}, Scanner([*vocabulary, *voters.of])

    def run(x: dict[str, list]) -> dict[str, list]:
        have = [(t, scan(t)) for t in x["text"]]
        return {"p": x["p"], "f": [np.array(sorted([*voters.votes(t, h), *(place[w] for w in h if w in place)]), "<i4").tobytes() for t, h in have]}

    got = sorted((bytes(r["f"]), r["p"]) for r in map_rows(sample, run, "p double, f binary").collect())  # at most 2 * each rows
    p = np.array([r[1] for r in got])
    n1, n0 = int((p >= 0.5).sum()), int((p < 0.5).sum())
    if not n1 or not n0:
        return nothing
    weight = np.where(p >= 0.5, shares / n1, (1 - shares) / n0)  # as frequent as among all documents
    w, b = logistic(Rows([np.frombuffer(f, "<i4") for f, _ in got]), p, voters.n + len(vocabulary), weight, l1=l1 / len(p) ** 0.5, l2=1e-6, steps=250)
    release()
    return Model(voters, {t: float(w[i]) for t, i in place.items() if w[i]}, w[: voters.n], b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have the vote of silence alone and score by it and the bias. Repeated rows score alike, a score of exactly 0.5
    is predicted 1, a text of any length is scored whole, and an empty table gives no rows. A null id counts as the empty text and is held
    out so. Other columns are not read.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        p = [model.score(t) for t in x["text"]]
        return {"doc_id": x["doc_id"], "held_out": x["held_out"], "score": p, "predicted": [int(s >= 0.5) for s in p]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8("text").alias("text"))
    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int")
