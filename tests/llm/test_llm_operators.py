"""Operators against brute force, other libraries, held-out labels or SQL."""

from __future__ import annotations

import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import exact_dedup, lexicon, packing, queries, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts, toxicity
from quarry.llm.common import components
from quarry.llm.learn import auc

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
SP = public_tokenizers.path("piece_bpe_32k.model")


def rows(got):
    return sorted(tuple(map(str, r)) for r in got)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_substring_levels():
    assert substring_dedup.lengths(13) == [7, 13]
    assert substring_dedup.lengths(50) == [7, 13, 25, 50]
    assert substring_dedup.lengths(5) == [5]
    for n in range(1, 400):
        got = substring_dedup.lengths(n)
        assert got[-1] == n and all(a < b <= 2 * a for a, b in zip(got, got[1:], strict=False))


def test_substring_no_candidates(spark):
    """Nothing of 50 words repeats, and no shorter length does from the second level on."""
    docs = [(i, " ".join(f"{i}x{k // 9 if k % 2 else k}" for k in range(120))) for i in range(30)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 50, group_mb=0.001)
    assert {(r.doc_id, r.text, r.n_removed) for r in out.collect()} == {(i, t, 0) for i, t in docs}


@pytest.mark.parametrize("words", [1, 2, 5, 13, 50])
def test_substring_brute(spark, words):
    rng = random.Random(words)
    passages = [" ".join(rng.choices("a b c d".split(), k=rng.randint(words // 2, words * 3))) for _ in range(12)]
    docs = [(i, " ".join([*rng.choices("a b c d".split(), k=rng.randint(0, 40)), *rng.choices(passages, k=i % 3)])) for i in range(60)]
    first: dict = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - words + 1):
            first.setdefault(tuple(w[k : k + words]), i)
    want = {}
    for i, t in docs:
        w, gone = t.split(), set()
        for k in range(len(w) - words + 1):
            if first[tuple(w[k : k + words])] < i:
                gone |= set(range(k, k + words))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(n for _, n, _ in want.values())
    out = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), words, group_mb=0.002)
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join(r.text.split())) for r in out.collect()} == want


def test_substring_ranges_are_linear():
    """However many ranges there are, a group's rows are at most its keys, and its answers find their keys again."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype="u8"))
    for buckets in (1, 24, 10**9):
        table = substring_dedup.packed(3, [keys], np.zeros(len(keys), "u1"), buckets)
        assert table.num_rows <= min(buckets, len(keys))
        assert sum(len(x) for x in table["ids"].to_pylist()) == 8 * len(keys)
        want = np.random.default_rng(2).random(len(keys)) < 0.5
        bits = [np.packbits(want[np.searchsorted(keys, np.frombuffer(x, "u8"))]).tobytes() for x in table["ids"].to_pylist()]
        answers = substring_dedup.table_of("answers", table["g"].to_pylist(), table["bucket"].to_pylist(), bits)
        answers = answers.append_column("level", [[0] * answers.num_rows]).take(list(range(answers.num_rows))[::-1])
        assert (substring_dedup.unpacked(answers, 0, keys, buckets) == want).all()


def test_substring_keeps_columns(spark):
    """Microseconds, maps, binaries, decimals, large longs beside nulls and nested values come through the stage as they were."""
    import datetime
    import decimal

    text = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"{text} {i}", datetime.datetime(2024, 1, 1, 0, 0, 0, 123456), {1: "x", 2: None}, b"\x00\xff", decimal.Decimal("1.23"), [1, None], None if i else 2**60 + 1, (1, "z"), "c", None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ts timestamp, m map<int,string>, b binary, d decimal(10,2), a array<int>, big long, st struct<p:int,q:string>, c0 string, n_chars int")
    df = df.withColumn("ntz", df.ts.cast("timestamp_ntz"))
    out = substring_dedup.drop_repeats(df)
    assert out.schema == df.schema
    rest = [c for c in df.columns if c not in ("text", "n_chars")]
    assert sorted(map(str, out.select(*rest).collect())) == sorted(map(str, df.select(*rest).collect()))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: (rows[0][1], None)} | {i: (str(i), 1) for i in range(1, 4)}


def test_exact_tells_equal_addresses_apart(spark, monkeypatch):
    """With one address for all chunks, digests alone keep them apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a. " * 400), (5, "a. " * 401)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def brute_components(points):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(points)):
        for b in range(a):
            if ((points[a] ^ points[b]) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize(("shard", "large"), [(20, 10_000), (20, 60), (10_000, 10_000), (10_000, 100)])
def test_simhash_brute(spark, shard, large):
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(150)}
    for p in list(points)[:60]:
        points |= {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(6)}
    points = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    df = spark.createDataFrame([(p,) for p in points], "point long")
    got = {r.node: r.component for r in components(simhash.links(simhash.shards(df, len(points), shard, large))).collect()}
    roots = brute_components(points)
    size = collections.Counter(roots)
    assert got == {p: points[r] for p, r in zip(points, roots, strict=True) if size[r] > 1}


def test_simhash_blocks(spark):
    """Points that no vantage point can part go in pairs of blocks; none of these is large, and all pairs meet."""
    tight = [(1 << a) | (1 << b) for a in range(20) for b in range(a)]
    got = simhash.shards(spark.createDataFrame([(p,) for p in tight], "point long"), len(tight), 1000, 40)
    by_shard = collections.defaultdict(set)
    for r in got.collect():
        by_shard[r.shard].add(r.point)
    assert max(map(len, by_shard.values())) <= 80
    met = {(p, q) for points in by_shard.values() for p in points for q in points}
    assert met >= {(p, q) for p in tight for q in tight if (p ^ q).bit_count() <= 3}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()

    def fingerprint(text):
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    points = [fingerprint(r.text) for r in docs]
    want = {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, points, brute_components(points), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_near_dedup(spark, SF).collect()} == want


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1100)]
    parent = {x: x for p in pairs for x in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: find(x) for x in linked}


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram model over the same pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(SP, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    lowest = min(p.score for p in model.pieces if p.score > lexicon.NEVER)
    for p in model.pieces:
        if p.score <= lexicon.NEVER:
            p.type, p.score = (p.type, lowest) if p.piece == lexicon.MARK else (5, p.score)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_sentencepiece(spark, unigram):
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in lexicon.chunks(r.text)} | {"é\n\nfoo", "a𝒳b", "ßßé%%%", "aaaaaaaaaaaa", "", "漢字"}
    words = sorted(w for w in words if len(w) < 60)
    codec, counter = sentencepiece_codec.codec(SP), token_counts.counter(SP)
    got = [x.tolist() for x in codec.encode(words)]
    assert [unigram.encode(w) for w in words] == got
    assert [counter[w][0] for w in words if w] == [len(x) for w, x in zip(words, got, strict=True) if w]


def test_whole_texts(spark, unigram):
    """Whole documents against the library: ids, counts and scores. The library adds 32-bit scores over a whole text, so texts where that decides are left to the exact arithmetic here, and must be few."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["é\n\nfoo a𝒳b", "ßßé%%% aaaaaaaaaaaa", "漢字 漢字"]
    codec, counter = sentencepiece_codec.codec(SP), token_counts.counter(SP)
    got = [x.tolist() for x in codec.encode(texts)]
    want = [unigram.encode(t) for t in texts]
    same = [a == b for a, b in zip(got, want, strict=True)]
    assert sum(same) > 0.97 * len(texts)
    scores = {i: s for p, (i, s) in codec.lexicon.pieces.items()}
    for text, ids, lib, ok in zip(texts, got, want, same, strict=True):
        counts = [counter[c] for c in lexicon.chunks(text)]
        assert sum(n for n, _ in counts) == len(ids)
        if all(i in scores for i in ids):  # no byte pieces
            assert sum(s for _, s in counts) == pytest.approx(sum(scores[i] for i in ids), abs=1e-6)
            if not ok and all(i in scores for i in lib):
                assert sum(scores[i] for i in ids) >= sum(scores[i] for i in lib) - 1e-4


def test_collision_goes_on(spark, monkeypatch):
    """With a hash that many substrings share, results are the same."""
    words = ["hello", "worlds", "ouen", "the", "é漢", "thtion", "aaaa"]
    want = [x.tolist() for x in sentencepiece_codec.Codec(lexicon.load(SP)).encode(words)]
    codec = sentencepiece_codec.Codec(lexicon.load(SP))
    monkeypatch.setattr(codec, "spelt", lambda ids: b"never")
    assert [x.tolist() for x in codec.encode(words)] == want


def test_tokens(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "  a\n\n b'll don't 12,3 \t​ 漢字🙂", "a" * 5000, "1 " * 500, "hi <|endoftext|> there", "<|endoftext|><|endoftext|>\n<|endoftext"]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        coder = packing.encoding(public_tokenizers.path(name))
        plain = [t for t in texts if name.endswith(".json") or "<|endoftext|>" not in t]  # the other file has no special tokens
        assert [coder.encode_to_numpy(t, allowed_special="all").tolist() for t in plain] == [own.encode(t, add_special_tokens=False).ids for t in plain]


@pytest.mark.parametrize("seed", range(6))
def test_pack_plan(seed):
    rng = np.random.default_rng(seed)
    size = 128
    counts = np.bincount(np.clip(rng.lognormal(3, 1.2, 20_000 if seed < 4 else 7).astype(int) + 1, 1, size), minlength=size + 1)
    plan, by_pattern = packing.pack_plan(counts, size)
    used = np.zeros(size + 1, int)
    for lengths, n in plan:
        assert sum(lengths) <= size
        assert n > 0
        for v in lengths:
            used[v] += n
    assert (used == counts).all()
    bound = -(-int((counts * np.arange(size + 1)).sum()) // size)
    assert sum(n for _, n in plan) <= max(bound * 1.02, bound + 2, counts[size // 2 + 1 :].sum() * 1.02)
    assert all(sum(lengths) == size for lengths, _ in plan[:by_pattern])


def test_most_pieces_go_by_patterns(spark):
    """On whole tables over half of the pieces that are shorter than a sequence have their place by a pattern, and there are hardly more sequences than tokens need."""
    for folder in (BIG, LARGE):
        rows = packing.tokenised(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).groupBy("length").count().collect()
        counts = np.zeros(packing.SEQUENCE + 1, "i8")
        for length, n in rows:
            counts[length] = n
        plan, by_pattern = packing.pack_plan(counts)
        placed = sum(len(lengths) * n for lengths, n in plan[:by_pattern] if len(lengths) > 1)
        assert placed > 0.5 * counts[: packing.SEQUENCE].sum()
        bound = -(-int((counts * np.arange(packing.SEQUENCE + 1)).sum()) // packing.SEQUENCE)
        assert sum(n for _, n in plan) <= bound * 1.005 + 1


def test_packing_query(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*own.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op9_best_fit_packing(spark, SF).collect():
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == ids.keys()
    for i, pieces in docs.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at)
            assert crc == zlib.crc32(ids[i][at : at + length].tobytes())
            assert k == 0 or length == 2048
            at += length
        assert at == len(ids[i])
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_base_counts():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b", "é", "#", "|", " ", "\n", "\t", "\n\n", "a b ", "𝒳"], k=rng.randint(0, 60)))
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert quality_rules.base_counts(text.encode()) == want


def test_viterbi_brute():
    from itertools import product

    rng = np.random.default_rng(0)
    field = quality_rules.Field(rng.normal(size=quality_rules.FEATURES), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        bits = rng.integers(0, 1 << quality_rules.FEATURES, n).astype("i4")
        score = quality_rules.expand(bits) @ field.w
        total = lambda p: sum(s for s, k in zip(score, p, strict=True) if k) + sum(field.t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(field.decode(bits).astype(int)) == max(product((0, 1), repeat=n), key=total)


def labels(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}


def test_one_each(spark):
    """A sample by ids stays as large as its ids however often each is repeated, and doesn't depend on the order of rows."""
    from quarry.llm.common import one_each

    rows = [(i % 7, f"text {i % 21}", i % 2) for i in range(400)]
    got = [sorted(map(tuple, one_each(spark.createDataFrame(r, "doc_id long, text string, y int"), ["text", "y"]).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1]
    assert [r[0] for r in got[0]] == list(range(7))


def test_quality(spark):
    """Documents whose label is not shown to it are scored as their label says; the two views see different columns."""
    labels_ = spark.read.parquet(f"{LARGE}/labels.parquet")
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality_classifier.fit(docs, labels_.where(~hidden))
    known = {r.doc_id: r.quality for r in labels_.where(hidden).collect()}
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    y, score = np.array([(k, got[i].score) for i, k in known.items()]).T
    assert auc(y, score) > 0.98
    assert (score[y == 1] >= 0.5).mean() > 0.99
    assert (score[y == 0] < 0.5).mean() > 0.9
    other = {r.doc_id: r.metadata_score for r in quality_classifier.score(docs.withColumn("text", F.lit("x")), model).collect()}
    assert all(other[i] == r.metadata_score for i, r in got.items())


def test_quality_teaches_from_all(spark):
    """The surest of all unlabelled documents teach, wherever they stand; labelled ones never do."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    known = spark.read.parquet(f"{BIG}/labels.parquet")
    model = quality_classifier.fit(docs, known, rounds=0)
    model.scales[:] = [[1, 0], [1, 0]]
    got = [r for r in quality_classifier.sure(docs, known, model, 20, 0.5, 0.5).collect() if r.y & 2]  # what the first view is sure of
    seen = labels(spark, "quality")
    read = docs.select(*quality_classifier.fields(docs)).collect()
    scores = model.raw({c: [r[c] for r in read] for c in quality_classifier.FIELDS})[:, 0]
    raw = {r["doc_id"]: v for r, v in zip(read, scores, strict=True) if r["doc_id"] not in seen}
    best = sorted(raw.values())
    assert {r.doc_id for r in got} <= raw.keys()
    assert sorted(raw[r.doc_id] for r in got if r.y & 1) == pytest.approx(best[-5:])


def test_rules(spark):
    known = labels(spark, "quality")
    got = collections.Counter((known[r.doc_id], r.kept) for r in queries.op8_quality_rules(spark, BIG).collect() if r.doc_id in known and not r.base_failed)
    assert got[1, True] > 0.98 * (got[1, True] + got[1, False])
    assert got[0, False] > 0.7 * (got[0, True] + got[0, False])


def test_rules_kept_brute(spark):
    """kept and content_share of every document against a plain Viterbi over its lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in quality_rules.apply_rules(docs, field).collect():
        bits, sizes = quality_rules.line_features(texts[r.doc_id])
        best = {0: (0.0, [0]), 1: (float(quality_rules.expand(bits[:1])[0] @ field.w), [1])} if len(bits) else None
        for b in bits[1:]:
            s = float(quality_rules.expand(np.array([b]))[0] @ field.w)
            best = {k: max(((v + field.t[p, k] + s * k, [*path, k]) for p, (v, path) in best.items()), key=lambda x: x[0]) for k in (0, 1)}
        path = max(best.values(), key=lambda x: x[0])[1] if best else []
        share = sum(n for n, k in zip(sizes, path, strict=True) if not k) / sizes.sum() if len(sizes) else 1.0
        assert r.content_share == pytest.approx(share)
        assert r.kept == (not r.base_failed and share >= 0.5)


def test_rules_long_document(spark):
    """A document of very many lines is trained on in stretches."""
    many = "\n".join(f"line {i} of a text that goes on." for i in range(20_000))
    junk = "\n".join(f"| a | b{i} | c |" for i in range(300))
    docs = spark.createDataFrame([(1, many), (2, junk), (3, many[:5000])], "doc_id long, text string")
    assert max(len(b) for b in quality_rules.stretches(quality_rules.line_features(many.encode())[0])) == 4 * quality_rules.LINES
    field = quality_rules.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"), each=40)
    got = {r.doc_id: r.content_share for r in quality_rules.apply_rules(docs, field).collect()}
    assert got[1] > 0.9 > 0.1 > got[2]


def brute_label_model(votes, n, steps=12, settled=1e-3):
    """The label model with a row for each document and dense matrices."""
    m = np.zeros((len(votes), n))
    for i, v in enumerate(votes):
        m[i, v] = 1
    lexical = m[:, : n - toxicity.PATTERNS - 1].sum(axis=1)
    post, weight, rates, prior = np.where(lexical == 0, 0.02, np.where(lexical == 1, 0.3, 0.95)), np.ones(n), None, None
    for phase in range(2):
        for _ in range(steps):
            new = np.stack([((m * p[:, None]).sum(axis=0) + 0.1) / (p.sum() + 1) for p in (post, 1 - post)])
            now = float(np.clip(post.mean(), 0.001, 0.999))
            still = rates is not None and abs(now - prior) < settled and np.abs(new - rates).max() < settled
            rates, prior = new, now
            post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + m @ (weight * np.log(rates[0] / rates[1])), -40, 40)))
            if still:
                break
        if not phase:
            r = np.stack([((m * p[:, None]).sum(axis=0) + 0.1) / (p.sum() + 1) for p in (post, 1 - post)])
            apart = m - post[:, None] * r[0] - (1 - post)[:, None] * r[1]
            cov = apart.T @ apart / len(m)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            ties = cov / spread / spread[:, None]
            np.fill_diagonal(ties, 0)
            ties[-1, :] = ties[:, -1] = 0  # silence is the absence of the others
            weight = 1 / (1 + np.where(ties > 0.5, ties, 0).sum(axis=0))
            if weight.min() > 1 - 1e-9:
                break
    return prior, rates, weight


def test_label_model_brute(spark):
    """Sums over patterns in tasks give what dense matrices over documents do; twin voters count less, and the classes come apart without any label."""
    rng = np.random.default_rng(4)
    n, truth, votes = 4 + toxicity.PATTERNS + 1, rng.random(3000) < 0.2, []
    for t in truth:
        v = [k for k in range(3) if rng.random() < (0.6 if t else 0.01)]
        if 2 in v and rng.random() < 0.95:
            v.append(3)  # a twin of voter 2
        v += [n - 2] if rng.random() < 0.1 else []
        votes.append(sorted(v) + ([] if any(k < 4 for k in v) else [n - 1]))
    table = spark.createDataFrame([(v,) for v in votes], "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))
    model = toxicity.label_model(table, n)
    prior, rates, weight = brute_label_model(votes, n)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    assert np.allclose(model.rates, rates, atol=1e-6)
    assert np.allclose(model.weight, weight, atol=1e-6)
    assert weight[2] < 0.7 and weight[3] < 0.7 and weight[0] == 1
    post = model.posterior(votes)
    assert auc(truth.astype(int), post) > 0.95
    assert abs(model.rates[0][0] - 0.6) < 0.1


def test_discovered_brute(spark):
    """Benjamini and Hochberg's rule over all strengths, to the hundredth; nothing where nothing is to be found."""
    from statistics import NormalDist

    rng = random.Random(6)
    for told in (0, 3, 60):
        z = [rng.gauss(0, 1) for _ in range(5000)] + [rng.uniform(3.5, 9) for _ in range(told)]
        p = sorted(1 - NormalDist().cdf(x) for x in z)
        good = [k for k, x in enumerate(p, 1) if x <= 0.01 * k / len(p)]
        got = toxicity.discovered(spark.createDataFrame([(x,) for x in z], "z double"), 0.01)
        if not good:
            assert got == float("inf")
            continue
        want = NormalDist().inv_cdf(1 - p[good[-1] - 1])
        assert want - 0.011 <= got <= want + 0.1
        assert sum(x >= got for x in z) >= told * 0.8


def test_label_model_balance(spark):
    """Nine tenths of the documents are silent: with the share of the class known they stay out of it, and a voter that never votes beside another goes by its trust."""
    n, rng = 6 + toxicity.PATTERNS + 1, np.random.default_rng(8)
    votes = []
    for t in rng.random(4000) < 0.1:
        v = [k for k in range(5) if rng.random() < (0.4 if t else 0.002)] or ([5] if t and rng.random() < 0.5 else [])
        votes.append(v or [n - 1])
    table = spark.createDataFrame([(v,) for v in votes], "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))
    trust = np.array([0.95] * 5 + [0.9])
    model = toxicity.label_model(table, n, balance=0.1, trust=trust)
    lone, silent = model.posterior([[5], [n - 1]])
    assert model.prior == 0.1
    assert silent < 0.05
    assert lone > 0.5


def test_lexicon_trust(spark):
    """Terms with the share of toxic texts among those that have them; a term that is wrong more often than right is no voter, however significant."""
    own = ["".join(x) for x in itertools.product("abcdefghij", repeat=3)]  # words of one text each, or of two
    rows = [(f"{'foul' if i < 30 else 'mixed'} {own[i]}", 1) for i in range(60)] + [(f"{'mixed' if i < 100 else 'fine'} {own[i]}", 0) for i in range(800)]
    sample = spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, y int")
    got = toxicity.lexicon(sample)
    assert list(got) == [b"foul"]
    balance = 60.5 / 861
    toxic, clean = balance * 30.5 / 61, (1 - balance) * 0.5 / 801
    assert got[b"foul"] == pytest.approx(toxic / (toxic + clean))


def test_scanner():
    """The remembering scanner finds what terms_of() does."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["idiot", "Idiots", "loweiß", "LOWEI", "path", "pathetic!!", "a", "éé", "idio"], k=rng.randint(0, 12))).encode() for _ in range(300)]
    vocabulary = rng.sample(sorted(set().union(*map(toxicity.terms_of, texts))), 20)
    scan = toxicity.Scanner(vocabulary)
    assert [scan(t) for t in texts] == [toxicity.terms_of(t) & set(vocabulary) for t in texts]


def test_toxicity_held_out(spark):
    """Labels that were never read, and posteriors that aren't the labels."""
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, LARGE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    y, score, said = np.array([(known[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in known]).T
    assert auc(y, score) > 0.94
    assert said[y == 1].mean() > 0.88
    assert said[y == 0].mean() < 0.02
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    labels_ = spark.read.parquet(f"{LARGE}/labels.parquet").where(~toxicity.held_out())
    voters = toxicity.Voters(toxicity.lexicon(docs.join(labels_, "doc_id").select(F.col("text").cast("binary").alias("text"), F.col("toxic").alias("y"))))
    votes = toxicity.voted(docs.where(~toxicity.held_out()), voters).cache()
    model = toxicity.label_model(votes.groupBy("votes").agg(F.count("*").alias("n")), voters.n)
    post = {r.doc_id: r.p for r in toxicity.posteriors(votes, model).collect()}
    votes.unpersist()
    apart = [i for i, k in known.items() if i in post and (post[i] >= 0.5) != (k == 1)]
    assert len(apart) > 10  # labels are no voter: where votes and labels disagree, the posterior goes with the votes
    assert len(post) > 2 * len([i for i in known if i in post])  # and most documents that have one have no label


def test_pipeline(spark):
    """Stage by stage, from what it kept, against plain Python; the classifier against its labels."""
    import tempfile

    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    known, kept = labels(spark, "quality"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        folder = tempfile.mkdtemp() + "/out"
        stage(spark, docs, BIG).write.parquet(folder)
        docs = spark.read.parquet(folder)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good = kept["quality classifier"]
    assert sum(i in good for i, q in known.items() if q) > 0.97 * sum(known.values())
    first: dict = {}
    for i, r in sorted(good.items()):
        first.setdefault(" ".join(r.text.split()), i)
    assert set(kept["exact dedup"]) == set(first.values())
    assert set(kept["substring dedup"]) == set(kept["near-dedup"])
    seen: set = set()
    for _, r in sorted(kept["substring dedup"].items()):
        w = r.text.split()
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not own & seen
        seen |= own
    assert all(r.n_chars == len(r.text) for r in kept["substring dedup"].values())
