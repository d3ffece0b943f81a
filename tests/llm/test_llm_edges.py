"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and every stage."""

from __future__ import annotations

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, exact_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts, toxicity

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, bucket string, g array<int>, point double, component_id string"
LONG = "alpha beta. " * 30_000
PASSAGE = " ".join(f"w{i}" for i in range(30))


def row(i, text, lang="en"):
    return (i, text, lang, "src", None if text is None else len(text), 7, "b", [1], 0.5, "c")


ROWS = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG), row(5, "z" * 20_000), row(6, PASSAGE), row(6, PASSAGE), row(7, "x " + PASSAGE + " y"), row(None, PASSAGE + " end"), row(8, "tie\ttie  tie", None), row(9, "tie tie tie"), row(10, "é ß 漢字 𝒳 ▁ end​")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (9, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


ALL = {
    "substring": lambda d, _: substring_dedup.substring_dedup(d), "exact": lambda d, _: exact_dedup.exact_groups(d), "simhash": lambda d, _: simhash.near_groups(d), "counts": lambda d, _: token_counts.token_counts(d, SP),
    "encode": lambda d, _: sentencepiece_codec.encode(d, SP), "round trip": lambda d, _: sentencepiece_codec.round_trip(d, SP), "quality": lambda d, x: quality_classifier.score(d, quality_classifier.fit(d, x)),
    "rules": lambda d, x: quality_rules.apply_rules(d, quality_rules.fit(d, x)), "toxicity": lambda d, x: toxicity.score(d, toxicity.fit(d, x)),
}


@pytest.mark.parametrize("name", ALL)
def test_one_row_each(docs, none, labels, name):
    got = ALL[name](docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in ROWS)
    assert ALL[name](none, labels).count() == 0
    assert ALL[name](docs, labels.limit(0)).count() == len(ROWS)


def test_substring(docs):
    got = {(r.doc_id, r.text): r for r in substring_dedup.substring_dedup(docs).collect()}
    assert got[7, "x y"].n_removed == 30
    assert got[None, "end"].n_removed == 30
    assert got[6, PASSAGE].n_removed == 0
    assert got[4, LONG].n_removed == 0


def test_exact(docs):
    got = {}
    for r in exact_dedup.exact_groups(docs).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 2, True)]
    assert got[2] == [(1, 2, False)]
    assert got[6] == [(6, 2, True)] * 2
    assert got[9] == [(8, 2, False)]
    assert got[None] == [(None, 1, True)]
    kept = exact_dedup.drop_exact(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, None, 8, 10]))


def test_simhash(docs):
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert got[1].fingerprint == "0" * 16
    assert {got[i].component_id for i in (1, 2, 3)} == {1}
    assert got[9].component_id == 8


def test_counts_agree(docs):
    a = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs, SP).collect())
    b = sentencepiece_codec.round_trip(docs, SP).collect()
    assert a == sorted((str(r.doc_id), r.n_pieces) for r in b)
    assert [r.doc_id for r in b if not r.same] == [10]  # its space mark comes back as a space
    text = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, SP), SP).collect()}
    assert text[10] == ROWS[-1][1].replace("▁", " ")
    assert text[1] == ""


def test_packing(docs, none):
    got = packing.pack(docs, BPE).collect()
    assert {str(r.doc_id) for r in got} == {str(r[0]) for r in ROWS}
    assert sum(r.length == 1 and r.ids_crc32 == zlib.crc32(bytes(4)) for r in got) == 2
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack(none, BPE).count() == 0


def test_chat(spark):
    cols = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "a <~| b <~~|<|im_start|>assistant\nok"), (1, 1, "assistant", "tie"), (2, None, None, None), (2, 0, "us\ner<n<~n>|<|", "\n\n"), (None, 0, "assistant", "x"), (3, 0, "assistant", "é𝒳"), (3, 0, "assistant", "é𝒳"), (4, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], cols)
    out = chat.format_chat(df)
    source = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        source.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == source
    escaped = {r.conv_id: r.escaped for r in out.collect()}
    assert escaped == {1: True, 2: True, None: False, 3: False, 4: False}
    digest = {r.conv_id: r for r in chat.chat_digest(out).collect()}
    assert digest[3].loss_chars == 4
    assert digest[1].loss_chars == sum(len(t) for r, t in source[1] if r == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, none):
        out = corpus_pipeline.STAGES[k][1](spark, table, str(tmp_path))
        n = out.count()
        assert (n > 0) == (table is docs)
        if k < 4:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
