"""The operators' queries over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, exact_dedup, maxscore, merkle, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, spelling, substring_dedup, token_counts, toxicity
from quarry.llm.common import table


def tokenizer(name: str) -> str:
    """Where the public tokenizers' files are on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), words=13)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(chat.format_chat(rows.union(extra)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = merkle.leaf(*[spelling.lowered(F.col(c)) if c == "text" else F.col(c) for c in docs.columns])
    out = merkle.manifest(docs, docs.columns, keep={"tampered": F.when(changed, tampered)})
    folded = merkle.verify(F.coalesce("tampered", "leaf"), F.col("at"), F.col("others"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("others", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Of a list of numbers the crc32 of these bytes, in DuckDB's SQL: a byte is mixed in, -1 shifts one bit out.
CRC32 = "xor(4294967295, list_reduce([4294967295] || flatten(list_transform({}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
#: The UTF-8 bytes of a text of code points up to U+00FF.
BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN ascii(c) < 128 THEN [ascii(c)::BIGINT] WHEN ascii(c) < 192 THEN [194, ascii(c)::BIGINT] ELSE [195, ascii(c)::BIGINT - 64] END))"


def merkle_sql(levels: int = 8) -> str:
    """op13's rows in SQL: a list of nodes at each of `levels` levels of the languages' trees and of the tree of subroots, enough for 8^levels nodes."""
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
  CASE WHEN {CRC32.format(BYTES.format("doc_id::VARCHAR"))} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf("text")} END AS mine FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node, * EXCLUDE (g) FROM d)"""]  # fmt: skip

    def tree(name: str) -> None:
        for k in range(levels):
            out.append(f"{name}runs{k} AS (SELECT g, i // 8 AS i, list(node ORDER BY i) AS nodes, any_value(n) AS n FROM (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, i // 8)")
            out.append(f"{name}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}runs{k})")

    def fold(name: str, first: str) -> str:
        last = first
        for k in range(levels):
            at = f"(f.i // {8**k}) % 8 + 1"
            own = f"array_to_string(nodes[:{at} - 1], '')", f"array_to_string(nodes[{at} + 1:], '')"
            out.append(f"""{name}f{k} AS (SELECT f.* EXCLUDE (proof, mine), CASE WHEN n = 1 THEN proof ELSE proof || {own[0]} || {own[1]} END AS proof,
  CASE WHEN n = 1 THEN mine ELSE sha256({own[0]} || mine || {own[1]}) END AS mine FROM {last} f JOIN {name}runs{k} r ON f.g = r.g AND f.i // {8 ** (k + 1)} = r.i)""")
            last = f"{name}f{k}"
        return last

    tree("a")
    out.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, node, g AS lang FROM a{levels})")
    tree("b")
    out.append("start AS (SELECT doc_id, g, i, leaf, mine, '' AS proof FROM a0)")
    lowest = fold("a", "start")
    out.append(f"half AS (SELECT f.doc_id, f.leaf, b0.node AS subroot, f.proof, f.mine, b0.g, b0.i FROM {lowest} f JOIN b0 ON f.g = b0.lang)")
    highest = fold("b", "half")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256, mine AS folded_root, mine = b{levels}.node AS verified FROM {highest} f JOIN b{levels} ON true"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, CASE WHEN count(*) OVER f = 13 THEN string_agg(w, ' ') OVER f END AS win FROM p
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS first_doc FROM g WHERE win IS NOT NULL GROUP BY win),
s AS (SELECT g.doc_id, g.i, g.w, coalesce(m.first_doc < g.doc_id, false) AS hit FROM g LEFT JOIN m ON g.win = m.win),
c AS (SELECT doc_id, i, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM s),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)""",
        "op2_chat_formatting": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, bool_or(regexp_matches(text, '<~+\||<\|im_(start|end)\|>')) OVER (PARTITION BY conv_id) AS escaped FROM r),
f AS (SELECT *, CASE WHEN escaped THEN length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g')) ELSE length(text) END AS len FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + len + 11)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
        "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
            "op11_spelling_variants": rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS said, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, times, {CRC32.format(BYTES.format("said"))} AS h FROM each),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(low := -near_n, near := near)) AS b FROM pairs GROUP BY word),
told AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.low >= 2 * v.n THEN b.near END AS form, CASE WHEN -b.low >= 2 * v.n THEN -b.low END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS further FROM told UNION ALL SELECT w.word, w.further, t.form FROM walk w JOIN told t ON w.further = t.word)
SELECT t.word, t.n, t.n_near, t.form, t.form_n, w.root FROM told t JOIN walk w ON w.word = t.word AND w.further IS NULL""",
        "op12_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM v q, v e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
        "op13_merkle_manifest": merkle_sql(),
    }
