"""Checks of generated text against its evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import arithmetic_claims, digits, figures, groundable, sentences, squeeze, tokens

# The least share of a sentence's words that evidence must hold, the least score that passes, words of a sentence that counts.
OVERLAP, LEAST, WORDS = 0.18, 0.34, 4


def ungrounded(answers: DataFrame) -> DataFrame:
    """answers (id, answer, evidence) with figures (those that can be looked up) and ungrounded (those whose digits the evidence's digits don't hold; without evidence all)."""
    known = digits(F.coalesce("evidence", F.lit("")))
    found = F.filter(figures(F.coalesce("answer", F.lit(""))), groundable)
    return answers.withColumn("figures", found).withColumn("ungrounded", F.filter("figures", lambda t: ~known.contains(digits(t))))


def verdict(answers: DataFrame, overlap: float = OVERLAP, least: float = LEAST) -> DataFrame:
    """(id, n_sentences, n_ungrounded, n_unsupported, n_wrong, n_material, score, passed, reason).

    An empty answer fails, and so does one without evidence (null, or blank). A sentence of four words or more is unsupported if under
    `overlap` of its words are in the evidence and it has no marker; it is material if it holds a figure. A figure without ground, a
    wrong sum or a material sentence fails the answer; else the score decides.
    """
    bare = lambda s: F.trim(F.regexp_replace(s, r"\[\d+\]", ""))
    words = lambda s: tokens(bare(s))
    share = lambda s: F.size(F.filter(words(s), lambda w: F.array_contains("known", w)))
    loose = F.filter("parts", lambda s: (F.size(words(s)) >= WORDS) & (share(s) < overlap * F.size(words(s))) & ~s.rlike(r"\[\d+\]"))
    answer, evidence = F.coalesce("answer", F.lit("")), squeeze(F.coalesce("evidence", F.lit("")))
    r = ungrounded(answers).withColumn("known", F.array_distinct(tokens(evidence))).withColumn("parts", F.filter(F.transform(sentences(answer), F.trim), lambda s: F.length(s) > 0))
    r = r.withColumn("loose", F.transform(loose, lambda s: F.left(bare(s), F.lit(120))))
    missing = F.when(squeeze(answer) == "", "Empty answer.").when(evidence == "", "No evidence to support the answer.")
    r = r.select("id", F.size("parts").alias("n_sentences"), F.size("ungrounded").alias("n_ungrounded"), F.size("loose").alias("n_unsupported"), F.size(F.filter(arithmetic_claims(answer), lambda c: ~c["ok"])).alias("n_wrong"),
        F.size(F.filter("loose", lambda s: F.exists(figures(s), groundable))).alias("n_material"), missing.alias("missing"))
    score = F.greatest(F.lit(0.0), 1 - (F.col("n_unsupported") + F.col("n_wrong") + F.col("n_ungrounded")) / F.greatest(F.col("n_sentences"), F.lit(1)))
    r = r.withColumn("score", F.when(F.col("missing").isNotNull(), 0.0).otherwise(F.round(score, 3)))
    hard = (F.col("n_ungrounded") > 0) | (F.col("n_wrong") > 0) | (F.col("n_material") > 0)
    told = F.concat_ws("; ", F.when(F.col("n_ungrounded") > 0, F.concat("n_ungrounded", F.lit(" ungrounded figure(s)"))), F.when(F.col("n_unsupported") > 0, F.concat("n_unsupported", F.lit(" unsupported statement(s)"))))
    reason = F.coalesce("missing", F.when(told != "", told), F.lit("All claims grounded in cited evidence."))
    return r.withColumn("passed", F.col("missing").isNull() & ~hard & (F.col("score") >= least)).withColumn("reason", reason).drop("missing")


def grounded_before(answers: DataFrame, passages: DataFrame, overlap: float = OVERLAP, start: int = 3) -> DataFrame:
    """(key, at, figures, ungrounded, unsupported) of each of answers (key, at, text), against all passages (key, at, text) of its key before it.

    Counts distinct figures that can be looked up, those whose digits no earlier passage holds, and sentences (as in verdict()) too few of
    whose words earlier passages have. Nothing is gathered by key: figures meet passages by key and the first digits (as many as `start`, of
    each place in a passage's digits), words by key and word, where the word's first passage is known. A long history is so dealt among tasks.
    """
    text = F.coalesce("text", F.lit(""))
    said = answers.select("key", "at", text.alias("text"))
    figs = said.select("key", "at", F.explode(F.array_distinct(F.filter(figures(F.col("text")), groundable))).alias("figure")).withColumn("digits", digits(F.col("figure")))
    asked = figs.select("key", "at", "digits", F.left("digits", F.lit(start)).alias("gram")).distinct()
    strings = passages.select("key", F.col("at").alias("before"), digits(text).alias("held")).where("held <> ''")
    places = F.sequence(F.lit(1), F.length("held"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(start)), lambda n: F.col("held").substr(i, n)))))
    held = strings.select("key", "before", "held", F.explode(grams).alias("gram"))
    found = asked.join(held, ["key", "gram"]).where((F.col("before") < F.col("at")) & F.col("held").contains(F.col("digits"))).select("key", "at", "digits").distinct().withColumn("ok", F.lit(1))
    figured = figs.join(found, ["key", "at", "digits"], "left").groupBy("key", "at").agg(F.count("*").alias("figures"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("ungrounded"))
    bare = lambda s: F.trim(F.regexp_replace(s, r"\[\d+\]", ""))
    first = passages.select("key", "at", F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("key", "term").agg(F.min("at").alias("first"))
    parts = said.select("key", "at", F.posexplode(F.filter(F.transform(sentences(F.col("text")), F.trim), lambda s: (s != "") & ~s.rlike(r"\[\d+\]"))).alias("i", "s"))
    words = parts.select("key", "at", "i", F.explode(tokens(bare(F.col("s")))).alias("term"))
    known = words.join(first, ["key", "term"], "left").groupBy("key", "at", "i").agg(F.count("*").alias("n"), F.count(F.when(F.col("first") < F.col("at"), 1)).alias("known"))
    loose = known.where((F.col("n") >= WORDS) & (F.col("known") < overlap * F.col("n"))).groupBy("key", "at").agg(F.count("*").alias("unsupported"))
    out = said.select("key", "at").join(figured, ["key", "at"], "left").join(loose, ["key", "at"], "left")
    return out.na.fill(0, ["figures", "ungrounded", "unsupported"])


def around(text: Column, at: Column, n: Column, window: int) -> Column:
    """The n characters of a text from `at` (1 and up) with `window` on either side, and ellipses where the text goes on."""
    first, last = F.greatest(F.lit(1), at - window), F.least(F.length(text), at + n - 1 + window)
    return F.concat(F.when(first > 1, "…").otherwise(""), text.substr(first, last - first + 1), F.when(last < F.length(text), "…").otherwise(""))


def flags(texts: DataFrame, patterns: dict[str, str], window: int = 90) -> DataFrame:
    """(id, flag, snippet): the first match of each pattern in a text with single blanks, with `window` characters on either side. What has been matched is taken out for hits alone."""
    table = F.array(*[F.struct(F.lit(k).alias("flag"), F.regexp_instr("flat", F.lit(p)).alias("at")) for k, p in patterns.items()])
    hit = texts.select("id", squeeze(F.col("text")).alias("flat")).select("id", "flat", F.inline(table)).where("at > 0")
    found = F.coalesce(*[F.when(F.col("flag") == k, F.length(F.regexp_extract("flat", p, 0))) for k, p in patterns.items()])
    return hit.select("id", "flag", around(F.col("flat"), F.col("at"), found, window).alias("snippet"))


def evaluated(rows: DataFrame, column: str = "expression") -> DataFrame:
    """rows with value (null for what is no arithmetic) and ok; Arrow batches of expressions, each parsed and never run as code."""

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else safe_eval(x) for x in s], dtype="Float64").astype("float64")

    return rows.withColumn("value", F.nullif(value(F.col(column)), F.lit(float("nan")))).withColumn("ok", F.col("value").isNotNull())


def safe_eval(expression: str) -> float | None:
    """Value of an arithmetic expression of numbers, + - * / ** % and signs; None for anything else, and for powers past 64 or 1e6."""
    import ast
    import operator

    two = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod}

    def value(node: ast.AST) -> float:
        match node:
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                return node.value
            case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=x):
                return -value(x) if isinstance(node.op, ast.USub) else value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in two:
                a, b = value(a), value(b)
                if isinstance(op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
                    raise ValueError("too large")
                return two[type(op)](a, b)
        raise ValueError("not arithmetic")

    try:
        out = float(value(ast.parse(expression.strip(), mode="eval").body))
    except (ValueError, SyntaxError, TypeError, ZeroDivisionError, OverflowError):
        return None
    return out
