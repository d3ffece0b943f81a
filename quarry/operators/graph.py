"""The company-topic graph as edges, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.questions import grams


def topic_edges(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """One edge (ticker, topic, chunk_id) for each chunk that holds a phrase of a topic, in lower case with single blanks; phrases (topic, phrase) are a stated dictionary, gathered into one row."""
    table = phrases.groupBy("topic").agg(F.collect_set("phrase").alias("ps")).groupBy().agg(F.collect_list(F.struct("topic", "ps")).alias("table"))
    low = chunks.select("chunk_id", "ticker", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("low")).crossJoin(F.broadcast(table))
    hit = F.filter("table", lambda t: F.exists(t["ps"], lambda p: F.col("low").contains(p)))
    return low.select("ticker", F.explode(F.transform(hit, lambda t: t["topic"])).alias("topic"), "chunk_id")


def popularity(edges: DataFrame) -> DataFrame:
    return edges.groupBy("topic").agg(F.countDistinct("ticker").alias("companies"))


def matrix(edges: DataFrame, topics: list[str]) -> DataFrame:
    """Companies by topics, 0 or 1."""
    return edges.groupBy("ticker").pivot("topic", topics).agg(F.lit(1)).na.fill(0, topics)


def shared(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Topics of both companies."""
    own = lambda t: edges.where(F.col("ticker") == t).select("topic")
    return own(a).intersect(own(b))


def overlap(edges: DataFrame, holdings: list[str], least: int = 2) -> DataFrame:
    """(topic, n, share, tickers) of topics that `least` holdings or more share."""
    own = edges.where(F.col("ticker").isin(holdings)).groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"), F.countDistinct("ticker").alias("n"))
    return own.where(F.col("n") >= least).select("topic", "n", F.round(F.col("n") / len(holdings), 2).alias("share"), "tickers")


def topic_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(topic, change): new, removed or, with more mentions than before, escalated; from (topic, mentions) of two periods."""
    both = old.withColumnRenamed("mentions", "before").join(new.withColumnRenamed("mentions", "after"), "topic", "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "escalated")
    return both.select("topic", change.alias("change")).where("change is not null")


def query_topics(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, topic) of the topics whose name or phrases a question holds."""
    low = questions.select("qid", F.lower("question").alias("low"))
    names = phrases.select("topic", F.lower("topic").alias("phrase")).union(phrases.select("topic", "phrase")).distinct()
    table = names.groupBy().agg(F.collect_list(F.struct("topic", "phrase")).alias("table"))  # one row of the stated dictionary
    hit = F.filter("table", lambda t: F.col("low").contains(t["phrase"]))
    return low.crossJoin(F.broadcast(table)).select("qid", F.explode(F.array_distinct(F.transform(hit, lambda t: t["topic"]))).alias("topic"))


def network(edges: DataFrame, most: int = 60) -> DataFrame:
    """(ticker, topic, degree): links of the most shared topics, at most `most` of them."""
    degree = popularity(edges).withColumnRenamed("companies", "degree").orderBy(F.desc("degree"), "topic").limit(most)
    return edges.select("ticker", "topic").distinct().join(degree, "topic").select("ticker", "topic", "degree")


def graph_evidence(edges: DataFrame, questions: DataFrame, companies: DataFrame, phrases: DataFrame, most: int = 8) -> DataFrame:
    """(qid, branch, chunk_id): evidence by what a question names: two companies (topics they share), topics (whoever has them), one company (all its topics)."""
    topics = query_topics(questions, phrases)
    names = companies.select("ticker", F.lower("name").alias("gram")).withColumn("size", F.size(F.split("gram", " ")))
    named = grams(questions, names.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n"))).join(names, "gram").select("qid", "ticker").distinct()
    flags = questions.select("qid").join(named.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").join(topics.groupBy("qid").agg(F.count("*").alias("t")), "qid", "left").na.fill(0)
    branch = F.when(F.col("n") >= 2, "shared").when(F.col("t") > 0, "topic").when(F.col("n") == 1, "company")
    flags = flags.select("qid", "n", branch.alias("branch")).where("branch is not null")
    own = named.join(flags.where("branch <> 'topic'"), "qid").join(edges, "ticker")
    both = own.groupBy("qid", "branch", "n", "topic").agg(F.countDistinct("ticker").alias("have")).where("branch = 'company' or have >= 2").select("qid", "branch", "topic")
    by_company = own.join(both, ["qid", "branch", "topic"], "left_semi").select("qid", "branch", "chunk_id")
    by_topic = flags.where("branch = 'topic'").join(topics, "qid").join(edges, "topic").select("qid", "branch", "chunk_id")
    every = by_company.union(by_topic).distinct()
    return every.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where(F.col("rn") <= most).select("qid", "branch", "chunk_id")


def build(chunks: DataFrame, phrases: DataFrame, officers: DataFrame, subsidiaries: DataFrame) -> DataFrame:
    """All edges (src, dst, relation, chunk_id): faces (topics), has_officer and owns, from what chunks, officers (id, name) and subsidiaries (id, name) say."""
    of = chunks.select(F.col("chunk_id").alias("id"), "ticker")
    faces = topic_edges(chunks, phrases).select(F.col("ticker").alias("src"), F.col("topic").alias("dst"), F.lit("faces").alias("relation"), "chunk_id")
    other = lambda rows, relation: rows.join(of, "id").select(F.col("ticker").alias("src"), F.col("name").alias("dst"), F.lit(relation).alias("relation"), F.col("id").alias("chunk_id"))
    return faces.unionByName(other(officers, "has_officer")).unionByName(other(subsidiaries, "owns"))


def nodes(edges: DataFrame) -> DataFrame:
    """(node, kind): companies, and topics, officers and subsidiaries by the relation that leads to them."""
    kind = F.when(F.col("relation") == "faces", "topic").when(F.col("relation") == "has_officer", "officer").otherwise("subsidiary")
    return edges.select(F.col("src").alias("node"), F.lit("company").alias("kind")).union(edges.select("dst", kind)).distinct()


def stats(edges: DataFrame) -> DataFrame:
    """(kind, n): nodes by kind, and edges by relation."""
    by = lambda rows, c: rows.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n"))
    return by(nodes(edges), "kind").union(by(edges, "relation"))


def related(edges: DataFrame, relation: str) -> DataFrame:
    """(src, names): each company's distinct neighbours of a relation, sorted, as one text."""
    own = edges.where(F.col("relation") == relation).groupBy("src", "dst").agg(F.lit(1))
    return own.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), "; ").alias("names"))


def evidence_of(edges: DataFrame, relation: str, src: str, dst: str | None = None) -> DataFrame:
    """Every parallel edge of a company and relation, and of a topic where one is named."""
    own = edges.where((F.col("relation") == relation) & (F.col("src") == src))
    return own if dst is None else own.where(F.col("dst") == dst)


def listed(names: DataFrame, most: int = 25) -> DataFrame:
    """(src, line) of (src, name): the first names, and how many more there are."""
    by = Window.partitionBy("src").orderBy("name")
    first = names.distinct().withColumn("k", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("src"))).where(F.col("k") <= most)
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ")
    more = F.max("n") - most
    return first.groupBy("src").agg(F.concat(line, F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("line"))


def around(edges: DataFrame, most: int = 60) -> DataFrame:
    """(ticker, topic, degree) of the network of each company's topics: companies in order of name each add themselves and their topics until `most` nodes are there.

    What is counted is distinct companies and topics by the order of their first edge, so one row for each, not one for each chunk.
    """
    pairs = edges.select("ticker", "topic").distinct()
    first = pairs.groupBy("topic").agg(F.min("ticker").alias("ticker")).select("ticker", F.lit(1).alias("kind"), F.col("topic").alias("node"))
    every = first.union(pairs.select("ticker").distinct().select("ticker", F.lit(0), F.col("ticker")))
    kept = every.orderBy("ticker", "kind", "node").limit(most)
    topics = kept.where("kind = 1").select(F.col("node").alias("topic"))
    shown = pairs.join(kept.where("kind = 0").select("ticker"), "ticker", "left_semi").join(topics, "topic", "left_semi")
    return shown.join(pairs.groupBy("topic").agg(F.count("*").alias("degree")), "topic").select("ticker", "topic", "degree")
