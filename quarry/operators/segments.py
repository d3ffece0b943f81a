"""A lexical index that lives: segments are appended, ids deleted, and what is live is read or merged into one segment.

Each change is a segment with a number: postings (id, term, tf, dl) in folders by the hash of the term, the same as they stand in the texts
(packed rows, for questions that ask for most of them; a segment that is asked in large batches alone needs no folders), documents (id, dl), terms (term, df)
and totals (n, size), the last two as differences, so that a deletion's are negative; and the ids that are gone. A posting is live unless its
id is gone in a later segment. Totals are written last: a segment without them doesn't count, and its number is used again. A merged
segment says so in its totals; what came before isn't read any more.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import search
from quarry.sources.tables import cut

SCHEMAS = {
    "postings": "id long, term string, tf long, dl int, seq int, slot int", "documents": "id long, dl int, seq int", "terms": "term string, df long, seq int", "gone": "id long, seq int", "packed": f"{search.PACKED}, seq int", "totals": "n long, size long, merged boolean, slots boolean, seq int",
}
SLOTS = 64
#: Documents whose postings of a slot are one task's and one file's.
DOCUMENTS = 50_000
#: Bytes of packed rows that are read at once.
ROW_GROUP = 32 << 20


def slot(term: str = "term") -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


class Index:
    """An index in a folder of any file system that Spark writes to. One writer at a time; readers see what was complete when they began."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # no segment has written it yet
            return self.spark.createDataFrame([], SCHEMAS[name])

    def numbers(self) -> list[int]:
        """Segments that count, in order: the last merged one and what came after. They are few, as merging keeps them so."""
        rows = self._table("totals").select("seq", "merged").collect()
        last = max((r["seq"] for r in rows if r["merged"]), default=0)
        return sorted(r["seq"] for r in rows if r["seq"] >= last)

    def _next(self) -> int:
        return max((r["seq"] for r in self._table("totals").select("seq").collect()), default=0) + 1

    def _seen(self, name: str) -> DataFrame:
        return self._table(name).where(F.col("seq").isin(self.numbers()))

    def _bare(self) -> list[int]:
        """Segments that count and have no folders of slots."""
        return [r["seq"] for r in self._seen("totals").where("not slots").select("seq").collect()]

    def _postings(self) -> DataFrame:
        """Postings of all segments that count; of those without slots they are read from the packed rows."""
        bare = [search.unpacked(self._seen("packed").where(F.col("seq") == i)).select("*", F.lit(i).alias("seq"), slot().alias("slot")) for i in self._bare()]
        return functools.reduce(DataFrame.unionByName, bare, self._seen("postings"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Those of rows (id, seq, ...) whose id isn't gone in a later segment."""
        gone = self._seen("gone").groupBy("id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).drop("gone")

    def _put(self, df: DataFrame, name: str, seq: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/seq={seq}")

    def _put_postings(self, postings: DataFrame, seq: int, n: int) -> DataFrame:
        """Write the postings of n documents, as many tasks a slot as they need, and read them again."""
        share, path = max(1, -(-n // DOCUMENTS)), f"{self.folder}/postings/seq={seq}"
        dealt = postings.select("id", "term", "tf", "dl", slot().alias("slot")).repartition(SLOTS * share, "slot", F.pmod(F.xxhash64("id"), F.lit(share)))
        dealt.sortWithinPartitions("slot", "term").write.mode("overwrite").partitionBy("slot").parquet(path)
        return self.spark.read.schema(SCHEMAS["postings"].replace(" seq int,", "")).parquet(path)

    def _write(self, postings: DataFrame | None, documents: DataFrame | None, gone: DataFrame | None, terms: DataFrame, totals: DataFrame, n: int = 0) -> None:
        seq = self._next()
        put = lambda df, name: self._put(df, name, seq)
        if postings is not None:
            self._put_postings(postings, seq, n)
            put(documents.select("id", "dl"), "documents")
        if gone is not None:
            put(gone.select("id"), "gone")
        put(terms.select("term", "df"), "terms")
        put(totals.select("n", "size", "merged").coalesce(1), "totals")

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: bool = True) -> None:
        """Add documents; one whose id is live takes its place. Of repeated ids the text of the smallest hash counts, null ids are left out, a null text has no terms. Without slots no posting moves, and questions read all of the segment."""
        one = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        twice = search.small(one.groupBy("id").count().where("count > 1").select("id"))
        if not twice.isEmpty():
            of_several = one.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", F.col("t.text").alias("text"))
            one = one.join(twice, "id", "left_anti").union(of_several)
        self.delete(one.select("id"))
        seq = self._next()
        search.packed(one, "id", "text").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/packed/seq={seq}")
        packed = self.spark.read.schema(search.PACKED).parquet(f"{self.folder}/packed/seq={seq}")
        if slots:
            self._put_postings(search.unpacked(packed), seq, docs.count())
        own = one.select("id").join(packed.select(F.inline(F.arrays_zip("ids", "dl"))).withColumnRenamed("ids", "id"), "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))
        self._put(own, "documents", seq)
        self._put(packed.select(F.inline(F.arrays_zip("words", "df"))).groupBy(F.col("words").alias("term")).agg(F.sum("df").alias("df")), "terms", seq)
        held = self.spark.read.schema("id long, dl int").parquet(f"{self.folder}/documents/seq={seq}")
        self._put(held.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("size"), F.lit(False).alias("merged"), F.lit(slots).alias("slots")).coalesce(1), "totals", seq)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents of ids (id); ids that aren't there change nothing."""
        if not self.numbers():
            return
        hit = cut(self._live(self._seen("documents")).join(ids.select("id").distinct(), "id", "left_semi").select("id", "dl"))
        if hit.isEmpty():
            return
        lost = self._live(self._postings()).join(hit.select("id"), "id", "left_semi")
        totals = hit.agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("size"), F.lit(False).alias("merged"))
        self._write(None, None, hit, lost.groupBy("term").agg((-F.count("*")).alias("df")), totals)

    def merge(self) -> None:
        """All that is live as one segment. Earlier folders can be removed once no reader uses them; vacuum() does."""
        terms, totals = self._seen("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), self._seen("totals").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.lit(True).alias("merged"))
        self._write(self._live(self._postings()), self._live(self._seen("documents")), None, terms, totals, totals.first()["n"] or 0)

    def vacuum(self) -> None:
        """Remove the folders of segments before the last merged one; their totals go first."""
        first = self.numbers()[0] if self.numbers() else 0
        old = [r["seq"] for r in self._table("totals").select("seq").collect() if r["seq"] < first]
        for name in ("totals", "postings", "packed", "documents", "terms", "gone"):
            for seq in old:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/seq={seq}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _packed(self) -> DataFrame:
        """What is live as packed rows: those that were written with the texts, or, where ids are gone or a segment has none, its postings packed anew."""
        written = {r["seq"]: r["slots"] is not None for r in self._seen("totals").where("size <> 0").select("seq", "slots").collect()}
        if all(written.values()) and self._seen("gone").isEmpty():
            return self._table("packed").where(F.col("seq").isin(list(written))).drop("seq")
        n = self._seen("totals").agg(F.sum("n")).first()[0] or 0
        return cut(search.repacked(self._live(self._postings()), n))

    def read(self, questions: DataFrame | None = None, qtext: str = "qtext") -> dict[str, DataFrame]:
        """postings, terms and total as search.ranked() takes them; with questions, postings of the slots that their terms lie in (at most SLOTS numbers come to the driver), and all as packed rows if most postings are asked for or a segment has no slots."""
        postings, built = self._postings(), {}
        df = self._seen("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        if questions is not None:
            df = cut(df)
            asked = questions.select(F.explode(tokens(F.col(qtext))).alias("term")).distinct()
            asked = search.small(asked.join(df, "term"))
            if self._bare() or 2 * (asked.agg(F.sum("df")).first()[0] or 0) > (df.agg(F.sum("df")).first()[0] or 0):
                built["packed"] = self._packed()
            slots = [r["slot"] for r in asked.select(slot().alias("slot")).distinct().collect()]
            postings = postings.where(F.col("slot").isin(slots)).join(asked, "term", "left_semi")
        total = self._seen("totals").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).select("n", (F.col("size") / F.col("n")).alias("avgdl"))
        return built | {"postings": self._live(postings).select("id", "term", "tf", "dl"), "terms": search.idf(df, total), "total": total}
