"""Postings of texts: kept in the shared folder, appended to, and searched by TF-IDF cosine without reading common terms' lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.operators.retrieval import Frequent, _best_of_blocks, cosine, inverse_document_frequency, item_terms, top_k
from turnmill.sources.shared import written

#: Postings that a block holds on average, parts that a term's name is hashed to, and a query's blocks that set its mark.
BLOCK, BUCKETS, SEEDS = 4096, 64, 4
#: Scores are rounded to 9 places; a bound this close to the mark is still read.
SLACK = 1e-8
_META = "version long, items long"


class TextIndex:
    """`folder` holds the items' term counts, and versions of weights and postings made from them.

    A version has `terms` (term, df, idf), `norms` (id, norm) and `postings`: a term's list in blocks of items with similar
    weights, each with the largest weight in it over the item's norm, `top`. Blocks are dealt by a hash, so a term in a
    third of all items is no single task's. A line in `meta` makes a version count, once it is whole; the newest two stay.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, items: DataFrame, folder: str, *, key: str = "doc_id", text: str = "content") -> TextIndex:
        """An index that holds `items`; it can be searched after `refresh`."""
        self = cls(items.sparkSession, folder)
        self._save(item_terms(items.limit(0), key, text), "counts")
        self.add(items, key=key, text=text)
        return self

    def _save(self, rows: DataFrame, name: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
        rows.write.mode(mode).option("compression", "zstd").partitionBy(by or []).parquet(f"{self.folder}/{name}")

    def add(self, items: DataFrame, *, key: str = "doc_id", text: str = "content") -> None:
        """Appends the counts of items whose id isn't there yet (of several texts of one id, the smallest); rows with a null
        id are left out. Only the ids of what is there are read. Searches find them after `refresh`."""
        rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("x"))
        # Only texts of ids that repeat are shuffled.
        often = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "often")
        one = rows.join(often, "id", "left_anti").unionByName(rows.join(often, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")))
        counts = item_terms(one, "id", "x")
        fresh = counts.join(self.spark.read.parquet(f"{self.folder}/counts").select("id"), "id", "left_anti")
        self._save(fresh, "counts", "append")

    def version(self) -> int:
        """The newest whole version; 0 if there is none."""
        try:
            found = self.spark.read.schema(_META).parquet(f"{self.folder}/meta").agg(F.max("version")).first()[0]
        except Exception as error:  # there is no such table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            found = None
        return found or 0

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}/{name}")

    def _postings(self, version: int) -> DataFrame:
        kind = self._read("norms", version).schema["id"].dataType.simpleString()
        schema = f"term string, level int, part long, top double, ids array<{kind}>, n int, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/version={version}/postings")

    def refresh(self) -> None:
        """Makes a version of all that was added: idf and norms depend on every item, so weights are worked out anew, from
        counts; no text is read."""
        version = self.version() + 1
        path = f"version={version}"
        counts = self.spark.read.parquet(f"{self.folder}/counts")
        n = counts.count()
        self._save(inverse_document_frequency(counts.select(F.explode("terms.term").alias("term")), n), f"{path}/terms")
        terms = self._read("terms", version)
        frequent = Frequent(terms)
        squares = F.col("head") + F.coalesce("rest", F.lit(0.0))
        norms = frequent.weighed(counts.withColumn("key", F.col("id")), "key").join(frequent.norms(counts, terms, "id"), "id", "left")
        self._save(norms.select("id", (F.sqrt(squares) / F.greatest("len", F.lit(1))).alias("norm")), f"{path}/norms")
        held = counts.join(self._read("norms", version).where("norm > 0"), "id").select("id", (F.col("len") * F.col("norm")).alias("over"), "terms")
        # Frequent terms' weights are looked up; only postings of rare terms meet the terms' table, which keeps them dealt by term.
        common, rare = frequent.flat(held), frequent.flat(held, rare=True).join(terms.where(~frequent.is_held), "term")
        for mode, entries in (("overwrite", common), ("append", rare)):
            entries = entries.where("idf <> 0").select("id", "term", "df", (F.col("n") / F.col("over") * F.col("idf")).alias("share"))
            level = F.floor(-2 * F.log2("share")).cast("int")
            part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / BLOCK)).cast("long")
            blocks = entries.groupBy("term", level.alias("level"), part.alias("part")).agg(F.max("share").alias("top"), F.collect_list("id").alias("ids"))
            named = blocks.withColumn("n", F.size("ids")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            self._save(named, f"{path}/postings", mode, by=["bucket"])
        self._save(self.spark.createDataFrame([(version, n)], _META), "meta", "append")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={version - 2}")
        old.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    def _asked(self, queries: DataFrame, version: int) -> DataFrame:
        """(query_id, term, q, norm) of queries with tokens: weights of known terms; a null term if there is none."""
        flat = item_terms(queries, "query_id", "query").where("len > 0").select("id", "len", F.explode("terms").alias("x")).select("id", "len", "x.term", "x.n")
        weights = flat.join(self._read("terms", version).where("idf <> 0"), "term", "left")
        weights = weights.select(F.col("id").alias("query_id"), F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), (F.col("n") / F.col("len") * F.col("idf")).alias("q"), "idf")
        norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy("query_id")))  # one query's own terms
        return written(weights.withColumn("norm", F.coalesce(norm, F.lit(0.0))), "asked")

    def _scored(self, ids: DataFrame, asked: DataFrame, version: int, k: int) -> DataFrame:
        """The k best items of each query among `ids`, by exact scores: items bring their counts, queries their weights times
        idf, and they meet in blocks."""
        entry = F.struct("term", (F.col("q") * F.col("idf")).alias("w"))
        known = F.collect_list(F.when(F.col("term").isNotNull(), entry))
        given = asked.groupBy(F.col("query_id").alias("id")).agg(known.alias("terms"), F.max("norm").alias("norm"))
        counts = self.spark.read.parquet(f"{self.folder}/counts")
        terms = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["n"].cast("double").alias("w")))
        held = counts.join(ids, "id", "left_semi").join(self._read("norms", version), "id")
        return _best_of_blocks(written(held.select("id", terms.alias("terms"), (F.col("len") * F.col("norm")).alias("norm")), "scored"), given, cosine, k, "id")

    def _bounds(self, asked: DataFrame, version: int) -> DataFrame:
        """Blocks of the queries' terms: query_id, term, level, part, n, own (most that the term adds there), rest (most that
        the query's terms after it, in order of their most, add)."""
        heads = self._postings(version).select("bucket", "term", "level", "part", "top", "n")
        wanted = asked.where("term is not null").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        tops = heads.groupBy("bucket", "term").agg(F.max("top").alias("most"))
        after = W.partitionBy("query_id").orderBy(F.desc("ub"), "term").rowsBetween(1, W.unboundedFollowing)
        ranked = wanted.join(tops, ["bucket", "term"]).withColumn("ub", F.col("q") / F.col("norm") * F.col("most"))
        ranked = ranked.withColumn("rest", F.coalesce(F.sum("ub").over(after), F.lit(0.0)))
        own = (F.col("q") / F.col("norm") * F.col("top")).alias("own")
        return heads.join(ranked.select("bucket", "term", "query_id", "q", "norm", "rest"), ["bucket", "term"]).select(
            "query_id", "bucket", "term", "level", "part", "n", own, "rest"
        )

    def needed(self, queries: DataFrame, k: int) -> DataFrame:
        """The blocks of each query's terms, and whether its k best can only be known by reading them: `read`.

        An item's score is at most what the first of its terms, in order of what they can add, adds in the item's block,
        and what all later ones can add. The exact scores of the items in the query's most promising blocks give a
        mark: blocks whose bound is below the k-th best of them hold none of the k best as the first of their terms.
        """
        version = self.version()
        return self._needed(self._asked(queries, version), version, k)

    def _needed(self, asked: DataFrame, version: int, k: int) -> DataFrame:
        bounds = written(self._bounds(asked, version), "bounds")
        best = W.partitionBy("query_id").orderBy(F.desc("own"), "term", "level", "part")
        seeds = bounds.withColumn("at", F.row_number().over(best)).where(F.col("at") <= max(SEEDS, k))
        # Other items of the seeds are scored as well, which can only raise the mark.
        mark = self._scored(written(self._members(seeds, version), "seeds"), asked, version, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("mark"))
        read = F.col("own") + F.col("rest") >= F.coalesce("mark", F.lit(0.0)) - SLACK
        return bounds.join(mark, "query_id", "left").withColumn("read", read)

    def _members(self, blocks: DataFrame, version: int) -> DataFrame:
        """(id): items of the blocks."""
        lists = self._postings(version).select("bucket", "term", "level", "part", "ids")
        keys = ["bucket", "term", "level", "part"]
        return lists.join(blocks.select(*keys).distinct(), keys).select(F.explode("ids").alias("id")).distinct()

    def search(self, queries: DataFrame, k: int, *, item: str = "doc_id") -> DataFrame:
        """The k best items of each query (query_id, query) by TF-IDF cosine: query_id, item, score, rank.

        Equals `retrieval.tfidf_top_k` on all items of the version: ties go to the smaller id, items that share no weighted
        term score 0 and fill up by id, and queries without a token get nothing.
        """
        version = self.version()
        asked = self._asked(queries, version)
        # Items that any query needs; each meets all queries, and scores beyond those needed are exact too.
        found = self._members(self._needed(asked, version, k).where("read"), version)
        fill = self._read("norms", version).select("id").orderBy("id").limit(k)  # score at least 0, for queries that match less than k
        return self._scored(written(found.unionByName(fill).distinct(), "found"), asked, version, k).withColumnRenamed("id", item)
