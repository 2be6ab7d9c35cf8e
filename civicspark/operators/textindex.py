"""A stored full-text index: occurrences of terms in files by buckets, sorted by term, and the lengths of texts.

Built once by a scan of the texts and one shuffle of their terms; a batch of questions then reads only the buckets, and within
them only the row groups, of its own terms, and groups what it has read. A bucket's rows are salted by key over SALTS tasks,
so a term that a third of all texts hold is not one task's work. Rows repeated for a key change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import retrieval as R

BUCKETS = 64
SALTS = 8
#: Distinct terms of a batch of questions up to which they are written into the scan's filter; more are joined.
TERMS_IN_FILTER = 5_000


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    key: str
    buckets: int
    terms: R.Terms

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def postings(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """(term, key, positions, tf) of the questions' terms."""
        asked = queries.select(F.explode(self.terms(F.col(text))).alias("term")).distinct()
        post = self.spark.read.parquet(f"{self.path}/terms")
        some = [r[0] for r in asked.limit(TERMS_IN_FILTER + 1).collect()]
        if len(some) > TERMS_IN_FILTER:
            return self._grouped(post.join(asked, "term", "left_semi"))
        at = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in some], "t string").select(self._bucket(F.col("t"))).collect()}) if some else []
        return self._grouped(post.where(F.col("bucket").isin(at) & F.col("term").isin(some)))

    def _grouped(self, occurrences: DataFrame) -> DataFrame:
        p = occurrences.groupBy("term", self.key).agg(F.array_sort(F.collect_set("pos")).alias("positions"))
        return p.withColumn("tf", F.size("positions").cast("bigint"))

    def lengths(self) -> DataFrame:
        """(key, dl): the number of terms of every text."""
        return self.spark.read.parquet(f"{self.path}/lengths").distinct()


def build(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS, terms: R.Terms = R.terms) -> TextIndex:
    """Write the index of all texts below path, which must not exist; null texts have no terms."""
    index = TextIndex(docs.sparkSession, path, key, buckets, terms)
    post = docs.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term")).withColumn("bucket", index._bucket(F.col("term")))
    spread = post.repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(SALTS)))
    spread.sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{path}/terms")
    docs.select(key, F.size(terms(F.coalesce(F.col(text), F.lit("")))).alias("dl")).write.parquet(f"{path}/lengths")
    return index
