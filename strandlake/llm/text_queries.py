"""Queries of the problems on the corpus (8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.leaks import find_leaks
from strandlake.llm.offence import rates, score_offence
from strandlake.llm.pack_containers import pack_containers
from strandlake.plans.runtime import table

CAPACITY = 2048


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece of text."""
    return pack_containers(table(spark, d, "documents"), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, share of room left, and the spread: the variance of the curve key among what shares a
    container, over its variance among all (1 for texts dealt out at random)."""
    p = p8_packed(spark, d)
    k = F.col("curve_key").cast("double") / 2**30
    per = p.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), (F.var_pop(k) * F.count("*")).alias("within"), F.sum(k).alias("k"), F.sum(k * k).alias("kk"))
    n = F.sum("n")
    spread = F.sum("within") / n / (F.sum("kk") / n - (F.sum("k") / n) ** 2)
    return per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count("*") * CAPACITY)).alias("room_left"), spread.alias("spread"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and placed rows of them, and what must not be: containers above the capacity, texts cut that fit
    one, pieces that leave or repeat a part of their text, negative sizes."""
    p = p8_packed(spark, d)
    over = p.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.count(F.when(F.col("t") > CAPACITY, 1)).alias("overfull"))
    per = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.max("piece_no").alias("last"), F.sum((F.col("token_start") != F.col("piece_no") * CAPACITY).cast("int")).alias("off"), F.min("tokens").alias("least"))
    bad_cut, broken = (F.col("pieces") > 1) & (F.col("t") <= CAPACITY), (F.col("off") > 0) | (F.col("last") + 1 != F.col("pieces")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("t") / CAPACITY)))
    docs = per.agg(F.count("*").alias("documents"), F.count(F.when(bad_cut, 1)).alias("cut_needlessly"), F.count(F.when(broken, 1)).alias("broken"), F.count(F.when(F.col("least") < 0, 1)).alias("negative"))
    return docs.withColumn("overfull", over.scalar())


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its longest run of words and where it stands in the original text."""
    return _leaks(spark, d)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score_offence(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("score >= 0.5").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, kind and evidence of every document."""
    return _scores(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Offending documents per source."""
    return rates(_scores(spark, d))


QUERIES = {f.__name__: f for f in (p8_packed, p8_fill, p8_checks, p9_found, p9_spans, p9_items, p10_found, p10_scores, p10_rates)}
ORACLE: dict[str, str] = {
    "p8_checks": "select count(*) as documents, 0::bigint as cut_needlessly, 0::bigint as broken, 0::bigint as negative, 0::bigint as overfull from documents",
}
