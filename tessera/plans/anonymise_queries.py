"""Query of phrases replaced by a map. SQL takes minutes over whole tables; tests hold the operator against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import anonymise as A
from tessera.plans import tables as T
from tessera.plans.registry import query


@query("anonymised_documents")
def anonymised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which phrases that every twentieth of them has are replaced wherever they stand."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    w, key = F.split("content", " ", -1), F.col("doc_id").cast("string")
    some = docs.where("doc_id % 20 = 0 and content is not null")
    mapping = some.select(F.array_join(F.slice(w, 2, 2), " ").alias("original"), F.concat(F.lit("["), key, F.lit("]")).alias("anonymized"))
    mapping = mapping.union(some.select(F.array_join(F.slice(w, 4, 3), " "), F.concat(F.lit("("), key, F.lit(")"))))
    return A.anonymised(docs, mapping).select("doc_id", "replaced", F.md5("content").alias("digest"))
