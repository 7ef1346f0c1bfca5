"""Search indexes of data folders, built once a session and kept until it ends."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import SearchIndex
from lodestone.sources import notes
from lodestone.sources.tables import folder_for, load

_BUILT: dict[tuple, SearchIndex] = {}
#: Those whose texts have vectors.
_DENSE: set[tuple] = set()
#: Seconds that building took, by folder.
BUILD_SECONDS: dict[str, float] = {}


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: their id is the chunk's, their source the document's and its title."""
    docs = load(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("source").alias("title"), "text")


def index_of(spark: SparkSession, d: str, dense: bool = False) -> SearchIndex:
    """The index of a folder's documents, built anew when its files have changed; the vectors of its texts once they are asked for."""
    files = load(spark, d, "documents").select(F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("at")).distinct()
    key = (spark.sparkContext.applicationId, d, tuple(sorted((r["f"], str(r["at"])) for r in files.collect())))
    if key not in _BUILT:
        began = time.time()
        _BUILT[key] = SearchIndex.build(spark, folder_for(spark), document_chunks(spark, d), fields={"text": 1.0})
        BUILD_SECONDS[d] = time.time() - began
    index = _BUILT[key]
    if dense and key not in _DENSE:
        index.embed(lambda df: notes.hashed_embedding(df, "text"))
        _DENSE.add(key)
    return index
