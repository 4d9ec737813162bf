"""Files as they arrive: the batch operators over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.documents import pdf_page_text

#: The columns that the binary file source gives.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    """(doc_id, path, content) of files that appear in a folder."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA)
    files = reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def stream_page_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, page_no, text) of the pages of new files, empty ones included."""
    return pdf_page_text(new_files(spark, path, **options))
