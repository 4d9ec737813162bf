"""Reading PDF files as tables and writing them back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, path, n_bytes, content) of files; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("n_bytes"), "content")


def write_files(files: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes each row's content under ``folder`` and gives (path, n_bytes); ``name`` is a string column.

    Through pyarrow's file systems, so the folder may be a local one or in a store that it knows.
    Each file is written under a temporary name and then moved, so repeated tasks do no harm.
    """
    import pandas as pd

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            paths = []
            for n, content in zip(pdf["name"], pdf["content"], strict=True):
                target = f"{base}/{n}"
                with system.open_output_stream(f"{target}.{id(pdf)}.part") as out:
                    out.write(content)
                system.move(f"{target}.{id(pdf)}.part", target)
                paths.append(target)
            yield pd.DataFrame({"path": paths, "n_bytes": [len(c) for c in pdf["content"]]})

    return files.select(F.col(name).alias("name"), "content").mapInPandas(run, "path string, n_bytes long")


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; a local one is set only where it is unset and all runs in one process."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="leafmill-"))
