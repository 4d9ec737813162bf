"""Token files: Parquet list columns with dictionary or delta encoding (operator 3)."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import CACHE_WORDS, chunks_of, library
from leafmill.llm.common import rebatched, small_batches, text_or_empty, with_local_order, write_scratch

#: Row groups and pages of the files: a reader can fetch few documents without the rest.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10


_MARKS = frozenset(punctuation)
#: Words that the library encodes as one text.
_TOGETHER = 1000


class LibraryEncoder:
    """Runs without white space and their ids, as the tokenizers library encodes them.

    No token of the vocabulary crosses white space, so a text's ids are its runs' ids in a row; nor
    does one hold both letters and the punctuation behind them, so a run of both is encoded as two.
    The vocabulary is a lower-case one: a text of Latin-1 characters, where a character's lower case
    depends on nothing else, is lowered at once, unless it may hold a special token. A full table
    becomes the older one, from which runs still in use come back unencoded.
    """

    def __init__(self, path: str):
        self.model, self.known, self.older = library(path), {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.model.get_vocab(with_added_tokens=True)
        #: Of each id whether it ends a word; of none if the vocabulary does not mark them.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    @staticmethod
    def lowered(text: str) -> tuple[str, bool]:
        """The text, in lower case where that changes no id, and whether it is so."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text, False
        return (text, False) if "<|" in text else (text.lower(), True)

    def learn(self, runs: set[str], plain: bool) -> None:
        known, older, made, parts = self.known, self.older, [], set()
        if older:
            again = {run: older[run] for run in runs if run in older}
            known.update(again)
            runs = runs.difference(again)
        if plain:
            for run in runs:
                if run[-1] in _MARKS and (word := run.rstrip(punctuation)).isalpha():
                    made.append((run, word, run[len(word) :]))
                    parts.add(word)
                    parts.add(run[len(word) :])
                else:
                    parts.add(run)
        else:
            parts = runs
        unseen = [part for part in parts if part not in known]
        if older:
            again = {part: older[part] for part in unseen if part in older}
            known.update(again)
            unseen = [part for part in unseen if part not in again]
        words = [part for part in unseen if part.isalpha()] if plain else []
        for a in range(0, len(words), _TOGETHER):
            self._learn_words(words[a : a + _TOGETHER])
        rest = [part for part in unseen if part not in known]
        for part, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[part] = array("I", e.ids).tobytes()
        for run, word, tail in made:
            known[run] = known[word] + known[tail]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters as one text: each is one pre-token, so its ids end at the first that ends a word.

        Where the numbers do not agree (another vocabulary) the words are left to be encoded one by one.
        """
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) == len(words):
            data = ids.tobytes()
            self.known.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        ready = [self.lowered(t) for t in texts]
        split = [chunks_of(t) for t, _ in ready]
        for plain in (True, False):
            runs = set().union(*[c for c, (_, low) in zip(split, ready, strict=True) if low == plain])
            # Not by the difference of key views, which walks over the whole table.
            self.learn(runs.difference(self.known), plain)
        ids = self.known.__getitem__
        return [b"".join(map(ids, chunks)) + end for chunks in split]


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One table for all tasks of a worker; the library's own threads would fight over the executors' cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def encode_in_order(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, place, before, n_tokens, tokens) in ascending id order, each document closed by ``end_id``.

    ``before`` counts the ids of the earlier documents of the same part. Equal ids follow each other
    in the order of a hash of their texts (then of the texts); null ids come first; a null text is the
    empty text; repeated rows each have their place; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("__hash", F.xxhash64("text"))
    rows = with_local_order(rows, "doc_id", "__hash", ties=("text",))

    def run(batches):
        encoder, end, before = library_encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for batch in rebatched(batches):
            ids = encoder.encode(batch.column("text").to_pylist(), end)
            n = np.array([len(i) // 4 for i in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            columns = [batch.column("doc_id"), batch.column("__part"), batch.column("__idx"), pa.array(before + offsets[:-1]), pa.array(n), tokens]
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "before", "n_tokens", "tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part int, place long, before long, n_tokens long, tokens array<int>")


def write_tokens(rows: DataFrame, encoding: str = "dictionary") -> str:
    """Writes token files to the shared folder and gives their path.

    ``encoding`` is "dictionary" or "delta"; either way pages carry column and offset indexes, so
    that a filter on doc_id or a read of the counts alone touches few pages.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    options = {
        "compression": "zstd",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v2",
    }
    return write_scratch(rows, "tokens", **options)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): ``start`` counts the ids of all documents before.

    Only what is selected is read; the starts come from the counts alone. The totals table has a row
    for each part file, so it is small beside the documents, and its window runs over it alone.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("__part"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("__base"))
    joined = rows.join(F.broadcast(bases), rows["part"] == bases["__part"])
    return joined.select("doc_id", (F.col("__base") + F.col("before")).alias("start"), "n_tokens", "tokens")


def token_digests(rows: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with ``ids_crc32`` in place of the ids."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:  # views of the column, so any size will do
            tokens = batch.column("tokens")
            at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
