"""A byte-level convolutional quality classifier in numpy (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, rebatched, small_batches, text_or_empty

#: Bytes that a filter sees (even), filters, and bytes in which a chunk's windows begin; chunks overlap by WIDTH - 1.
WIDTH, FILTERS, CHUNK = 6, 16, 256
#: Fitting: labelled rows at most, passes, and texts a step. A text over FIT_BYTES is fitted on as many bytes
#: of it, in pieces of PIECE spread evenly over the whole text; so the sample is at most FIT_ROWS * FIT_BYTES.
FIT_ROWS, FIT_BYTES, PIECE, EPOCHS, STEP_ROWS = 4000, 1 << 15, 1 << 11, 12, 32
THRESHOLD = 0.3
_BLOCK = 1 << 10  # chunks convolved at once


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each chunk, with the first bytes of the text's next chunk or zeros behind, and each chunk's text."""
    n = [-(-len(t) // CHUNK) for t in texts]
    own = np.frombuffer(b"".join(t.ljust(k * CHUNK, b"\0") for t, k in zip(texts, n, strict=True)), np.uint8).reshape(-1, CHUNK)
    owner = np.repeat(np.arange(len(texts)), n)
    behind = np.zeros((len(own), WIDTH - 1), np.uint8)
    goes_on = np.flatnonzero(owner[1:] == owner[:-1])
    behind[goes_on] = own[goes_on + 1, : WIDTH - 1]
    return np.concatenate([own, behind], axis=1), owner


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS: what a byte adds to a filter at each place
    out: np.ndarray  # weights of the document's largest and mean chunk maxima
    bias: float

    def pairs(self) -> list[np.ndarray]:
        """The filters as tables over pairs of bytes."""
        t = self.table
        return [np.ascontiguousarray((t[i + 1][:, None, :] + t[i][None, :, :]).reshape(65536, FILTERS)) for i in range(0, WIDTH, 2)]

    def chunk_maxima(self, data: np.ndarray, tables: list[np.ndarray], arg: bool = False):
        """The largest response of each filter in each chunk (and where)."""
        chunks = len(data)
        best, at = np.empty((chunks, FILTERS), np.float32), np.empty((chunks, FILTERS), np.int64) if arg else None
        for a in range(0, chunks, _BLOCK):
            b = min(chunks, a + _BLOCK)
            wide = data[a:b].astype(np.uint16)
            pair = wide[:, :-1] | wide[:, 1:] << np.uint16(8)
            z = tables[0][pair[:, :CHUNK]]
            for k, t in enumerate(tables[1:], 1):
                z += t[pair[:, 2 * k : 2 * k + CHUNK]]
            if arg:
                at[a:b] = z.argmax(axis=1)
                best[a:b] = np.take_along_axis(z, at[a:b, None, :], axis=1)[:, 0]
            else:
                z.max(axis=1, out=best[a:b])
        return (best, at) if arg else best

    def pooled(self, best: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each document's features, from its chunks' maxima after the rectifier, and its number of chunks."""
        count = np.bincount(owner, minlength=n)
        features = np.zeros((n, 2 * FILTERS), np.float32)
        if len(owner):
            r, has = np.maximum(best, 0), np.flatnonzero(count)
            starts = np.searchsorted(owner, has)
            features[has, :FILTERS] = np.maximum.reduceat(r, starts)
            features[has, FILTERS:] = np.add.reduceat(r, starts) / count[has, None]
        return features, count

    def score(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """Each text's probability of label 1: of the text alone, whatever stands beside it."""
        data, owner = _chunks(texts)
        features, _ = self.pooled(self.chunk_maxima(data, tables), owner, len(texts))
        # Row by row: a product of matrices may round by the number of rows.
        z = (features.astype(np.float64) * self.out).sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; gradients flow to the bytes under the largest response of each chunk.

    Without both labels the network answers with the smoothed share of label 1.
    """
    y = np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    rate = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    net = Network(rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), float(np.log(rate / (1 - rate))))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    state = [np.zeros_like(net.table), np.zeros_like(net.table), np.zeros_like(net.out), np.zeros_like(net.out), 0.0, 0.0]
    turn = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(texts))
        for a in range(0, len(order), STEP_ROWS):
            rows = order[a : a + STEP_ROWS]
            data, owner = _chunks([texts[i] for i in rows])
            best, at = net.chunk_maxima(data, net.pairs(), arg=True)
            features, count = net.pooled(best, owner, len(rows))
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.bias, -30, 30)))
            d = (p - y[rows]) / len(rows)
            g_out, g_bias = features.T @ d, float(d.sum())
            top = (best >= features[owner, :FILTERS]) & (best > 0)
            g_best = np.where(top, (d[:, None] * net.out[:FILTERS])[owner], 0) + np.where(best > 0, (d / np.maximum(count, 1))[owner, None] * net.out[FILTERS:], 0)
            g_table = np.zeros_like(net.table)
            filters, chunk = np.broadcast_to(np.arange(FILTERS), at.shape), np.arange(len(at))[:, None]
            for w in range(WIDTH):
                np.add.at(g_table[w], (data[chunk, at + w], filters), g_best)
            turn += 1
            fix1, fix2 = 1 - 0.9**turn, 1 - 0.999**turn
            for k, (g, value) in enumerate(((g_table, net.table), (g_out, net.out))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
            state[4] += 0.1 * (g_bias - state[4])
            state[5] += 0.001 * (g_bias**2 - state[5])
            net.bias -= rate * (state[4] / fix1) / (np.sqrt(state[5] / fix2) + 1e-6)
    return net


def spread(text: bytes, most: int) -> bytes:
    """The text, or where it is longer than ``most`` bytes, pieces at even distances from its start to its end."""
    if len(text) <= most:
        return text
    n = max(1, most // PIECE)
    last = len(text) - PIECE
    return b"".join(text[at : at + PIECE] for at in (last * i // max(1, n - 1) for i in range(n)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts whose id is not held out, in the order of a hash of the id.

    Texts of every length take part; of those over ``most`` bytes, pieces from the whole text. Null
    texts are empty texts; rows without a quality label, and ids without a text, do not count.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("__id"), "quality")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "quality").limit(rows)
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches):
        for batch in rebatched(batches):
            cut = [spread(t.encode("utf-8", "surrogatepass"), most) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("quality"), pa.array(cut, pa.binary())], ["place", "quality", "text"])

    parts = found.select(F.xxhash64("doc_id").alias("place"), F.col("quality").cast("int"), text_or_empty().alias("text")).mapInArrow(run, "place long, quality int, text binary")
    sample = parts.orderBy("place", F.xxhash64("text"), "quality").limit(rows).collect()
    return [bytes(r.text) for r in sample], [r.quality for r in sample]


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Filters pass over overlapping chunks of the whole text; a null text is the empty text, whose
    score is what the bias says. A null id counts as the empty id. A score depends on the text alone,
    so repeated rows get equal scores; extra columns are not read, whatever they are called.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(F.col(doc_id), 5) == 0).alias("held_out"), text_or_empty(text).alias("text"))

    def run(batches):
        tables = net.pairs()
        for batch in rebatched(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            scores = np.asarray(net.score(texts, tables), np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
