"""A hashed maximum-entropy language model with a class-factored softmax (operator 10)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, materialize, rebatched, small_batches, text_or_empty

#: Classes of the softmax: the end of a text, frequent words in classes of even weight, all other words by spelling.
FREQUENT, SPELLED = 27, 4
CLASSES = 1 + FREQUENT + SPELLED
#: Hashed contexts of each feature: one for so many training tokens, from the first number named. Up to the second
#: they are broadcast; more are dealt out in shards of ``SHARD_BUCKETS`` and never broadcast, so they have no bound.
BUCKET_TOKENS, BUCKETS = 1024, (1 << 10, 1 << 14)
SHARD_BUCKETS = 1 << 12
#: The word before a token names its shard; if that word has over this share of a shard's tokens, so do the words
#: before it, back to one that has not, at most so many.
HOT_SHARE, REACH = 0.25, 8
#: Tokens and documents that a task gathers before it sends them to their shards (documents have 16-bit numbers there).
WINDOW_TOKENS, WINDOW_DOCS = 1 << 19, 1 << 15
#: The words back that each feature looks at: single words, skips, and pairs.
FEATURES = ((1,), (2,), (3,), (1, 2))
#: Gradient updates, each over another part of the training documents; prior tokens of a context, share of a
#: context's own log ratio that the first update takes, and the step of the others.
ROUNDS, PRIOR, START_SHARE, STEP = 4, 20.0, 0.3, 1.0
#: Bound of a weight.
MOST = 12.0
#: A token is broadcast with its count if it is one of at most so many of the corpus; so there are no more of them.
HEAD_SHARE = 500_000
#: Tokens in one numpy batch; words in a worker's table before it is emptied.
STEP_TOKENS, TABLE_WORDS = 1 << 17, 300_000
#: Tokens whose classes are worked out at once.
CACHE_ROWS = 1 << 12

END = b" "  # no word holds a space
_BACK = max(REACH, *(max(f) for f in FEATURES))
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)


def class_of(word: bytes) -> int:
    """The class of a word that is not frequent, seen or not: by its last two bytes."""
    return 0 if word == END else 1 + FREQUENT + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7) % SPELLED


def classes_of(counts: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """The classes of frequent words (token, count), the end left out: in the order of their counts, of even weight.

    The weight is the root of the count, so the most frequent words have classes almost by themselves.
    """
    ordered = sorted((x for x in counts if x[0] != END), key=lambda x: (-x[1], x[0]))
    weight = np.sqrt([n for _, n in ordered])
    spot = (np.cumsum(weight) - weight / 2) / max(1.0, weight.sum())
    # The first classes are narrow: a word's share of the text counts for more than its share of the words.
    cls = 1 + np.minimum(FREQUENT - 1, (spot ** 0.4 * FREQUENT).astype(np.int64))
    return {w: int(c) for (w, _), c in zip(ordered, cls, strict=True)}


class Words(dict):
    """Word to its number in arrays of hashes, classes and logarithms of counts; number 0 stands before a text.

    ``head`` holds (count, class) of the frequent words; of all others the logarithm is -1.
    """

    def __init__(self, head: dict[bytes, tuple[int, int]] | None = None):
        self.head = head or {}
        self.start()

    def start(self) -> None:
        self.clear()
        self.names: list[bytes] = [b""]
        self.hash, self.cls, self.log = np.array([0x5BD1E995], np.uint32), np.zeros(1, np.int64), np.zeros(1)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    def learn(self) -> None:
        """Brings the arrays up to date with the words that came since."""
        if new := self.names[len(self.hash) :]:
            self.hash = np.concatenate([self.hash, np.array([*map(zlib.crc32, new)], np.uint32)])
            known = [self.head.get(w) for w in new]
            self.cls = np.concatenate([self.cls, np.array([class_of(w) if k is None else k[1] for w, k in zip(new, known, strict=True)], np.int64)])
            self.log = np.concatenate([self.log, np.array([-1.0 if k is None else log10(k[0] + 1) for k in known])])

    @property
    def full(self) -> bool:
        return len(self) > TABLE_WORDS


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased (A to Z) words between space and \\t..\\r, then one end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _pieces(texts: list[str], words: Words):
    """(word numbers with a margin before each text, places of the tokens, text of each token), bounded pieces."""
    rows, owner, n = [], [], 0
    for i, t in enumerate(texts):
        toks = tokens_of(t)
        ids = np.fromiter(map(words.__getitem__, toks), np.int32, len(toks))
        for at in range(0, len(ids), STEP_TOKENS):  # long texts go in several pieces
            part = ids[at : at + STEP_TOKENS]
            margin = np.zeros(_BACK, np.int32)
            if at:
                margin[:] = ids[at - _BACK : at]
            rows += [margin, part]
            owner.append((i, len(part)))
            n += len(part)
            if n >= STEP_TOKENS:
                words.learn()
                yield _piece(rows, owner)
                rows, owner, n = [], [], 0
    if rows:
        words.learn()
        yield _piece(rows, owner)


def _piece(rows, owner):
    ids = np.concatenate(rows)
    lengths = np.array([n for _, n in owner])
    starts = np.concatenate([[0], np.cumsum(lengths + _BACK)[:-1]]) + _BACK
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return ids, places, np.repeat([i for i, _ in owner], lengths)


def shards_of(tokens: int) -> int:
    """1 if the contexts that the training tokens give can be broadcast, else the number of their shards."""
    return 1 if tokens <= BUCKETS[1] * BUCKET_TOKENS else -(-tokens // (SHARD_BUCKETS * BUCKET_TOKENS))


def buckets_of(tokens: int) -> int:
    """The contexts of each feature in a shard: with one shard the power of two that the training tokens give."""
    if shards_of(tokens) > 1:
        return SHARD_BUCKETS
    return max(BUCKETS[0], 1 << (max(1, tokens // BUCKET_TOKENS) - 1).bit_length())


def _shards(ids: np.ndarray, places: np.ndarray, words: Words, shards: int, most: int) -> np.ndarray:
    """Of every token the shard that holds its contexts, from the words before it alone; words of over ``most`` tokens are hot."""
    h, hot = words.hash[ids], words.log[ids] > log10(most + 1)
    key = h[places - 1] * _SALTS[5]
    key ^= key >> np.uint32(15)
    at = np.flatnonzero(hot[places - 1])
    for lag in range(2, REACH + 1):
        back = places[at] - lag
        mix = (key[at] ^ h[back]) * _SALTS[(lag + 1) % len(_SALTS)]
        key[at] = mix ^ mix >> np.uint32(15)
        at = at[hot[back]]
    return key % np.uint32(shards)


def _contexts(ids: np.ndarray, places: np.ndarray, words: Words, buckets: int) -> list[np.ndarray]:
    """For each feature the number of every token's hashed context; features share none."""
    h, out = words.hash[ids], []
    for k, lags in enumerate(FEATURES):
        mix = np.full(len(places), _SALTS[k], np.uint32)
        for lag in lags:
            mix = (mix ^ h[places - lag]) * _SALTS[(k + lag) % len(_SALTS)]
            mix ^= mix >> np.uint32(15)
        out.append((mix % np.uint32(buckets)).astype(np.int64) + k * buckets)
    return out


@dataclass
class Model:
    bias: np.ndarray  # of the classes
    weights: np.ndarray  # contexts x classes, log base e
    head: dict[bytes, tuple[int, int]]  # frequent tokens, their counts and classes
    log_size: np.ndarray  # log10 of each class's denominator
    tokens: int
    distinct: int

    @property
    def buckets(self) -> int:
        return len(self.weights) // len(FEATURES)

    def _sums(self, contexts: list[np.ndarray]) -> np.ndarray:
        """The bias and the contexts' weights, a row for each token."""
        z = self.weights.take(contexts[0], axis=0)
        for c in contexts[1:]:
            z += self.weights.take(c, axis=0)
        z += self.bias
        return z

    def log_classes(self, contexts: list[np.ndarray]) -> np.ndarray:
        """The classes' log probabilities (base e), a row for each token."""
        z = self._sums(contexts)
        # Weights are bounded (``update``), so the powers are too; a product sums rows faster than a sum does.
        z -= np.log(np.exp(z) @ np.ones(CLASSES, z.dtype))[:, None]
        return z

    def log_class(self, contexts: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        """Of each token the log probability of its own class; few rows at once, so that they stay in the cache."""
        out, ones = np.empty(len(cls), np.float32), np.ones(CLASSES, np.float32)
        for a in range(0, len(cls), CACHE_ROWS):
            z = self._sums([c[a : a + CACHE_ROWS] for c in contexts])
            own = z[np.arange(len(z)), cls[a : a + CACHE_ROWS]]
            out[a : a + CACHE_ROWS] = own - np.log(np.exp(z, out=z) @ ones)
        return out

    def rest(self, texts: list[str], words: Words, grid: np.ndarray) -> None:
        """Adds to ``grid`` (1 + classes, contexts + 1) each context's tokens and observed less expected classes; the bias's are last."""
        for ids, places, _ in _pieces(texts, words):
            self.add_rest(_contexts(ids, places, words, self.buckets), words.cls[ids[places]], grid)

    def add_rest(self, contexts: list[np.ndarray], cls: np.ndarray, grid: np.ndarray) -> None:
        """``rest`` of tokens by their contexts and classes."""
        size = self.buckets
        if not self.weights.any():  # all tokens have the same expected classes, so the observed ones are counted
            share = np.exp(self.log_classes([np.zeros(1, np.int64)] * len(contexts))[0].astype(np.float64))
            for k, c in enumerate(contexts):
                own = slice(k * size, (k + 1) * size)
                seen = np.bincount((c - k * size) * CLASSES + cls, minlength=size * CLASSES).reshape(size, CLASSES)
                n = seen.sum(axis=1, keepdims=True)
                grid[0, own] += n[:, 0]
                grid[1:, own] += (seen - n * share).T
            grid[0, -1] += len(cls)
            grid[1:, -1] += np.bincount(cls, minlength=CLASSES) - len(cls) * share
            return
        rest, ones = np.empty((CLASSES, len(cls))), np.ones(CLASSES, np.float32)
        for a in range(0, len(cls), CACHE_ROWS):
            z = self._sums([c[a : a + CACHE_ROWS] for c in contexts])
            np.exp(z, out=z)
            z *= (-1 / (z @ ones))[:, None]
            rest[:, a : a + CACHE_ROWS] = z.T
        rest[cls, np.arange(len(cls))] += 1
        grid[0, -1] += len(cls)
        grid[1:, -1] += rest.sum(axis=1, dtype=np.float64)
        for k, c in enumerate(contexts):
            own = slice(k * size, (k + 1) * size)
            c = c - k * size
            grid[0, own] += np.bincount(c, minlength=size)
            for j in range(CLASSES):
                grid[1 + j, own] += np.bincount(c, rest[j], size)

    def update(self, sums: np.ndarray, turn: int) -> None:
        """One step up the likelihood from sums as ``rest`` makes them, in the scale of each context's size."""
        share = np.exp(self.bias - self.bias.max(), dtype=np.float64)
        share /= share.sum()
        size, gain = sums[0][:, None], sums[1:].T
        if turn == 0:
            # At zero weights the sums say which classes were seen: the contexts' own smoothed log ratios, in part.
            seen = np.maximum(gain[:-1] + size[:-1] * share, 0)
            start = START_SHARE * np.log((seen + PRIOR * share) / (size[:-1] + PRIOR) / share)
            self.weights = np.ascontiguousarray(np.clip(start, -MOST, MOST), np.float32)  # a context's row in one piece
            return
        # Every token has all features at once, so a context's own step is divided among them.
        step = STEP / turn**0.5 * gain / (share * (size + PRIOR)) / len(FEATURES)
        self.weights = np.ascontiguousarray(np.clip(self.weights + np.clip(step[:-1], -1, 1), -MOST, MOST), np.float32)
        self.bias = (self.bias + np.clip(step[-1], -1, 1)).astype(np.float32)


def _documents(docs: DataFrame, doc_id: str, text: str, mod: int, held: int) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(F.col(doc_id), mod) == held).alias("held_out"), text_or_empty(text).alias("text"))


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, n): counts of the tokens, several rows a token."""

    def run(batches):
        words, seen = Words(), np.zeros(1, np.int64)

        def counted():
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array([words.names[i] for i in at.tolist()], pa.binary()), pa.array(seen[at])], ["token", "n"])

        for batch in rebatched(batches):
            split = [tokens_of(t) for t in batch.column(0).to_pylist()]
            now = np.bincount(np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64))
            now[: len(seen)] += seen[: len(now)]
            seen = np.concatenate([now, seen[len(now) :]])
            if words.full:
                yield counted()
                words.start()
                seen = np.zeros(1, np.int64)
        yield counted()

    return train.select("text").mapInArrow(run, "token binary, n long")


def gradient(train: DataFrame, model: Model, head) -> np.ndarray:
    """The sums of ``Model.rest`` over every document of ``train``; a row for each context reaches the driver.

    ``head`` is the broadcast of the frequent tokens: sent once, while the weights go with each update.
    """
    contexts = len(model.weights) + 1
    shared = train.sparkSession.sparkContext.broadcast(replace(model, head={}))

    def run(batches):
        local = shared.value
        words, grid = Words(head.value), np.zeros((1 + CLASSES, contexts))
        for batch in rebatched(batches):
            local.rest(batch.column(0).to_pylist(), words, grid)
            if words.full:
                words.start()
        at = np.flatnonzero(grid[0])
        flat = pa.array(np.ascontiguousarray(grid[:, at].T, np.float32).ravel())
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * (1 + CLASSES))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], ["context", "v"])

    rows = train.select("text").mapInArrow(run, "context int, v array<float>")
    sums = rows.groupBy("context").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(1 + CLASSES)]).alias("v"))
    out = np.zeros((1 + CLASSES, contexts))
    for r in sums.toArrow().to_batches():
        out[:, r.column("context").to_numpy()] = r.column("v").flatten().to_numpy().reshape(-1, 1 + CLASSES).T
    return out


def start_model(head: list[tuple[bytes, int]], sizes: dict[int, tuple[int, int]]) -> Model:
    """A model without weights, from the frequent tokens' counts and (tokens, words) of the other tokens by class."""
    cls = classes_of(head)
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (tokens, words) in sizes.items():
        n[k] += tokens
        v[k] += words
    for w, c in head:
        n[cls.get(w, 0)] += c
        v[cls.get(w, 0)] += 1
    share = (n + 1) / (n + 1).sum()
    weights = np.zeros((len(FEATURES) * buckets_of(int(n.sum())), CLASSES), np.float32)
    known = {w: (c, cls.get(w, 0)) for w, c in head}
    return Model(np.log(share).astype(np.float32), weights, known, np.log10(n + v + 1), int(n.sum()), int(v.sum()))


def _class_column(token: Column) -> Column:
    """``class_of`` in SQL."""
    size = F.octet_length(token)

    def byte(at: Column) -> Column:
        return F.conv(F.hex(F.substring(token, at, F.lit(1))), 16, 10).cast("int")

    two = byte(size) * 31 + F.when(size > 1, byte(size - 1)).otherwise(0) * 7
    return F.when(token == F.lit(bytearray(END)), 0).otherwise(1 + FREQUENT + two % SPELLED)


def _turn(columns: list[str], rounds: int) -> Column:
    """The gradient update that a row takes part in."""
    return F.pmod(F.xxhash64(*columns), F.lit(max(1, rounds)))


def start(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model without weights of the rows of ``train`` (column text), and the table (token, n) of all their tokens."""
    small_batches(train.sparkSession)
    counts = materialize(count_tokens(train).groupBy("token").agg(F.sum("n").alias("n")), "lm-tokens")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * HEAD_SHARE >= total
    head = [(bytes(r.token), r.n) for r in counts.where(frequent).collect()]
    other = counts.where(~frequent).groupBy(_class_column(F.col("token")).alias("cls")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    return start_model(head, {r.cls: (r.n, r.v) for r in other.collect()}), counts


def fit(train: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the rows of ``train`` (column text), and the table (token, n) of all their tokens.

    The counts are of all rows. Each gradient update takes the rows whose hash falls to it, so all rows
    take part once, and the updates together cost one pass over the texts. A model of several shards
    is in no one place; only ``score`` can use it.
    """
    model, counts = start(train)
    if shards_of(model.tokens) > 1:
        raise ValueError("the contexts are too many for one model; score() deals them out in shards")
    return learn(train, model, rounds), counts


def learn(train: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``model`` after the gradient updates, its weights broadcast with each."""
    train = train.withColumn("part", _turn(train.columns, rounds))
    known = train.sparkSession.sparkContext.broadcast(model.head)
    tasks = max(1, train.rdd.getNumPartitions() // rounds) if rounds else 1
    for turn in range(rounds if model.tokens else 0):
        # Fewer tasks, as each reads but a part: every task sends a row for each context.
        model.update(gradient(train.coalesce(tasks).where(F.col("part") == turn), model, known), turn)
    return model


def _dealt(rows: DataFrame, shared, shards: int, most: int) -> DataFrame:
    """(shard, base, n, blob): every token's contexts, class, update and document, packed by window (base) and shard.

    A row with a shard below 0 holds the keys of the window's documents.
    """
    names = ["shard", "base", "n", "blob"]

    def run(batches):
        m = shared.value
        words, codec = Words(m.head), pa.Codec("zstd", compression_level=1)
        keys, parts, held, base = [], [], 0, None

        def window():
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(columns[0].astype(np.uint16) if shards <= 1 << 16 else columns[0], kind="stable")
            shard, *columns = (x[order] for x in columns)
            at = np.flatnonzero(np.diff(shard, prepend=shard[0] + np.uint32(1)))
            found, ends = shard[at], np.append(at[1:], len(shard))
            blobs = [codec.compress(b"".join(x[a:b].tobytes() for x in columns), asbytes=True) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            found, n = [*found.tolist(), -1 - base % shards], [*(ends - at).tolist(), len(keys)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([base] * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array([*blobs, b"".join(keys)], pa.binary())], names)

        for batch in rebatched(batches):
            if base is None:
                base = batch.column("base")[0].as_py()
            own, turns, first = batch.column("key").to_pylist(), batch.column("turn").to_numpy(), len(keys)
            keys += own
            for ids, places, owner in _pieces(batch.column("text").to_pylist(), words):
                contexts = [(c - k * m.buckets).astype(np.uint16) for k, c in enumerate(_contexts(ids, places, words, m.buckets))]
                tag = (words.cls[ids[places]] | turns[owner] << 5).astype(np.uint8)
                parts.append([_shards(ids, places, words, shards, most), *contexts, (owner + first).astype(np.uint16), tag])
                held += len(places)
                if held >= WINDOW_TOKENS:  # the batch's documents may go on in the next window
                    yield window()
                    keys, parts, held, base, first = [*own], [], 0, base + 1, 0
            if len(keys) >= WINDOW_DOCS:
                if parts:
                    yield window()
                keys, parts, held, base = [], [], 0, base + 1
            if words.full:
                words.start()
        if parts:
            yield window()

    return rows.mapInArrow(run, "shard int, base long, n int, blob binary")


def _unpacked(blob: bytes, n: int, buckets: int, codec) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, document in the window, class, update) of the tokens of a blob."""
    width = 2 * len(FEATURES) + 3
    flat = codec.decompress(blob, decompressed_size=width * n, asbytes=True)
    twos = np.frombuffer(flat, np.uint16, (len(FEATURES) + 1) * n).reshape(-1, n)
    tag = np.frombuffer(flat, np.uint8, n, (width - 1) * n)
    return [c.astype(np.int64) + k * buckets for k, c in enumerate(twos[:-1])], twos[-1], (tag & 31).astype(np.int64), tag >> 5


def _shard_model(blobs: list[tuple[int, int, bytes]], model: Model, rounds: int, codec) -> Model:
    """The model of a shard, from its tokens (base, n, blob); the blobs stay packed, so that few tokens lie open."""
    own = replace(model, weights=np.zeros_like(model.weights))
    for turn in range(rounds):
        grid, wait, held = np.zeros((1 + CLASSES, len(own.weights) + 1)), [], 0
        for no, (_, n, blob) in enumerate(blobs, 1):
            contexts, _, cls, turns = _unpacked(blob, n, own.buckets, codec)
            at = np.flatnonzero(turns == turn)
            wait.append([*(c[at] for c in contexts), cls[at]])
            held += len(at)
            if held >= STEP_TOKENS or no == len(blobs):
                *contexts, cls = (np.concatenate(x) for x in zip(*wait, strict=True))
                own.add_rest(contexts, cls, grid)
                wait, held = [], 0
        own.update(grid, turn)
    return own


def shard_log_classes(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> DataFrame:
    """(key, class_log, n): of the documents with a key the log10 probability of their classes, and their tokens.

    ``rows`` has key, text, turn (the update a document takes part in; ``rounds``: none) and base (a number
    for its partition, with room above it). The tokens are dealt out by shard; a shard's model is learnt and
    used where its tokens are, so no weights are sent. Equal keys are equal texts and are summed.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    shards = shards_of(model.tokens)
    kinds = [("base", pa.int64()), ("doc", pa.binary()), ("v", pa.binary()), ("n", pa.binary()), ("keys", pa.binary())]

    def learnt(batches):
        m, codec = shared.value, pa.Codec("zstd")
        made, schema = [], pa.schema(kinds)

        def scored(blobs):
            own = _shard_model(blobs, m, rounds, codec)
            for at in range(0, len(blobs), 64):
                out = []
                for base, n, blob in blobs[at : at + 64]:
                    contexts, doc, cls, _ = _unpacked(blob, n, own.buckets, codec)
                    count = np.bincount(doc)
                    there = np.flatnonzero(count)
                    v = np.bincount(doc, own.log_class(contexts, cls))[there] / np.log(10)
                    out.append((base, there.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes(), count[there].astype(np.uint32).tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        now = None
        for batch in batches:
            for shard, base, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard < 0:
                    yield pa.RecordBatch.from_pylist([{"base": base, "keys": blob}], schema)
                    continue
                if shard != now and made:
                    yield from scored(made)
                    made.clear()
                now = shard
                made.append((base, n, blob))
        if made:
            yield from scored(made)

    def summed(batches):
        now, keys, v, n = None, b"", np.zeros(1 << 16), np.zeros(1 << 16, np.int64)

        def out():
            size = len(keys) // 16
            at = np.flatnonzero(n[:size])
            return pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in at.tolist()], pa.binary()), pa.array(v[at]), pa.array(n[at])], ["key", "class_log", "n"])

        for batch in batches:
            for base, doc, part, count, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base != now:
                    if now is not None:
                        yield out()
                    now = base
                    v[:], n[:] = 0, 0
                if own is not None:
                    keys = own
                else:
                    at = np.frombuffer(doc, np.uint16)
                    v[at] += np.frombuffer(part, np.float32)
                    n[at] += np.frombuffer(count, np.uint32)
        if now is not None:
            yield out()

    most = int(HOT_SHARE * SHARD_BUCKETS * BUCKET_TOKENS)
    dealt = _dealt(rows, shared, shards, most).repartitionById(shards, F.pmod("shard", F.lit(shards))).sortWithinPartitions("shard", "base")
    sums = dealt.mapInArrow(learnt, "base long, doc binary, v binary, n binary, keys binary")
    # In the order of a window's parts, so that sums are the same each time.
    sums = sums.repartition("base").sortWithinPartitions("base", "doc", "v")
    return sums.mapInArrow(summed, "key binary, class_log double, n long").groupBy("key").agg(F.sum("class_log").alias("class_log"), F.sum("n").alias("n"))


def score(docs: DataFrame, mod: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Learns from the rows whose crc32 of the id, modulo ``mod``, is not ``held``. A null text is the
    empty text, of one token, the end; a null id counts as the empty id. Repeated rows count each
    time and each get a row. Without a training row all counts are 0 and the class model is uniform.
    The model's probability of a token is its class's, given the words before, times the smoothed
    share of the token in its class; a token never seen has a place in the class that its spelling
    gives. Frequent counts are broadcast; all others are joined, so that every token counts. Contexts
    are as many as the training tokens ask for: few are broadcast, many are dealt out with the tokens
    that need them (``shard_log_classes``), and every token is then learnt and scored there. Texts of
    any length are read in pieces; extra columns are not read, whatever they are called.
    """
    small_batches(docs.sparkSession)
    rows = _documents(docs, doc_id, text, mod, held)
    train = rows.where("not held_out").select("doc_id", "text")
    model, counts = start(train)
    dealt = shards_of(model.tokens) > 1
    base = F.shiftleft(F.spark_partition_id().cast("long"), 36)
    key = F.unhex(F.md5("text")) if dealt else F.lit(None).cast("binary")
    if dealt:
        turn = F.when(F.col("held_out"), ROUNDS).otherwise(_turn(train.columns, ROUNDS)).cast("long")
        classes = materialize(shard_log_classes(rows.select(key.alias("key"), "text", turn.alias("turn"), base.alias("base")), model), "lm-classes")
    else:
        model = learn(train, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = rows.select("doc_id", "held_out", base.alias("part"), "text", key.alias("key"))
    names = ["doc", "key", "doc_id", "held_out", "token", "times", "n_tokens", "head_known", "head_log", "class_log"]

    def run(batches):
        m, no = shared.value, 0
        words = Words(m.head)
        for batch in rebatched(batches):
            texts = batch.column("text").to_pylist()
            n, k, s, c = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            tails = []
            for ids, places, owner in _pieces(texts, words):
                own = ids[places]
                cls = words.cls[own]
                lp = -m.log_size[cls]
                if not dealt:
                    lp += m.log_class(_contexts(ids, places, words, m.buckets), cls) / np.log(10)
                ll = words.log[own]
                known = ll >= 0
                n += np.bincount(owner, minlength=len(texts))
                k += np.bincount(owner[known], minlength=len(texts))
                s += np.bincount(owner[known], ll[known], len(texts))
                c += np.bincount(owner, lp, len(texts))
                tails.append(owner[~known].astype(np.int64) << 32 | own[~known])
            codes, times = np.unique(np.concatenate(tails), return_counts=True)
            doc = batch.column("part").to_numpy() + no + np.arange(len(texts))
            none = pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), batch.column("key"), batch.column("doc_id"), batch.column("held_out"), *none, pa.array(n), pa.array(k), pa.array(s), pa.array(c)], names)
            if len(codes):
                token = pa.array([words.names[w] for w in (codes & 0xFFFFFFFF).tolist()], pa.binary())
                kinds = (pa.binary(), batch.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                none = [pa.nulls(len(codes), t) for t in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(doc[codes >> 32]), *none[:3], token, pa.array(times.astype(np.int64)), *none[3:]], names)
            no += len(texts)
            if words.full:
                words.start()

    schema = f"doc long, key binary, doc_id {kind}, held_out boolean, token binary, times long, n_tokens long, head_known long, head_log double, class_log double"
    made = materialize(keyed.mapInArrow(run, schema), "lm-scores")
    tail = counts.where(F.col("n") * HEAD_SHARE < model.tokens).select(F.col("token").alias("t"), "n")
    # A token that is not there adds nothing, so an inner join finds all that do; documents are not joined.
    rare = made.where("token is not null").select("doc", "token", "times")
    found = rare.join(tail, rare["token"] == tail["t"]).groupBy("doc").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    per = made.where("token is null").drop("token", "times").join(found.withColumnRenamed("doc", "__doc"), F.col("doc") == F.col("__doc"), "left")
    class_log = F.col("class_log")
    if dealt:
        classes = classes.select(F.col("key").alias("__key"), F.col("class_log").alias("dealt_log"), F.col("n").alias("dealt_n"))
        per = per.join(classes, F.col("key") == F.col("__key"))
        # Equal texts were summed under one key; each has its share.
        class_log += F.col("dealt_log") * F.col("n_tokens") / F.col("dealt_n")
    log = F.col("head_log") + F.coalesce("log", F.lit(0.0))
    size = float(np.log10(model.tokens + model.distinct + 1))
    return per.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (log - F.col("n_tokens") * size).alias("base_score"),
        (log + class_log).alias("score"),
    )
