"""BPE encoding and decoding with a minimal acyclic transducer as lexicon (operator 1)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, rebatched, small_batches, text_or_empty
from leafmill.llm.lexicon import compile_words, mapped

#: A pre-token enters the lexicon if at least one of so many pre-tokens of the corpus is it; so the
#: lexicon holds at most this many words, however large the corpus is.
LEXICON_SHARE = 50_000

#: Words kept in a worker's table before it is emptied, and in a counting table before it is sent on.
CACHE_WORDS = 400_000

# The library's white space is Python's without the four information separators.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


# Below this character texts are in normal form C and split the same in every Unicode version; the
# library's own normaliser and splitter handle all runs that go beyond it.
_PLAIN_END = "\u0130"
_PLAIN_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_NO_RANK = 1 << 30
#: Longer pre-tokens are merged one by one.
_SIDE_BY_SIDE = 64


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def chunks_of(text: str) -> list[str]:
    """The maximal runs without white space; no token crosses their bounds."""
    if _ODD.search(text):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merger:
    """Exact byte-pair merging by rank, with the word-end suffix of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = np.array([self.vocab[a + b] for a, b in pairs])
        keys = np.array([*self.rank, 1 << 50], np.int64)  # the last stands after every pair
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: p for p, i in [*self.vocab.items(), *self.special.items()]}
        self.pieces = [pieces.get(i, "").encode() for i in range(max(pieces) + 1)]
        self.normalizer, self.pre = library(path).normalizer, library(path).pre_tokenizer
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pre_tokens(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a run without white space; special tokens are given as their ids."""
        if (plain := chunk.isascii()) or max(chunk) < _PLAIN_END:
            low = chunk.lower()
            if low.isalpha():
                tokens = [low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                tokens = [low[:-1], low[-1]]
            elif "<|" in chunk:
                tokens = None
            else:
                tokens, plain = _PLAIN_WORD.findall(low), low.isprintable() and plain
            if tokens is not None:
                return tokens if plain else [t if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(_BYTE_CHARS) for t in tokens]
        out: list[str | int] = []
        parts = self.cut.split(chunk) if self.cut and "<|" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.normalizer.normalize_str(part)
                out += [t for t, _ in self.pre.pre_tokenize_str(norm)]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], _NO_RANK)

    def merge(self, tokens: list[str]) -> list[bytes]:
        """The ids of pre-tokens: the pair of the lowest rank first, the leftmost of equal ones.

        All tokens of about one length are merged side by side, a row each.
        """
        out: list[bytes] = [b""] * len(tokens)
        by_length = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        at = 0
        while at < len(by_length):
            longest = max(4, len(tokens[by_length[at]]) * 5 // 4)
            rows = []
            while at < len(by_length) and len(tokens[by_length[at]]) <= longest and (len(rows) + 1) * longest <= 1 << 20:
                rows.append(by_length[at])
                at += 1
            if not rows:  # one very long token alone
                rows, longest, at = [by_length[at]], len(tokens[by_length[at]]), at + 1
            if longest > _SIDE_BY_SIDE:
                for i in rows:
                    out[i] = self._merge_long(tokens[i])
                continue
            parts = np.full((len(rows), longest + 1), -1, np.int64)
            for r, i in enumerate(rows):
                t = tokens[i]
                parts[r, : len(t)] = [*map(self.vocab.__getitem__, t[:-1]), self.vocab[t[-1] + self.suffix]]
            for i, ids in zip(rows, self._merge_rows(parts), strict=True):
                out[i] = ids
        return out

    def _merge_rows(self, parts: np.ndarray) -> list[bytes]:
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        done: list[bytes] = [b""] * len(parts)
        row = np.arange(len(parts))
        while True:
            best = ranks.min(axis=1)
            if not (open_ := best != _NO_RANK).all():
                for r, p in zip(row[~open_], parts[~open_].astype("<i4"), strict=True):
                    done[r] = p[p >= 0].tobytes()
                row, parts, ranks, best = row[open_], parts[open_], ranks[open_], best[open_]
                if not len(row):
                    return done
            at, n, width = ranks.argmin(axis=1), np.arange(len(row)), ranks.shape[1]
            column = np.arange(width)
            parts[n, at] = self.merged[best]
            parts[:, 1:] = np.take_along_axis(parts, np.minimum(column + 1 + (column >= at[:, None]), width), axis=1)
            parts[:, -1] = -1
            ranks[:, :-1] = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            ranks[:, -1] = _NO_RANK
            ranks[n, at] = self._ranks(parts[n, at], parts[n, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[n, before] = np.where(at > 0, self._ranks(parts[n, before], parts[n, before + 1]), ranks[n, before])

    def _merge_long(self, token: str) -> bytes:
        """One long token: a heap of pairs over a linked list, so that the time stays near linear."""
        ids = [*map(self.vocab.__getitem__, token[:-1]), self.vocab[token[-1] + self.suffix]]
        nxt, prv, rank = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], self.rank.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], nxt[i] = int(self.merged[r]), -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if (q := rank(ids[i] << 20 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if prv[i] >= 0 and (q := rank(ids[prv[i]] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (q, prv[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


class Encoder(dict):
    """Chunk to its ids as little-endian bytes; filled from the lexicon, else by merging."""

    def __init__(self, path: str, blob: bytes):
        self.model, self.lexicon, self.words = merger(path), mapped(blob) if blob else None, {}

    def learn(self, chunks: set[str]) -> None:
        words, unseen, made = self.words, {}, []
        for chunk in chunks:
            tokens = self.model.pre_tokens(chunk)
            made.append((chunk, tokens))
            for t in tokens:
                if t not in words and t not in unseen:
                    if isinstance(t, int):
                        words[t] = t.to_bytes(4, "little")
                    elif self.lexicon and (known := self.lexicon.get(t.encode())) is not None:
                        words[t] = struct.pack(f"<{len(known)}I", *known)
                    else:
                        unseen[t] = None
        words.update(zip(unseen, self.model.merge(list(unseen)), strict=True))
        self.update((c, words[t[0]] if len(t) == 1 else b"".join([words[x] for x in t])) for c, t in made)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = [chunks_of(t) for t in texts]
        # Not by the difference of key views, which walks over the whole table.
        self.learn({c for c in set().union(*split) if c not in self})
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> bytes:
        """The pieces with a space between, as a vocabulary without a decoder is decoded."""
        return b" ".join(map(self.model.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def build_lexicon(docs: DataFrame, path: str, share: int = LEXICON_SHARE, text: str = "text") -> bytes:
    """The transducer of the pre-tokens in the frequent runs of ``docs``; at most ``share`` runs reach the driver."""
    runs = docs.select(F.explode(F.split(F.trim(text_or_empty(text)), r"\s+")).alias("run"))
    counts = materialize(runs.groupBy("run").agg(F.count("*").alias("n")), "runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") * share >= total).select("run")
    model = merger(path)
    words = {t for r in frequent.collect() for c in chunks_of(r.run) for t in model.pre_tokens(c) if isinstance(t, str)}
    ordered = sorted(words)
    ids = [np.frombuffer(b, "<u4").tolist() for b in model.merge(ordered)]
    return compile_words([(w.encode(), i) for w, i in zip(ordered, ids, strict=True)])


def encode_documents(docs: DataFrame, path: str, lexicon: bytes, text: str = "text", digest: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (string), or with ``digest`` only their digests.

    Every row keeps all its columns and gives one row. A null text is the empty text: no ids, and an
    empty decoded text. Repeated rows give repeated results; texts of any length are encoded whole.
    Columns that are called like an added one are replaced.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(lexicon)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"
    drop = [c.split()[0] for c in added.split(", ")]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in drop], text_or_empty(text).alias("__t"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), added])

    def run(batches):
        encoder = Encoder(path, blob.value)
        for batch in rebatched(batches):
            encoded = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
            n = pa.array([len(e) // 4 for e in encoded], pa.int64())
            if digest:
                made = [
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(e)).hexdigest() for e in encoded], pa.string()),
                ]
            else:
                made = [
                    pa.array([np.frombuffer(e, "<i4") for e in encoded], pa.list_(pa.int32())),
                    pa.array([encoder.decode(e).decode() for e in encoded], pa.string()),
                ]
            names = [*batch.schema.names[:-1], *drop]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n, *made], names)

    return kept.mapInArrow(run, schema)
