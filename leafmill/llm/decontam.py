"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance (operator 5)."""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import rebatched, small_batches, text_or_empty

#: An item leaks if a window of its number of words is within this share of word edits.
EDIT_SHARE = 0.2
#: Independent walks and output positions sampled in each: P(found) = 1 - (1 - p^samples)^walks, where p is
#: the share of equal output positions. In simulations of windows at the edit limit (substitutions, insertions
#: and deletions) p is 0.54 for 15 words, 0.40 for 59, 0.33 for 100, 0.25 for 200, 0.19 for 400 and 0.14 for 800.
#: The samples and walks of each size keep P(found) at 99 % there (38 walks needed for 100 words, 58 for 200,
#: 206 for 800). Copies with few edits are found all but surely.
WALKS, SAMPLES = 28, 3
SHORT, MEDIUM = 16, 48
#: Items are searched by pieces of at most this many words, each with windows of its own size: an item within the
#: limit has a piece within it.
LONGEST = 160
#: Items broadcast at once, and their bytes; a larger benchmark is searched block by block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Words searched together, and (where there are several blocks) bytes of text that are held for all of them.
SEARCH_WORDS, HELD_BYTES = 1 << 18, 8 << 20
#: Rows of the table that says how walks move; words share them by their number.
MOVE_ROWS = 4096

_PUNCT = string.punctuation.encode()
_FILTER_BITS = 20


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return " ".join(text.split()).lower().encode("utf-8", "surrogatepass").translate(None, _PUNCT).split()


def places_of(a: list) -> dict:
    """For each symbol of a sequence a number with a bit set at each of its places."""
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edit_distance(a: list, b: list, most: int, places: dict | None = None) -> int:
    """The exact edit distance of two sequences, or most + 1 if it is larger.

    Bit-parallel: a column of the table is two long numbers, the places where its values rise and fall,
    so a step costs a few operations on them. ``places`` are those of ``a``, if they are known.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m:
        return n
    get, full, last = (places if places is not None else places_of(a)).get, (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, left = full, 0, m, n
    for x in b:
        equal = get(x, 0)
        zero = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        up, down = fall | (full ^ (zero | rise)), zero & rise
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        left -= 1
        if score - left > most:  # each symbol left takes off one at best
            return most + 1
        up = (up << 1 | 1) & full
        rise, fall = (down << 1 & full) | (full ^ (zero | up)), up & zero
    return score


def _mix(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.asarray(salt).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def samples_of(n: int) -> int:
    return SAMPLES if n < SHORT else SAMPLES - 1


def walks_of(n: int) -> int:
    return WALKS if n < MEDIUM else 16 + n // 4


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """Whether a word moves a walk's pointer at a step: 64 steps in a number, by block of steps, walk and word.

    Of one size whatever the items are; the same in every process.
    """
    blocks, walks = 2 * LONGEST // 64 + 1, max(WALKS, walks_of(LONGEST))
    salt = 1_000_003 * (np.arange(walks)[None, :, None] + 1) + 7919 * np.arange(blocks)[:, None, None]
    return _mix(np.broadcast_to(np.arange(MOVE_ROWS), (blocks, walks, MOVE_ROWS)), salt).reshape(blocks, -1)


@lru_cache(maxsize=4 * LONGEST)
def _spots(n: int) -> np.ndarray:
    """The output positions that each walk samples of an embedding of n words."""
    rng = np.random.default_rng([20_240_601, n])
    spots = np.zeros((2 * n, walks_of(n)), bool)
    for w in range(walks_of(n)):
        spots[rng.choice(2 * n, min(samples_of(n), 2 * n), replace=False), w] = True
    return spots


def pieces_of(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item of n words, of sizes as even as can be."""
    parts = -(-n // LONGEST)
    bounds = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


class Index:
    """The items of one block: their words, a filter on word pairs, and sorted keys of sampled embeddings.

    Equal items are one; sizes are those of the items' words and of a fixed number of keys a piece.
    """

    def __init__(self, items: list[tuple[int, str]]):
        equal: dict[tuple[bytes, ...], list[int]] = {}
        for i, t in items:
            if w := words_of(t or ""):
                equal.setdefault(tuple(w), []).append(i)
        self.items = list(equal.values())
        self.vocab: dict[bytes, int] = {}
        self.ids = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64) for w in equal]
        self.sets = [frozenset(ids.tolist()) for ids in self.ids]
        pieces = [(item, at, n) for item, ids in enumerate(self.ids) for at, n in pieces_of(len(ids))]
        self.piece = np.array([(item, at) for item, at, _ in pieces], np.int64).reshape(-1, 2)
        by_size: dict[int, list[int]] = defaultdict(list)
        for p, (_, _, n) in enumerate(pieces):
            by_size[n].append(p)
        self.sizes = sorted(by_size)
        # For each hashed word pair a bit for the sizes of the pieces that hold it (sizes 64 apart share one).
        self.pairs = np.zeros(1 << _FILTER_BITS, np.uint64)
        #: Of each size the keys of its pieces' walks in order, and each key's piece.
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, n in enumerate(self.sizes):
            rows = np.array([self.ids[pieces[p][0]][pieces[p][1] :][:n] for p in by_size[n]])
            self.pairs[self._pair(rows[:, :-1], rows[:, 1:]).ravel()] |= np.uint64(1 << at % 64)
            keys = np.concatenate([self.embed(rows[a : a + 4096]) for a in range(0, len(rows), 4096)], axis=1)
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys[n] = keys.ravel()[order], np.array(by_size[n], np.int32)[order % len(rows)]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << _FILTER_BITS) - 1)

    @staticmethod
    def embed(windows: np.ndarray) -> np.ndarray:
        """For each walk the sampled positions of the windows' CGK embeddings, as one number each.

        A walk copies the word under its pointer to the output and moves on or stays, as a random
        function of the step and the word says; so two strings fall back into step after an edit.
        """
        rows, n = windows.shape
        walks, table = walks_of(n), _moves()
        words = np.concatenate([windows, np.zeros((rows, 1), np.int64)], axis=1).astype(np.int32)
        low = words & (MOVE_ROWS - 1)
        words, low = words.ravel(), low.ravel()
        line = (np.arange(rows, dtype=np.int32) * (n + 1))[None, :]
        own = (np.arange(walks, dtype=np.int32) * MOVE_ROWS)[:, None]
        end = line + n
        pointer = np.repeat(line, walks, axis=0)
        spots = _spots(n)
        picked = np.zeros((min(samples_of(n), 2 * n), walks, rows), np.uint64)
        taken = np.zeros(walks, np.int64)
        for step in range(int(np.flatnonzero(spots.any(axis=1))[-1]) + 1):
            if len(at := np.flatnonzero(spots[step])):
                picked[taken[at], at] = words.take(pointer[at])
                taken[at] += 1
            moves = table[step >> 6].take(low.take(pointer) + own)
            pointer += ((moves >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int32)
            np.minimum(pointer, end, out=pointer)
        key = np.repeat(_mix(np.arange(walks), 77)[:, None], rows, axis=1)  # keys of different walks are different
        for k, sample in enumerate(picked):
            key = _mix(key * np.uint64(31) + sample, k)
        return key

    def candidates(self, ids: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, text, start of the item) for windows that share embedding keys with a piece, those of most keys first.

        Texts begin at ``begins`` in ``ids``, which ends in padding. A window within k word edits of a piece of n words keeps at least
        n - 1 - 2 k of its word pairs, so windows with fewer pairs of pieces of that size are passed
        over: none of them can match.
        """
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        masks = self.pairs[self._pair(ids[both], ids[both + 1])]
        hits, masks = both[masks > 0], masks[masks > 0]
        found: list[np.ndarray] = []
        for at, n in enumerate(self.sizes):
            k = int(EDIT_SHARE * n)
            least = n - 1 - 2 * k
            if least > 0:
                own = hits[(masks >> np.uint64(at % 64)) & np.uint64(1) > 0]
                low, high = own[: max(0, len(own) - least + 1)], own[least - 1 :]
                dense = high - low <= n - 2
                if not dense.any():
                    continue
                # The starts whose window covers so many pairs in a row.
                first, last = np.maximum(high[dense] - (n - 2), 0), low[dense]
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
            else:
                starts = np.flatnonzero(ids > 0)
            starts = starts[starts + n <= len(ids)]
            keys, owner = self.keys[n]
            for i in range(0, len(starts), 2048):
                some = starts[i : i + 2048]
                windows = ids[some[:, None] + np.arange(n)]
                close = (windows > 0).sum(axis=1) >= n - k
                if not close.any():
                    continue
                some, made = some[close], self.embed(windows[close])
                left = np.searchsorted(keys, made, "left")
                times = np.searchsorted(keys, made, "right") - left
                _, row = hit = np.nonzero(times)
                times, left = times[hit], left[hit]
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item, offset = self.piece[owner[np.repeat(left, times) + inside]].T
                found.append(np.stack([item, np.repeat(some[row], times) - offset, np.repeat(some[row], times)]))
        if not found:
            return []
        item, start, place = np.concatenate(found, axis=1)
        text = np.searchsorted(begins, place, "right") - 1
        (item, text, start), keys = np.unique(np.stack([item, text, start]), axis=1, return_counts=True)
        order = np.lexsort((start, text, item, -keys))
        start = np.maximum(start, begins[text])  # an item that would begin before its text is tried at its first word
        return list(zip(item[order].tolist(), text[order].tolist(), start[order].tolist(), strict=True))

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """For each text the items that leak into it, each with its closest window (the first of equal ones).

        Of an item of several pieces it is the window that most of their keys point at.
        """
        if not self.sizes:
            return [[] for _ in texts]
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        split, held, first = [], 0, 0
        for i, t in enumerate(texts):
            split.append(words_of(t))
            held += len(split[-1])
            if held >= SEARCH_WORDS or i == len(texts) - 1:
                self._search(split, best[first : i + 1])
                split, held, first = [], 0, i + 1
        out = []
        for b in best:
            found = [(i, at) for at in b for i in self.items[at]]
            out.append([{"item_id": i, "start_word": b[at][1], "n_words": len(self.ids[at]), "edits": b[at][0]} for i, at in sorted(found)])
        return out

    def _search(self, split: list[list[bytes]], best: list[dict[int, tuple[int, int]]]) -> None:
        gap, get = np.zeros(self.sizes[-1] + 1, np.int64), self.vocab.get
        parts, starts, at = [], [], 0
        for words in split:
            parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), gap]
            starts.append(at)
            at += len(words) + len(gap)
        ids = np.concatenate(parts)
        places: dict[int, dict] = {}
        tried: set[tuple[int, int]] = set()
        for item, text, start in self.candidates(ids, np.array(starts)):
            n, end = len(self.ids[item]), starts[text] + len(split[text])
            limit, seen = int(EDIT_SHARE * n), best[text].get(item)
            if start >= end or (item, start) in tried or (seen and (seen[0] == 0 or n > LONGEST)):
                continue
            tried.add((item, start))
            window = ids[start : min(end, start + n)].tolist()
            if len(self.sets[item].difference(window)) > limit:  # each missing word costs an edit
                continue
            # A window as close as the best one counts if it begins before it.
            most = limit if seen is None else seen[0] - (start - starts[text] > seen[1])
            if item not in places:
                places = {item: places_of(self.ids[item].tolist())}
            if (d := edit_distance(self.ids[item], window, most, places[item])) <= most:
                best[text][item] = (d, start - starts[text])


MATCH = "array<struct<item_id:bigint,start_word:int,n_words:int,edits:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("edits", pa.int32())]))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items block by block, each block within ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` (or one item)."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), text_or_empty(text).alias("t")).where("i is not null").toLocalIterator():
        own = len(r.t.encode("utf-8", "surrogatepass"))
        if block and (len(block) == BLOCK_ITEMS or size + own > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += own
    if block:
        yield block


def _held(batches, place: int, most: int):
    """Lists of batches of up to ``most`` bytes of text (or one batch)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(place).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks") -> DataFrame:
    """Adds ``into``: the benchmark items that a text holds, as (item_id, start_word, n_words, edits).

    An item leaks if a window of as many words (lower-cased, without ASCII punctuation) is within
    ``EDIT_SHARE`` word edits, rounded down; items of under five words have to be equal. Every row
    keeps its columns and gives one row; a null or empty text, and an empty benchmark, give an empty
    list. Items without words or id are not searched for; of equal items each is reported. Repeated
    rows each have their list; texts and items of any length are searched whole, items of over
    ``LONGEST`` words by their pieces. A column called like ``into`` is replaced. Nothing is shuffled:
    each block of items is sent to all tasks, and a task holds one block's index at a time.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    place = [c.lower() for c in rows.columns].index(text.lower())
    shared = [docs.sparkSession.sparkContext.broadcast(Index(block)) for block in blocks(benchmark)]
    if not shared:
        return rows.withColumn(into, F.array().cast(MATCH))

    def run(batches):
        turn = 0
        for held in _held(rebatched(batches), place, HELD_BYTES if len(shared) > 1 else 0):
            texts = [[t or "" for t in batch.column(place).to_pylist()] for batch in held]
            found: list[list[list[dict]]] = [[[] for _ in t] for t in texts]
            # To and fro, so that the block used last is used again; all others are let go.
            for k in range(len(shared)) if turn % 2 == 0 else range(len(shared) - 1, -1, -1):
                index = shared[k].value
                for t, f in zip(texts, found, strict=True):
                    for one, new in zip(f, index.matches(t), strict=True):
                        one += new
                if k != (len(shared) - 1 if turn % 2 == 0 else 0):
                    vars(shared[k]).pop("_value", None)
            turn += 1
            for batch, f in zip(held, found, strict=True):
                ordered = [sorted(x, key=lambda m: m["item_id"]) for x in f]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ordered, _MATCH)], [*batch.schema.names, into])

    return rows.mapInArrow(run, f"{own}, `{into}` {MATCH}")


def leak_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits): a row for each item in each row of ``docs`` that holds it."""
    found = find_leaks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    into = "__leaks"
    return find_leaks(docs, benchmark, text, into).where(F.size(into) == 0).drop(into)
