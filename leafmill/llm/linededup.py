"""Line dedup: shared rare line hashes, patience alignment, blocks cut from the later document (operator 8)."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import materialize, rebatched, small_batches, text_or_empty

#: Blocks of fewer words than this stay; a line of as many is a block by itself.
BLOCK_WORDS = 20

#: Texts whose hashes are held in Python at once.
SPLIT_ROWS = 32

#: Places of a run in a partner that are looked at where the later document has fewer of it.
PLACES = 16

#: A line has three words or more and ends after a newline, or after a sentence mark and one space, if
#: three words follow: passages recur inside lines, and shorter sentences belong to what comes next.
LINE = r"(?s)[ \t-\r]*+(?:[^ \t-\r]++[ \t-\r]++){2}[^ \t-\r].*?(?:(?:\n|[.!?] )(?=[ \t-\r]*+[^ \t-\r]++[ \t-\r]++[^ \t-\r]++[ \t-\r]++[^ \t-\r])|\z)|.++\z"
_LINE = re.compile(LINE.replace(r"\z", r"\Z"))


def lines_of(text: Column) -> Column:
    """A text's lines with what separates them; in a row they give the text again."""
    return F.regexp_extract_all(text, F.lit(LINE), 0)


def units_of(text: str, least: int = BLOCK_WORDS) -> list[tuple[int, int, list[int]]]:
    """(hash, lines, places): the different rare line hashes of a text and the line numbers where each begins.

    Single lines recur by chance; a rare hash is that of a shortest run of ``least`` words or more from a
    line on or up to one. Together they cover every line of any longer run, so a block that two
    documents share shows in its hashes, whoever holds parts of it. White space and case do not count.
    """
    split = [x.lower().encode("utf-8", "surrogatepass").split() for x in _LINE.findall(text)]
    lines, sizes = [b" ".join(x) for x in split], [len(x) for x in split]
    runs: set[tuple[int, int]] = set()
    end = total = 0
    for i, size in enumerate(sizes):
        while total < least and end < len(lines):
            total += sizes[end]
            end += 1
        if total < least:
            break
        runs.add((i, end))
        total -= size
    start = total = 0
    for end, size in enumerate(sizes, 1):
        total += size
        while total - sizes[start] >= least:
            total -= sizes[start]
            start += 1
        if total >= least:
            runs.add((start, end))
    places: dict[tuple[int, int], list[int]] = {}
    for i, end in sorted(runs):
        places.setdefault((xxhash.xxh3_64_intdigest(b"\n".join(lines[i:end])), end - i), []).append(i)
    return [(h, n, at) for (h, n), at in places.items()]


def _ascending(q: list[int]) -> list[int]:
    """Patience: the indexes of a longest strictly ascending part of ``q``."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(q)
    for i, x in enumerate(q):
        at = bisect_left(piles, x)
        back[i] = tops[at - 1] if at else -1
        if at == len(piles):
            piles.append(x)
            tops.append(i)
        else:
            piles[at], tops[at] = x, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_blocks(p, q, words, least: int = BLOCK_WORDS) -> list[tuple[int, int, int, bool]]:
    """(first, last, there, moved) of the blocks that a document shares with an earlier one, in the order of its lines.

    Row i says that line p[i] of the later document equals line q[i] of the earlier one. Rows in step on
    both sides are a block if they have ``least`` words or more. Lines that stand in one row alone are
    the anchors; a longest ascending row of them aligns the two texts, and blocks without such an anchor
    are moved or repeated ones. The time is that of sorting the rows.
    """
    p, q, words = np.asarray(p, np.int64), np.asarray(q, np.int64), np.asarray(words)
    order = np.lexsort((p, p - q))
    p, q, words = p[order], q[order], words[order]
    block = np.concatenate([np.zeros(min(1, len(p)), int), np.cumsum((np.diff(p - q) != 0) | (np.diff(p) != 1))])
    kept = (np.bincount(block, words) >= least)[block]
    p, q, block = p[kept], q[kept], block[kept]
    if not len(p):
        return []
    begins = np.concatenate([[True], np.diff(block) != 0])
    once = (np.bincount(p)[p] == 1) & (np.bincount(q)[q] == 1)
    if not once.any():
        once = begins  # no line stands alone: the blocks' first lines
    rows = np.flatnonzero(once)
    rows = rows[np.lexsort((q[rows], p[rows]))]
    inside = set(block[rows[_ascending(q[rows].tolist())]].tolist())
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(p)) - 1
    return sorted((int(p[a]), int(p[b]), int(q[a]), int(block[a]) not in inside) for a, b in zip(starts, ends, strict=True))


def _line_pairs(shared: list[tuple[list[int], list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of equal lines in the common runs (places in the later document, in the earlier one, lines).

    A run's k-th place goes with the k-th there, or with the last; where that is out of step with the
    line before and another place there is not, with that one.
    """
    rows, step = [], None
    for p, there, k, n in sorted((p, there, k, n) for at, there, n in shared for k, p in enumerate(at)):
        q = there[min(k, len(there) - 1)]
        if step is not None and p - q != step:
            near = bisect_left(there, p - step)
            if near < len(there) and there[near] == p - step:
                q = p - step
        step = p - q
        rows.append((p, q, n))
    p, q, n = np.array(rows, np.int64).T
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(np.stack([np.repeat(p, n) + inside, np.repeat(q, n) + inside], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _blocks_with(runs: list[tuple[list[int], list[int], int]], least: int) -> list[tuple[int, int, int, bool]]:
    """The blocks shared with one partner; runs that follow each other in step are one block without more ado."""
    if all(len(at) == len(there) == 1 for at, there, _ in runs):
        rows = sorted((at[0], there[0], n) for at, there, n in runs)
        first, start, n = rows[0]
        end = first + n
        for p, q, n in rows:
            if p - q != first - start or p > end:
                break
            end = max(end, p + n)
        else:
            return [(first, end - 1, start, False)]
    p, q = _line_pairs(runs)
    # Each pair lies in a run of enough words, whatever its own line has.
    return common_blocks(p, q, np.full(len(p), least), least)


def shared_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, key, cut, blocks): for documents with a block to delete, whether each of their lines goes, up to the last.

    ``blocks`` has (partner, first, last, there, moved) of each block: the earlier document's id, the line
    numbers here, the first there, and whether the block is out of the common order. Documents are in
    the order of doc_id (null first), then of their key. A rare hash is known by the first document that
    holds it and links all others to that one, so it needs no cap, and no list of all its documents:
    a group of n documents gives n links. Each document is aligned with every partner.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), text_or_empty(text).alias("text"))

    def split(batches):
        for batch in rebatched(batches, SPLIT_ROWS):
            of, h, n, places, ends = array("i"), array("Q"), array("i"), array("i"), array("i", [0])
            for i, t in enumerate(batch.column("text")):
                for unit, lines, at in units_of(t.as_py(), block_words):
                    of.append(i)
                    h.append(unit)
                    n.append(lines)
                    places.extend(at)
                    ends.append(len(places))
            ints = [np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (of, n, places, ends)]
            rows, made = pa.array(ints[0]), pa.array((np.frombuffer(h, np.uint64) if len(h) else np.empty(0, np.uint64)).view(np.int64))
            at = pa.ListArray.from_arrays(pa.array(ints[3]), pa.array(ints[2]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), made, pa.array(ints[1]), at], ["id", "key", "h", "n", "at"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = materialize(texts.mapInArrow(split, f"id {kind}, key long, h long, n int, at array<int>"), "lines")
    first = rows.groupBy("h").agg(F.min(F.struct("id", "key", "at")).alias("f"), F.count("*").alias("times")).where("times > 1")
    # Written, so that both sides of the join are plain exchanges and a hot hash's can be split.
    holders = materialize(first.select("h", F.col("f.id").alias("partner"), F.col("f.key").alias("pkey"), F.col("f.at").alias("there")), "first-holders")
    matched = rows.join(holders, "h").where(~(F.col("id").eqNullSafe(F.col("partner")) & (F.col("key") == F.col("pkey"))))
    # A partner may repeat a run without end; which of its places stands opposite changes no cut.
    matched = matched.withColumn("there", F.slice("there", 1, F.greatest(F.size("at"), F.lit(PLACES))))
    # A document's hashes are one row each and repeated rows fall together, so the set is bounded by one text.
    of = matched.groupBy("id", "key").agg(F.collect_set(F.struct("partner", "pkey", "n", "at", "there")).alias("shared"))

    block = pa.struct([("partner", to_arrow_type(docs.schema[doc_id].dataType)), ("first", pa.int32()), ("last", pa.int32()), ("there", pa.int32()), ("moved", pa.bool_())])

    def align(batches):
        for batch in rebatched(batches):
            cuts, found = [], []
            for shared in batch.column("shared").to_pylist():
                partners: dict[tuple, list] = {}
                for s in shared:
                    partners.setdefault((s["partner"], s["pkey"]), []).append((s["at"], s["there"], s["n"]))
                blocks = []
                for (partner, _), runs in sorted(partners.items(), key=lambda x: (x[0][0] is not None, x[0])):
                    blocks += [(partner, *b) for b in _blocks_with(runs, block_words)]
                cut = np.zeros(max(b[2] for b in blocks) + 1, bool)
                for _, a, b, _, _ in blocks:
                    cut[a : b + 1] = True
                cuts.append(cut.tolist())
                found.append([dict(zip(("partner", "first", "last", "there", "moved"), b, strict=True)) for b in blocks])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(cuts, pa.list_(pa.bool_())), pa.array(found, pa.list_(block))], ["id", "key", "cut", "blocks"])

    return of.mapInArrow(align, f"id {kind}, key long, cut array<boolean>, blocks array<struct<partner:{kind},first:int,last:int,there:int,moved:boolean>>")


def delete_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, counts: bool = False) -> DataFrame:
    """The rows of ``docs`` with the blocks that they share with an earlier document deleted.

    A text keeps its other lines as they were; white space at the end of a cut text goes, and a copy of
    an earlier text of ``block_words`` words or more becomes the empty text. Null texts stay null; texts
    without a long enough shared block stay as they are. Rows with equal id and text are one document,
    so repeated rows leave each other alone; a document's own repeats stay. With ``counts``, n_cut
    (long), the number of deleted lines, is added (and replaces a column called so).
    """
    cuts = shared_blocks(docs, doc_id, text, block_words).select(F.col("id").alias("__id"), F.col("key").alias("__cut_key"), F.col("cut").alias("__cut"))
    own = [c for c in docs.columns if not (counts and c.lower() == "n_cut")]
    rows = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    rows = rows.join(cuts, (rows["__key"] == cuts["__cut_key"]) & rows[doc_id].eqNullSafe(cuts["__id"]), "left")
    cut = F.col("__cut")
    left = F.array_join(F.filter(lines_of(F.col(text)), lambda _, i: ~F.coalesce(F.get(cut, i), F.lit(False))), "")
    new = F.when(cut.isNull(), F.col(text)).otherwise(F.regexp_replace(left, r"\s+$", ""))
    out = [new.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in own]
    if counts:
        out += [F.coalesce(F.size(F.filter(cut, lambda x: x)), F.lit(0)).cast("long").alias("n_cut")]
    return rows.select(*out)
