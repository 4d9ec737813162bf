"""SimHash near-duplicates: fingerprints, BK-tree shards, linked components (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import batch_rows, materialize, rebatched, small_batches, text_or_empty
from leafmill.llm.graph import components

#: Bits in which linked fingerprints may differ, and blocks that a fingerprint is cut into.
RADIUS, BLOCKS = 3, 4
#: A shard of more fingerprints than this is dealt out further by its remaining bits, so often at most.
SHARD_ROWS, DEALS = 1024, 3
#: Rows of numbers in one batch of a search.
SEARCH_ROWS = 20_000


def fingerprint_of(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp): one row for each row, fp as a signed 64-bit number. A null text is the empty text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), text_or_empty(text).alias("text"))

    def run(batches):
        for batch in rebatched(batches):
            fps = np.array([fingerprint_of(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps)], ["doc_id", "key", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, fp long")


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    __slots__ = ("child", "nodes")

    def __init__(self):
        self.nodes: list[int] = []
        self.child: list[dict[int, int]] = []

    def within(self, fp: int, radius: int) -> list[int]:
        """Places of the nodes within the radius; only edges that can lead to one are followed."""
        found, open_ = [], [0] if self.nodes else []
        nodes, child = self.nodes, self.child
        while open_:
            at = open_.pop()
            d = (nodes[at] ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            kids = child[at]
            if len(kids) <= 2 * radius + 1:
                open_ += [c for k, c in kids.items() if d - radius <= k <= d + radius]
            else:
                open_ += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
        return found

    def add(self, fp: int) -> None:
        """Adds a fingerprint that is not in the tree."""
        self.nodes.append(fp)
        self.child.append({})
        at, new = 0, len(self.nodes) - 1
        while new:
            d = (self.nodes[at] ^ fp).bit_count()
            if d not in self.child[at]:
                self.child[at][d] = new
                return
            at = self.child[at][d]


def linked_roots(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, root) for all of a shard that are linked to a root before them: a forest, not all pairs."""
    tree, parent = BKTree(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, fp in enumerate(fps):
        parent.append(i)
        for j in tree.within(fp, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(fp)
    return [(fps[i], fps[r]) for i in range(len(fps)) if (r := root(i)) != i]


def _parts(used: int, parts: int) -> list[tuple[int, int]]:
    """(nibbles used then, mask of the part's bits) of the parts that the unused nibbles of a fingerprint are cut into."""
    free = [k for k in range(16) if not used >> k & 1]
    out = []
    for i in range(parts):
        own = free[len(free) * i // parts : len(free) * (i + 1) // parts]
        out.append((used | sum(1 << k for k in own), sum(0xF << 4 * k for k in own)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of a forest that spans all fingerprints of ``distinct`` (column fp) within the radius.

    Fingerprints that differ in at most ``radius`` bits agree in one of radius + 1 parts of them, so each
    part's value names a shard. A shard of over ``SHARD_ROWS`` fingerprints is dealt out again by parts of
    its other bits, by the same argument and with the same links, up to ``DEALS`` times in all. A tree
    is built where its shard is and searched by the shard's own fingerprints only.
    """
    fp, blocks = F.col("fp"), radius + 1
    dealt = distinct.select("fp", F.lit(0).alias("used"), F.lit(0).cast("long").alias("shard"), F.lit(True).alias("open"))
    states = {0}
    for deal in range(DEALS):
        known = {u: _parts(u, blocks) for u in sorted(states)}
        states = {u for parts in known.values() for u, _ in parts}
        cut = None
        for u, parts in known.items():
            made = F.array(*[F.struct(F.lit(v).alias("used"), F.xxhash64("shard", F.lit(v), fp.bitwiseAND(F.lit(_signed(mask)))).alias("shard"), F.lit(True).alias("open")) for v, mask in parts])
            cut = F.when(F.col("used") == u, made) if cut is None else cut.when(F.col("used") == u, made)
        stays = F.array(F.struct("used", "shard", F.lit(False).alias("open")))
        dealt = dealt.select("fp", F.explode(F.when(F.col("open"), cut).otherwise(stays)).alias("c")).select("fp", "c.*")
        if deal == DEALS - 1:
            break
        if deal:
            dealt = materialize(dealt, "shards")
        hot = dealt.where("open").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select(F.col("shard").alias("hot"))
        dealt = dealt.join(hot, dealt["shard"] == hot["hot"], "left").select("fp", "used", "shard", (F.col("open") & F.col("hot").isNotNull()).alias("open"))
    ordered = dealt.select("fp", "shard").repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the shard that goes on

        def found():
            fps, shards = (np.concatenate(x) for x in zip(*held, strict=True))
            bounds = np.flatnonzero(np.diff(shards)) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(shards)]])
            unsigned, out = fps.view(np.uint64), []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                out += linked_roots(unsigned[a:b].tolist(), radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            fps, shards = batch.column("fp").to_numpy(), batch.column("shard").to_numpy()
            if not len(shards):
                continue
            last = int(np.searchsorted(shards, shards[-1]))
            if last or (held and held[-1][1][-1] != shards[-1]):
                held.append((fps[:last], shards[:last]))
                yield found()
                held = []
            held.append((fps[last:], shards[last:]))
        if held:
            yield found()

    return ordered.mapInArrow(run, "a long, b long")


def rooted(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp, root, component_id), one row for each row of ``docs``: root is a fingerprint that names the component."""
    prints = materialize(fingerprints(docs, doc_id, text), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    with batch_rows(docs.sparkSession, SEARCH_ROWS):  # numbers alone, so large batches are small
        edges = materialize(links(distinct.select("fp"), radius), "links")
    roots = components(edges)
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    merged = labelled.join(smallest.where("n > 1"), "root", "left")
    named = merged.select("fp", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fingerprint, component_id), one row for each row of ``docs``.

    component_id is the smallest doc_id that can be reached over links. Null and empty texts, and
    those without words, have fingerprint zero and are linked with each other and with what lies in
    the radius. Repeated rows stay. A null doc_id is larger than none: it is never a component's id
    unless the component has no other. ``key`` tells apart rows with one doc_id and different texts.
    Texts of any length are read whole; extra columns are not read, whatever they are called.
    """
    out = rooted(docs, radius, doc_id, text)
    return out.select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest doc_id stays.

    All columns are kept. Of rows that share the smallest id, or are repeated, one stays. Components
    are told apart by their fingerprints, so null and repeated ids join none that are not linked.
    """
    found = rooted(docs, radius, doc_id, text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("b"))
    keys = best.select(F.col("b.doc_id").alias("__id"), F.col("b.key").alias("__keep"))
    rows = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    # By id and key: keys alone are too few for all the documents of a large corpus.
    kept = rows.join(keys, (rows["__key"] == keys["__keep"]) & rows[doc_id].eqNullSafe(keys["__id"]), "left_semi")
    return kept.dropDuplicates([doc_id, "__key"]).drop("__key")
