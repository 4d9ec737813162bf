"""Sharding by balanced label propagation over groups of equal texts (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, with_local_order

SHARDS, ROUNDS = 16, 5
#: A unit of more than one of so many parts of all rows is placed by itself; so there are fewer than this many.
BIG_PARTS = 20 * SHARDS


def _lookup(values: list, column: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), column.cast("int")).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law "rows", so counts differ by at most one.

    Documents of equal texts are linked; null and empty texts are one group. Labels start at random and
    linked documents move in rounds (``propagate``) towards the shard that most of their group are in, as
    far as the shard's quota allows. A group too large for a shard is cut into even parts first.
    Documents without links then even out the counts, linked ones only if none is left. Texts of any
    length go by their hashes; repeated rows are documents of their own; a null doc_id is placed like
    any other; extra columns are not read; no rows give no rows.
    """
    rows, quota = _rows(docs, shards, doc_id, text)
    labels, _ = propagate(rows, quota, shards)
    marked = rows.join(labels.withColumnRenamed("start", "__start"), (rows["unit"] == labels["unit"]) & (F.col("start") == F.col("__start")), "left").drop(labels["unit"])
    single = F.col("unit").isNull()
    marked = marked.select("doc_id", "size", "text_crc32", F.coalesce("label", "start").alias("shard"), single.alias("single"), F.coalesce("unit", F.lit(0)).alias("unit"))
    return _even_out(marked, shards)


def _rows(docs: DataFrame, shards: int, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Each document's hashes, first label and unit (null without links), and a shard's quota."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("g"))
    rows = materialize(rows.withColumn("start", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")), "shard-rows")
    quota = max(1, rows.count() // shards)
    # A group over nine tenths of a shard is dealt out by hash into even parts under that size.
    parts = F.ceil(F.col("n") / F.lit(max(1.0, 0.9 * quota))).cast("int").alias("parts")
    groups = materialize(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", parts), "shard-groups")
    unit = F.xxhash64("g", F.pmod(F.xxhash64("doc_id", F.lit(7)), "parts"))
    linked = rows.join(groups, "g", "left").withColumn("unit", F.when(F.col("parts").isNotNull(), unit))
    return linked.select("doc_id", "size", "text_crc32", "start", "unit"), quota


def propagate(rows: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(unit, start, label), and the cut links before and after each round, of documents with (start, unit).

    Members of a unit are all linked to each other, so what a document's neighbours vote for is known
    from the unit's members by label; those of one unit and first label move together and are one row.
    In each round a unit wishes for the label that most of its members have, and the rows elsewhere move
    there by a hash of theirs, in shares that keep every label within its quota when all have moved
    (``_allowed``). Members of one label stay together, so the cut links fall in each round. Units in a
    label over its quota go where there is room. Rounds end when none wishes to move.
    """
    spark = rows.sparkSession
    start = rows.where("unit is not null").groupBy("unit", "start").agg(F.count("*").alias("n"))
    state = materialize(start.select("unit", "start", F.col("start").alias("label"), "n"), "shard-labels")
    weight = materialize(state.groupBy("unit").agg(F.sum("n").alias("n")), "shard-units")
    total = quota * shards
    # The largest units, of which there are fewer than BIG_PARTS, are dealt with one by one.
    large = F.col("n") * BIG_PARTS > total
    votes = state.join(F.broadcast(weight.where(large).select("unit", F.col("n").alias("all"))), "unit")
    members: dict[int, dict[int, int]] = {}
    for r in votes.collect():
        members.setdefault(r.unit, {})[r.label] = r.n
    load, wishes = [0] * shards, []
    for unit, own in sorted(members.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(own.values())
        fits = [s for s in range(shards) if load[s] + n <= quota]
        s = max(fits, key=lambda s: (own.get(s, 0), -load[s], -s)) if fits else min(range(shards), key=lambda s: (load[s], s))
        load[s] += n
        wishes.append((unit, s))
    placed = spark.createDataFrame(wishes, "unit long, big int") if wishes else None
    cuts = [_cut_links(state)]
    if placed is not None:
        state = materialize(state.join(F.broadcast(placed), "unit", "left").select("unit", "start", F.coalesce("big", "label").alias("label"), "n"), "shard-labels")
        cuts.append(_cut_links(state))
    for turn in range(rounds):
        now = [0] * shards
        for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect():  # one row a label
            now[r.label] = r.n
        room = [max(0, quota - n) for n in now]
        free = F.get(F.array(*[F.lit(int(r > 0)) for r in room]), F.col("label"))
        by_label = state.groupBy("unit", "label").agg(F.sum("n").alias("n"))
        # Votes first, and by turns labels with room first; of equal ones that with room, then by hash.
        best = F.max(F.struct(free if turn % 2 else F.lit(0), "n", free.alias("free"), F.xxhash64("unit", "label").alias("h"), "label"))
        voted = by_label.groupBy("unit").agg(best.alias("b"), F.count("*").alias("labels"))
        # Of units at one in a label over its quota, the share that is too much goes where there is room.
        over = F.get(F.array(*[F.lit(max(0, n - quota) / n if n else 0.0) for n in now]), F.col("b.label"))
        leaves = (F.col("labels") == 1) & (_share(turn, "unit") < over)
        wish = voted.select("unit", F.when(leaves, _by_room(room, F.xxhash64("unit", F.lit(-turn)))).otherwise(F.col("b.label")).cast("int").alias("wish"))
        asked = materialize(state.join(wish, "unit"), "shard-wishes")
        flows = {(r.label, r.wish): r.n for r in asked.where("wish <> label").groupBy("label", "wish").agg(F.sum("n").alias("n")).collect()}  # two labels a row
        if not flows:
            break
        taken = _allowed(flows, now, quota, shards)
        moves = (F.col("wish") != F.col("label")) & (_share(turn, "unit", "label") < F.get(F.array(*[F.lit(x) for x in taken]), F.col("label") * shards + F.col("wish")))
        state = materialize(asked.select("unit", "start", F.when(moves, F.col("wish")).otherwise(F.col("label")).alias("label"), "n"), "shard-labels")
        cuts.append(_cut_links(state))
    return state.select("unit", "start", "label"), cuts


def _share(turn: int, *names: str) -> Column:
    """A number from 0 to 1 by hash: rows of equal names go together."""
    return F.pmod(F.xxhash64(*names, F.lit(turn)), F.lit(1_000_000)) / 1e6


def _by_room(room: list[int], number: Column) -> Column:
    """A label by a hash, each as often as it has room."""
    spot, at, target = F.pmod(number, F.lit(max(1, sum(room)))), 0, F.lit(0)
    for r in room[:-1]:
        at += r
        target = target + F.when(spot >= at, 1).otherwise(0)
    return target


def _allowed(flows: dict[tuple[int, int], int], now: list[int], quota: int, shards: int) -> list[float]:
    """For each pair of labels the share of the rows that wish to go from one to the other that may.

    As many as can be so that no label ends over its quota (or over what it has now, if that is more):
    what goes into a full label is cut down, which leaves more where it comes from, until all fit.
    """
    x = {k: float(n) for k, n in flows.items()}
    for _ in range(1000):
        fits = True
        for t in range(shards):
            into, out = (sum(n for k, n in x.items() if k[side] == t) for side in (1, 0))
            if now[t] + into - out > max(quota, now[t]) + 0.5 and into:
                fits = False
                part = max(0.0, max(quota, now[t]) - now[t] + out) / into
                x |= {k: n * part for k, n in x.items() if k[1] == t}
        if fits:
            break
    return [x[s, t] / flows[s, t] if (s, t) in flows else 0.0 for s in range(shards) for t in range(shards)]


def _cut_links(state: DataFrame) -> int:
    """The pairs of linked documents with different labels, from the counts alone."""
    pairs = F.col("n").cast("decimal(38,0)") * (F.col("n") - 1)
    by_label = state.groupBy("unit", "label").agg(F.sum("n").alias("n"))
    inside = by_label.groupBy("unit").agg(F.sum(pairs).alias("same"), F.sum("n").alias("n"))
    return int(inside.agg(F.sum(pairs - F.col("same"))).first()[0] or 0) // 2


def _even_out(marked: DataFrame, shards: int) -> DataFrame:
    """Slots in each shard, and the surplus of full shards moved to the free slots of the others."""
    ordered = materialize(with_local_order(marked, "shard", "single", "unit", "doc_id", "text_crc32"), "shard-order")
    pieces = ordered.groupBy("shard", "__part").agg(F.count("*").alias("n"), F.min("__idx").alias("low"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    slots = ordered.join(F.broadcast(offsets), ["shard", "__part"]).withColumn("slot", F.col("__idx") + F.col("shift"))
    count = [0] * shards
    for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        count[r.shard] = r.n
    small, more = divmod(sum(count), shards)
    largest = sorted(range(shards), key=lambda s: (-count[s], s))[:more]
    quota = [small + (s in largest) for s in range(shards)]
    given, at = [], 0  # surplus documents of the shards before, less the shard's quota
    for s in range(shards):
        given.append(at - quota[s])
        at += max(0, count[s] - quota[s])
    ends, bases, at = [], [], 0  # where each shard's free slots end in the row of all free slots
    for s in range(shards):
        bases.append(count[s] - at)
        at += max(0, quota[s] - count[s])
        ends.append(at)
    moves = F.col("slot") >= _lookup(quota, F.col("shard"))
    spot = F.col("slot") + _lookup(given, F.col("shard"))
    target = sum((F.when(spot >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    placed = slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(moves, target).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(moves, spot + _lookup(bases, target)).otherwise(F.col("slot")).cast("long").alias("slot"),
    )
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))
