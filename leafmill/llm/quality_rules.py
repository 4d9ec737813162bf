"""Quality rules in SQL functions alone: base counts and a hashed n-gram likelihood ratio (operator 4)."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WORD_BREAK, text_or_empty

#: Buckets of the two multinomials, smoothing in tokens a bucket, and the lowest accepted mean ratio where no
#: trusted document tells it.
BUCKETS, SMOOTHING, LOWEST_MEAN = 8192, 1.0, -0.15
#: Share of the trusted documents that may lie below the fitted lowest mean before its margin is taken off, and
#: the steps in a unit in which means are counted.
LOST_SHARE, MARGIN, STEPS = 0.001, 0.01, 1000
SYMBOLS = "#*$%&|<>"
#: Bits of a window's hash given up beyond those that its place needs: none, but for tests.
MORE_BITS = 0


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _grams(words: Column) -> Column:
    """The buckets of each word and of each pair of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    two = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)))
    return F.concat(one, two)


def fit_ratio(raw: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log(p_trusted / p_raw) of each bucket: the raw multinomial counts every document of ``raw``, the
    trusted one those whose id is in ``trusted``. At most ``BUCKETS`` rows reach the driver.

    Without trusted documents all ratios are 0, so that no document is rejected by them.
    """
    ids = trusted.select(F.col(doc_id).alias("__id")).distinct()
    rows = raw.select(F.col(doc_id).alias("__doc"), text_or_empty(text).alias("text"))
    # Always by shuffle: the labels grow with the corpus, and one way of joining costs alike at any size.
    rows = rows.join(ids.withColumn("__in", F.lit(1)).hint("merge"), F.col("__doc") == F.col("__id"), "left")
    words = rows.select(F.coalesce("__in", F.lit(0)).alias("t"), _words(F.col("text")).alias("w"))
    counts = words.select("t", F.explode(_grams(F.col("w"))).alias("g")).groupBy("g").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    n = {r.g: (r.raw, r.trusted) for r in counts.collect()}
    raw_all, trusted_all = (sum(v[i] for v in n.values()) for i in (0, 1))
    if not trusted_all:
        return [0.0] * BUCKETS
    pad = SMOOTHING * BUCKETS
    # The same prior in both, and in the trusted one scaled to its size, so that rare buckets say nothing.
    out = []
    for g in range(BUCKETS):
        r, t = n.get(g, (0, 0))
        prior = (r + SMOOTHING) / (raw_all + pad)
        out.append(log((t + SMOOTHING * BUCKETS * prior) / (trusted_all + pad)) - log(prior))
    return out


def score_rules(docs: DataFrame, ratios: list[float], text: str = "text", lowest: float = LOWEST_MEAN) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_ratio and kept.

    Words are the runs without space or \\t..\\r; a null text has none, and like every text under 50
    words it fails the base rule. A word counts as repeated if it lies in a 3-word window that the
    text holds at least twice. The mean ratio is the sum over words and neighbour pairs divided by
    their number, 0 without any. Every row gives one row; columns called like an added one are replaced.
    """
    c = F.col
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mean_ratio", "kept"]
    own = [f"`{x}`" for x in docs.columns if x.lower() not in added]
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def weight(b: Column) -> Column:
        return F.element_at(weights, (F.pmod(b, F.lit(BUCKETS)) + 1).cast("int"))

    a = docs.select(*own, text_or_empty(text).alias("__t")).withColumn("__w", _words(c("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("__w")
    windows = F.transform(F.slice("__w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    b = a.withColumns(
        {
            "__l": lines,
            "__h": windows,
            "__bits": F.length(F.conv(n.cast("string"), 10, 2)) + F.lit(MORE_BITS),
            "__symbols": F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")),
            "__chars": F.aggregate("__w", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)),
        }
    )
    # The window's place replaces the low bits of its hash, so a sort of plain numbers brings equal windows together.
    packed = F.transform("__h", lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, c("__bits")), c("__bits")).bitwiseOR(i.cast("long")))
    b = b.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), c("__bits")) - 1

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        high = F.call_function("shiftright", x, c("__bits")) == F.call_function("shiftright", y, c("__bits"))
        words = [F.get("__w", p + k) == F.get("__w", q + k) for k in range(3)]
        return F.coalesce(high & words[0] & words[1] & words[2], F.lit(False))

    def mixed(x: Column, y: Column) -> Column:
        """Different windows in a row whose hashes agree in the high bits: between equal ones they would hide those."""
        return F.coalesce((F.call_function("shiftright", x, c("__bits")) == F.call_function("shiftright", y, c("__bits"))) & ~same(x, y), F.lit(False))

    twice = F.filter("__s", lambda x, j: same(x, F.get("__s", j - 1)) | same(x, F.get("__s", j + 1)))
    quick = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low).cast("int")))
    # Where that happens (in long texts, rarely) whole hashes are sorted, with their places.
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    whole = F.filter("__q", lambda x, j: F.coalesce(x["h"] == F.get(c("__q"), j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(c("__q"), j + 1)["h"], F.lit(False)))
    hidden = F.exists(F.transform("__s", lambda x, j: mixed(x, F.get("__s", j + 1))), lambda x: x)
    b = b.withColumn("__q", F.when(hidden, pairs))
    d = b.withColumn("__p", F.when(c("__q").isNotNull(), F.sort_array(F.transform(whole, lambda x: x["i"]))).otherwise(quick))
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1), p + 3) - p)), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    ratio = F.aggregate(
        F.transform("__w", lambda w, i: weight(F.xxhash64(w)) + F.when(i + 1 < n, weight(F.xxhash64(w, F.get("__w", i + 1)))).otherwise(0.0)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    e = d.select(
        *own,
        n.cast("long").alias("n_words"),
        c("__chars").alias("word_chars"),
        c("__symbols").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.when(n > 0, ratio / (2 * n - 1)).otherwise(0.0).alias("mean_ratio"),
        F.monotonically_increasing_id().alias("__m"),
    )
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    # A condition on the results must not be pushed below: it would put whole arrays' expressions into
    # the functions over their elements. A column that is not deterministic stops that.
    verdict = (c("mean_ratio") >= lowest) & (c("__m") >= 0)
    return e.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict).drop("__m")


def fit_lowest(scored: DataFrame, trusted: DataFrame, doc_id: str = "doc_id") -> float:
    """The lowest mean ratio to accept: a low quantile of the trusted documents that pass the base rules, less a margin.

    Counted in steps, so that it is the same in every run and few rows reach the driver. ``scored`` is
    the result of ``score_rules``, written before. Without trusted documents it is ``LOWEST_MEAN``.
    """
    ids = trusted.select(F.col(doc_id).alias("__id")).distinct()
    rows = scored.where("not base_failed").select(F.col(doc_id).alias("__doc"), F.floor(F.col("mean_ratio") * STEPS).alias("step"))
    rows = rows.join(ids.hint("merge"), F.col("__doc") == F.col("__id")).groupBy("step").agg(F.count("*").alias("n"))
    counts = sorted((r.step, r.n) for r in rows.collect())
    left = int(LOST_SHARE * sum(n for _, n in counts))
    for step, n in counts:
        if left < n:
            return step / STEPS - MARGIN
        left -= n
    return LOWEST_MEAN


def judge(scored: DataFrame, lowest: float) -> DataFrame:
    """``scored`` with kept by another lowest mean."""
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= lowest))
