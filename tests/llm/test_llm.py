"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import bpe, cnn, decontam, html_extract, lexicon, linededup, maxent, quality_rules, queries, sharding, simhash, token_files

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "The quick brown fox. " * 30, "a"), (2, None, "b"), (3, "", None), (4, "   \n\t ", "b"), (5, "The quick brown fox. " * 30, "a"),
    (5, "The quick brown fox. " * 30, "a"), (None, "İΣΣ naïve 你好 🙂 <|endoftext|>x a\x1cb ½", "c"), (7, "word " * 40_000, "c"), (8, "x" * 60_000, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column that is called like results."""
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words_of(text):
    return (text or "").encode().lower().split()


# 1: encoding ---------------------------------------------------------------------------------------


def test_transducer_is_minimal_and_complete():
    words = [(w.encode(), [i, i * 7]) for i, w in enumerate(["tap", "taps", "top", "tops", "stops", "a", ""])]
    t = lexicon.mapped(lexicon.compile_words(words))
    assert all(t.get(w) == ids for w, ids in words)
    assert t.get(b"to") is None
    assert t.get(b"tapss") is None
    prefixes = {w[:k] for w, _ in words for k in range(len(w) + 1)}
    assert len(t.first) - 1 == len({frozenset(w[len(p) :] for w, _ in words if w.startswith(p)) for p in prefixes})
    assert lexicon.mapped(lexicon.compile_words([])).get(b"x") is None


def test_encoding_equals_the_library(spark, odd):
    path = queries.vocabulary_path()
    made = bpe.encode_documents(odd, path, bpe.build_lexicon(odd, path))
    lib = bpe.library(path)
    rows = made.collect()
    assert len(rows) == len(ODD)
    wanted = collections.Counter()
    for i, t, _ in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        wanted[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == wanted


def test_op1_digests(spark, texts):
    lib = bpe.library(queries.vocabulary_path())
    for r in queries.op1_bpe_transducer(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 2: classifier -------------------------------------------------------------------------------------


def test_classifier_learns_and_scores_all(spark, odd, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "and", "rain", "falls", "on", "grass"]) for _ in range(60)) for _ in range(80)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    net = cnn.fit([t.encode() for t in good + bad], [1] * 80 + [0] * 80)
    tables = net.pairs()
    assert (net.score([t.encode() for t in good], tables) > 0.5).mean() > 0.95
    assert (net.score([t.encode() for t in bad], tables) < 0.5).mean() > 0.95
    tail = good[0] * 30 + bad[0] * 3  # what stands at the end of a long text counts
    assert net.score([tail.encode()], tables)[0] < net.score([(good[0] * 33).encode()], tables)[0]
    rows = cnn.score(odd, net).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert cnn.score(empty, net).count() == 0
    assert cnn.fit([], []).score([b"", b"x"], cnn.fit([], []).pairs()).tolist() == [0.5, 0.5]


def test_scores_are_of_the_text_alone(docs):
    """Equal to a plain forward pass, byte by byte, whatever stands in the batch."""
    net = cnn.fit([b"good words here", b"BAD!!! $$$"] * 20, [1, 0] * 20, epochs=2)
    texts = [(r.text or "").encode() for r in docs.limit(60).collect()] + [b"x" * n for n in (0, 1, 255, 256, 257, 512, 3000)] + [b"\xff" * 256]
    tables = net.pairs()
    alone = [net.score([t], tables)[0] for t in texts]
    order = random.Random(1).sample(range(len(texts)), len(texts))
    for size in (1, 7, 256):
        for a in range(0, len(order), size):
            some = order[a : a + size]
            assert net.score([texts[i] for i in some], tables).tolist() == [alone[i] for i in some]
    for t, got in zip(texts[-12:], alone[-12:], strict=True):
        padded = np.frombuffer(t + b"\0" * (cnn.CHUNK + cnn.WIDTH), np.uint8)
        tops = []
        for a in range(0, len(t), cnn.CHUNK):
            windows = [sum(net.table[w, padded[i + w]].astype(float) for w in range(cnn.WIDTH)) for i in range(a, a + cnn.CHUNK)]
            tops.append(np.maximum(np.max(windows, axis=0), 0))
        features = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) if tops else np.zeros(2 * cnn.FILTERS)
        assert got == pytest.approx(1 / (1 + math.exp(-(features @ net.out + net.bias))), abs=1e-4)


def test_long_texts_take_part_in_the_fit(spark):
    rows = [(i, ("a" if i % 2 else "b") * (200_000 if i < 20 else 50)) for i in range(60)] + [(7, None), (7, "z")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(99, 1), (3, None)], "doc_id long, quality int")
    texts, marks = cnn.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    free = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(texts) == len(marks) == len(free)
    assert sum(len(t) == cnn.FIT_BYTES for t in texts) == len({i for i in free if i < 20})
    assert all(q == (t[:1] in (b"a", b"z", b"")) for t, q in zip(texts, marks, strict=True))
    few = cnn.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, rows=5)
    assert len(few[0]) == 5
    text = bytes(range(256)) * 1000
    assert cnn.spread(text, cnn.FIT_BYTES)[-cnn.PIECE :] == text[-cnn.PIECE :]


def test_held_out_accuracy(spark):
    folder = f"{SF}/../sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null")
    got = queries.op2_byte_cnn(spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 500
    assert sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    low = [r for r in got if r.quality == 0]
    assert sum(r.predicted == 0 for r in low) >= 0.9 * len(low)


def test_op2_never_learns_from_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample, marks = cnn.training_rows(docs, labels)
    held = {r.text.encode() for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    free = {r.text.encode() for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert not [t for t in sample if t in held - free]
    assert len(sample) == len(marks)


# 3: token files ------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, encoding):
    path = queries.vocabulary_path()
    files = token_files.write_tokens(token_files.encode_in_order(odd, path, 2), encoding)
    rows = token_files.read_tokens(spark, files).orderBy("start").collect()
    lib, at = bpe.library(path), 0
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(rows) == len(order)
    for r, (i, t, _) in zip(rows, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.tokens)) == (i, at, len(ids), ids)
        at += len(ids)
    plan = token_files.read_tokens(spark, files).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens#" not in "".join(re.findall(r"ReadSchema: (.*)", plan)).replace("n_tokens", "")


def test_library_encoder_equals_the_library_on_odd_runs():
    texts = ["É'S ITALL's ab's. 'S <|ENDOFTEXT|> <|endoftext|>x", "µß ÿŸ İI ſ K", "a_b__ a'... x''s 12,3. ª.º ½a ²", "'re're 're. don't! 'tis", "\x1cq\x1fr \x85u\xa0v", "ΑΣ ΑΣ. é!", "a\x00b. \xad-x\xad.", "x" * 5000 + "!!", ""]
    rng = random.Random(8)
    texts += ["".join(rng.choice("aBé'.,!_ 1\nΣ<|>") for _ in range(40)) for _ in range(2000)]
    encoder = token_files.LibraryEncoder(queries.vocabulary_path())
    full = token_files.CACHE_WORDS
    token_files.CACHE_WORDS = 500
    try:
        got = [x for i in range(0, len(texts), 64) for x in encoder.encode(texts[i : i + 64], b"")]
    finally:
        token_files.CACHE_WORDS = full
    assert encoder.older
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in encoder.model.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_files_of_nothing(spark, empty):
    files = token_files.write_tokens(token_files.encode_in_order(empty, queries.vocabulary_path(), 2))
    assert token_files.token_digests(token_files.read_tokens(spark, files)).count() == 0


def test_equal_ids_are_ordered_without_their_texts(spark):
    """A third of all rows with one id: split by the texts' hashes, of which alone a sample goes to the driver."""
    rows = [(7 if i % 3 == 0 else i, f"text {i} " * 50) for i in range(600)] + [(7, "text 0 " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    encoded = token_files.encode_in_order(docs, queries.vocabulary_path(), 2)
    files = token_files.write_tokens(encoded)
    got = token_files.read_tokens(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    again = token_files.read_tokens(spark, token_files.write_tokens(token_files.encode_in_order(docs.repartition(3), queries.vocabulary_path(), 2)))
    assert again.orderBy("start").collect() == got
    exchange = re.findall(r"rangepartitioning\(([^)]*)\)", encoded._jdf.queryExecution().executedPlan().toString())
    assert exchange and all("text#" not in e for e in exchange)


# 4: rules ------------------------------------------------------------------------------------------


def base_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, docs, odd):
    more = spark.createDataFrame([(100 + i, " ".join(random.Random(i).choice("abc") for _ in range(i))) for i in range(40)] + [(200, "a\nb\n\na\n \n a\n#*<"), (201, "a a a a")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        ratios = [((i * 37) % 101 - 50) / 100 for i in range(quality_rules.BUCKETS)]
        for r in quality_rules.score_rules(frame, ratios).collect():
            want = base_rules(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r.base_failed == failed
            w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            b = lambda *p: _xx(p) % quality_rules.BUCKETS
            total = sum(ratios[b(x)] for x in w) + sum(ratios[b(x, y)] for x, y in zip(w, w[1:], strict=False))
            mean = total / (2 * len(w) - 1) if w else 0.0
            assert r.mean_ratio == pytest.approx(mean, abs=1e-9)
            assert r.kept == (not failed and mean >= quality_rules.LOWEST_MEAN)


def test_rules_are_exact_where_hashes_agree_in_part(spark, docs, monkeypatch):
    """With few bits left of a window's hash, different windows get between equal ones; the counts stay right."""
    monkeypatch.setattr(quality_rules, "MORE_BITS", 48)
    rows = [(i, " ".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(20 + 5 * i))) for i in range(60)]
    frame = docs.select("doc_id", "text").limit(100).union(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in quality_rules.score_rules(frame, [0.0] * quality_rules.BUCKETS).collect():
        assert r.n_repeat_words == base_rules(r.text)[4]


def _xx(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_ratios_are_the_two_multinomials(spark):
    raw = spark.createDataFrame([(1, "a a b"), (2, "c"), (2, "c"), (None, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (9,)], "doc_id long")
    got, n = quality_rules.fit_ratio(raw, trusted), quality_rules.BUCKETS
    counts = collections.Counter(_xx(p) % n for p in [("a",), ("a",), ("b",), ("a", "a"), ("a", "b"), ("c",), ("c",)])
    inside = collections.Counter(_xx(p) % n for p in [("a",), ("a",), ("b",), ("a", "a"), ("a", "b")])
    for g in [*counts, 0]:
        prior = (counts[g] + 1) / (7 + n)
        assert got[g] == pytest.approx(math.log((inside[g] + n * prior) / (5 + n)) - math.log(prior))
    assert quality_rules.fit_ratio(raw, trusted.where("doc_id = 5")) == [0.0] * n


def test_lowest_mean_comes_from_the_trusted_documents(spark):
    rows = [(i, False, 0.02 - i / 100_000) for i in range(3000)] + [(5000, True, -0.9), (5001, False, -0.06), (5002, False, None)]
    scored = spark.createDataFrame(rows, "doc_id long, base_failed boolean, mean_ratio double")
    trusted = spark.createDataFrame([(i,) for i in range(3000)] + [(5000,), (1,), (None,)], "doc_id long")
    lowest = quality_rules.fit_lowest(scored, trusted)
    assert lowest == pytest.approx(-0.02, abs=0.0011)
    assert quality_rules.judge(scored, lowest).where("kept and doc_id >= 5000").count() == 0
    assert quality_rules.fit_lowest(scored, trusted.limit(0)) == quality_rules.LOWEST_MEAN


def test_op4_rejects_what_the_labels_reject(spark):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = queries.op4_quality_rules(spark, f"{SF}/../sf0.01").where("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.05 * (n.get((0, True), 0) + n.get((0, False), 0))
    assert n.get((1, False), 0) <= 0.01 * n[1, True]


# 5: decontamination --------------------------------------------------------------------------------


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert all(decontam.edit_distance(a, b, k) == min(d[-1][-1], k + 1) for k in range(10))


def test_leaks_reach_recall_and_clean_texts_stay(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [line(rng.randrange(12, 60)) for _ in range(60)]
    planted, rows = set(), []
    for i in range(240):
        body = line(200)
        if i % 2:
            item = rng.randrange(60)
            copy = [*items[item]]
            for _ in range(rng.randrange(int(0.15 * len(copy)) + 1)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], rng.choice(vocabulary)]])
            at = rng.randrange(150)
            body[at:at] = [w.upper() + "," for w in copy]
            planted.add((i, item))
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leak_pairs(docs, bench).collect()}
    assert len(found & planted) >= 0.95 * len(planted)
    assert not found - planted
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert kept == {i for i in range(240)} - {i for i, _ in found}


@pytest.mark.parametrize("n", [20, 59, 100, 200])
def test_recall_at_the_edit_limit(n):
    rng = random.Random(n)
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(100)]
    texts = []
    for item in items:
        copy = [*item]
        for at in rng.sample(range(n), int(decontam.EDIT_SHARE * n)):
            copy[at] = f"w{rng.randrange(3000)}"
        texts.append(" ".join([*(f"w{rng.randrange(3000)}" for _ in range(30)), *copy, *(f"w{rng.randrange(3000)}" for _ in range(30))]))
    found = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)]).matches(texts)
    assert sum(i in [m["item_id"] for m in f] for i, f in enumerate(found)) >= 96
    assert all(m["item_id"] == i for i, f in enumerate(found) for m in f)


@pytest.mark.parametrize("n", [20, 40, 59, 120, 400])
def test_recall_at_the_edit_limit_with_moves(n):
    """Substitutions, insertions and deletions up to the limit; judged by what the item's own window then costs."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for _ in range(100)]
    texts, due = [], set()
    for i, item in enumerate(items):
        copy = [*item]
        for _ in range(int(decontam.EDIT_SHARE * n * 0.6)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [word()], [copy[k], word()]])
        body = [*(word() for _ in range(30)), *copy, *(word() for _ in range(30 + n))]
        texts.append(" ".join(body))
        limit = int(decontam.EDIT_SHARE * n)
        if decontam.edit_distance(item, body[30 : 30 + n], limit) <= limit:
            due.add(i)
    found = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)]).matches(texts)
    assert len(due) >= 80
    assert sum(i in [m["item_id"] for m in found[i]] for i in due) >= 0.95 * len(due)


def test_leaks_against_all_windows():
    """Every window of every text compared with every item."""
    rng = random.Random(17)
    words = [f"v{i}" for i in range(40)]
    items = [[rng.choice(words) for _ in range(rng.randrange(3, 16))] for _ in range(30)]
    items += [items[0], items[1]]
    texts = []
    for _ in range(80):
        t = [rng.choice(words) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            copy = [*rng.choice(items)]
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(copy) + 1)
                copy[k : k + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words), *copy[k : k + 1]]])
            at = rng.randrange(len(t) + 1)
            t[at:at] = copy
        texts.append(t)
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            k = int(decontam.EDIT_SHARE * len(item))
            d = min(((decontam.edit_distance(item, t[a : a + len(item)], k), a) for a in range(len(t))), default=(k + 1, 0))
            if d[0] <= k:
                want[i, j] = d
    found = decontam.Index([(j, " ".join(x)) for j, x in enumerate(items)]).matches([" ".join(t) for t in texts])
    got = {(i, m["item_id"]): (m["edits"], m["start_word"]) for i, f in enumerate(found) for m in f}
    assert len(want) > 50
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    assert all(got[x] >= want[x] for x in got)
    assert sum(got[x] == want[x] for x in got) >= 0.9 * len(got)


def test_very_long_items_and_many_blocks(spark):
    rng = random.Random(19)
    word = lambda: f"w{rng.randrange(9000)}"
    long = [word() for _ in range(40_000)]
    copy = [*long]
    for at in rng.sample(range(40_000), 6000):
        copy[at] = word()
    items = [[word() for _ in range(rng.randrange(10, 40))] for _ in range(100)]
    items[3] = items[50]  # equal items in different blocks
    rows = [(0, " ".join([word(), *copy])), (1, " ".join(long[:20_000])), (2, None), (3, " ".join(items[7] + items[50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (500, " ".join(long))], "item_id long, text string")
    full = decontam.BLOCK_ITEMS
    decontam.BLOCK_ITEMS = 1
    try:
        got = {r.doc_id: [(m.item_id, m.start_word, m.n_words) for m in r.leaks] for r in decontam.find_leaks(docs, bench).collect()}
    finally:
        decontam.BLOCK_ITEMS = full
    assert got == {0: [(500, 1, 40_000)], 1: [], 2: [], 3: [(3, len(items[7]), len(items[50])), (7, 0, len(items[7])), (50, len(items[7]), len(items[50]))]}
    big = decontam.Index([(1, " ".join(f"u{i}" for i in range(40_000)))])
    assert sum(k.nbytes + o.nbytes for k, o in big.keys.values()) + big.pairs.nbytes < 12 << 20


def test_leaks_edge_cases(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "the quick brown fox"), (None, "word"), (5, "the quick brown fox")], "item_id long, text string")
    rows = decontam.find_leaks(odd, bench, into="score").collect()
    assert len(rows) == len(ODD)
    assert {tuple(m.item_id for m in r.score) for r in rows if r.doc_id in (1, 5)} == {(4, 5)}
    assert all(not r.score for r in rows if r.doc_id not in (1, 5))
    assert decontam.drop_leaks(empty, bench).count() == 0
    assert decontam.drop_leaks(odd, bench.limit(0)).count() == len(ODD)
    blocks = decontam.BLOCK_ITEMS
    decontam.BLOCK_ITEMS = 1
    try:
        assert sorted(map(str, decontam.find_leaks(odd, bench, into="score").collect())) == sorted(map(str, rows))
    finally:
        decontam.BLOCK_ITEMS = blocks


# 6: SimHash ----------------------------------------------------------------------------------------


def brute_components(pairs, radius=3):
    """(doc_id, fingerprint) to the smallest doc_id reachable."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in pairs}


def plain_fingerprint(text):
    w = words_of(text)
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in g) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(g))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates_equal_brute_force(request, which):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in frame.collect()]
    want = brute_components(rows)
    got = simhash.near_duplicates(frame).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == collections.Counter((d, f"{f:016x}", want[d, f]) for d, f in rows)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | ({None} if None in want.values() else set())
    assert kept.count() == len(set(want.values()))


def test_unrelated_documents_stay_whatever_their_ids(spark):
    rng = random.Random(12)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([*rows, rows[0], (None, clean[1]), (8, clean[2])], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted(rows, key=str)


def test_hot_shards_lose_no_link(spark):
    rng = random.Random(2)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 3000:  # a dense ball, and others that share a block with it
        f = base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9)))
        fps.add(f if rng.random() < 0.5 else base & 0xFFFF | rng.getrandbits(48) << 16)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    from leafmill.llm.graph import components

    roots = {r.node: r.root for r in components(edges).collect()}
    got = collections.defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f % (1 << 64))
    want = collections.defaultdict(set)
    for (d, f), c in brute_components([(f, f) for f in fps]).items():
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bk_tree():
    rng = random.Random(4)
    tree, fps = simhash.BKTree(), [rng.getrandbits(10) for _ in range(200)]
    fps = list(dict.fromkeys(fps))
    for f in fps:
        tree.add(f)
    for q in range(0, 1024, 7):
        assert sorted(tree.nodes[i] for i in tree.within(q, 2)) == sorted(f for f in fps if (f ^ q).bit_count() <= 2)


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert linededup.delete_repeats(empty).count() == 0
    assert maxent.score(empty).count() == 0
    assert bpe.encode_documents(empty, queries.vocabulary_path(), b"").count() == 0
    assert quality_rules.score_rules(empty, [0.0] * quality_rules.BUCKETS).count() == 0


# 7: sharding ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0, 400, 900])
def test_sharding_keeps_its_law(spark, hot):
    rows = [(i, "hot") for i in range(hot)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(5000 + i, f"one {i}") for i in range(333)] + [(None, None), (None, "")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    count = collections.Counter(r.shard for r in got)
    sizes = [count[s] for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    of = collections.defaultdict(set)
    text = dict(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t.encode())) or r.doc_id is None
        of[t].add(r.shard)
    cut = sum(len(s) > 1 for t, s in of.items() if t.startswith("pair"))
    assert cut <= 8
    if hot:
        assert len(of["hot"]) <= math.ceil(hot / (len(rows) // 16) / 0.9) + 2


@pytest.mark.parametrize("linked", [0.4, 1.0])
def test_labels_spread_under_quotas_and_cuts_fall(spark, linked):
    """With every document linked the labels are tight; even so no label passes its quota by more than chance."""
    rng = random.Random(3)
    rows, unit = [], 0
    while len(rows) < 6000 * linked:
        unit += 1
        rows += [(unit, rng.randrange(16)) for _ in range(rng.choice([2, 2, 3, 5, 9]))]
    quota = 6000 // 16
    labels, cuts = sharding.propagate(spark.createDataFrame(rows, "unit long, start int"), quota, rounds=6)
    of = {(r.unit, r.start): r.label for r in labels.collect()}
    got = [(u, of[u, s]) for u, s in rows]
    by = collections.defaultdict(list)
    for u, label in got:
        by[u].append(label)
    start = collections.defaultdict(list)
    for u, s in rows:
        start[u].append(s)
    pairs = lambda g: sum(a != b for x in g.values() for i, a in enumerate(x) for b in x[:i])
    assert cuts[0] == pairs(start)
    assert cuts[-1] == pairs(by)
    assert all(a >= b for a, b in zip(cuts, cuts[1:], strict=False))
    assert len(cuts) > (1 if linked < 1 else 2)
    assert cuts[-1] <= (0.01 if linked < 1 else 0.25) * cuts[0]
    sizes = collections.Counter(label for _, label in got)
    assert max(sizes.values()) <= 1.1 * quota


def test_sharding_of_odd_rows(spark, odd):
    """Nulls, long and empty texts, repeated rows and clashing columns."""
    frame = odd.withColumns({"shard": F.lit("s"), "slot": F.lit(None).cast("string"), "unit": F.lit(1), "g": F.lit("g"), "n": F.lit(2)})
    got = sharding.shard_documents(frame).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ODD)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) == 1
    assert all(r.slot == 0 for r in got)


# 8: line dedup -------------------------------------------------------------------------------------


def test_lines_give_the_text_again(spark, docs, odd):
    for frame in (docs.select("text"), odd.select("text")):
        for r in frame.withColumn("lines", linededup.lines_of(F.col("text"))).where("text is not null").collect():
            assert "".join(r.lines) == r.text
            assert r.lines == linededup._LINE.findall(r.text)


def test_common_blocks():
    blocks = lambda pairs, w=5: linededup.common_blocks([p for p, _ in pairs], [q for _, q in pairs], [w] * len(pairs), 20)
    run = lambda pairs: [b[:2] for b in blocks(pairs)]
    assert run([(i, i + 3) for i in range(4)]) == [(0, 3)]
    assert run([(i, i + 3) for i in range(3)]) == []
    assert run([(0, 10), (1, 11), (2, 12), (3, 13), (8, 0), (9, 1), (10, 2), (11, 3)]) == [(0, 3), (8, 11)]  # moved
    assert run([(0, 0), (1, 1), (2, 2), (3, 3), (6, 0), (7, 1), (8, 2), (9, 3)]) == [(0, 3), (6, 9)]  # repeated
    assert run([(0, 0), (2, 1), (4, 2), (6, 3)]) == []
    assert linededup.common_blocks([], [], []) == []
    moved = [(i, i + 10) for i in range(6)] + [(6 + i, i) for i in range(4)]
    assert blocks(moved) == [(0, 5, 10, False), (6, 9, 0, True)]
    assert blocks([(i, j) for i in range(4) for j in range(4)]) == [(0, 3, 0, False)]  # one line again and again
    n = 30_000  # blocks in reversed order take no longer than others
    start = time.perf_counter()
    assert len(linededup.common_blocks(range(n), [2 * (n - i) for i in range(n)], [20] * n)) == n
    assert time.perf_counter() - start < 3


def test_passages_go_from_later_documents(spark, odd):
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)).capitalize() + ". "
    passage = "".join(sentence() for _ in range(7))
    common = "Released under a licence. "
    rows = []
    for i in range(12):
        own = [sentence() for _ in range(8)]
        own.insert(3, common)
        if i in (2, 5, 9):
            own.insert(5, passage)
        rows.append((i, "".join(own)))
    rows.append((20, rows[0][1]))
    out = {r.doc_id: r for r in linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    for i, text in rows:
        if i in (5, 9):
            assert passage.strip() not in out[i].text
            assert out[i].text == text.replace(passage, "").rstrip() or out[i].n_cut >= 5
        elif i == 20:
            assert out[i].text == ""
        else:
            assert out[i].text == text
            assert out[i].n_cut == 0
    rows = linededup.delete_repeats(odd).collect()
    assert len(rows) == len(ODD)
    # One sentence again and again is a copy of the earlier document like any other; repeated rows are one document.
    assert [r.text for r in rows if r.doc_id == 5] == ["", ""]
    assert [r.text for r in rows if r.doc_id == 1] == ["The quick brown fox. " * 30]


def test_blocks_are_found_whoever_holds_their_parts(spark):
    """A block of eight lines whose pairs earlier documents hold, and random texts of few lines against all pairs of documents."""
    line = lambda i: " ".join(f"w{i}x{k}" for k in range(7)) + "\n"
    block = [line(i) for i in range(8)]
    rows = [(n, "".join([line(100 + n), *block[a : a + 2], line(200 + n)])) for n, a in enumerate((0, 2, 3, 5, 6))]
    rows += [(10, "".join([line(300), *block])), (11, "".join([*block, line(400)]))]
    out = {r.doc_id: r for r in linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert [out[n].n_cut for n in (0, 1, 2, 3, 4, 10, 11)] == [0, 0, 0, 0, 0, 0, 8]
    assert out[11].text == line(400).strip()
    rng = random.Random(9)
    words = [rng.choice((3, 5, 8, 12, 21)) for _ in range(12)]
    make = lambda i: " ".join(f"v{i}x{k}" for k in range(words[i])) + "\n"
    plans = [[rng.randrange(12) for _ in range(14)] for _ in range(25)]
    plans = [[x for i, x in enumerate(p) if not i or x != p[i - 1]] for p in plans]
    rows = [(n, "".join(map(make, p))) for n, p in enumerate(plans)]
    got = {r.doc_id: r.n_cut for r in linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=True).collect()}
    for n, p in enumerate(plans):
        cut = set()
        for q in plans[:n]:
            pairs = [(i, j, words[x]) for i, x in enumerate(p) for j, y in enumerate(q) if x == y]
            for a, b, _, _ in linededup.common_blocks(*([x[k] for x in pairs] for k in range(3))):
                cut.update(range(a, b + 1))
        assert got[n] == len(cut)


def test_later_copies_go_whoever_holds_their_lines(spark):
    line = lambda x: " ".join(f"{x}{k}" for k in range(6)) + ".\n"
    rows = [(1, line("a") + line("b")), (2, "".join(map(line, "abcd"))), (3, "".join(map(line, "abcd"))), (10, line("e") * 40), (11, line("e") * 40), (12, line("f") + line("e") * 25 + line("g"))]
    rows += [(20, "".join(map(line, "hijkl"))), (21, "".join(map(line, "klxhij"))), (None, "".join(map(line, "mnop"))), (30, "".join(map(line, "mnopq")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.text, r.n_cut) for r in linededup.delete_repeats(docs, counts=True).collect()}
    text = dict(rows)
    assert all(out[i] == (text[i], 0) for i in (None, 1, 2, 10, 20))
    assert out[3] == ("", 4)
    assert out[11] == ("", 40)
    assert out[12] == ((line("f") + line("g")).strip(), 25)
    assert out[21] == (text[21], 0)  # three and two lines: under twenty words each
    assert out[30] == (line("q").strip(), 4)
    blocks = {r.id: [tuple(b) for b in r.blocks] for r in linededup.shared_blocks(docs).collect()}
    assert blocks == {3: [(2, 0, 3, 0, False)], 11: [(10, 0, 39, 0, False)], 12: [(10, 1, 25, 0, False)], 30: [(None, 0, 3, 0, False)]}


def test_cuts_equal_alignments_of_all_pairs(spark, docs, texts):
    """On the small table: every document aligned line by line with every earlier one."""
    got = {r.doc_id: r.n_cut for r in linededup.delete_repeats(docs.select("doc_id", "text"), counts=True).collect()}
    lines = {i: [b" ".join(x.lower().encode().split()) for x in linededup._LINE.findall(t)] for i, t in texts.items()}
    words = {i: [len(x.split()) for x in own] for i, own in lines.items()}
    some = 0
    for i, own in sorted(lines.items()):
        cut = set()
        for j in (j for j in lines if j < i and not set(lines[j]).isdisjoint(own)):
            at = collections.defaultdict(list)
            for q, x in enumerate(lines[j]):
                at[x].append(q)
            pairs = [(p, q) for p, x in enumerate(own) for q in at.get(x, ())]
            for a, b, _, _ in linededup.common_blocks([p for p, _ in pairs], [q for _, q in pairs], [words[i][p] for p, _ in pairs]):
                cut.update(range(a, b + 1))
        assert got[i] == len(cut), i
        some += bool(cut)
    assert some > 20


def test_repeated_rows_and_null_ids_are_kept_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, text), (None, text + " more"), (4, text), (4, text)], "doc_id long, text string")
    out = collections.Counter((r.doc_id, r.text) for r in linededup.delete_repeats(docs).collect())
    assert out == {(4, ""): 2, (None, text): 2, (None, text + " more"): 1}


# 9: pages ------------------------------------------------------------------------------------------


def test_extraction(spark):
    side = "<nav><a href=/>Home page</a></nav><div class='sidebar'>Side text here</div>"
    page = lambda body: f"<html><body>{side}<div class='post-7 content'><h1>T&eacute;st</h1>{body}<div class='ad'>Buy</div><form>f</form><div id=comments>nice</div></div><footer>f</footer></body></html>"
    rows = [
        (1, "http://A.example/1", page("<p>One <b>t</b>wo\n three<p>four<script>if(a<b)x('</p>')</script><ul><li>a<li>b</ul>")),
        (2, "http://a.example:80/2", page("<p>short</p>")),
        (3, "http://a.example/3", None),
        (4, None, ""),
        (5, "http://b.example", "<article><p>only &amp; this</p></article>"),
        (5, "http://b.example", "<article><p>only &amp; this</p></article>"),
        (6, "http://a.example/x", "<p>no container at all"),
        (7, "not a url", "<nav>menu</nav>"),
    ]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text == {1: "Tést\nOne two three\nfour\na\nb", 2: "Tést\nshort", 3: "", 4: "", 5: "only & this", 6: "", 7: ""} | {6: text[6]}
    assert all(r.n_chars == len(r.text) for r in got)


def read(page):
    return html_extract.extract(page, html_extract.best_path(page))


def test_markup_is_read_as_browsers_do():
    assert read("<div><p title=it's>Hello</p></div>") == "Hello"
    assert read("<div><p data-x='a>b' class=\"c\"title=x>One</p><p a=b/>Two<br/>three</div>") == "One\nTwo\nthree"
    assert read("<article><h2 class='section-header'>Head</h2><p class='more'>One</p><p id=share>Two</p><p>a < b &amp; c &lt;d&gt;</article>") == "Head\nOne\nTwo\na < b & c <d>"
    assert read("<main><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li><div>e<li>f</ul></main>") == "a\nb\nc\nd\ne\nf"
    assert read("<article><!-- > no --><!-->yes<script>if (a<b) '</p>'</script ><style>p</style></article>") == "yes"
    noise = "".join(f"<div class='{c}'>no</div>" for c in ("ad", "cookie-notice", "post-comments", "site-footer", "ad-banner", "related-posts", "share box", "sidebar_left"))
    assert read(f"<body><div class='content sidebar-right'><p>yes</p>{noise}<div class='article-header'>too</div><div class='read-more-text'>and</div></div></body>") == "yes\ntoo\nand"
    assert read("<nav>menu</nav><footer>foot</footer>") is None
    assert read("<p>no container") == "no container"


@pytest.mark.parametrize("page", ["<div>" * 80_000 + "x", "<a '" * 80_000, "<a b=\"" * 80_000, "<div>" * 40_000 + "x</span>" * 40_000, "<p><span>" * 20_000 + "<li>x" * 20_000, "<!--" * 80_000, "<title>" * 80_000, "<div><p>a b" * 20_000])
def test_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    read(page)
    assert time.perf_counter() - start < 2


def test_hosts_decide_where_pages_are_ambiguous(spark):
    """Each page alone prefers its longer box; the host's other pages say which one is the article."""
    page = lambda story, box: f"<body><div class=lead><p>{story}</p></div><div class=teaser><p>{box}</p></div></body>"
    rows = [(i, f"https://u@Host.example:81/{i}", page("story " * 30, "box " * 3), "x", "y") for i in range(3)]
    rows += [(3, "//host.example/3", page("short story", "box " * 40), "x", "y"), (4, "https://other.example/4", page("short story", "box " * 40), "x", "y")]
    # Equal votes: the path that is first in order.
    rows += [(5, "https://tie.example/5", page("story " * 30, "box"), "x", "y"), (6, "https://tie.example/6", page("story", "box " * 40), "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_pages(frame).collect()}
    assert got == {i: ("story " * 30).strip() for i in range(3)} | {3: "short story", 4: ("box " * 40).strip(), 5: ("story " * 30).strip(), 6: "story"}
    assert html_extract.extract_pages(frame.limit(0)).collect() == []
    deep = spark.createDataFrame([(1, "http://d.example", "<div>" * 5000 + "word " * 100_000), (2, "http://d.example", "<div>" * 5000 + "b")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_extract.extract_pages(deep).collect()) == [1, 499_999]


def test_paths_equal_a_plain_sum(spark):
    """The scores of all containers against sums over the blocks' own steps."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        paths, score = html_extract.containers(r.html)
        own = html_extract.Paths()
        blocks = [(own.text(n).split(" > ") if n else [], len(t) * (1 - s)) for n, t, s in html_extract.blocks_of(r.html, own)]
        for n, step in enumerate(paths.step):
            steps = paths.text(n).split(" > ") if n else []
            total = sum(x for b, x in blocks if b[: len(steps)] == steps)
            tag, _, classes = step.partition(".")
            if n and tag not in html_extract._CONTAINER:
                assert score[n] == -1
            else:
                bonus = {"article": 2.5, "main": 1.6, "body": 0.5, "": 0.5}.get(tag, 1.0) * (1.3 if html_extract._GOOD.search(classes) else 1.0)
                assert score[n] == pytest.approx(total * bonus * (1 + 0.05 * min(len(steps), 10)))


def test_op9_reads_the_articles(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_consensus_paths(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|ul|li)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


# 10: language model --------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_scores_equal_brute_force(request, which):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*words_of(t), b" "])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        toks = [*words_of(t), b" "]
        want[i, held(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks), 4)] += 1
    got = maxent.score(frame).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_a_distribution_and_beats_the_base(spark):
    got = maxent.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    gain = (sum(r.score for r in got) - sum(r.base_score for r in got)) / sum(r.n_tokens for r in got)
    assert gain > 0.08  # log10 a held-out token
    train = spark.createDataFrame([("a b a c",), ("b a",)], "text string")
    model, counts = maxent.fit(train)
    lp = model.log_classes([np.zeros(3, np.int64)] * len(maxent.FEATURES))
    assert np.exp(lp).sum(axis=1) == pytest.approx([1, 1, 1], abs=1e-5)
    by = collections.defaultdict(float)
    for r in counts.collect():
        by[model.head.get(bytes(r.token), (0, maxent.class_of(bytes(r.token))))[1]] += (r.n + 1) / 10 ** model.log_size[model.head[bytes(r.token)][1]]
    assert all(p < 1 for p in by.values())  # the rest of each class is for a word never seen


def test_scores_equal_a_plain_model(spark, docs, monkeypatch):
    """The score column against the model's formula token by token, with counts that have to be joined."""
    monkeypatch.setattr(maxent, "HEAD_SHARE", 300)
    frame = docs.where("doc_id < 120")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    train = spark.createDataFrame([(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], "doc_id long, text string")
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in maxent.tokens_of(t))
    model, table = maxent.fit(train)
    assert {bytes(r.token): r.n for r in table.collect()} == counts
    assert 0 < len(model.head) < len(counts) / 10
    spelled = table.select("token", maxent._class_column(F.col("token")).alias("c")).collect()
    assert all(r.c == maxent.class_of(bytes(r.token)) for r in spelled)
    sizes = collections.Counter()
    for w, n in counts.items():
        sizes[model.head[w][1] if w in model.head else maxent.class_of(w)] += n + 1
    assert [round(10 ** x) for x in model.log_size] == [sizes[k] + 1 for k in range(maxent.CLASSES)]
    words = maxent.Words(model.head)
    want = {}
    for i, t in rows:
        toks, total = maxent.tokens_of(t), 0.0
        for k, w in enumerate(toks):
            ids = np.array([words[x] if x else 0 for x in ([b""] * 4 + toks)[k : k + 5]])
            words.learn()
            c = maxent._contexts(ids, np.array([4]), words, model.buckets)
            cls = int(words.cls[words[w]])
            total += model.log_classes(c)[0, cls] / math.log(10) + math.log10(counts[w] + 1) - model.log_size[cls]
        want[i] = total
    got = {r.doc_id: r.score for r in maxent.score(frame).collect()}
    assert got == {i: pytest.approx(x, rel=1e-4, abs=1e-3) for i, x in want.items()}


def test_updates_climb_the_likelihood(spark):
    rng = random.Random(23)
    # Two languages: what comes next depends on the words before.
    texts = [" ".join(rng.choice(["le", "la", "de", "que"] if i % 2 else ["the", "of", "and", "to"]) for _ in range(60)) for i in range(200)]
    counts = collections.Counter(w for t in texts for w in maxent.tokens_of(t))
    model = maxent.start_model(list(counts.items()), {})

    def mean():
        words, total, n = maxent.Words(model.head), 0.0, 0
        for ids, places, _ in maxent._pieces(texts, words):
            cls = words.cls[ids[places]]
            total += model.log_classes(maxent._contexts(ids, places, words, model.buckets))[np.arange(len(places)), cls].sum()
            n += len(places)
        return total / n

    values = [mean()]
    for turn in range(4):
        grid = np.zeros((1 + maxent.CLASSES, len(model.weights) + 1))
        model.rest(texts, maxent.Words(model.head), grid)
        model.update(grid, turn)
        values.append(mean())
    assert values == sorted(values)
    assert values[-1] - values[0] > 0.4
    share = np.exp(model.log_classes([np.arange(5) * k % len(model.weights) for k in range(len(maxent.FEATURES))]))
    assert share.sum(axis=1) == pytest.approx(np.ones(5), abs=1e-5)


def test_language_model_on_odd_rows(spark, odd):
    """Clashing columns, equal rows and equal counts: one row each, equal scores for equal texts."""
    frame = odd.withColumns({"part": F.lit("p"), "token": F.lit(b"t"), "n": F.lit(1), "held_out": F.lit("h"), "doc": F.lit(3)})
    got = maxent.score(frame).collect()
    assert len(got) == len(ODD)
    scores = {round(r.score, 6) for r in got if r.doc_id in (1, 5)}
    assert len(scores) == 1
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert maxent.classes_of([(b"b", 5), (b"a", 5), (b" ", 9)]) == maxent.classes_of([(b" ", 9), (b"a", 5), (b"b", 5)])


def test_contexts_follow_the_training_tokens():
    for tokens in (1 << 20, 1 << 24, (1 << 24) + 1, 1 << 28, 10**10, 10**13):
        contexts = maxent.shards_of(tokens) * maxent.buckets_of(tokens)
        assert tokens / maxent.BUCKET_TOKENS <= contexts < 2 * tokens / maxent.BUCKET_TOKENS + maxent.SHARD_BUCKETS
        assert maxent.buckets_of(tokens) <= maxent.BUCKETS[1]


def test_dealt_contexts_equal_plain_shards(spark, docs, monkeypatch):
    """Contexts in shards against shards learnt one by one, with hot words, repeated texts and documents cut by windows."""
    for name, value in (("HEAD_SHARE", 300), ("BUCKET_TOKENS", 64), ("BUCKETS", (16, 32)), ("SHARD_BUCKETS", 64), ("WINDOW_TOKENS", 500), ("WINDOW_DOCS", 40)):
        monkeypatch.setattr(maxent, name, value)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 90").collect()]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, None), (2001, ""), (2002, "x"), (2003, "the " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = spark.createDataFrame([(i, t or "") for i, t in rows if not held[i]], "doc_id long, text string")
    turn = {r.doc_id: r.turn for r in train.select("doc_id", maxent._turn(train.columns, maxent.ROUNDS).alias("turn")).collect()}
    model, table = maxent.start(train)
    counts = {bytes(r.token): r.n for r in table.collect()}
    shards, most = maxent.shards_of(model.tokens), 64 * 64 // 4
    assert shards > 3
    assert sum(n > most for n, _ in model.head.values()) > 0
    with pytest.raises(ValueError, match="shards"):
        maxent.fit(train)
    words, tokens, want = maxent.Words(model.head), collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        toks = maxent.tokens_of(t or "")
        ids = np.array([0] * 8 + [words[w] for w in toks])
        words.learn()
        places = np.arange(8, len(ids))
        contexts, cls = np.stack(maxent._contexts(ids, places, words, model.buckets)), words.cls[ids[places]]
        for k, s in enumerate(maxent._shards(ids, places, words, shards, most).tolist()):
            tokens[s].append((i, turn.get(i), contexts[:, k], int(cls[k])))
        want[i] = sum(math.log10(counts.get(w, 0) + 1) - model.log_size[c] for w, c in zip(toks, cls, strict=True))
    assert len(tokens) == shards
    assert max(map(len, tokens.values())) < 0.6 * sum(map(len, tokens.values()))
    for own in tokens.values():
        part = dataclasses.replace(model, weights=np.zeros_like(model.weights))
        for k in range(maxent.ROUNDS):
            grid = np.zeros((1 + maxent.CLASSES, len(part.weights) + 1))
            for _, _, c, cls in (x for x in own if x[1] == k):
                part.add_rest(list(c[:, None]), np.array([cls]), grid)
            part.update(grid, k)
        for i, _, c, cls in own:
            want[i] += part.log_classes(list(c[:, None]))[0, cls] / math.log(10)
    got = {r.doc_id: r.score for r in maxent.score(frame).collect()}
    assert got == {i: pytest.approx(x, rel=1e-4, abs=1e-3) for i, x in want.items()}
    assert all(got[1000 + i] == pytest.approx(got[rows[i][0]], rel=1e-9) for i in range(5))


def test_windows_of_dealt_tokens_make_no_difference(spark, odd, monkeypatch):
    """A text that goes on in another window, null and repeated ids, clashing columns."""
    for name, value in (("BUCKET_TOKENS", 64), ("BUCKETS", (16, 32)), ("SHARD_BUCKETS", 64)):
        monkeypatch.setattr(maxent, name, value)
    long = spark.createDataFrame([(9, "a b c d e " * 60_000, "c"), (10, "a b", "c")], "doc_id long, text string, score string")
    frame = odd.unionByName(long).coalesce(2).withColumns({"key": F.lit("k"), "turn": F.lit("t"), "base": F.lit(7), "n": F.lit(1), "class_log": F.lit("l")})

    def scores():
        return sorted((r.doc_id or 0, r.n_tokens, r.score) for r in maxent.score(frame).collect())

    whole = scores()
    assert len(whole) == len(ODD) + 2
    assert all(math.isfinite(s) and s < 0 for _, _, s in whole)
    assert {n for i, n, _ in whole if i == 9} == {300_001}
    monkeypatch.setattr(maxent, "WINDOW_TOKENS", 1000)
    monkeypatch.setattr(maxent, "WINDOW_DOCS", 2)
    for (i, n, s), (j, m, t) in zip(whole, scores(), strict=True):
        assert (i, n) == (j, m)
        assert s == pytest.approx(t, rel=1e-4, abs=1e-3)


# Pipeline ------------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_hand(spark, docs, texts):
    out = corpus_pipeline.run(spark, SF)
    rows = {r.doc_id: r for r in out.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, current, SF)
        assert following.columns == docs.columns, name
        current = spark.createDataFrame(following.collect(), docs.schema)
    assert set(rows) == {r.doc_id for r in current.collect()}
    lib = bpe.library(queries.vocabulary_path())
    for r in current.collect():
        assert list(rows[r.doc_id].ids) == lib.encode(r.text, add_special_tokens=False).ids
    rejected = {i for i, t in texts.items() if base_rules(t)[0] < 50}
    assert not rejected & set(rows)


def test_pipeline_of_nothing_that_is_kept(spark, tmp_path):
    for name, rows in {"short": [(1, "few words", "en", "s", 9), (2, None, "en", "s", 0), (None, "", None, None, None)], "none": []}.items():
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_keep_clashing_columns(spark, odd):
    frame = odd.withColumns({"kept": F.lit("x"), "row": F.lit(1), "n_cut": F.lit(2), "n_words": F.lit(3), "key": F.lit("k"), "lang": F.lit(None).cast("string")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert all(r.kept == "x" and r.row == 1 and r.n_cut == 2 and r.n_words == 3 for r in out.collect()), name
        assert stage(spark, frame.limit(0), SF).count() == 0
