from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from seriesloom.llm import ann, chat, mixing, packing, quality_classifier, quality_rules, simhash, suffix_array, suffix_dedup, token_counts, toxicity
from seriesloom.llm.graph import components
from seriesloom.llm.tokens import PreTokenizer, load, vocabulary_path


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def test_simhash_equals_brute_force(documents, clashing, hard_texts):
    prints = [brute.fingerprint(t) for t in hard_texts]
    want = brute.components(prints)
    for df in (documents, clashing):
        got = by_id(simhash.op1_simhash(df))
        assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (prints[i], want[i]) for i in range(len(prints))}


def test_covering_masks_cover():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i in range(64) for j in range(64))


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(600):
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64 if p >> 63 else 0) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes), "a", "b").collect()}
    want = brute.components(prints)
    groups = defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert {got[i] for i in range(101)} == {0} and got[300] == 200


def test_simhash_of_nothing_and_of_null_ids(empty, documents, spark):
    assert simhash.op1_simhash(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    unnamed = documents.where("doc_id = 3").selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    rows = simhash.op1_simhash(unnamed.unionByName(documents.where("doc_id = 3").select("doc_id", "text"))).collect()
    assert {r.component_id for r in rows} == {3} and len(rows) == 2
    assert [r.component_id for r in simhash.op1_simhash(unnamed).collect()] == [None]


def test_keep_one_leaves_one_of_each_group(documents, hard_texts):
    want = set(brute.components([brute.fingerprint(t) for t in hard_texts]))
    kept = simhash.keep_one(documents.unionByName(documents.where("doc_id = 0")))
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)


# 2


@pytest.fixture(scope="module")
def toxic(spark, prose):
    rng = random.Random(3)
    texts = []
    for i in range(600):
        text = prose(1000 + i, 60)
        if bad := i % 4 == 0:
            parts = text.split()
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["vilewort", "gruntfool", "snarkzed"]))
            text = " ".join(parts)
        texts.append((i, text, int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in texts] + [(None, 1, 1), (9999, None, None)], "doc_id long, toxic int, quality int")
    return docs, labels, {i: y for i, _, y in texts}


def test_toxicity_is_learned(toxic):
    docs, labels, truth = toxic
    got = by_id(toxicity.op2_toxicity(docs, labels))
    held = {i: r for i, r in got.items() if r.held_out}
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[i] for i, r in held.items()]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [texts[i][r.worst_start : r.worst_end] for i, r in got.items() if r.predicted]
    assert np.mean([any(w in s for w in ("vilewort", "gruntfool", "snarkzed")) for s in found]) > 0.97


def test_toxicity_edge_cases(toxic, documents, clashing, empty, spark):
    _, labels, _ = toxic
    assert toxicity.op2_toxicity(clashing, labels).count() == documents.count()
    assert toxicity.op2_toxicity(empty, labels).count() == 0
    none = labels.where("false")
    got = by_id(toxicity.op2_toxicity(documents, none))
    assert got[[i for i, r in by_id(documents).items() if r.text is None][0]].score < 0.01
    assert toxicity.keep_clean(documents, none).count() == documents.count()


def plain_toxicity(text, weights, bias):
    """Every sentence with a telling word is an instance; the score is the chance that one of them, or the leak, is toxic."""
    clean = 1 - 1 / (1 + math.exp(-bias))
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        total = 0.0
        for word in re.findall(r"[^\W_]+", sentence):
            total += weights.get(word, 0.0) + sum(weights.get(word[:n] + "~", 0.0) for n in (4, 5, 6) if len(word) >= n)
        if total:
            clean *= 1 - 1 / (1 + math.exp(-(bias + total)))
    return 1 - clean


def test_toxicity_scores_equal_the_plain_formula(spark, documents, hard_texts):
    long = "x" * 100
    weights = {"same": 1.5, "line": -0.25, "here~": 2.0, "ünïc~": 3.0, long: 4.0, "text": 0.75}
    texts = [*hard_texts, f"{long}. {long[:64]}! Same LINE", "Text text? same here", "here\nhereabouts _same_"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r.score for r in toxicity.score(docs, weights, -3.0).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_toxicity(t, weights, -3.0) for t in texts], abs=1e-12)


def test_training_takes_one_text_of_an_id_and_reruns_agree(toxic):
    docs, labels, _ = toxic
    once = toxicity.train(docs, labels, "toxic", F.lit(True))
    many = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4")).repartition(11)
    assert toxicity.train(many, labels, "toxic", F.lit(True)) == once


def test_noisy_or():
    assert toxicity.noisy_or([], -20.0) < 1e-8
    assert toxicity.noisy_or([20.0, 20.0, 0.0, 0.0], -20.0) == pytest.approx(0.75)


# 3


def test_suffix_arrays_on_random_strings():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", b"a"])
        word = lambda n: bytes(rng.choice(letters) for _ in range(n))
        base = word(60)
        texts = [word(rng.randint(0, 15)) + base[(a := rng.randint(0, 50)) : a + rng.randint(0, 30)] + word(rng.randint(0, 15)) for _ in range(rng.randint(1, 6))]
        s, _ = suffix_array.join_texts(texts)
        sa = suffix_array.suffix_array(s, 200)
        raw = s.tobytes()
        assert [raw[i:] for i in sa] == sorted(raw[i:] for i in range(len(raw)))
        n = rng.choice([3, 5, 8])
        seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        want = [[i for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1] for t in texts]
        assert [x.tolist() for x in suffix_array.repeated_starts(texts, n)] == want


def test_equal_windows_share_their_anchor_hash(prose):
    a, b = prose(1, 300).encode(), b"zz" + prose(1, 300).encode()[3:]
    own = [{s: int(h) for _, _, x, y, h in zip(*suffix_dedup.anchors([t])) for s in range(x, y + 1)} for t in (a, b)]
    assert set(own[0]) == set(range(len(a) - 399))
    assert all(own[0][s] == own[1][s - 1] for s in range(3, len(a) - 399))


@pytest.mark.parametrize("contexts", [suffix_dedup.CONTEXTS, 1])
def test_suffix_dedup_equals_brute_force(documents, hard_texts, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    want = brute.repeated_bytes(hard_texts, 400)
    got = by_id(suffix_dedup.op3_suffix_dedup(documents))
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(hard_texts))] == want
    assert [got[i].n_bytes for i in range(len(hard_texts))] == [len((t or "").encode()) for t in hard_texts]


def test_suffix_dedup_edge_cases(documents, clashing, empty, spark):
    assert suffix_dedup.op3_suffix_dedup(empty).count() == 0
    assert sorted(map(tuple, suffix_dedup.op3_suffix_dedup(clashing).collect())) == sorted(map(tuple, suffix_dedup.op3_suffix_dedup(documents).collect()))
    twice = documents.where("doc_id IN (11, 13)").selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert {r.n_removed == r.n_bytes for r in suffix_dedup.op3_suffix_dedup(twice.unionByName(twice)).collect()} == {True}


def test_documents_lose_their_repeated_passages(documents, hard_texts):
    out = suffix_dedup.without_repeats(documents)
    assert out.columns == documents.columns
    got, want = by_id(out), brute.without_passages(hard_texts)
    for i, t in enumerate(hard_texts):
        if t and not want[i].strip() and want[i] != t:
            assert i not in got
        else:
            assert (got[i].text or "") == want[i]
            assert got[i].text is None or len(got[i].text) == got[i].n_chars


def test_passages_between_the_two_lengths(spark, prose):
    """Passages of 51 words go and of 49 stay, both far under 400 bytes; several tasks, null and repeated ids."""
    passages = {n: " ".join(prose(n, n).replace(".", "").split()[:n]) for n in (49, 51, 55, 60)}
    assert all(len(p) < 400 for p in passages.values())
    texts = [f"{prose(900 + i, 25)} {p} {prose(1900 + i, 25)}" for i in range(3) for p in passages.values()]
    texts += [prose(3000 + i, 40) for i in range(20)] + [passages[49]] * 2 + [passages[60]] * 2
    rows = [(None if i % 5 == 0 else i // 2, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = sorted(t for t in brute.without_passages(texts) if t.strip())
    assert sorted(r.text for r in suffix_dedup.without_repeats(docs).collect()) == want
    assert sum(passages[49] in t for t in want) == 5 and not any(passages[n] in t for t in want for n in (51, 55, 60))


def test_texts_of_one_letter_stay_small(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a" * 300_000, "ab" * 100_000])], ["id", "text"])
    (found,) = suffix_dedup._scan(400, 64)(iter([batch]))
    assert max(map(len, found.column(4).to_pylist())) <= 4
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "ab" * 100_000), (3, "a" * 399)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.op3_suffix_dedup(docs).collect()}
    assert got == {1: (300_000, 1), 2: (200_000, 1), 3: (0, 0)}


# 4


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[500:540] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, block=512).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        top = np.lexsort((np.arange(3000), d))[:10]
        hits += len({i for _, i, _ in found} & set(top.tolist()))
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, _, s in found] == pytest.approx([d[i] for _, i, _ in found])
    assert hits / (10 * len(got)) >= 0.9
    assert [i for _, i, _ in got[0]] == list(range(500, 510))


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.id) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.where("false")).count() == 0


# 5


def test_rules_count_as_brute_force(documents, clashing, hard_texts, empty):
    for df in (documents, clashing):
        got = by_id(quality_rules.op5_quality_rules(df))
        for i, t in enumerate(hard_texts):
            want = brute.rule_counts(t)
            assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
            assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (got[i].base_failed and got[i].kept)
    assert quality_rules.op5_quality_rules(empty).count() == 0


def plain_votes(text):
    """The nine rules, read from their definition: 1 good, 0 bad, None abstains."""
    text = text or ""
    n, chars, symbols, dup, repeat = brute.rule_counts(text)
    words, lines = brute.words(text), [x for x in text.split("\n") if brute.words(x)]
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    ends = sum(unicodedata.category(x.rstrip(" \t\v\f\r")[-1])[0] == "P" for x in lines)
    letter = lambda c: re.match(r"[^\W\d_]", c) is not None
    letters, lettered = sum(map(letter, text)), sum(any(map(letter, w)) for w in words)
    m, k, c = max(n, 1), max(len(lines), 1), max(chars, 1)

    def vote(good, bad):
        return 0 if bad else 1 if good else None

    return (
        vote(n >= 100, n < 50),
        vote(2.5 <= chars / m <= 9, not 1.5 <= chars / m <= 14),
        vote(symbols / m < 0.1, symbols / m > 0.3),
        vote(dup / k < 0.1, dup / k > 0.5),
        vote(repeat / m < 0.1, repeat / m > 0.3),
        vote(caps / m < 0.15, caps / m > 0.5),
        vote(ends / k >= 0.5, len(lines) >= 3 and ends / k < 0.1),
        vote(lettered / m >= 0.95, lettered / m < 0.8),
        vote(letters / c >= 0.9, letters / c < 0.75),
    )


def test_kept_equals_plain_expectation_maximisation(documents, hard_texts):
    """Votes, accuracies and posteriors document by document, in plain loops."""
    votes = [plain_votes(t) for t in hard_texts]
    prior, good, bad = 0.8, [0.9] * 9, [0.5] * 9

    def quality(v):
        z = math.log(prior / (1 - prior))
        for j, x in enumerate(v):
            z += 0 if x is None else math.log(good[j] / bad[j]) if x else math.log((1 - good[j]) / (1 - bad[j]))
        return 1 / (1 + math.exp(-z))

    q = [0.9 if v.count(0) < 2 else 0.1 for v in votes]
    for _ in range(500):
        prior = (sum(q) + 20 * 0.8) / (len(votes) + 20)
        for j in range(9):
            cast = [(p, v[j]) for p, v in zip(q, votes) if v[j] is not None]
            good[j] = (sum(p for p, x in cast if x) + 20 * 0.9) / (sum(p for p, _ in cast) + 20)
            bad[j] = (sum(1 - p for p, x in cast if x) + 20 * 0.5) / (sum(1 - p for p, _ in cast) + 20)
        q = [quality(v) for v in votes]
    got = by_id(quality_rules.op5_quality_rules(documents))
    for i, (t, v) in enumerate(zip(hard_texts, votes)):
        n, _, _, _, repeat = brute.rule_counts(t)
        assert got[i].quality == pytest.approx(quality(v), abs=1e-6), i
        assert got[i].kept == (n >= 20 and 100 * repeat <= 30 * n and quality(v) >= 0.5), i


def test_a_lone_bad_vote_of_a_weak_rule_does_not_reject(spark):
    """On the given documents: short ones, whose bad vote comes alone, stay; what their labels call bad goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "label"), F.col("id") == F.col("doc_id"), "left").collect()
    names = [f"vote_{n}" for n, _ in quality_rules.rules()]
    lone = [r for r in rows if [r[n] for n in names].count(0) == 1 and r.n_words >= 20]
    assert sum(r.good for r in lone if r.vote_length == 0) > 5
    told = [r for r in rows if r.label is not None and r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words]
    assert np.mean([r.good for r in told if r.label == 1]) > 0.99 and np.mean([r.good for r in told if r.label == 0]) < 0.05


def test_lines_of_any_script_end():
    for text in ("これは文です。\n" * 3, "यह वाक्य है।\n" * 3, "Это текст.\n" * 3, "¿Qué?»\n" * 3):
        stats = dict(zip(quality_rules.STATS, quality_rules.statistics(text.encode())))
        assert stats["n_ends"] == stats["n_lines"] == 3 and stats["n_letters"] > 0
    stats = dict(zip(quality_rules.STATS, quality_rules.statistics("ЭТО ВСЁ КРИК A\u00a0B".encode())))
    assert (stats["n_words"], stats["n_caps"]) == (4, 4)


def test_expectation_maximisation_tells_rules_apart():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    catches = (0.7, 0.6, 0.5, 0.01)  # how often a rule votes bad on a bad document
    votes = [tuple(None if rng.random() < 0.1 else int(rng.random() >= (0.004 if t else c)) for c in catches) for t in truth]
    prior, good, bad = quality_rules.fit(sorted(Counter(votes).items(), key=str))
    assert prior == pytest.approx(0.8, abs=0.07)
    assert bad[3] > max(bad[:3]) + 0.2 and good.min() >= 0.98
    table = np.array([[-1 if v is None else v for v in p] for p in votes])
    kept = quality_rules.posterior(table, prior, good, bad) >= 0.5
    assert kept[truth].mean() > 0.97 and (~kept[~truth]).mean() > 0.85


# 6


def test_compression_tells_good_from_bad(spark, prose):
    rng = random.Random(6)
    junk = lambda n: " ".join(rng.choice(["BUY NOW!!", "CLICK###", "$$$ FREE $$$", "WIN%%%"]) for _ in range(n))
    texts = {i: prose(4000 + i, 120) if i % 3 else junk(80) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in texts], "doc_id long, quality int")
    got = by_id(quality_classifier.op6_quality(docs, labels))
    held = [i for i in texts if got[i].held_out]
    assert held == [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert {r.score for r in quality_classifier.op6_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.op6_quality(docs.where("false"), labels).count() == 0


def test_quality_scores_equal_the_plain_formula(spark, hard_texts, prose):
    good, bad = prose(1, 3000).encode(), b"BUY NOW!! CLICK### " * 400
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]
    texts = [*hard_texts, prose(2, 900), "BUY NOW!! CLICK### " * 300]
    want = []
    for t in texts:
        data = (t or "").encode()
        a, b = (sum(len(tool.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for tool in tools)
        x = (b - a) / (a + b) if data else 0.0
        want.append((x, 1 / (1 + math.exp(-(9.0 * x - 0.5)))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(quality_classifier.score(docs, good, bad, 9.0, -0.5), "id")
    assert [got[i].difference for i in range(len(texts))] == pytest.approx([x for x, _ in want], abs=1e-12)
    assert [got[i].score for i in range(len(texts))] == pytest.approx([p for _, p in want], abs=1e-12)


# 7 and 8


@pytest.fixture(scope="module")
def ids(hard_texts):
    tokenizer = load(vocabulary_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in hard_texts]


def test_packing_is_a_round_trip(documents, clashing, hard_texts, ids):
    for df in (documents, clashing):
        rows = packing.op7_packing(df).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            own = [*ids[r.doc_id], 1][r.start : r.start + r.length]
            assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) + 1
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            pieces[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        for i in range(len(hard_texts)):
            at = 0
            for start, length in sorted(pieces[i]):
                assert start == at
                at += length
            assert at == len(ids[i]) + 1
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
        assert len(sequences) <= sum(r.length for r in rows) / packing.WINDOW + 2


def test_the_shelf_is_bounded_and_fits_best():
    shelf = packing.Shelf(10, 2)
    assert shelf.place(6) == (0, 0, None)
    assert shelf.place(7) == (1, 0, None)
    assert shelf.place(3) == (1, 7, None)
    assert shelf.place(5) == (2, 0, None)
    assert shelf.place(8) == (3, 0, 0)


def test_packing_nothing(empty):
    assert packing.op7_packing(empty).count() == 0


def test_token_counts(documents, clashing, hard_texts, ids, empty):
    for df in (documents, clashing):
        got = by_id(token_counts.op8_token_counts(df))
        assert [got[i].n_tokens for i in range(len(ids))] == list(map(len, ids))
        assert [got[i].n_bytes for i in range(len(ids))] == [len((t or "").encode()) for t in hard_texts]
        assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())
    assert token_counts.op8_token_counts(empty).count() == 0


@pytest.mark.parametrize("frequent", [0, 60, token_counts.FREQUENT])
def test_random_texts_tokenize_as_the_library_does(spark, frequent):
    rng, letters = random.Random(3), "ab'sé1² \n\t _-ñß½Ⅷ\x1c\xa0　日本'll 'Re\U0001f600\U0001d7d8\U000e01f5"
    tokenizer = load(vocabulary_path())
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) + ("<|endoftext|>" if k % 7 == 0 else "") for k in range(1500)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if not frequent:
        encoder = packing.Encoder(vocabulary_path())
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.n_tokens for r in token_counts.token_counts(docs, frequent=frequent).collect()}
    assert [got[i] for i in range(len(texts))] == list(map(len, want))


def test_pre_tokens_of_all_kinds_of_characters():
    split = PreTokenizer(vocabulary_path())
    known = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 11)]) if unicodedata.category(c) != "Cn"]
    for c in known:
        text = f"a{c}b 1{c}2 {c}! {c}"
        assert split(text) == [text[x:y] for _, (x, y) in split.tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))
    assert split("x \U0001f600 y") == ["x", " \U0001f600", " y"] and split("a<|endoftext|>") is None


# 9


def test_mixing(documents, clashing, hard_texts):
    sources = {r.doc_id: r.source for r in documents.collect()}
    sizes = defaultdict(int)
    for i, t in enumerate(hard_texts):
        sizes[sources[i]] += len(brute.words(t))
    want = brute.targets(sizes)
    for df in (documents, clashing):
        got = by_id(mixing.op9_mixing(df))
        taken = defaultdict(int)
        for i, r in got.items():
            assert r.size == len(brute.words(hard_texts[i])) and r.source_size == sizes[sources[i]]
            assert r.target == pytest.approx(want[sources[i]]) and 0 <= r.taken <= 3 * r.size
            taken[sources[i]] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert got == by_id(mixing.op9_mixing(clashing.repartition(7)))


def test_mixing_extremes(spark, empty):
    assert mixing.op9_mixing(empty).count() == 0
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "a b c d e f", "y"), (4, "a b c d e f", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op9_mixing(df).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 15
    assert {r.taken for r in got if r.size == 0} == {0}


def test_whole_epochs_come_first(spark):
    rows = [(i, "w " * 10, "a") for i in range(20)] + [(100 + i, "w " * 10, "b") for i in range(200)]
    got = mixing.op9_mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.taken for r in got if r.doc_id < 100} == {30}
    assert all(r.taken <= 10 for r in got if r.doc_id >= 100)


@pytest.mark.parametrize("unit", [5 * 10**7, 10**8, 10**9, 10**17])
def test_targets_of_large_sizes(spark, unit):
    """Sizes whose products with weights and with each other need more than 32 bits, and more than 64."""
    for parts in ((6, 6, 5), (1, 5, 5, 5), (2, 3, 4, None, 8)):
        sizes = {None if n is None else f"s{i}": unit * (n or 1) for i, n in enumerate(parts)}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(brute.targets(sizes)) and {r.source: r.source_size for r in got} == sizes


def test_mixed_documents_repeat_rows(documents):
    took = {r.doc_id: r.taken / r.size for r in mixing.op9_mixing(documents).collect() if r.size}
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: int(t + 0.5) for i, t in took.items() if int(t + 0.5)})


def test_spaceless_texts_are_not_remembered(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(1500)) for _ in range(40)]
    encoder = packing.Encoder(vocabulary_path())
    ids = encoder.encode(texts)
    assert not encoder.known and all(np.frombuffer(x, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids for x, t in zip(ids, texts))
    monkeypatch.setattr(packing, "MEMORY", 20_000)
    words = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(50)) for _ in range(60)]
    for t in words:
        encoder.encode([t])
        assert encoder.known.held <= 20_000 and len(encoder.known) < 200


def test_places_of_sentences_are_those_of_the_text():
    text = "İİİ one. two bad three! İ end"
    found = toxicity.sentence_scores(text, toxicity.WordScores({"bad": 2.0, "i̇": 1.0}))
    assert [(text[a:b], s) for a, b, s in found] == [("İİİ one", 0.0), (" two bad three", 2.0), (" İ end", 1.0)]


# 10


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")


def test_preferences_share_their_prompt_once(spark):
    chosen = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "why"), (1, 3, "assistant", "so"), (2, 0, "user", "x"), (3, 0, "user", None), (None, 0, "user", "no")])
    rejected = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "why"), (1, 3, "assistant", "no"), (2, 0, "user", "x"), (1, 0, "user", "hi"), (4, 0, "assistant", "y")])
    rows = by_id(chat.format_preferences(chosen, rejected), "pair_id")
    row = rows[1]
    assert row.prompt == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nwhy\n"
    assert (row.chosen, row.chosen_mask, row.rejected, row.rejected_mask, row.chosen_chars) == ("<|assistant|>\nso\n", [1], "<|assistant|>\nno\n", [1], [len("<|assistant|>\nso\n")])
    assert (rows[2].prompt, rows[2].chosen, rows[2].rejected, rows[2].chosen_mask) == ("<|user|>\nx\n", "", "", [])
    assert (rows[3].prompt, rows[3].chosen, rows[3].rejected) == ("", "<|user|>\n\n", "")
    assert (rows[4].prompt, rows[4].chosen, rows[4].rejected, rows[4].rejected_mask) == ("", "", "<|assistant|>\ny\n", [1])
    assert sorted(rows) == [1, 2, 3, 4]


def test_later_equal_turns_are_no_prompt(spark):
    a = turns(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")])
    b = turns(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "z"), (1, 2, "user", "c")])
    (row,) = chat.format_preferences(a, b).collect()
    assert (row.prompt, row.chosen_mask, row.rejected_mask) == ("<|user|>\na\n", [1, 0], [1, 0])


def test_swapped_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "later"), (7, 0, "user", "p"), (7, 1, "assistant", "a2"), (3, 0, "user", "alone"), (None, 0, "user", "x"), (1, 0, "user", "q")]
    extra = {c: F.lit(c) for c in ("mask", "pair_id", "part", "place", "turns", "chosen", "prompt", "last", "other", "c", "r", "t")}
    out = chat.op10_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(extra))
    u, r = (lambda x: f"<|user|>\n{x}\n"), (lambda x: f"<|assistant|>\n{x}\n")
    got = sorted((x.pair_id, x.prompt, x.chosen, x.rejected, x.chosen_mask, x.rejected_mask) for x in out.collect())
    assert got == [
        (1, u("q"), r("a1") + u("later"), r("a2") + u("later"), "1,0", "1,0"),  # the next id with a reply, gaps or not
        (3, u("alone"), "", "", "", ""),
        (7, u("p"), r("a2"), r("a1"), "1", "1"),  # after the last comes the first
    ]
    assert chat.op10_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_take_one_row(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(600)] + [(8, 0, "user", f"{i:04}") for i in range(300)] + [(9, 1, "assistant", "é" * 200_000)]
    out = {x.pair_id: x for x in chat.op10_chat(spark.createDataFrame(rows + rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(out) == [7, 8, 9]
    assert out[7].prompt + out[7].chosen == "".join(f"<|{r}|>\n{t}\n" for _, _, r, t in rows[:600])
    assert out[7].rejected == f"<|assistant|>\n{'é' * 200_000}\n" == out[9].chosen and out[9].rejected == "<|assistant|>\nt599\n"
    assert out[8].prompt == "".join(f"<|user|>\n{i:04}\n" for i in range(300))
