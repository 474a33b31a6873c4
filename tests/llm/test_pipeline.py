from __future__ import annotations

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest

from seriesloom.llm import mixing, toxicity
from seriesloom.llm.common import held_out, row_key


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    passage = prose(77, 120)
    texts = {i: prose(i, 60) for i in range(120)}
    texts |= {i: texts[i - 60] + (" vilewort gruntfool vilewort" if i % 3 == 0 else "") for i in range(120, 180)}
    texts |= {i: prose(i, 20) + " " + passage + " " + prose(i + 500, 20) for i in range(180, 190)}
    texts |= {190: None, 191: "", 192: "a b"}
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(120 <= i < 180 and i % 3 == 0), 1) for i in range(190)], "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    return where


def test_each_stage_does_its_work(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    state = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        state.append(docs.collect())
    clean, single, cut, mixed, packed = state

    model = toxicity.train(spark.read.parquet(f"{tables}/documents.parquet"), labels, "toxic", ~held_out("doc_id", 5, 0))
    scores = {r.id: r.score for r in toxicity.score(spark.read.parquet(f"{tables}/documents.parquet"), *model).collect()}
    left = sorted(i for i in text if scores[i] < 0.5)
    assert sorted(r.doc_id for r in clean) == left
    assert not {i for i in left if 120 <= i < 180 and i % 3 == 0}

    first = brute.near_copy_groups([text[i] for i in left])
    stay = sorted({left[j] for j in first})
    assert sorted(r.doc_id for r in single) == stay

    left_over = dict(zip(stay, brute.without_passages([text[i] for i in stay])))
    got = {r.doc_id: r.text for r in cut}
    assert set(got) == {i for i in stay if left_over[i].strip() or left_over[i] == (text[i] or "")}
    assert all((got[i] or "") == left_over[i] for i in got)
    assert sum(left_over[i] != (text[i] or "") for i in got) == 10

    sizes = defaultdict(int)
    for r in cut:
        sizes[r.source] += len(brute.words(r.text))
    took = {r.id: r.taken / r.size for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect() if r.size}
    assert Counter(r.doc_id for r in mixed) == Counter({i: int(t + 0.5) for i, t in took.items() if int(t + 0.5)})
    words = defaultdict(int)
    for r in mixed:
        words[r.source] += len(brute.words(r.text))
    for s, target in brute.targets(sizes).items():
        assert abs(words[s] - target) <= max(len(brute.words(r.text)) for r in cut)

    copies = Counter(r.doc_id for r in mixed)
    pieces = Counter()
    for r in packed:
        pieces[r.doc_id] += r.length
    for r in packed:
        assert pieces[r.doc_id] == copies[r.doc_id] * r.doc_tokens
    assert set(pieces) == set(copies)


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


@pytest.fixture(scope="module")
def hard(spark, prose, tmp_path_factory):
    """Null and repeated ids, null columns, repeated rows, and columns with names that stages use themselves."""
    where = str(tmp_path_factory.mktemp("hard"))
    texts = [prose(9000 + i, 70) for i in range(12)]
    rows = [(None if i % 3 == 0 else i // 3, t, None if i % 2 else "en", None if i % 4 == 0 else "src0", len(t)) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, texts[2], "en", "src0", len(texts[2])), (7, None, None, None, None), (None, "", "en", "src0", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    extra = ["id", "row", "_row", "fp", "sha", "spans", "size", "times", "key", "slice", "component", "score", "label", "h", "own_sha", "w", "z"]
    docs.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(extra)]).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (0, 0, 1), (1, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    return where, texts


def test_stages_lose_no_row_without_a_reason(spark, hard, tmp_path):
    where, texts = hard
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append(docs.collect())
    assert len(kept[0]) == 18  # no label tells toxic texts
    assert Counter(r.text for r in kept[1] if r.text) == Counter(texts)  # one of each group of copies
    assert sum(not r.text for r in kept[1]) == 1  # texts without words are copies of one another
    assert Counter(r.text for r in kept[2]) == Counter(r.text for r in kept[1])
    assert {r.text for r in kept[3]} == set(texts)  # only texts without words have nothing to take
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]}


def test_nothing_in_nothing_out(spark, hard, tmp_path):
    docs = spark.read.parquet(f"{hard[0]}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{hard[0]}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_differ_anywhere_are_told_apart(spark):
    """Times by a microsecond, zeros by their sign, nulls from NaN, decimals, binaries and maps: all rows survive mixing."""
    one = "CAST(0 AS LONG) AS doc_id, 'some words here' AS text, 'en' AS lang, 'src0' AS source, CAST(15 AS LONG) AS n_chars"
    columns = {
        "at": ["TIMESTAMP'2024-01-01 00:00:00.000001'", "TIMESTAMP'2024-01-01 00:00:00.000002'", "CAST(NULL AS TIMESTAMP)"],
        "plain": ["TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'", "TIMESTAMP_NTZ'2024-01-01 00:00:00.000002'", "CAST(NULL AS TIMESTAMP_NTZ)"],
        "x": ["0.0D", "-0.0D", "CAST('NaN' AS DOUBLE)", "CAST(NULL AS DOUBLE)"],
        "d": ["CAST(0.1 AS DECIMAL(38, 20))", "CAST(0.10000000000000000001 AS DECIMAL(38, 20))"],
        "b": ["X'00'", "X'0000'", "CAST(NULL AS BINARY)"],
        "a": ["ARRAY(1, NULL)", "ARRAY(NULL, 1)", "ARRAY(1)", "CAST(NULL AS ARRAY<INT>)"],
        "m": ["MAP('k', 1)", "MAP('k', CAST(NULL AS INT))", "CAST(MAP() AS MAP<STRING, INT>)"],
    }
    for name, values in columns.items():
        docs = spark.sql(" UNION ALL ".join(f"SELECT {one}, {v} AS {name}" for v in values))
        assert docs.select(row_key(docs)).distinct().count() == len(values), name
        took = mixing.mixed_documents(docs)
        assert took.count() == mixing.mix(docs).selectExpr("CAST(sum(floor(taken / size + 0.5)) AS INT)").first()[0] >= len(values), name


def test_mixing_takes_sizes_beyond_32_bits(spark, tables, monkeypatch):
    """The stage gives the same rows when its sources' sizes, as the targets see them, are 100,000 times as large."""
    docs, targets = spark.read.parquet(f"{tables}/documents.parquet"), mixing.source_targets
    want = Counter(corpus_pipeline.mix_sources(spark, docs, tables).collect())

    def enlarged(sizes):
        out = targets(sizes.withColumn("source_size", sizes.source_size * 100_000))
        return out.selectExpr("source", "source_size div 100000 AS source_size", "target / 100000 AS target")

    monkeypatch.setattr(mixing, "source_targets", enlarged)
    assert want and Counter(corpus_pipeline.mix_sources(spark, docs, tables).collect()) == want


def test_results_between_stages_are_deleted(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0
    (folder,) = tmp_path.iterdir()
    assert [p.name for p in folder.iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)]
