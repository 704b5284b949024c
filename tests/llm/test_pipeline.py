"""The pipeline's stages against brute force on a small table."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeghi") for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        y = int(i % 8 == 0)
        if y:
            for j in range(6):
                w[5 + 4 * j] = rng.choice(["vilestuff", "rotten"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, y))
    item = " ".join(word() for _ in range(30))
    rows.append((500, rows[1][1].replace(" ", "\n"), "en", "s", 1))
    rows.append((501, rows[1][1], "en", "s", 1))
    rows.append((502, "some words before " + item + " and some behind", "en", "s", 1))
    rows.append((503, None, None, None, None))
    for i, share in enumerate((0.02, 0.02, 0.3)):  # a long text, two copies with few changed words and one with many
        w = [f"z{j}q" for j in range(300)]
        for j in rng.sample(range(300), int(300 * share) * (i > 0)):
            w[j] = word()
        rows.append((510 + i, " ".join(w), "en", "s", 1))
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] - kept[1] == set(range(0, 400, 8))
    assert kept[1] - kept[2] == {500, 501}
    assert kept[2] - kept[3] == {511}
    assert kept[3] - kept[4] == {502}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept[4]
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_null_and_repeated_ids(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one text", None, None, 1), (None, "one  text", None, None, 1), (None, "another text", None, None, 1), (2, "one text", None, None, 1), (2, "a third", None, None, 1)]
    kept = corpus_pipeline.drop_exact_copies(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "one  text"), (None, "another text"), (2, "a third")}
    rows = [(None, f"begin {item} end", None, None, 1), (None, "clean", None, None, 1), (3, item, None, None, 1), (3, "clean too", None, None, 1)]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "clean"), (3, "clean too")}


def test_stages_on_odd_tables(spark, folder):
    """Empty tables, repeated rows, empty and long texts, and columns whose names the operators use themselves."""
    names = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, node long, digest string, row int, _row int, score string, key int, n int"
    names = names.replace("_row int, ", "")
    extra = (None, "fp", 3, "d", 1, "s", 2, 3)
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(20_000))
    rows = [(1, "", None, None, 0, *extra), (1, "", None, None, 0, *extra), (2, None, None, None, 0, *extra), (3, long, None, None, 0, *extra), (3, long, None, None, 0, *extra), (4, long + " tail", None, None, 0, *extra), (5, "calm", None, None, 0, *extra)]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = sorted({r.doc_id for r in out.collect()})
        assert kept == {"exact_dedup": [1, 3, 4, 5], "near_dedup": [1, 3, 5]}.get(name, [1, 2, 3, 4, 5]), name
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, folder).collect()} == {1, 2, 3, 4, 5}
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).collect() == []


def test_toxicity_by_row(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bad = "some vilestuff and rotten vilestuff or rotten vilestuff then rotten end"
    known = [(r.doc_id, r.text, None, None, 1) for r in spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 400").collect()]
    docs = spark.createDataFrame([*known, (None, bad, None, None, 1), (None, "calm", None, None, 1), (600, bad, None, None, 1), (600, "calm too", None, None, 1)], schema)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).filter("doc_id is null or doc_id = 600").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "calm"), (600, "calm too")}
