"""The pipeline's stages, each against a brute-force version on its own input."""

import brute
import pytest
from test_llm_operators import ROWS, frame, words

import corpus_pipeline
from strata.llm import quality


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = ROWS + [(600 + i, " ".join(["ab"] * 30)) for i in range(40)] + [(700 + i, words(50)) for i in range(40)]
    frame(spark, rows).withColumnRenamed("size", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(600 + i, 0, 0) for i in range(40)] + [(700 + i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(dict(ROWS)[405].split()[5:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, made, tmp_path):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, made)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, docs)
        assert name == "source_mixing" or docs.columns == columns
    pairs = lambda df: {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}

    before, after = steps["quality_classifier"]
    scores = quality.quality_scores(before, spark.read.parquet(f"{made}/labels.parquet")).collect()
    assert pairs(after) == {(r.doc_id, r.text) for r in scores if r.predicted == 1}
    before, after = steps["ngram_jaccard_join"]
    groups = brute.jaccard(sorted(pairs(before), key=str))
    assert {i for i, _ in pairs(after)} == {g for _, _, g in groups}
    before, after = steps["suffix_array_dedup"]
    cut = brute.suffix(sorted(pairs(before), key=str))
    texts = dict(pairs(before))
    for i, t in pairs(after):
        n, removed, _, sha = cut[i, texts[i]]
        assert (t is None) == (texts[i] is None)
        assert removed <= n and (removed > 0 or t == texts[i])
        assert t is None or abs(len(t.encode()) - (n - removed)) <= 3 * 10
    before, after = steps["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{made}/benchmark.parquet").collect()]
    hit = brute.contamination(sorted(pairs(before), key=str), items)
    assert pairs(after) == {k for k, v in hit.items() if not v[4]}
    before, after = steps["source_mixing"]
    assert pairs(after) == pairs(before)
    assert corpus_pipeline.run(spark, made).count() == after.count()


def test_near_duplicates_leave_one_row_of_each_group(spark, tmp_path):
    a, b, c, d, e, f, g = (words(40) for _ in range(7))
    alone = [(None, a), (None, b), (None, None), (8, None)]  # rows that link with nothing
    copies = [(None, c), (1, c), (None, d), (None, d), (2, e), (2, e), (2, e)]  # of documents with and without id, and repeated rows
    twice = [(3, f), (3, g), (4, f), (4, g)]  # two texts of one id, each copied by another
    frame(spark, alone + copies + twice).write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    after = corpus_pipeline.near_duplicates(spark, docs, "")
    assert after.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in after.collect()), key=str)
    assert got == sorted([*alone, (1, c), (None, d), (2, e), (3, f), (3, g)], key=str)
