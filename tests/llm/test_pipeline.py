"""The whole pipeline against brute force, and each stage's columns."""

import re

import pytest
from test_llm import jaccard_roots, measured, sentencepiece_ids, thinned, words

import corpus_pipeline
from kinspark.llm import sentencepiece_lattice


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    item = words(30, 77)
    line = " ".join(words(60, 78))
    rows = [(i, "\n".join(" ".join(words(20, 100 * i + k)) for k in range(6))) for i in range(14)]
    rows += [(20, rows[3][1]), (21, rows[4][1].replace("w", "W", 1)), (22, "too short"), (23, None)]
    rows += [(24, rows[5][1] + "\n" + line), (25, rows[6][1][:-4] + "\nown tail here\n" + line), (26, " ".join(words(70, 55) + item[4:17]))]
    near = rows[7][1].split(" ")
    near[3] = "other"
    rows += [(27, " ".join(near[:60]) + " " + " ".join(near[60:]).replace("\n", " "))]
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def test_brute_force(spark, folder):
    at, rows, item = folder
    m = {i: measured(t) for i, t in rows}
    left = [(i, t) for i, t in rows if m[i][0] >= 50 and 100 * m[i][4] <= 50 * m[i][0]]
    cut = thinned(left, 50)
    left = [(i, t) for i, t in cut.items() if re.search(r"[^\x20\x09-\x0D]", t)]
    left = [(i, t) for i, t in left if jaccard_roots(left, 5)[i][1] == i]
    wins = {tuple(item[k : k + 10]) for k in range(21)}
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    left = [(i, t) for i, t in left if not wins & set(zip(*[plain(t)[k:] for k in range(10)]))]
    v = sentencepiece_lattice.load()
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, at).collect()}
    assert got == {i: sentencepiece_ids(t, v) for i, t in left}
    assert {20, 22, 23, 26} & set(got) == set() and 24 in got


def test_stages_keep_columns(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dup", "decontaminate", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
