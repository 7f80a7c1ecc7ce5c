"""The pipeline's stages against what each operator says by brute force, and odd rows through all of them."""


import pytest

import corpus_pipeline
from barloom.llm.queries import vocabulary
from tests.llm.conftest import DOCUMENT, ODD_TEXTS, SF_DIR
from tests.llm.test_lines_simhash import groups, lines_by_hand
from tests.llm.test_tokens import check_pieces

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows that each stage returns, its predecessor's rows being its input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        step(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_return_documents(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
        assert df.dtypes == steps[0].dtypes


def test_language_keeps_clean_documents(steps):
    assert steps[1].count() == steps[0].count()


def test_lines_go_and_lengths_follow(steps):
    import hashlib

    before = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    want = {d: h for d, _, _, h in lines_by_hand(before)}
    after = steps[2].collect()
    assert len(after) == len(before)
    for r in after:
        assert want[r["doc_id"]] == hashlib.sha256(r["text"].encode()).hexdigest() and r["n_chars"] == len(r["text"])


def test_one_document_of_each_group(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    assert {r["doc_id"] for r in steps[3].collect()} == {c for _, _, c in groups(rows)}


def test_packed_ids_are_those_of_the_kept(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    padding, _ = check_pieces(rows, texts, tokenizers.Tokenizer.from_file(vocabulary()))
    assert padding < 1024


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(i, t, None, "s", 1, "x", 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id here", "en", None, None, None, None), rows[6], rows[6], (6, "other text of an id", "en", "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, DOCUMENT + ", language string, dedup int")
    for frame in (docs, docs.limit(0)):
        now = frame
        for i, (name, step) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{frame is docs}{i}")
            step(spark, now, SF_DIR).write.parquet(path)
            now = spark.read.parquet(path)
            if i < 4:
                assert now.columns == docs.columns
        assert (now.count() > 0) == (frame is docs)
