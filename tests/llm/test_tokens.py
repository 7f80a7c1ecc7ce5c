"""Pre-tokens, token counts and packed ids against the tokenizer's own library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm.packing import Packer, pack
from barloom.llm.queries import op3_packing, op10_token_counts, vocabulary
from barloom.llm.token_counts import count_tokens
from tests.llm.conftest import ODD_TEXTS, SF_DIR

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_frame(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD_TEXTS)] + [(2, " ", 9), (2, " ", 9), (None, "null id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)


def check_pieces(rows, texts, library, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*ids_of(library, texts[doc]), 0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += window - at
    return padding, len(by_sequence)


def test_counts_equal_library_on_odd_texts(spark, library):
    rows = count_tokens(odd_frame(spark), vocabulary()).collect()
    texts = dict(enumerate(ODD_TEXTS)) | {None: "null id"}
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        text = texts[r["id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(ids_of(library, text))), repr(text[:40])
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_counts_equal_library_on_documents(spark, library, documents):
    rows = {r["doc_id"]: r for r in op10_token_counts(spark, SF_DIR).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        assert rows[d["doc_id"]]["n_tokens"] == len(ids_of(library, d["text"]))


def test_packing_is_a_partition_of_the_ids(spark, library, documents):
    rows = op3_packing(spark, SF_DIR).collect()
    padding, _ = check_pieces(rows, {d["doc_id"]: d["text"] for d in documents}, library)
    assert padding < 1024


def test_packing_odd_texts_over_partitions(spark, library):
    texts = {i: t for i, t in enumerate(ODD_TEXTS)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = pack(docs, vocabulary()).withColumnRenamed("id", "doc_id").collect()
    padding, _ = check_pieces(rows, texts, library)
    assert padding < 1024
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_packing_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, vocabulary()).collect() == []
    assert count_tokens(docs, vocabulary()).collect() == []


def test_open_windows_are_bounded_and_best_fit():
    packer, left = Packer(0, 100, 3), []
    for i, n in enumerate([60, 70, 80, 20, 30, 40, 90, 90, 90]):
        left += packer.add(i, b"\0" * (4 * n), n)
        assert len(packer.open) <= 3
    assert [w.fill for w in left] == [100] * len(left)
    assert left[0].pieces[1][0] == 3 and left[1].pieces[1][0] == 4
