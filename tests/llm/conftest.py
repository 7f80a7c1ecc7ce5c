"""One session and small frames for the text operators."""

import pytest

from barloom.session import build_session

SF_DIR = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "llm-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "A\tb\x0bC\x0c d\r\n", "it's we're I'll 's 'll x'd '' !'s 'sxyz é'st don't.'s",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "你好 世界。 12½ Ⅷ กิ", "tab\x1cx\x1f y z w ×÷",
    "a" * 5000, "  lead  and   trail  \n \n x ", "é \U0001f600 mixed CafÉ ßƀȿɀ", "7 77 777abc _under_ score\n\n\n  z",
    "word " * 3000, "\r\n\r\n  \t x", "x\x00y \x7f z", "Â Ã\u0097 Año 1º",
]
