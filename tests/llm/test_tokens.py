"""Token ids against the tokenizer itself, and packing queries against plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirework.llm import packing_gga, token_rollup
from quirework.llm.tokens import encoder, plain_letters, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_every_code_point_alone_and_between_letters(tokenizer):
    encode = encoder()
    signs = [chr(i) for i in range(0x21, 0x250)]
    texts = [t for c in signs for t in (c, f"a{c}b", f"1{c}2", f"A{c}{c} {c}Z", f".{c}'s")]
    got = encode(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encode(["".join(plain_letters())])[0] == np.array(tokenizer.encode(plain_letters(), add_special_tokens=False).ids, "<u4").tobytes()


def test_capitals_whose_lower_case_is_elsewhere(spark, tokenizer):
    text = "BAKI, AZƏRBAYCAN"
    df = spark.createDataFrame([(1, text, "az", "s")], "doc_id long, text string, lang string, source string")
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    got = packing_gga.sequences(df, with_ids=True).first()
    assert got["ids"] == ids and got["length"] == len(ids)
    assert token_rollup.token_counts(df, ["doc_id"]).first()["n_tokens"] == len(ids) - 1


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_op8_against_plain_python(spark, tokenizer):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(plain_ids(tokenizer, r["text"]), "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    got = packing_gga.op8_packing_gga(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= 1 + -(-sum(n for _, n, _ in want.values()) // 4096)
