from __future__ import annotations

import hashlib
import random

import pytest

from duskwire.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def digests(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def check(tok, docs):
    want = sorted(((r.doc_id, *digests(tok, r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    have = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
    assert have == want


def test_all_documents(documents, library):
    check(library, documents)


def test_odd_documents(clashing, library):
    check(library, clashing)


def test_no_documents(empty):
    assert bpe.digests(empty).collect() == []


@pytest.mark.parametrize("leaf", [16, 61, 997])
def test_halves_joined_are_the_whole(library, leaf):
    rng = random.Random(leaf)
    codec = bpe.codec(bpe.default_path())
    kinds = ["a", "ab ", " \n\t ", "é漢字", "\U0001f600x", "don't we'll ", "0123456789", "hello world ", "aaaaaaab", "   x", "...!?", "́e"]
    for _ in range(60):
        text = "".join(rng.choice(kinds) * rng.randint(1, 40) for _ in range(rng.randint(1, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text, leaf).tolist() == want
        assert codec.decode(codec.encode(text, leaf)) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_text(library):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(150_000))
    assert bpe.codec(bpe.default_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_null_and_wrong_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows).orderBy("k").collect()] == ["", ""]
    with pytest.raises(Exception):  # noqa: B017
        bpe.decode(spark.createDataFrame([(1, [10**8])], "k int, ids array<int>")).collect()
