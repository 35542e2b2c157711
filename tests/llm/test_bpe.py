import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import AWKWARD, documents, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from meterbook.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encode_equals_the_library_and_decodes(text):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    codec = bpe.codec(PATH, PATTERN)
    ids = ids_of(codec.encode([text])[0])
    assert ids == encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_many_at_once_equals_one_by_one():
    rng = random.Random(1)
    codec = bpe.codec(PATH, PATTERN)
    pieces = [b"a" * k for k in range(1, 50)] + [bytes(rng.choice(b"ab e") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert codec.merge_many(pieces) == [codec.merge_one(p) for p in pieces]
    assert codec.merge_many([bytes([b]) for b in range(256)]) == [codec.merge_one(bytes([b])) for b in range(256)]


def test_long_pretokens(library):
    rng = random.Random(2)
    codec = bpe.codec(PATH, PATTERN)
    for text in ("a" * 30_000, "ab" * 10_000, "".join(rng.choice("abc") for _ in range(20_000)), " " * 3000 + "x", "=" * 5000):
        assert ids_of(codec.encode([text])[0]) == library.encode_ordinary(text)


def test_queue_takes_the_lowest_rank_first():
    queue = bpe.RankQueue()
    for rank, at in ((70, 1), (3, 9), (3, 2), (64, 5)):
        queue.push(rank, at)
    taken = []
    while queue.root:
        rank = queue.lowest()
        taken.append((rank, sorted(queue.take(rank))))
    assert taken == [(3, [2, 9]), (64, [5]), (70, [1])]


def test_small_cache_changes_nothing(monkeypatch, library):
    codec = bpe.Codec(bpe.load_ranks(PATH), PATTERN)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    texts = [f"some words number {k} and more of them" for k in range(50)]
    for _ in range(2):
        assert [ids_of(x) for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_awkward_documents(spark, library):
    texts = AWKWARD + AWKWARD[-3:]
    ids = [*range(len(AWKWARD)), 3, 3, None]
    got = bpe.digests(documents(spark, texts, ids), PATH, PATTERN).collect()
    want = [(i, len(e := library.encode_ordinary(t or "")), sha(" ".join(map(str, e))), sha(t or "")) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_clashing_columns_and_empty_table(spark):
    docs = documents(spark, ["hello world", None]).withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded")
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in rows] == [b"hello world", b""]
    assert rows[1].ids == []
    assert bpe.digests(documents(spark, []), PATH, PATTERN).count() == 0
