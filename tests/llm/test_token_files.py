import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterbook.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts, end=None):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = []
    for _, ids, counts in token_files.encoded(iter([batch]), PATH, end):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
    return out


MIXED = st.lists(st.sampled_from([*"aeÉéß ŉſİ1٣'.,%<|>\t\n\x85\x1c\u00a0\u0301Σσ", "'s", "'LL", "<|endoftext|>", "<|StartOfText|>", "日本"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), MIXED), max_size=6))
def test_blocks_equal_the_tokenizer_on_whole_texts(texts):
    assert encoded(texts, 2) == [[*ids_of(t), 2] for t in texts]


def test_small_cache_small_blocks_and_long_texts(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 7)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 40)
    texts = ["one two three four " * 9, None, "", "x" * 100, "five six seven, eight: nine " * 4, "one", " one\n"] * 2
    assert encoded(texts) == [ids_of(t) for t in texts]


def test_words_are_kept_once_whatever_white_space_follows():
    encoder = token_files.WordEncoder(PATH)
    texts = ["one one\n one  one", " \t", "\n One.one 7 é\r\n", "", "one \n"]
    ids, counts = encoder.block(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [ids_of(t) for t in texts]
    assert {w for w in encoder.cache.words if w} == {"one", ".", "7", "é"}


def test_ends_of_words_are_known_by_their_ids():
    encoder, words = token_files.WordEncoder(PATH), ["a", "thereupon", "</", ">", "</>", "w", "éßſ"[:2], "xqzjv", "7", "unbelievableness"]
    assert encoder.ends is not None and encoder.ends.sum() >= 256
    want = [ids_of(w) for w in words]
    for ends in (encoder.ends, None, np.zeros_like(encoder.ends), np.ones_like(encoder.ends)):  # wrong ones are noticed
        encoder.ends = ends
        flat, counts = encoder._by_model(words)
        assert [x.tolist() for x in np.split(np.concatenate(flat), np.cumsum(np.concatenate(counts)))[:-1]] == want


def test_other_tokenizers_take_whole_words(monkeypatch, tmp_path):
    from tokenizers import normalizers

    other = Tokenizer.from_file(PATH)
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "t.json"))
    encoder = token_files.WordEncoder(str(tmp_path / "t.json"))
    assert encoder.model is None and not encoder.folds
    texts = ["One one, 12 É<|endoftext|>", "", "two"]
    ids, counts = encoder.block(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def want(ids, texts, end):
    out, start = [], 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        tokens = ids_of(t) + end
        out.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()), tokens))
        start += len(tokens)
    return out


@pytest.mark.parametrize("end_id", [2, None])
def test_files_round_trip(spark, tmp_path, end_id):
    texts = [*AWKWARD, "unnumbered"]
    ids = [7 * k % 101 for k in range(len(AWKWARD))] + [None]
    folder = f"file://{tmp_path}/tokens"
    token_files.write(documents(spark, texts, ids), folder, PATH, end_id)
    rows = token_files.read(spark, folder).collect()
    assert sorted(map(tuple, rows), key=lambda r: (r[1], r[2], r[0] or 0)) == sorted(want(ids, texts, [2] if end_id else []), key=lambda r: (r[1], r[2], r[0] or 0))


def test_format_is_flat_and_memory_mapped(spark, tmp_path):
    texts = [f"document number {k} of many" for k in range(40)]
    manifest = token_files.write(documents(spark, texts), str(tmp_path / "t"), PATH, 2).orderBy("part").collect()
    base, tokens = 0, []
    for row in manifest:
        assert row.base == base
        base += row.n_ids
        flat = np.memmap(tmp_path / "t" / row.bin, "<u2", "r")
        offsets = np.memmap(tmp_path / "t" / row.idx, "<i8", "r")
        assert offsets[0] == 0 and offsets[-1] == len(flat) == row.n_ids and len(offsets) == row.n_docs + 1
        tokens += flat.tolist()
    assert tokens == [t for x in texts for t in ids_of(x) + [2]]


def test_leftover_attempts_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write(documents(spark, ["one", "two"]), folder, PATH, 2)
    one = glob.glob(f"{folder}/data/*.bin")[0]
    with open(one.replace(os.path.basename(one), "000000-lost.bin"), "wb") as f:
        f.write(b"\x01\x02")
    assert token_files.read(spark, folder).count() == 2


def test_damaged_files_are_an_error(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write(documents(spark, ["one two three"]), folder, PATH, 2)
    for name in glob.glob(f"{folder}/data/*.bin"):
        with open(name, "ab") as f:
            f.write(b"\x01\x02")
    with pytest.raises(Exception, match="don't agree"):
        token_files.read(spark, folder).collect()


def test_same_ids_and_empty_table(spark):
    docs = documents(spark, ["x y", "z", "x y", None], [5, 5, 5, 5]).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids")
    rows = token_files.digests(docs, PATH, 2).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 3, 3]
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(4)]
    assert token_files.digests(documents(spark, []), PATH, 2).count() == 0


SPECIAL = ["hello <|endoftext|> world foo<|startoftext|>bar", "<|endoftext|>", "A<|EndOfText|>B <|ENDOFTEXT|>", "Mixed CASE <|startoftext|><|endoftext|> and <|StartOfText|> Too", "<|end oftext|> <|endoftext", "e\u0301 <|endoftext|>\u0301 É", "cafe\u0301 <|EndOfText|>"]


def test_strings_of_added_tokens_equal_the_call_of_the_contract(spark):
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert want[0] == [3306, 49407, 1002, 23435, 49406, 2411]
    assert encoded(SPECIAL) == want
    rows = {r.doc_id: r for r in token_files.digests(documents(spark, SPECIAL), PATH, 2).collect()}
    assert [rows[k].n_tokens for k in range(len(SPECIAL))] == [len(x) + 1 for x in want]
    assert [rows[k].ids_crc32 for k in range(len(SPECIAL))] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want]


def test_added_tokens_with_white_space_or_capitals(tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens(["two words", "Big"])
    tokenizer.save(str(tmp_path / "t.json"))
    encoder = token_files.WordEncoder(str(tmp_path / "t.json"))
    texts = ["some two words here", "a Big one", "a big one", "two  words BIG"]
    ids, counts = encoder.block(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
