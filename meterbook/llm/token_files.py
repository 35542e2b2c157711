"""Token ids in flat binary files.

The documents are range-partitioned by doc_id; each partition writes three flat files in the
shared folder: ``.bin`` (the ids, little-endian unsigned integers of the smallest width that
holds the vocabulary, document after document), ``.idx`` (n + 1 little-endian 64-bit offsets
into it, in ids) and ``.doc`` (n little-endian 64-bit doc_ids). A manifest, written by Spark,
has one row for each partition: its files and counts. The base of a partition, the number of
ids before it in the whole corpus, is the prefix sum of those counts, so a document's
global start is base + offset without a second pass over the ids.

A file is written under a name of its own for each attempt and only the manifest row of the
attempt that succeeded is kept, so lost executors and repeated tasks leave no wrong file
behind, at most an unused one. Files go through ``pyarrow.fs``; on a local or mounted folder
they are memory-mapped when read, elsewhere read by ranges.

The strings of the tokenizer's added tokens (``<|endoftext|>``) in a text become their ids, as
in the tokenizer's own call. Null and empty texts have no ids (only the end id, if one is given). Rows with the same
doc_id stand in the order of a hash of their texts; null doc_ids come first and read back as null.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterbook.llm.common import partitions_for, scratch

#: Text bytes of one partition, hence of one file.
PART_BYTES = 24_000_000
#: Cached words of one Python worker; beyond it the half that was used last stays.
CACHE_WORDS = 600_000
#: Longer words are encoded each time they occur.
CACHE_WORD_BYTES = 64
#: Bytes of text that are split and looked up together.
BLOCK_BYTES = 4_000_000
#: Words or pieces that go through the tokenizer together.
ENCODE_WORDS = 10_000

MANIFEST = "part int, bin string, idx string, doc string, width int, n_docs long, n_ids long"

# The normalizer and the pre-tokenizer for which words of plain letters are cut here.
PLAIN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PLAIN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Small letters of Latin-1 and Latin Extended-A that no normalization changes.
_LETTERS = [c for c in map(chr, range(0xDF, 0x180)) if unicodedata.category(c) == "Ll" and c.lower() == c and unicodedata.normalize("NFC", c) == c]
_SPACES = b"\t\n\x0b\x0c\r "
# kinds of bytes: white space, small letters, digits, ASCII signs but the apostrophe, all else
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte that is a character, and of each two-byte one from C3 80 to C5 BF."""
    one, two = np.full(256, _OTHER, np.uint8), np.full((3, 64), _OTHER, np.uint8)
    one[0x21:0x7F] = _SIGN
    one[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ'")] = _OTHER
    one[0x61:0x7B], one[0x30:0x3A], one[list(_SPACES)] = _LETTER, _DIGIT, _SPACE
    for c in _LETTERS:
        lead, rest = c.encode()
        two[lead - 0xC3, rest - 0x80] = _LETTER
    return one, two


_ONE, _TWO = _kinds()
_ONE_TABLE, _FOLD_TABLE = _ONE.tobytes(), bytes(range(256)).lower()
_PLAIN = re.compile(f"[a-z{''.join(_LETTERS)}]+|[0-9]|[!-&(-/:-@[-`{{-~]+")


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(data.tobytes().translate(table)), np.uint8)


def _folded(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of Latin-1 lower-cased."""
    out = _mapped(raw, _FOLD_TABLE)
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    out[after] += 32
    return out


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + count]`` one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class WordCache:
    """Ids of the words seen last: the place of each word, in the order of places, and their ids as
    one flat array."""

    def __init__(self, kind: str):
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.clock = np.zeros(0, np.int64), 0

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word, -1 if it is not here."""
        self.clock += 1
        found = np.fromiter(map(self.words.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.used[found[found >= 0]] = self.clock
        return found

    def add(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """Keep these words, which are not here, too, after making room for them."""
        if len(self.words) + len(words) > CACHE_WORDS and len(self.words):
            keep = np.sort(np.argsort(-self.used, kind="stable")[: max(0, min(CACHE_WORDS // 2, CACHE_WORDS - len(words)))])
            old = list(self.words)
            self.words = {old[k]: place for place, k in enumerate(keep.tolist())}
            self.flat, self.counts, self.used = _gather(self.flat, self.starts[keep], self.counts[keep]), self.counts[keep], self.used[keep]
        self.words.update(zip(words, itertools.count(len(self.words)), strict=False))
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.full(len(words), self.clock)])
        self.starts = _starts(self.counts)[:-1]


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokens never cross white space: a block's bytes are
    cut into words without the white space between them and made distinct as arrays, and only what
    the bounded cache does not hold is encoded, by the tokenizer itself.

    For a tokenizer with the normalizer and the pre-tokenizer named above, words of plain letters,
    digits and ASCII signs without an apostrophe are cut into its pre-tokens, and its model alone
    encodes those."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [c.lower() for c in contents if c]
        self.spaced = any(c.split() != [c] for c in contents if c)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.cache = WordCache(self.kind)
        self.folds = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        form = json.loads(self.tokenizer.to_str())
        self.model = None
        if form["normalizer"] == PLAIN_NORMALIZER and form["pre_tokenizer"] == PLAIN_SPLIT:
            self.model = Tokenizer.from_str(self.tokenizer.to_str())
            self.model.normalizer = None
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = self._ends(form["model"])

    def _ends(self, model: dict) -> np.ndarray | None:
        """For a model that marks the ends of pre-tokens: whether each id is at the end of one."""
        from tokenizers import pre_tokenizers

        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
        if self.model is None or not suffix or not all(c + suffix in vocab for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        ends = np.zeros(1 + max(vocab.values()), bool)
        ends[[k for t, k in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _by_model(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of pre-tokens by the tokenizer's model, and how many each has."""
        flat, counts = [], []
        for at in range(0, len(pieces), 1000):
            mine = pieces[at : at + 1000]
            joined = " ".join(mine)
            if self.ends is not None:
                ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
                n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if self.ends is None or len(n) != len(mine) or n.sum() != len(ids):
                found = self.model.encode(joined, add_special_tokens=False)
                ids, n = np.array(found.ids, self.kind), np.bincount(found.word_ids, minlength=len(mine))
            flat.append(ids)
            counts.append(n)
        return flat, counts

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, flat, and how many each has."""
        plain = np.fromiter((_PLAIN.fullmatch(t) is not None for t in pieces), bool, len(pieces)) if self.model is not None else np.zeros(len(pieces), bool)
        flat, counts = self._by_model(list(itertools.compress(pieces, plain)))
        others = [k for k in np.flatnonzero(~plain).tolist() if pieces[k]]
        for at in range(0, len(others), ENCODE_WORDS):
            found = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[k] for k in others[at : at + ENCODE_WORDS]], add_special_tokens=False)]
            flat.append(np.fromiter(itertools.chain.from_iterable(found), self.kind))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        flat, counts = np.concatenate([np.zeros(0, self.kind), *flat]), np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
        place = np.concatenate([np.flatnonzero(plain), np.array(others, np.int64)])
        starts, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[place], n[place] = _starts(counts)[:-1], counts
        return (_gather(flat, starts, n) if others else flat), n

    def _cuts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (folded) bytes of texts without white space, where each piece starts, and how many
        pieces stand before each text and in all.

        A piece is a word or a pre-token of a plain one, an empty one the white space that a text
        begins with. The strings of added tokens have ids of their own: words of a text with one, in
        any case, are neither folded nor cut, and no text is split if white space belongs to some."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        first = np.unique(offsets[:-1][np.diff(offsets) > 0])
        if self.spaced or not len(raw):
            return raw, first, np.searchsorted(first, offsets)
        own = pa.array(np.zeros(len(texts), bool))
        for c in self.added:
            own = pc.or_(own, pc.match_substring(texts, c, ignore_case=True))
        own = own.to_numpy(zero_copy_only=False)
        data = raw
        if self.folds:
            data = _folded(raw)
            # combining marks may compose with a small letter and not with the capital one
            marked = own
            if (raw == 0xCC).any() or (raw == 0xCD).any():
                marked = own | pc.match_substring_regex(texts, "[\u0300-\u036f]").to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(marked):
                data[offsets[k] : offsets[k + 1]] = raw[offsets[k] : offsets[k + 1]]
        kind = _mapped(data, _ONE_TABLE)
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
        kind[lead] = kind[lead + 1] = _TWO[data[lead] - 0xC3, data[lead + 1] & 0x3F]
        for k in np.flatnonzero(own):
            mine = kind[offsets[k] : offsets[k + 1]]
            mine[mine != _SPACE] = _OTHER
        # runs of one kind, digits apart, that no text's start lies within
        begins = kind == _DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[first] = True
        runs = np.flatnonzero(begins)
        of = kind[runs]
        opens = np.zeros(len(runs), bool)
        opens[np.searchsorted(runs, first)] = True
        solid = of != _SPACE
        word = opens.copy()
        word[1:] |= solid[1:] & ~solid[:-1]
        number = np.cumsum(word)
        whole = np.zeros(number[-1] + 1, bool)
        whole[number[of == _OTHER] if self.model is not None else number] = True
        cut = np.flatnonzero(word | (solid & ~whole[number]))
        starts, last = runs[cut], cut - 1
        # the white space before a piece is one run; the first piece, whose last is no run, has none
        gaps = (starts - runs[last]) * ~solid[last]
        gaps[0] = 0
        left = np.frombuffer(data.tobytes().translate(None, _SPACES), np.uint8)
        return left, starts - np.cumsum(gaps), np.searchsorted(starts, offsets)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts (large strings without nulls), flat, and how many each has."""
        data, at, before = self._cuts(texts)
        offsets = np.append(at, len(data))
        places = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        size, pieces = pc.binary_length(places.dictionary).to_numpy(), places.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.cache.find(pieces)
        starts, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        known = found >= 0
        starts[known], counts[known] = self.cache.starts[found[known]], self.cache.counts[found[known]]
        missing = np.flatnonzero(~known)
        new = list(itertools.compress(pieces, ~known))
        flat, n = self._ids(new)
        starts[missing], counts[missing] = len(self.cache.flat) + _starts(n)[:-1], n
        place = places.indices.to_numpy()
        size_of = counts[place]
        out = _gather(np.concatenate([self.cache.flat, flat]), starts[place], size_of)
        short = np.flatnonzero(size[missing] <= CACHE_WORD_BYTES)[:CACHE_WORDS]
        self.cache.add([new[k] for k in short.tolist()], _gather(flat, _starts(n)[short], n[short]), n[short])
        return out, np.diff(_starts(size_of)[before])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(text: str) -> list[str]:
    """A very long text in runs of whole words."""
    out, at = [], 0
    while len(text) - at > BLOCK_BYTES:
        space = _BREAK.search(text, at + BLOCK_BYTES)
        end = space.start() if space else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


_BREAK = re.compile("[\t-\r ]")


def encoded(it: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in blocks of about ``BLOCK_BYTES`` of text (column 1, null: empty), each with
    the ids of its rows, flat, and how many each row has; ``end_id`` is appended to every row."""
    encoder = word_encoder(tokenizer)

    def block(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        if batch.num_rows == 1 and texts.nbytes > BLOCK_BYTES and not encoder.spaced:
            runs = [encoder.block(pa.array([x], pa.large_string()))[0] for x in _cut(texts[0].as_py())]
            flat, counts = np.concatenate(runs), np.array([sum(map(len, runs))])
        else:
            flat, counts = encoder.block(texts)
        if end_id is not None:
            ends, own = _starts(counts + 1)[1:] - 1, np.zeros(len(flat) + len(counts), encoder.kind)
            inner = np.ones(len(own), bool)
            inner[ends] = False
            own[inner], own[ends] = flat, end_id
            flat, counts = own, counts + 1
        return batch, flat, counts

    for batch in it:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + BLOCK_BYTES, "right")))
            yield block(batch.slice(at, to - at))
            at = to
        pa.default_memory_pool().release_unused()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write the files under ``folder``; returns the manifest, which
    stands as Parquet in ``folder``/manifest. One shuffle, by range of doc_id."""
    spark = docs.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        fs, root = _store(folder)
        fs.create_dir(f"{root}/data", recursive=True)
        names = [f"data/{part:06d}-{uuid.uuid4().hex}.{kind}" for kind in ("bin", "idx", "doc")]
        total = n_docs = 0
        streams = [fs.open_output_stream(f"{root}/{name}") for name in names]
        streams[1].write(np.zeros(1, "<i8").tobytes())

        for batch, ids, lengths in encoded(it, tokenizer, end_id):
            streams[0].write(ids.tobytes())
            streams[1].write((total + np.cumsum(lengths)).astype("<i8").tobytes())
            streams[2].write(pc.fill_null(batch.column(0), NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            total += int(lengths.sum())
            n_docs += batch.num_rows
        for stream in streams:
            stream.close()
        if n_docs:
            row = [part, *names, encoder.width, n_docs, total]
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_ARROW.names, row, strict=True))], schema=_MANIFEST_ARROW)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = partitions_for(rows, "text", PART_BYTES)
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


#: Stands for a null doc_id in a ``.doc`` file.
NULL_ID = -(1 << 63)

_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("bin", pa.string()), ("idx", pa.string()), ("doc", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per partition with ``base``, the exclusive prefix sum of its ids. The manifest
    has as many rows as there are files, so one window over it is small."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _array(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array, memory-mapped where the store is a mounted folder."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, on request, the
    ids themselves."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in it:
            for row in batch.to_pylist():
                tokens = _array(fs, f"{root}/{row['bin']}", f"<u{row['width']}")
                offsets = _array(fs, f"{root}/{row['idx']}", "<i8")
                doc_ids = _array(fs, f"{root}/{row['doc']}", "<i8")
                if len(offsets) != row["n_docs"] + 1 or len(tokens) != row["n_ids"] or offsets[-1] != len(tokens):
                    raise ValueError(f"{row['bin']}: the files don't agree with the manifest")
                for at in range(0, len(doc_ids), 2000):
                    mine, cuts = doc_ids[at : at + 2000], offsets[at : at + 2001].tolist()
                    lists = [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = [
                        pa.array(mine, mask=mine == NULL_ID),
                        pa.array(np.array(cuts[:-1]) + row["base"], pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.array(cuts) - cuts[0], pa.int32()), pa.array(tokens[cuts[0] : cuts[-1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    # one file a task: the manifest is small, its files are not
    rows = manifest(spark, folder)
    spread = rows.repartitionByRange(max(1, rows.count()), "part")
    return spread.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a fresh folder and read the files back."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    write(docs, folder, tokenizer, end_id)
    return read(spark, folder, ids=False)
