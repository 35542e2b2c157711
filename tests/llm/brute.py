"""Plain versions of the operators, and small tables with awkward rows."""

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None, langs=None):
    """A documents table of these texts."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, "src0", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs, strict=True)], DOCUMENTS)


PASSAGE = "Every good boy deserves fruit and a long sentence that repeats itself in many other documents of this small corpus."
AWKWARD = [
    None,
    "",
    " \t\n",
    "a",
    "A b",
    "A b c",
    PASSAGE,
    PASSAGE,
    "Before it. " + PASSAGE + " And after.",
    "é" * 40 + PASSAGE + "ü" * 40,
    "x" * 300,
    "ab " * 400,
    "Ünïcödé words 中文 字 🙂 and 'tis we'll 12345 ³½",
    " ".join(f"word{k % 97}" for k in range(9000)),
    "line one\nline one\n\nline two\r\nline one",
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    shingles = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=3):
    """The smallest index reachable from each by steps of at most ``bits`` bits."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def repeats(docs, depth=50):
    """{doc_id: (removed spans, kept bytes)} of (doc_id, bytes)."""
    first = {}
    for i, data in docs:
        for k in range(len(data) - depth + 1):
            window = data[k : k + depth]
            first[window] = min(first.get(window, i), i)
    out = {}
    for i, data in docs:
        hit = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - depth + 1):
            if first[data[k : k + depth]] < i:
                hit[k : k + depth] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])))
        out[i] = (list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(b for b, h in zip(data, hit, strict=False) if not h))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def contamination(text, items, window=13):
    """(number of words, hit words, items found)."""
    words = bench_words(text)
    hit, found = set(), set()
    for item, other in items:
        theirs = bench_words(other)
        for k in range(max(1, len(theirs) - window + 1) if theirs else 0):
            part = theirs[k : k + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
