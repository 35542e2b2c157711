"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three characters, within words
padded by blanks), most frequent first, ties by code point. A language's profile comes from
all its training texts, a document's from its whole text; the document gets the language
with the least out-of-place distance: the sum, over the document's n-grams, of how far the
rank differs, or the greatest possible difference where the language's profile lacks the
n-gram. Ties go to the language that sorts first.

Learning counts n-grams in each task and adds the counts up by (language, n-gram). The
profiles, at most ``PROFILE`` rows a language, are a written table; they reach the driver and
the tasks in blocks of ``LANGUAGES`` languages. Of any number of blocks the nearest language
wins: each block is a pass of its own over the rows, written before the next one.

Columns of the table whose names differ from the new ones in case only count as the same name
in :func:`predict` (replaced) and are kept by :func:`identified`. Null texts and texts without letters are ``und`` with score 0, as is everything when no
training row has a language. Repeated rows count and are judged each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterbook.llm.common import free_name, slices, written

#: N-grams of a profile.
PROFILE = 300
#: Characters counted at once.
PIECE = 1 << 18
#: Different n-grams, summed over languages, that a task counts before it passes them on.
HELD = 1 << 21
#: Languages whose profiles are broadcast at once.
LANGUAGES = 2000
UNKNOWN = "und"
_BLANK = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _characters(text: str) -> np.ndarray:
    """Lower-case letters with one blank before, after and between words."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[code]
    kept = letter | np.append(True, letter[:-1])  # the first blank of a stretch
    return np.where(letter, code, _BLANK)[kept]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of counts by n-gram."""
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([n for _, n in parts]).astype(np.float64)).astype(np.int64)


def _counts(characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending n-grams (21 bits a character) and how often each occurs."""
    parts = []
    for at in range(0, max(1, len(characters)), PIECE):
        x = characters[at : at + PIECE + 2]
        own = min(PIECE, len(x))
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        codes = np.concatenate([x[:own][x[:own] != _BLANK], two[:own], three[:own][x[1:-1][:own] != _BLANK]])
        codes.sort()
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        parts.append((codes[first], np.diff(np.append(first, len(codes)))))
    return _added(parts)


def _top(grams: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:profile]]


def learned(docs: DataFrame, profile: int = PROFILE, text: str = "text", lang: str = "lang") -> DataFrame:
    """The profile of each language of ``docs``: lang, place (from 1) and gram, as a written table."""

    def emit(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for language, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(it):
            texts: dict[str, list[np.ndarray]] = {}
            size = 0

            def flush() -> None:
                for language, some in texts.items():
                    new = _counts(np.concatenate(some))
                    held[language] = _added([held[language], new]) if language in held else new
                texts.clear()

            for language, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(language, []).append(_characters(x.as_py()))
                size += len(texts[language][-1])
                if size > PIECE:
                    flush()
                    size = 0
            flush()
            if sum(len(grams) for grams, _ in held.values()) > HELD:
                yield from emit(held)
                held.clear()
        yield from emit(held)

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the blanks alone between letterless texts are no n-grams of a language
    lettered = counted.filter(F.col("gram") != (_BLANK << 21 | _BLANK))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = lettered.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= profile)
    return written(top.select("lang", "place", "gram"), "langid-profiles")


def learn(docs: DataFrame, profile: int = PROFILE, text: str = "text", lang: str = "lang") -> Iterator[tuple[str, list[int]]]:
    """The profile of each language of ``docs``, in order of language; ``LANGUAGES`` are read at once."""
    top = learned(docs, profile, text, lang)
    names = top.filter("place = 1").select("lang")
    more = names
    while block := [r.lang for r in more.orderBy("lang").limit(LANGUAGES).collect()]:
        found: dict[str, list[int]] = {name: [] for name in block}
        for row in top.filter(F.col("lang").between(block[0], block[-1])).orderBy("lang", "place").collect():  # a block of profiles
            found[row.lang].append(row.gram)
        yield from found.items()
        more = names.filter(F.col("lang") > block[-1])


class Profiles:
    """Ranks of all profiles' n-grams, for distances to every language at once."""

    def __init__(self, profiles: list[tuple[str, list[int]]], profile: int):
        self.languages = [language for language, _ in profiles]
        self.profile = profile
        self.grams = np.unique(np.array([g for _, grams in profiles for g in grams], np.int64))
        self.ranks = np.full((len(profiles), len(self.grams)), -1, np.int64)
        for k, (_, grams) in enumerate(profiles):
            self.ranks[k, np.searchsorted(self.grams, np.array(grams, np.int64))] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        characters = _characters(text) if text else np.zeros(0, np.int64)
        if not self.languages or not (characters != _BLANK).any():
            return UNKNOWN, 0.0
        top = _top(*_counts(characters), self.profile)
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == top, self.ranks[:, at], -1)
        away = np.where(ranks < 0, self.profile, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.profile * len(top))



def predict(docs: DataFrame, profiles: Iterable[tuple[str, list[int]]], profile: int = PROFILE, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and the score in columns of these ``names`` (columns so named,
    in whatever case, are replaced). ``profiles`` come in order of language. No shuffle."""
    language, score = names
    kept = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    profiles = iter(profiles)
    block = list(islice(profiles, LANGUAGES))
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias(language), F.lit(0.0).alias(score))
    while True:
        out = out.mapInArrow(_nearer(docs, block, profile, text, kept, names), schema)
        if not (block := list(islice(profiles, LANGUAGES))):
            return out
        out = written(out, "langid-block")


def _nearer(docs: DataFrame, block: list[tuple[str, list[int]]], profile: int, text: str, kept: list[str], names: tuple[str, str]):
    """Replaces the language of a row found so far where one of ``block`` is nearer."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # LANGUAGES profiles at most

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(shared.value, profile)
        for batch in slices(it):
            found = []
            before = zip(batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist(), strict=True)
            for x, (language, score) in zip(batch.column(text), before, strict=True):
                new, near = model.predict(x.as_py())
                found.append((new, near) if language == UNKNOWN or near > score else (language, score))
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *names])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row takes no part in learning: a fifth of the doc_ids by their checksum (a
    null doc_id does take part)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digests(docs: DataFrame) -> DataFrame:
    profiles = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language."""
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    marked = predict(docs, learn(docs.filter(~held_out())), names=names)
    return marked.filter(F.col(names[0]) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
