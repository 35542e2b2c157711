"""Quality rules: statistics of each document and a learned decision list over them.

The statistics are counted over whole texts. The decision list is learned by sequential
covering from labelled statistics: a rule is grown on two thirds of the sample by adding the
threshold condition with the best gain until it covers no good document there, pruned on the
other third from its end, kept if it is precise enough on that third, and its documents are
taken out before the next rule. The rules become one ordered Spark conditional expression.

Learning sees at most ``SAMPLE_ROWS`` labelled documents (a share
of them by a hash of doc_id); everything else covers all rows. A document that fails the fixed base rules is
dropped whatever the list says and takes no part in learning.

Null, empty and blank texts have no words and fail the base rules. Labels without a quality
or without a document are ignored; of several labels of a document the lowest counts.
Repeated documents are judged alike. Without both kinds of labels the list is empty and only
the base rules drop documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import slices, utf8, without, written

#: Labelled documents that learning looks at, at most.
SAMPLE_ROWS = 20_000
#: Thresholds tried for a statistic: quantiles of the documents that a rule still covers.
THRESHOLDS = 64
#: Conditions of a rule and rules of a list, at most.
MAX_CONDITIONS, MAX_RULES = 4, 16
#: Bad documents among those a rule drops, on the rows it was not grown on.
MIN_PRECISION = 0.97
#: Bad documents that a rule covers there at least.
MIN_COVERED = 4
#: The fixed base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct_words")
#: What conditions are about: ratios of the counts.
FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "distinct_ratio", "words_per_line")

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_PUNCT = b"!\"'(),-./:;=?@[\\]^_`{}~+"


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.split()
    n = len(words)
    letters = text.decode("utf-8", "replace")
    word_chars = len(letters) - sum(letters.count(c) for c in " \t\n\r\x0b\x0c")
    size = len(text)
    n_symbols, n_upper, n_digits, n_punct = (size - len(text.translate(None, some)) for some in (SYMBOLS, _UPPER, _DIGITS, _PUNCT))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > REPEAT_WINDOW:
        joined = b" ".join(words)
        starts = (np.cumsum([0, *map(len, words)])[:-1] + np.arange(n)).tolist()
        ends = [*(s - 1 for s in starts[REPEAT_WINDOW:]), len(joined)]
        windows = [joined[a:b] for a, b in zip(starts, ends, strict=False)]
        if len(set(windows)) < len(windows):
            first: dict[bytes, int] = {}
            cover = np.zeros(n + 1, np.int64)
            for k, window in enumerate(windows):
                other = first.setdefault(window, k)
                if other != k:
                    cover[[other, k]] += 1
                    cover[[other + REPEAT_WINDOW, k + REPEAT_WINDOW]] -= 1
            repeated = int((np.cumsum(cover) > 0).sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), n_upper, n_digits, n_punct, len(set(words))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with the ``COUNTS``; columns of these names, in whatever
    case, are replaced. No shuffle."""
    kept = without(docs, [text, *COUNTS])
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType(), False) for c in COUNTS])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            found = np.array([counts(x) for x in utf8(batch.column(text))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*kept, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """Each feature as a ratio of counts, 0 where its base is 0."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    pairs = [("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_punct", "word_chars"), ("n_distinct_words", "n_words"), ("n_words", "n_lines")]
    return {name: ratio(*pair) for name, pair in zip(FEATURES, pairs, strict=True)}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        value = rows[:, FEATURES.index(self.feature)]
        return value >= self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: np.ndarray) -> np.ndarray:
    return reduce(lambda a, b: a & b, [c.holds(rows) for c in rule], np.ones(len(rows), bool))


def _grown(rows: np.ndarray, bad: np.ndarray) -> Rule:
    """Add conditions of the best gain (bits saved on bad documents) while good ones are covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        covered = _covered(rule, rows)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p or not n:
            break
        before, best, gain = np.log2(p / (p + n)), None, 0.0
        for k, feature in enumerate(FEATURES):
            for threshold in np.unique(np.quantile(rows[covered & bad, k], np.linspace(0, 1, THRESHOLDS), method="nearest")).tolist():
                for above in (True, False):
                    condition = Condition(feature, above, threshold)
                    holds = covered & condition.holds(rows)
                    p1, n1 = int((holds & bad).sum()), int((holds & ~bad).sum())
                    new = p1 * (np.log2(p1 / (p1 + n1)) - before) if p1 else 0.0
                    if new > gain:
                        best, gain = condition, new
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _pruned(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best balance on the pruning rows."""

    def worth(some: Rule) -> float:
        covered = _covered(some, rows)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def decision_list(rows: np.ndarray, bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Rules that drop documents, in order. ``rows`` holds ``FEATURES``; ``prune`` marks the
    rows that rules are pruned and judged on, the others grow them."""
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune, left & prune
        rule = _pruned(_grown(rows[grow], bad[grow]), rows[check], bad[check])
        covered = _covered(rule, rows)
        p, n = int((covered & check & bad).sum()), int((covered & check & ~bad).sum())
        if not rule or p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def learn(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """The decision list for ``stats`` by the labels 0 (bad) and 1 (good) of ``labels``."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("quality")).filter("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.filter(~base_failed()).select(F.col(doc_id).alias("doc_id"), *[c.alias(name) for name, c in features().items()]).join(marks, "doc_id")
    # a share of the rows by hash first, so that what all tasks send together is bounded too
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, known.count()))
    drawn = known.select("*", F.xxhash64("doc_id").alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.orderBy("h", "doc_id").limit(SAMPLE_ROWS).collect()
    rows = np.array([[r[name] for name in FEATURES] for r in sample], np.float64).reshape(-1, len(FEATURES))
    bad = np.array([r.quality == 0 for r in sample], bool)
    prune = np.array([r.h % 3 == 0 for r in sample], bool)
    return decision_list(rows, bad, prune)


def verdict(rules: list[Rule]) -> Column:
    """Whether the decision list keeps a document: the first rule that fits drops it."""
    chain = None
    for rule in rules:
        fits = reduce(lambda a, b: a & b, [c.column() for c in rule])
        chain = (F if chain is None else chain).when(fits, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without text, with ``COUNTS``, ``base_failed`` and ``kept``. The statistics are
    counted once and written to the shared folder for learning and judging."""
    stats = written(statistics(docs, text), "quality")
    rules = learn(stats, labels, doc_id)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = judge(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept")
