"""How filters interact: what each removes at each step of each order.

Every filter has a relation of its own, the ids of the rows that fail it, written once in the
shared folder. A prefix of an order is a set of filters already applied, so its survivors are
the rows left by an anti-join with each failing relation of the set, and a filter's removals
after it are those survivors that a semi-join finds in the filter's own relation. One chain of
joins works on all sets at once: before the join with a filter's relation each row stands once
with and once without that filter in its set, and only the former can be removed. Rows that
fail no filter survive every set; they are counted and join nothing.

All joins are on a unique row id, so no key is hot; what they find is counted by part and set
before it is shuffled. Orders and steps are laid over those counts at the end (n! * n rows for
each part, meant for a handful of filters).

Rows: each row of the table is judged on its own, also with a null or repeated doc_id. Null text
is empty, null part is the empty string. A text repeats a smaller doc_id's if a row with the same
text has a smaller doc_id; null doc_ids count as larger than all others and equal to each other.
A document is good or toxic if any label row of its doc_id says so; a null doc_id has no labels.
A table without rows has no parts and gives no rows. Other columns of the tables, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import written

WORD_BREAK = r"[\x20\x09-\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, signs: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions on a text without nulls: A few words, B few distinct words, C many
    capitals, D a sign of ``signs``."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    n_words = F.size(words).cast("long")
    return {
        "A": n_words < min_words,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capital_percent * F.char_length(text).cast("long"),
        "D": F.translate(text, signs, "") != text,
    }


def repeats(rows: DataFrame) -> DataFrame:
    """``row_id`` of the rows (row_id, doc_id, digest) whose digest a smaller doc_id has."""
    last = F.lit((1 << 63) - 1)
    groups = rows.groupBy("digest").agg(F.count("*").alias("times"), F.min(F.coalesce("doc_id", last)).alias("first")).filter("times > 1")
    # few digests have copies; written, so that the planner knows their size before the join
    firsts = written(groups.select("digest", "first"), "audit-copies")
    return rows.join(firsts, "digest").filter(F.coalesce("doc_id", last) > F.col("first")).select("row_id")


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (booleans) from the labels of their doc_id."""
    of = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    of = of.filter("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    known = rows.filter("doc_id is not null").join(of, "doc_id", "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return known.unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def _survivors(rows: DataFrame, failing: dict[str, DataFrame], names: list[str], bits: dict[str, int]) -> DataFrame:
    """Every row with each set ``done`` of the filters ``names`` that it survives."""
    rows = rows.withColumn("done", F.lit(0))
    for name in names:
        bit = F.lit(bits[name])
        rows = rows.withColumn("done", F.explode(F.array("done", F.col("done").bitwiseOR(bit))))
        ids = failing[name].select(F.col("row_id").alias("failed_id"))
        rows = rows.join(ids, (F.col("row_id") == F.col("failed_id")) & (F.col("done").bitwiseAND(bit) != 0), "left_anti")
    return rows


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """Per part, order of the filters and step: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing its filter
    only), ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``, its filter's removed
    summed over all orders.

    ``rows``: row_id (unique), part, good, toxic; ``failing``: of each filter, by its one-letter
    name, the row_id (once) of the rows that fail it. Both are written tables: they are read for
    each chain of joins."""
    names = sorted(failing)
    bits = {name: 1 << k for k, name in enumerate(names)}
    every = (1 << len(names)) - 1
    ids = failing[names[0]]
    for name in names[1:]:
        ids = ids.union(failing[name])
    touched = written(rows.join(ids.distinct(), "row_id", "left_semi"), "audit-touched")

    found = _survivors(touched, failing, names, bits).select("part", F.lit("").alias("name"), "done", "good", "toxic")
    for name in names:
        mine = touched.join(failing[name], "row_id", "left_semi")
        left = _survivors(mine, failing, [x for x in names if x != name], bits)
        found = found.unionByName(left.select("part", F.lit(name).alias("name"), "done", "good", "toxic"))
    lattice = found.groupBy("part", "name", "done").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    lattice = written(lattice, "audit-lattice")

    clean = rows.select("part", F.lit(1).alias("one")).unionByName(touched.select("part", F.lit(-1).alias("one"))).groupBy("part").agg(F.sum("one").alias("clean"))
    survived = lattice.filter("name = ''").select(F.col("part"), F.col("done").alias("after"), F.col("n").alias("survived"))
    removals = lattice.filter("name <> ''").select("part", "name", F.col("done").alias("before"), F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    # of the orders, |S|! (n - 1 - |S|)! have exactly the set S before a filter
    weights = F.array(*[F.lit(math.factorial(k) * math.factorial(len(names) - 1 - k)) for k in range(len(names))])
    alone = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, every - bits[name])]), F.col("name"))
    whole = removals.groupBy("part", "name").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("failed"),
        F.max(F.when(F.col("before") == alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.element_at(weights, F.bit_count("before") + 1)).alias("shapley"),
    )

    steps = clean.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(names)])))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "name")).withColumn("step", F.col("at") + 1)
    before = sum((F.when(F.instr("filter_order", name) < F.col("step"), F.lit(bits[name])).otherwise(0) for name in names), F.lit(0))
    bit = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, bits[name])]), F.col("name"))
    steps = steps.withColumn("before", before).withColumn("after", F.col("before") + bit)
    steps = steps.join(survived, ["part", "after"], "left").join(removals, ["part", "name", "before"], "left").join(whole, ["part", "name"], "left")
    steps = steps.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("survived", "removed", "failed", "unique_fails", "good_lost", "toxic_lost", "shapley")})
    steps = steps.withColumn("kept", F.col("clean") + F.col("survived")).withColumn("redundant", F.col("failed") - F.col("removed"))
    return steps.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in _COUNTS])


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of :func:`text_filters` and E, the texts that a smaller doc_id has too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    filters = text_filters(F.col("text"))
    facts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("text"))
    facts = facts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[fails.alias(f"fails_{name}") for name, fails in filters.items()])
    facts = written(facts, "audit-facts")
    failing = {name: written(facts.filter(f"fails_{name}").select("row_id"), f"audit-failing-{name}") for name in filters}
    failing["E"] = written(repeats(facts.select("row_id", "doc_id", "digest")), "audit-failing-E")
    rows = written(labelled(facts.select("row_id", "doc_id", "part"), labels).drop("doc_id"), "audit-rows")
    return audit(rows, failing)
