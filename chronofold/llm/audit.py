"""How filters act on each other, from one CUBE over their failure flags.

Each document gets five flags (which filters it fails). Counts by part and flags are all that is kept of the documents: 32 rows a
part. A CUBE over the flags and the part has a grouping set for each subset of filters, and its row whose selected flags are all false
counts what survives that subset, whatever the order. A step of an order leads from the subset of the filters before it to that subset
with its own filter, so each step is a join of two survivors' rows, and no order is ever applied to documents.

Copies are found by one aggregate over digests of the texts (least id of each), joined back by id and digest, so a text of very many
documents is counted by partial sums and never gathered.

Defined cases: a null or empty text has no words and is a copy of other empty ones; a document with a null doc_id is no copy and makes no
other one a copy; rows of one id aren't copies of each other; a null lang is part '', as an empty one is; documents without a label, or
with a null one, are neither good nor toxic, and one of several labels of an id suffices; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronofold.scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
SYMBOLS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, A, B, C, D, E: which filters each document fails."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, upper = F.size("words"), F.octet_length("text") - F.octet_length(F.translate("text", UPPER, ""))
    seen = rows.select(
        "doc_id", "part",
        (n < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")).cast("long") < MIN_DISTINCT_PERCENT * n.cast("long")).alias("B"),
        (100 * upper.cast("long") > MAX_UPPER_PERCENT * F.char_length("text").cast("long")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
        F.unhex(F.sha2("text", 256)).alias("print"),
    )
    seen = Scratch(docs.sparkSession).save(seen, "flags")
    first = seen.groupBy("print").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    own = seen.join(first, ["doc_id", "print"], "left")
    return own.select("doc_id", "part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"))


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i is in it), n, good, toxic: the documents of a part that pass every filter of a subset, zeros included."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = list(FILTERS)
    counts = failed.join(marks, "doc_id", "left").groupBy("part", *flags).agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    counts = Scratch(failed.sparkSession).save(counts, "counts")  # 32 rows a part
    cube = counts.cube("part", *flags).agg(F.grouping("part").alias("_all"), *(F.grouping(f).alias(f"_{f}") for f in flags), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passed = cube.where(" and ".join(["_all = 0", *(f"(_{f} = 1 or not {f})" for f in flags)]))
    subset = sum(((1 - F.col(f"_{f}")) * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("subset"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return grid.join(passed.select("part", subset.cast("int").alias("subset"), "n", "good", "toxic"), ["part", "subset"], "left").select("part", "subset", *zero)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row a step of every order of the filters."""
    spark = docs.sparkSession
    passed = Scratch(spark).save(survivors(failures(docs), labels), "survivors")
    every = (1 << len(FILTERS)) - 1
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(("".join(order), step + 1, f, bit, before, before | bit, every - bit))
            before |= bit
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, alone int, before int, after int, others int"))  # 600 rows
    named = lambda subset: passed.select("part", F.col("subset").alias(subset), *(F.col(c).alias(f"{subset}_{c}") for c in ("n", "good", "toxic")))
    total = passed.where("subset = 0").select("part", F.col("n").alias("total"))
    last = passed.where(F.col("subset") == every).select("part", F.col("n").alias("last"))
    at = named("before").join(orders, "before")
    for subset in ("after", "alone", "others"):
        at = at.join(named(subset), ["part", subset])
    at = at.join(total, "part").join(last, "part").withColumn("removed", F.col("before_n") - F.col("after_n"))
    out = at.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed",
        (F.col("total") - F.col("alone_n") - F.col("removed")).alias("redundant"), (F.col("others_n") - F.col("last")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "filter",
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).drop("filter")
