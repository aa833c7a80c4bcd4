"""Mixing sources to target weights by entropy balancing.

Document rates minimise the entropy divergence from one copy each, subject to one token constraint per source and a cap. The
dual has one variable for each source; a document's rate is exp(lambda * x), cut at the cap, with x the square root of its
size over its source's mean, so that neither documents nor words alone bear the change. Newton steps on the dual are
aggregates over the histogram of sizes, each written to the shared folder. Rates become whole copies class of sizes by class,
largest first; what rounding leaves over is carried to the next smaller class, so only the smallest documents decide
how near a source comes to its target.

Only DataFrame operations: one scan of the texts counts words, everything else works on (doc_id, source, size) or counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.llm.common import WORD, numbered_rows, unique_ids

#: Sizes of one class differ by at most this factor.
CLASS_RATIO = 1.05
#: Numbering within a class is done in so many groups, so that a common size is no single task.
SALTS = 32
MOST_STEPS = 60
PRECISION = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, n, source_size, target for a table of (source, n, source_size).

    Sources in code point order, null last, get the weights in turn. A target stops at ``cap`` times its source's size; what is
    over is shared by weight among the rest. That is one water level: sources are capped in the order of cap
    over weight until the level of the others is below their own caps.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) * F.lit(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(all_)
    levels = levels.withColumn("level", final)
    return levels.select("source", "n", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def rates(histogram: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """The histogram (source, size, n; sizes of 1 or more) with target and rate, by Newton steps on the dual.

    A step that leaves the bracket around a source's root is replaced by its middle.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    of = mean.withColumnRenamed("source", "s")
    table = histogram.join(of, same).drop("s").withColumn("x", F.sqrt(F.col("size") / F.col("mean")))
    table = cut_lineage(table.join(targets.select(F.col("source").alias("s"), "target", "source_size"), same).drop("s"))
    start = table.groupBy("source").agg(F.min("x").alias("x0"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    ratio = F.log(F.col("target") / F.col("size"))
    top = F.log(F.lit(cap)) / F.col("x0")
    state = start.select(
        F.col("source").alias("s"),
        F.when(ratio < 0, ratio / F.col("x0")).otherwise(F.lit(0.0)).alias("low"),
        F.when(ratio < 0, F.lit(0.0)).otherwise(top).alias("high"),
        F.when(F.col("target") >= F.col("size") * F.lit(cap), top).otherwise(ratio).alias("dual"),
    )
    state = cut_lineage(state)
    growth = F.exp(F.col("dual") * F.col("x"))
    mass = F.col("n") * F.col("size")
    for _ in range(MOST_STEPS):
        step = table.join(state, same).groupBy("s").agg(
            F.first("low").alias("low"), F.first("high").alias("high"), F.first("dual").alias("dual"),
            (F.sum(mass * F.least(growth, F.lit(cap))) - F.first("target")).alias("f"),
            F.sum(F.when(growth < cap, mass * F.col("x") * growth).otherwise(F.lit(0.0))).alias("slope"),
            F.first("target").alias("target"),
        )
        low = F.when(F.col("f") < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(F.col("f") > 0, F.col("dual")).otherwise(F.col("high"))
        step = step.withColumns({"low": low, "high": high})
        newton = F.when(F.col("slope") > 0, F.col("dual") - F.col("f") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs("f") <= F.lit(PRECISION) * F.col("target")
        moved = F.when(done, F.col("dual")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut_lineage(step.select("s", "low", "high", moved.alias("dual"), done.alias("done")))
        if not state.filter("not done").limit(1).count():
            break
    return table.join(state.select("s", "dual"), same).select("source", "size", "n", "target", F.least(growth, F.lit(cap)).alias("rate"))


def size_class(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(CLASS_RATIO))).cast("int")


def class_copies(rated: DataFrame, cap: float = 2.0) -> DataFrame:
    """source, class, docs and copies: whole copies that the documents of a size class get together.

    A source's classes are at most the logarithm of the longest size, so they fold in one row.
    """
    classes = rated.groupBy("source", size_class(F.col("size")).alias("class")).agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).cast("double").alias("words"), F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("want")
    )
    held = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "docs", "words", "want")), asc=False).alias("classes"))
    empty = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:int,docs:bigint,copies:bigint>>").alias("out"))

    def fold(state: Column, c: Column) -> Column:
        mean = c["words"] / c["docs"]
        copies = F.least(F.greatest(F.round((c["want"] + state["carry"]) / mean), F.lit(0.0)), c["docs"] * F.lit(cap)).cast("long")
        out = F.concat(state["out"], F.array(F.struct(c["class"].alias("class"), c["docs"].alias("docs"), copies.alias("copies"))))
        return F.struct((state["carry"] + c["want"] - copies * mean).alias("carry"), out.alias("out"))

    folded = held.select("source", F.aggregate("classes", empty, fold, lambda s: s["out"]).alias("out"))
    return folded.select("source", F.inline("out"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: how often a mix takes each document.

    Needs doc_id, text, source; other columns are ignored. Size is the number of words; null and empty texts have none, are kept once
    and take nothing. Null sources are one source, the last. Repeated rows count each; equal rows are
    interchangeable. An empty table gives no rows. Results depend on the rows alone, not on their order or partitions.
    """
    base = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    histogram = cut_lineage(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut_lineage(source_targets(sources, weights, budget, cap))
    copies = cut_lineage(class_copies(rates(histogram.filter("size > 0"), targets, cap), cap))
    keyed = base.withColumn("class", F.when(F.col("size") > 0, size_class(F.col("size")))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    key = ["source", "class", "salt"]
    counts = keyed.groupBy(*key).agg(F.count("*").alias("c"))
    lower = Window.partitionBy("source", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_{k}") for k in key], F.coalesce(F.sum("c").over(lower), F.lit(0)).alias("before"))
    numbered = keyed.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id")))
    equal = lambda names: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    numbered = numbered.join(before, equal(key)).withColumn("number", F.col("number") + F.col("before")).drop(*[f"_{k}" for k in key])
    planned = numbered.join(copies.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "docs", F.col("copies").alias("all")), equal(["source", "class"]), "left").drop("_source", "_class")
    share = F.expr("(number * all) div docs - ((number - 1) * all) div docs")
    planned = planned.withColumn("copies", F.when(F.col("size") > 0, share).otherwise(F.lit(1)).cast("long"))
    return planned.join(targets.select(F.col("source").alias("_source"), "source_size", "target"), equal(["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all columns; needs doc_id, text and source."""
    name = "__row"
    rows = docs.withColumn(name, F.col("doc_id").cast("long")) if unique_ids(docs) else numbered_rows(docs, name)
    mix = mix_sources(rows.select(F.col(name).alias("doc_id"), "text", "source"), weights, budget, cap).select(F.col("doc_id").alias(name), "copies")
    taken = rows.join(mix.filter("copies > 0"), name)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
