"""Context for prompts: budgets, ordered texts, prompt rendering and messages."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewright.functions.prompts import TEMPLATES, Template
from quirewright.plans.storage import materialise

SEPARATOR = "\n\n---\n\n"


def budget_prefix(chunks: DataFrame, keys: list[str], order: list[str], tokens: str, budget: int | Column, hot_rows: int = 10_000) -> DataFrame:
    """The chunks before the first that would exceed the budget; null counts are 0.

    Counts must not be negative. A first chunk over the budget leaves nothing. Groups of at least
    ``hot_rows`` rows and a thousandth of all (a thousand groups at most) are sorted over many tasks:
    the sums of the parts tell where each begins, and parts beyond the budget are dropped before any
    group is put together.
    """
    counted = chunks.withColumn("__n", F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    running = F.sum("__n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    plain = lambda rows: rows.withColumn("__running", running).where(F.col("__running") <= limit).select(*chunks.columns)
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("__size"))
    total = sizes.agg(F.sum("__size")).head()[0] or 0
    hot = sizes.where(F.col("__size") >= max(hot_rows, -(-total // 1_000))).select(*(F.col(k).alias(f"__{k}") for k in keys)).collect()
    if not hot:
        return plain(counted)
    schema = T.StructType([T.StructField(f"__{k}", chunks.schema[k].dataType) for k in keys])
    names = F.broadcast(chunks.sparkSession.createDataFrame(hot, schema))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    large = counted.join(names, same, "left_semi")
    ranged = materialise(large.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "budget-ranges")
    held = ranged.groupBy(*keys, "__part").agg(F.sum("__n").alias("__held"))  # a row per group and task
    before = F.coalesce(F.sum("__held").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.withColumn("__before", before).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__at"), "__before")
    placed = ranged.join(F.broadcast(starts), same & (F.col("__part") == F.col("__at"))).where(F.col("__before") <= limit)
    within = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = placed.withColumn("__running", F.col("__before") + within).where(F.col("__running") <= limit).select(*chunks.columns)
    return plain(counted.join(names, same, "left_anti")).unionByName(kept)


def assemble(chunks: DataFrame, keys: list[str], order: list[str], text: str, section: str) -> DataFrame:
    """keys, context, sections_analyzed, chunks_processed, n_chunks, tokens of ordered chunks.

    Sections are the distinct non-null names in order of appearance; chunks_processed is their number,
    n_chunks that of the chunks. Use it behind a budget: it holds a group's texts together.
    """
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("text"), F.col(section).alias("section"))))
    out = chunks.groupBy(*keys).agg(parts.alias("parts"))
    names = F.array_distinct(F.filter(F.transform("parts", lambda p: p["section"]), lambda s: s.isNotNull()))
    return out.select(
        *keys,
        F.array_join(F.transform("parts", lambda p: p["text"]), SEPARATOR).alias("context"),
        names.alias("sections_analyzed"),
        F.size(names).alias("chunks_processed"),
        F.size("parts").alias("n_chunks"),
    )


def get_template(name: str) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def render(template: Template, variables: dict[str, Column]) -> tuple[Column, Column]:
    """(system, user) prompts; missing variables are an error, and a null value is an empty text.

    Values are put in at once, so that braces inside a value stay what they are.
    """
    missing = [v for v in template.variables if v not in variables]
    if missing:
        raise KeyError(missing[0])
    parts: list[Column] = []
    for piece in re.split(r"(\{\w+\})", template.user):
        name = piece[1:-1]
        parts.append(F.coalesce(variables[name], F.lit("")) if piece.startswith("{") and name in variables else F.lit(piece))
    return F.lit(template.system), F.concat(*parts)


def messages(system: Column | None, user: Column) -> Column:
    """array<struct<role, content>>: the system message, if there is one, and the user's."""
    rows = F.array(
        F.struct(F.lit("system").alias("role"), (system if system is not None else F.lit(None).cast("string")).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return F.filter(rows, lambda m: m["content"].isNotNull())
