"""Problem 9: mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. Every document gets the exponential key -ln(u) / w, u uniform by hash of its id
and w its quality weight (the order of u^(1/w) from the highest, without its rounding near 0 and 1); a source
contributes complete epochs first, then the documents with the smallest keys up to the token budget that is left.

The prefix sum within a source is not one window over the source: logarithms of keys fall into cells of 1 / KEY_CELLS,
in which at most 0.37 / KEY_CELLS of a weight's documents lie; the cells' sums (a table bounded by sources and the range
of a double's logarithm) tell in which cell the budget ends, and only that cell is ordered.

Documents without source belong to no target but count in the total. A target absent from the documents, or one
whose source has no tokens, contributes nothing. A null cap is no cap; a null share is 0; a weight that is null or
not positive keeps a document out of the fractional part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lipika.session import cut_lineage
from lipika.llm.tokens import Pieces, token_count

KEY_CELLS = 1_000


def quality(text: Column) -> Column:
    """Weight in (0, 1]: share of a text that is neither digit nor page furniture sign."""
    plain = F.length(F.translate(text, "0123456789|<>#/[]", ""))
    return F.greatest(plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.01))


def sized_documents(docs: DataFrame, pieces: Pieces, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, key), written once to the shared folder as every later step reads it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 13)  # 52 bits
    u = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = quality(F.col("text"))
    rows = docs.select("doc_id", "source", token_count(pieces, F.col("text")).alias("tokens"), F.when(weight > 0, -F.log(u) / weight).alias("key"))
    return cut_lineage(rows)


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, source_tokens, target_tokens, epochs (complete), rest (tokens of a partial one), capped."""
    by_source = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = by_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).first()[0]
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(by_source, "source", "left")
    have = F.coalesce("source_tokens", F.lit(0))
    want = F.col("target_share") * F.lit(total)
    t = t.select("source", "target_share", "max_repeats", have.alias("source_tokens"), want.alias("target_tokens"))
    whole = F.when(F.col("source_tokens") > 0, F.floor(F.col("target_tokens") / F.col("source_tokens"))).otherwise(0)
    t = t.withColumn("epochs", F.least(whole, F.coalesce("max_repeats", whole)).cast("bigint"))
    t = t.withColumn("capped", F.coalesce(F.col("max_repeats") * F.col("source_tokens") < F.col("target_tokens"), F.lit(False)))
    left = F.col("target_tokens") - F.col("epochs") * F.col("source_tokens")
    return t.withColumn("rest", F.when(F.col("capped") | (F.col("source_tokens") == 0) | (F.col("epochs") >= F.coalesce("max_repeats", F.col("epochs") + 1)), 0.0).otherwise(left))


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document of a target enters the mix; 0 leaves it out."""
    plan = budgets(sized, targets).select("source", "epochs", "rest")
    cell = F.floor(F.log("key") * KEY_CELLS).cast("int")
    rows = sized.where("source is not null").withColumn("cell", cell)
    sums = rows.where("cell is not null").groupBy("source", "cell").agg(F.sum("tokens").alias("cell_tokens"))
    above = F.sum("cell_tokens").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_tokens")
    edge = sums.withColumn("above", above).join(plan, "source").where((F.col("above") <= F.col("rest")) & (F.col("above") + F.col("cell_tokens") > F.col("rest")))
    edge = edge.groupBy("source").agg(F.max_by("cell", "above").alias("edge"), F.max("above").alias("above"))
    plan = plan.join(edge, "source", "left")
    rows = rows.join(plan, "source")
    inside = rows.where("cell <> edge or cell is null or edge is null").withColumn("part", F.coalesce((F.col("cell") < F.col("edge")) | (F.col("edge").isNull() & (F.col("rest") > 0) & F.col("cell").isNotNull()), F.lit(False)))
    prefix = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = rows.where("cell = edge").withColumn("part", prefix + F.col("above") <= F.col("rest"))
    both = inside.unionByName(at_edge)
    return both.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("part").cast("int")).alias("repeats"))


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: plan beside the tokens and the share each source reached."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    out = plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(Window.partitionBy())  # one row per target
    return out.select("source", "target_share", "max_repeats", "source_tokens", "target_tokens", "mixed_tokens", (F.col("mixed_tokens") / F.nullif(total, F.lit(0))).alias("actual_share"), "capped")
