"""Mixing sources to target weights by weighted fair queueing.

Sources share a budget of words by weight. No source gives more than `repeats` times what it has;
what it can't give is shared among the others, again by weight. Each pass over a source's shuffled
documents continues its count of words, and a document's virtual finish time is that count divided
by the source's weight. All documents of all passes, in order of finish time, are the mix; it ends
where the budget does. A queue in this order serves every source in proportion to its weight as
long as it has documents, so no quota is imposed on it: sources come out within a document or two
of their targets.

Everything is DataFrame functions. Cumulative counts come from range partitions (`ordering`), so
neither a large source nor the global order passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.ordering import ranges, running, written

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLANKS, WORD = r"[\x20\x09-\x0D]*+", r"[^\x20\x09-\x0D]++"


def n_words(text):
    """Number of words; every word with the blanks around it becomes one letter, so no list of words is made."""
    marks = F.regexp_replace(text, f"{BLANKS}{WORD}{BLANKS}", "x")
    return F.when(marks.startswith("x"), F.length(marks)).otherwise(0).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """doc_id, source, size in words and a fixed shuffled `_key` of each row, written without the texts."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return written(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed), name)).alias("_key"),
    ), "sized")


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """source, source_size, weight, target: the share of each source of `sized` rows.

    Sources in order of code points, null last, get the weights in turn. Shares are one level times
    the weight, at most `repeats` times the size. With sources in order of the level at which they
    are used up, the level is the largest of what is left for each and the sources after it.
    """
    if not weights or min(weights) <= 0 or repeats < 1:
        raise ValueError("weights and repeats must be positive")
    sizes = ranges(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("_one")), F.col("source").asc_nulls_last())
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"_rank": "_one", "_words": "source_size"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.select(
        "source", "source_size", "_rank", weight.alias("weight"), (F.col("source_size") * repeats).alias("_cap"),
        (F.col("_words_all") if budget is None else F.lit(int(budget))).alias("_budget"))
    order = [F.col("_cap") / F.col("weight"), F.col("_rank")]
    served = running(ranges(capped, *order), order, {"_caps": "_cap", "_weights": "weight"})
    left = F.col("_budget") - (F.col("_caps") - F.col("_cap"))
    level = left / (F.col("_weights_all") - (F.col("_weights") - F.col("weight")))
    highest = served.agg(F.max(level)).first()[0]  # one number
    share = F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(highest))
    return written(served.select("source", "source_size", "weight", share.alias("target"), F.col("_budget").alias("budget")), "targets")


def queue(rows: DataFrame, shares: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Every pass of every row: source columns, pass, finish, position (words before it), taken (whether the budget reaches it)."""
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")]
    known = running(ranges(rows, *order), order, {"_served": "size"}, group=("source",),
                    lookup=shares.select("source", "weight", "target", "budget"))
    passes = known.select(
        "_row", "doc_id", "source", "size", "_key", "target", "budget", F.col("_served_all").alias("source_size"),
        "_served", "weight", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    finish = (F.col("pass") * F.col("source_size") + F.col("_served")) / F.col("weight")
    timed = passes.withColumn("finish", finish).drop("_served", "weight")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")]
    queued = running(ranges(timed, *order), order, {"_end": "size"})
    return queued.select(
        "_row", "doc_id", "source", "size", "source_size", "target", "pass", "finish",
        (F.col("_end") - F.col("size")).alias("position"), (F.col("_end") <= F.col("budget")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """The mix, one row for each document each time it is taken: doc_id, source, size, pass, finish, position.

    `position` orders the mix; without a budget it is as long as all documents. Null texts have no
    words, a null source is a source of its own, rows without doc_id and repeated rows count each for
    itself, and rows that are equal may change places. An empty table gives no rows. Other columns
    are not read.
    """
    rows = sized(docs, doc_id, text, source, seed)
    queued = queue(rows, targets(rows, weights, repeats, budget), repeats)
    return queued.where("taken").select("doc_id", "source", "size", "pass", "finish", "position")


def shares(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None,
           doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source, source_size, target, taken (words, repeats counted)."""
    rows = sized(docs, doc_id, text, source, seed)
    queued = queue(rows, targets(rows, weights, repeats, budget), repeats)
    return queued.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")],
        F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"),
    ).drop("_row")


def oracle_sql(weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> str:
    """The shares of `documents` in DuckDB."""
    listed = ", ".join(str(float(w)) for w in weights)
    return rf"""
WITH sized AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
capped AS (SELECT *, list_extract([{listed}]::DOUBLE[], ((rk - 1) % {len(weights)} + 1)::BIGINT) AS weight, {repeats} * source_size AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM capped WINDOW earlier AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, weight, least(cap::DOUBLE, weight * max(level) OVER ()) AS target, sum(source_size) OVER ()::BIGINT AS budget FROM levels),
served AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, r ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM sized),
timed AS (SELECT r, served.doc_id, served.source, size, k, p, source_size, target, budget, (p * source_size + s)::DOUBLE / weight AS finish
  FROM served JOIN targets ON served.source IS NOT DISTINCT FROM targets.source, range({repeats}) AS passes(p)),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, p, k, doc_id, size, r ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM timed)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  coalesce(sum(size) FILTER (WHERE taken), 0)::BIGINT AS taken FROM queued GROUP BY r"""
