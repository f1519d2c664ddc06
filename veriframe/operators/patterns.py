"""Regular expressions that values of a column have, generalised as far as a short description allows.

A value's shape (capital, small letter, digit, other characters as they are) is a sequence of runs.
Values with the same sequence share an expression in which every run has its least and greatest length.
Sequences are generalised in steps: capital and small letters become letters, letters and digits become
word characters, and at last anything. Each step sends a sequence to exactly one more general one,
so sequences form a tree. From its leaves up, what lies below a node is replaced by the node's one expression
if that is the shorter description: the expressions' text, and the bits that tell values apart under them.
Everything is counted by sequence in Spark; a value with very many runs counts as anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.names import named
from veriframe.operators.topk import top_per_group
from veriframe.session import shared_folder

MAX_RUNS = 64
CHARACTER_BITS = 8  # of an expression's text
ANYTHING = "\x00"

# What stands for letters and digits in a shape, and the classes it means at each step.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_FROM = _UPPER + _UPPER.lower() + _DIGITS
_TO = "A" * 26 + "a" * 26 + "9" * 10
_CLASSES = [
    {"A": ("[A-Z]", 26), "a": ("[a-z]", 26), "9": ("[0-9]", 10)},
    {"a": ("[A-Za-z]", 52), "9": ("[0-9]", 10)},
    {"a": ("[A-Za-z0-9]", 62)},
    {},
]
_STEPS = [("A", "a"), ("9", "a")]  # from one level to the next; the last step is to anything
TOP = len(_CLASSES) - 1


def _runs_joined(shape: Column) -> Column:
    """Every run as one character."""
    return F.regexp_replace(shape, r"(?s)(.)\1+", "$1")


def _levels(shape: Column) -> list[Column]:
    found = [shape]
    for old, new in _STEPS:
        found.append(F.translate(found[-1], old, new))
    return [*found, F.lit(None).cast("string")]


def _class(level: Column, character: Column) -> tuple[Column, Column]:
    """(text of the class in an expression, bits that tell its characters apart)"""
    text = F.regexp_replace(character, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    size: Column = F.lit(1)
    for i, classes in enumerate(_CLASSES):
        for c, (name, n) in classes.items():
            here = (level == i) & (character == c)
            text, size = F.when(here, F.lit(name)).otherwise(text), F.when(here, F.lit(n)).otherwise(size)
    anything = character == ANYTHING
    return F.when(anything, F.lit(".")).otherwise(text), F.log2(F.when(anything, F.lit(95)).otherwise(size))


def _nodes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, level, sequence, above, copies, expression, cost) of all sequences at all levels."""
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in columns]))).where("value IS NOT NULL")
    shape = F.translate("value", _FROM, _TO)
    short = F.length(_runs_joined(shape)) <= MAX_RUNS
    shapes = values.select("column_name", F.when(short, shape).alias("shape"), F.when(~short, F.length("value")).alias("long")).groupBy(
        "column_name", "shape", "long").agg(F.count(F.lit(1)).alias("copies"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), s.alias("at_level")) for i, s in enumerate(_levels(F.col("shape")))])
    each = shapes.select("column_name", "copies", F.coalesce("long", F.length("shape")).alias("size"), F.inline(levels))
    sequence = F.coalesce(_runs_joined(F.col("at_level")), F.lit(ANYTHING))
    lengths = F.when(F.col("at_level").isNull(), F.array("size")).otherwise(
        F.transform(F.regexp_extract_all("at_level", F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length))
    placed = each.select("column_name", "level", "copies", sequence.alias("sequence"), F.posexplode_outer(lengths).alias("place", "n"))
    runs = placed.groupBy("column_name", "level", "sequence", "place").agg(
        F.sum("copies").alias("copies"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.col("n") * F.col("copies")).alias("total"))
    character = F.substring("sequence", F.col("place") + 1, F.lit(1))
    text, bits = _class(F.col("level"), character)
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    times = F.when((F.col("low") == 1) & (F.col("high") == 1), "").when(
        F.col("low") == F.col("high"), F.concat(F.lit("{"), low, F.lit("}"))).otherwise(F.concat(F.lit("{"), low, F.lit(","), high, F.lit("}")))
    runs = runs.withColumn("text", F.concat(text, times)).withColumn(
        "bits", F.col("copies") * F.log2(F.col("high") - F.col("low") + 1) + F.col("total") * bits)
    nodes = runs.groupBy("column_name", "level", "sequence").agg(
        F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("texts"), F.sum("bits").alias("bits"))
    expression = F.concat(F.lit("^(?s:"), F.array_join(F.col("texts.text"), ""), F.lit(r")\z"))
    rows = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"))
    above = F.when(F.col("sequence") == ANYTHING, F.lit(ANYTHING))
    for i, (old, new) in enumerate(_STEPS):
        above = above.when(F.col("level") == i, _runs_joined(F.translate("sequence", old, new)))
    cost = (CHARACTER_BITS * F.length("expression") + F.col("copies") * F.log2(F.col("rows") / F.col("copies")) + F.coalesce("bits", F.lit(0.0)))
    return nodes.withColumn("expression", expression).join(rows, "column_name").select(
        "column_name", "level", "sequence", above.otherwise(F.lit(ANYTHING)).alias("above"), "copies", "rows", "expression", cost.alias("cost"))


def expressions(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent expressions of each column: column_name, expression, copies, share, rank.

    Every value that is not null belongs to one expression, which it matches as a whole; `copies` counts
    them. Empty values have the expression of nothing. A column without values has none.
    """
    path = shared_folder(df.sparkSession, "sequences")  # counted once, read at every step up and down the tree
    _nodes(df, columns).write.parquet(path)
    nodes = df.sparkSession.read.parquet(path)
    level = [nodes.where(F.col("level") == i).drop("level") for i in range(TOP + 1)]
    best = [level[0].withColumn("best", F.col("cost")).withColumn("merged", F.lit(True))]
    for i in range(1, TOP + 1):
        below = best[-1].groupBy("column_name", F.col("above").alias("sequence")).agg(F.sum("best").alias("apart"))
        joined = level[i].join(below, ["column_name", "sequence"])
        best.append(joined.withColumn("best", F.least("cost", "apart")).withColumn("merged", F.col("cost") < F.col("apart")).drop("apart"))
    kept = ["column_name", "expression", "copies", "rows"]
    chosen = [best[TOP].where("merged").select(*kept)]
    apart = best[TOP].where("NOT merged").select("column_name", F.col("sequence").alias("above"))
    for i in range(TOP - 1, -1, -1):
        reached = best[i].join(apart, ["column_name", "above"], "left_semi")
        chosen.append(reached.where("merged").select(*kept))
        apart = reached.where("NOT merged").select("column_name", F.col("sequence").alias("above"))
    found = reduce(DataFrame.unionByName, chosen).withColumn("share", F.round(F.col("copies") / F.col("rows"), 4)).drop("rows")
    return top_per_group(found, ["column_name"], [F.desc("copies"), F.col("expression")], n)
