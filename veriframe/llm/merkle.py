"""Merkle manifest of a table: a hash tree over the rows of each source, and one over the sources.

A leaf is the hash of a row's fields. Every `ARITY` nodes that follow each other become one parent,
the last run may be shorter; the tops of the sources' trees, in order of the sources, are the leaves
of one more tree. A row's proof is its siblings on all levels, left and right: whoever has a row and
its proof can compute the root again.

A level is a window over its nodes: lag and lead columns of fixed offsets, masked by the node's slot
and the length of its run, are its siblings, and first children hash their parents. Nodes stay on
the row of their first leaf, so level l has offsets of ARITY**l rows and all `LEVELS` levels of a
block of ARITY**LEVELS rows share one partitioning and one order. Tops of blocks are the rows of the
next climb. No task ever holds more than blocks, however many rows a source has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.ordering import ranges, running, written

ARITY = 3
LEVELS = 7  # 2 187 rows in a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left string, right string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Hash of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(*[one(f) for f in fields])


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda h, s: hashed(s["left"], h, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof in a row, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def climb(nodes: DataFrame, group: str, digest: str, arity: int, levels: int, proofs: bool) -> DataFrame:
    """Up to `levels` levels above `nodes`, (group, _idx, _n, digest, ...): `_top` on the first row of each block.

    `_idx` counts the nodes of a group, `_n` is their number. With `proofs` every row has `_proof`,
    its siblings on these levels.
    """
    size = arity**levels
    nodes = nodes.withColumn("_block", F.expr(f"_idx div {size}")).withColumn("_top", F.col(digest))
    rows = Window.partitionBy(group, "_block").orderBy("_idx")
    steps = []
    for level in range(levels):
        step = arity**level
        slot = F.expr(f"(_idx div {step}) % {arity}")
        alive = F.expr(f"(_n + {step - 1}) div {step}")  # nodes of this level
        run = F.least(F.lit(arity), alive - (F.expr(f"_idx div {step}") - slot))
        is_node, has_parent = F.expr(f"_idx % {step} = 0"), alive > 1
        near = {}
        for k in range(1, arity):
            near[-k], near[k] = F.lag("_top", k * step).over(rows), F.lead("_top", k * step).over(rows)
        names = {k: f"_near_{'a' if k > 0 else 'b'}{abs(k)}" for k in near}
        nodes = nodes.select("*", *[c.alias(names[k]) for k, c in near.items()])
        left = F.concat(*[F.when(slot >= k, F.col(names[-k])).otherwise("") for k in range(arity - 1, 0, -1)])
        right = F.concat(*[F.when(slot + k < run, F.col(names[k])).otherwise("") for k in range(1, arity)])
        nodes = nodes.withColumn("_left", left).withColumn("_right", right)
        if proofs:
            beside = F.when(is_node & has_parent, F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
            nodes = nodes.withColumn(f"_level{level}", F.last(beside, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
            steps.append(f"_level{level}")
        first_child = F.expr(f"_idx % {step * arity} = 0")
        parent = F.when(has_parent, hashed(F.col("_left"), F.col("_top"), F.col("_right"))).otherwise(F.col("_top"))
        nodes = nodes.withColumn("_top", F.when(first_child, parent)).drop("_left", "_right", *names.values())
    if proofs:
        nodes = nodes.withColumn("_proof", F.array_compact(F.array(*steps))).drop(*steps)
    return nodes


def tops(climbed: DataFrame, group: str, size: int) -> DataFrame:
    """The blocks of a climb as nodes."""
    return climbed.where(f"_idx % {size} = 0").select(
        group, F.col("_block").alias("_idx"), F.expr(f"(_n + {size - 1}) div {size}").alias("_n"), F.col("_top").alias("_digest"))


def trees(leaves: DataFrame, group: str, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each climb, the groups' tops) of leaves (group, _idx, _n, _digest); each climb is written."""
    size, climbs = arity**levels, [leaves]
    most = leaves.agg(F.max("_n")).first()[0] or 1
    while True:
        nodes = written(tops(climb(climbs[-1], group, "_digest", arity, levels, False), group, size), "nodes")
        most = -(-most // size)
        if most == 1:
            return climbs, nodes
        climbs.append(nodes)


def with_proofs(climbs: list[DataFrame], above: DataFrame, group: str, carry: Sequence[str], arity: int, levels: int) -> DataFrame:
    """Leaves of `trees` with `_proof`, which goes on with `_proof` of their group in `above`, and `carry` of it."""
    for nodes in reversed(climbs):
        own = climb(nodes, group, "_digest", arity, levels, True).drop("_top").withColumnRenamed("_proof", "_own")
        # a key has one row above and the rows of a block below
        upper = above.select(F.col(group).alias("_of"), F.col("_idx").alias("_at"), F.col("_proof").alias("_upper"), *carry)
        joined = own.join(upper, (F.col(group) == F.col("_of")) & (F.col("_block") == F.col("_at")))
        above = joined.withColumn("_proof", F.concat("_own", "_upper")).drop("_own", "_upper", "_of", "_at", "_block")
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, keep: dict[str, Column] | None = None, arity: int = ARITY,
             levels: int = LEVELS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of `docs`: doc_id, leaf, subroot (of its source), root, proof, and `keep`, by name.

    proof is an array of (left, right): digests of the siblings left and right of the way up, the
    own source's levels first; empty for the only row of the only source. Leaves of a source are in
    order of doc_id (null first), then of the leaf; equal rows follow each other. Sources are in order
    of their UTF-8 bytes, null first. Null and empty fields differ. An empty table gives no rows.
    Columns that are neither fields nor needed for `keep` are not read.
    """
    keep = keep or {}
    hashes = written(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
        leaf(*[F.col(f) for f in fields]).alias("_digest"), *[c.alias(f"_keep_{n}") for n, c in keep.items()]), "leaves")
    order = [F.col("_source").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("_digest"), F.col("_row")]
    first = [F.col("_source").asc_nulls_first()]
    ranged = ranges(hashes.withColumn("_one", F.lit(1).cast("long")), *order)
    sources = ranges(ranged.groupBy("_source").agg(F.first("_one").alias("_one")), *first)
    sources = written(running(sources, first, {"_number": "_one"}), "sources")
    placed = running(ranged, order, {"_place": "_one"}, group=("_source",), lookup=sources.select("_source", "_number"))
    leaves = written(placed.select(
        F.col("_number").alias("_group"), (F.col("_place") - 1).alias("_idx"), F.col("_place_all").alias("_n"), "_digest", "_id",
        *[f"_keep_{n}" for n in keep]), "placed")
    climbs, subroots = trees(leaves, "_group", arity, levels)
    over = subroots.join(sources.select(F.col("_number").alias("_group"), (F.col("_number") - 1).alias("_rank"), "_number_all"), "_group")
    over = written(over.select(
        F.lit(0).alias("_all"), F.col("_rank").alias("_idx"), F.col("_number_all").alias("_n"), "_digest", "_group"), "subroots")
    over_climbs, roots = trees(over, "_all", arity, levels)
    top = roots.select("_all", "_idx", F.expr(f"cast(array() as {PROOF})").alias("_proof"), F.col("_digest").alias("root"))
    by_source = with_proofs(over_climbs, top, "_all", ["root"], arity, levels)
    by_source = written(by_source.select("_group", F.lit(0).cast("long").alias("_idx"), "_proof", "root", F.col("_digest").alias("subroot")), "proofs")
    found = with_proofs(climbs, by_source, "_group", ["root", "subroot"], arity, levels)
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_digest").alias("leaf"), "subroot", "root", F.col("_proof").alias("proof"),
        *[F.col(f"_keep_{n}").alias(n) for n in keep])


def oracle_sql() -> str:
    """Manifest of `documents` by the query's contract, in DuckDB."""
    def of(f: str) -> str:
        return f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')"

    head = " || ".join(of(f) for f in FIELDS[:-1])
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([n::UBIGINT] || [0::UBIGINT for i in range(8)],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
leaves AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {of('text')}) AS leaf,
    sha256({head} || {of("replace(text, chr(10), '')")}) AS changed,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 2 = 0 AS tampered
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (SELECT 0 AS lv, source, i, n, leaf AS h FROM placed
  UNION ALL SELECT lv + 1, source, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lv, source, i // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
over_up AS (SELECT 0 AS lv, i, n, subroot AS h FROM subroots
  UNION ALL SELECT lv + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM over_up WHERE n > 1 GROUP BY lv, i // 3),
runs AS (SELECT lv, source, i, n, string_agg(h, '') OVER (PARTITION BY source, lv, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(h, '') OVER (PARTITION BY source, lv, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM up),
over_runs AS (SELECT lv, i, n, string_agg(h, '') OVER (PARTITION BY lv, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(h, '') OVER (PARTITION BY lv, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM over_up),
steps AS (SELECT r, lv, coalesce(before, '') AS before, coalesce(after, '') AS after FROM placed JOIN runs
    ON placed.source IS NOT DISTINCT FROM runs.source AND runs.i = placed.i // (3 ** lv)::BIGINT AND runs.n > 1
  UNION ALL SELECT r, 1000 + lv, coalesce(before, ''), coalesce(after, '') FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source
    JOIN over_runs ON over_runs.i = subroots.i // (3 ** lv)::BIGINT AND over_runs.n > 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(before || after, '' ORDER BY lv), '')) AS proof_sha256,
    list_reduce([''] || coalesce(list(before || '_' || after ORDER BY lv) FILTER (lv IS NOT NULL), []), lambda h, s: h || ' ' || s) AS path FROM placed LEFT JOIN steps USING (r) GROUP BY r),
presented AS (SELECT r, list_reduce([CASE WHEN tampered THEN changed ELSE leaf END] || string_split(path, ' ')[2:],
    lambda h, s: sha256(split_part(s, '_', 1) || h || split_part(s, '_', 2))) AS folded_root FROM placed JOIN proofs USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN proofs USING (r) JOIN presented USING (r) JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source,
  (SELECT h AS root FROM over_up WHERE n = 1)"""
