"""Merkle manifest of a dataset: a tree of rows for each source and one of the sources' roots, by sibling-shift self-joins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import table
from lexiforge.store import materialize

ARITY = 16
_PLACE_BITS = 33  # monotonically_increasing_id: the partition stands above, the place in it below


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 byte count, `:` and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf of a row: SHA-256, in lowercase hex, of its fields one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


class Manifest(NamedTuple):
    """rows: the rows given, with subroot and path, what stands beside a row's node at each level up to the root, an array
    of (left, right) of joined digests. trees: (group, n, subroot). root: hex, null for an empty table."""

    rows: DataFrame
    trees: DataFrame
    root: str | None


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path as hex text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_text(s["left"]), h, _text(s["right"])), 256))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, idx, n, digest, given) with left and right, the joined digests of their siblings on either side.

    Every node is shifted to the places of its siblings, computed from its own by XOR for pairs and else by slot offsets,
    and an equijoin on (tree, place) brings it there: n * (arity - 1) rows through one exchange, at most arity - 1 a key.
    """
    slot, at = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    target = F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")) if arity == 2 else at + (slot + F.col("offset")) % arity
    shifted = nodes.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))).select("tree", target.alias("idx"), "n", slot.cast("int").alias("slot"), "digest")
    shifted = shifted.where(F.col("idx") < F.col("n")).select("tree", "idx", F.struct("slot", "digest").alias("sibling"))
    found = nodes.join(shifted, ["tree", "idx"], "left").groupBy("tree", "idx").agg(*[F.first(c).alias(c) for c in ("n", "digest", "given")], F.array_sort(F.collect_list("sibling")).alias("siblings"))

    def side(keep) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("siblings", lambda s: keep(s["slot"])), lambda s: F.hex(s["digest"])), ""))

    return found.select("tree", "idx", "n", "digest", "given", side(lambda s: s < slot).alias("left"), side(lambda s: s > slot).alias("right"))


def _climb(nodes: DataFrame, height: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, from the nodes at the bottom up, each with the siblings of its nodes, and the top of every
    tree (tree, digest). The rows in slot zero of a run emit its parent: what stands to their right is the rest of the run."""
    levels, tops = [], nodes.where("n = 1").select("tree", "digest")
    for k in range(height):
        level = materialize(_siblings(nodes.where("n > 1"), arity), f"{name}-{k}")
        parent = F.unhex(F.sha2(F.concat(_text(F.col("digest")), _text(F.col("right"))), 256))
        nodes = level.where(F.col("idx") % arity == 0).select("tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), parent.alias("digest"), F.lit(None).cast("boolean").alias("given"))
        levels.append(level)
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return levels, tops


def _height(n: int, arity: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


_PATH = "array<struct<left:binary,right:binary>>"


def _paths(levels: list[DataFrame], bottom: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """From the top down: the nodes of the lowest level with their path, rows (tree, idx, given, path, subroot).

    bottom has the nodes of the lowest level, above (tree, height, path, subroot) every tree's top. A level meets its parents
    by one equijoin on their place, which carries a parent's path once for all its children; paths of the lowest level, a
    few kilobytes each, are made by the last of these joins and move nowhere."""
    tops = above.select("tree", "height", F.lit(0).cast("bigint").alias("idx"), "path", "subroot")
    alone = bottom.where("n = 1").select("tree", "given").join(tops.where("height = 0"), "tree").select("tree", "idx", "given", "path", "subroot")
    paths = None
    for k in reversed(range(len(levels))):
        parents = tops.where(F.col("height") == k + 1).select("tree", "idx", "path", "subroot")
        if paths is not None:
            parents = parents.unionByName(paths.drop("given"))
        own = levels[k].select("tree", "idx", "given", F.floor(F.col("idx") / arity).alias("up"), F.struct("left", "right").alias("own"))
        paths = own.join(parents.withColumnRenamed("idx", "up"), ["tree", "up"]).select("tree", "idx", "given", F.concat(F.array("own"), "path").alias("path"), "subroot")
    return alone if paths is None else paths.unionByName(alone)


def manifest(rows: DataFrame, group: str = "source", key: str = "doc_id", leaf: str = "leaf", *, arity: int = ARITY) -> Manifest:
    """Merkle trees over the leaves (hex) of rows: one a group, its leaves in ascending order of key, and one over the groups'
    roots in ascending order of group (null first, strings by bytes). Runs of `arity` nodes, the last one of a level
    shorter, down to a single node, become one node until one remains; a lone leaf is its tree's root.

    Places are found over the whole table by ranges of (group, key, leaf), so a group that holds most rows is spread over
    many tasks; null keys come first, rows with one key stand in the order of their leaves, equal rows next to each other.
    Digests move as bytes and no text moves at all. Levels are written, so a lost executor costs one level at most. Columns
    of rows that are called subroot or path are replaced.
    """
    rows, spark = rows.drop("subroot", "path"), rows.sparkSession
    named = rows.select(F.struct("*").alias("given"), F.col(group).alias("group"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"), F.monotonically_increasing_id().alias("spread"))
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.asc("digest"), F.asc("spread")]
    at = F.monotonically_increasing_id()
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("at", at)
    dealt = dealt.select("given", "group", "digest", F.shiftright("at", _PLACE_BITS).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"))
    dealt = materialize(dealt, "manifest-rows")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    runs = materialize(
        dealt.groupBy("part", "group").agg(F.min("place").alias("first"), F.count("*").alias("n")).join(F.broadcast(before), "part").select("part", "group", (F.col("first") + F.col("before")).alias("first"), "before", "n"), "manifest-runs"
    )
    groups = runs.groupBy("group").agg(F.min("first").alias("start"), F.sum("n").alias("n"))
    trees, n_trees = _numbered(groups, "start")
    widest = trees.agg(F.max("n")).first()[0]
    if not n_trees:
        return Manifest(rows.withColumns({"subroot": F.lit(None).cast("string"), "path": F.array().cast(_PATH)}), spark.createDataFrame([], f"group {rows.schema[group].dataType.simpleString()}, n bigint, subroot string"), None)
    placed = runs.alias("r").join(trees.alias("t"), F.col("r.group").eqNullSafe(F.col("t.group"))).select("part", F.col("r.group").alias("group"), "tree", F.col("t.n").alias("n"), (F.col("before") - F.col("start")).alias("shift"))
    leaves = dealt.alias("d").join(placed.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.group").eqNullSafe(F.col("p.group")))
    leaves = materialize(leaves.select("tree", (F.col("place") + F.col("shift")).alias("idx"), "n", "digest", "given"), "manifest-leaves")

    levels, subroots = _climb(leaves, _height(widest, arity), arity, "manifest")
    subroots = materialize(subroots, "manifest-subroots")
    upper = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("bigint").alias("n"), "digest", F.lit(None).cast("boolean").alias("given"))
    tall = _height(n_trees, arity)
    upper_levels, top = _climb(upper, tall, arity, "manifest-upper")
    root = top.select(_text(F.col("digest"))).first()[0]
    at_top = spark.range(1).select(F.lit(0).cast("bigint").alias("tree"), F.lit(tall).alias("height"), F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    over = _paths(upper_levels, upper, at_top, arity).select(F.col("idx").alias("tree"), "path")

    height = sum((F.when(F.col("n") > arity**k, 1).otherwise(0) for k in range(1, _height(widest, arity))), F.when(F.col("n") > 1, 1).otherwise(0))
    known = trees.join(subroots, "tree").select("tree", "group", "n", height.alias("height"), _text(F.col("digest")).alias("subroot"))
    above = materialize(known.join(over, "tree").select("tree", "group", "n", "height", "path", "subroot"), "manifest-trees")
    out = _paths(levels, leaves, above.drop("group", "n"), arity).select("given.*", "subroot", "path")
    return Manifest(out, above.select("group", "n", "subroot"), root)


def _numbered(groups: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Groups with tree, their number from 0 in ascending order of a column without ties, and how many there are."""
    dealt = materialize(groups.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "manifest-groups")
    part = F.shiftright("at", _PLACE_BITS).cast("int")
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("of_part"))
    before = sizes.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("before"))  # one row a partition
    numbered = dealt.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.select("group", "start", "n", (F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("before")).alias("tree")), dealt.count()


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf(*others, F.col("text")).alias("leaf"), F.when(touched, F.unhex(leaf(*others, small))).alias("tampered"))
    tree = manifest(rows)
    root = F.lit(tree.root).cast("string")
    out = tree.rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce(_text(F.col("tampered")), "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the decimal id: 8 steps for each byte, from 2^32 - 1 on.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"
)
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: Levels are joined up by grouping; the siblings of a document are those of its ancestors at each level.
ORACLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
          CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
        FROM documents)),
low AS (
  SELECT source, 0 AS lev, idx::BIGINT AS idx, n::BIGINT AS n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, lev + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY source, lev, idx // 16),
subs AS (SELECT source, lev AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lev, idx::BIGINT AS idx, n::BIGINT AS n, subroot AS digest FROM subs
  UNION ALL
  SELECT lev + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lev, idx // 16),
beside AS (
  SELECT l.source, l.doc_id, l.idx AS row_idx, x.lev, x.idx < l.idx // (16 ** x.lev)::BIGINT AS is_left, x.idx, x.digest
  FROM leaves l JOIN low x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.idx // 16 = l.idx // (16 ** (x.lev + 1))::BIGINT AND x.idx <> l.idx // (16 ** x.lev)::BIGINT
  UNION ALL
  SELECT l.source, l.doc_id, l.idx, 100 + x.lev, x.idx < s.idx // (16 ** x.lev)::BIGINT, x.idx, x.digest
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
  JOIN high x ON x.n > 1 AND x.idx // 16 = s.idx // (16 ** (x.lev + 1))::BIGINT AND x.idx <> s.idx // (16 ** x.lev)::BIGINT),
steps AS (
  SELECT source, row_idx, lev, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (is_left), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT is_left), '') AS after
  FROM beside GROUP BY source, row_idx, lev),
levels AS (
  SELECT source, lev, false AS up FROM low WHERE n > 1 GROUP BY source, lev
  UNION ALL SELECT s.source, 100 + h.lev, true FROM subs s, (SELECT DISTINCT lev FROM high WHERE n > 1) h),
walk AS (
  SELECT l.source, l.idx AS row_idx, list({{'before': coalesce(t.before, ''), 'after': coalesce(t.after, '')}} ORDER BY v.lev) FILTER (v.lev IS NOT NULL) AS path
  FROM leaves l LEFT JOIN levels v ON v.source IS NOT DISTINCT FROM l.source
  LEFT JOIN steps t ON t.source IS NOT DISTINCT FROM l.source AND t.row_idx = l.idx AND t.lev = v.lev GROUP BY l.source, l.idx),
folded AS (
  SELECT l.source, l.idx AS row_idx, 0 AS k, coalesce(tampered, leaf) AS h, coalesce(path, []) AS path FROM leaves l JOIN walk w ON w.source IS NOT DISTINCT FROM l.source AND w.row_idx = l.idx
  UNION ALL
  SELECT source, row_idx, k + 1, sha256(path[k + 1].before || h || path[k + 1].after), path FROM folded WHERE k < len(path))
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(coalesce(array_to_string(list_transform(f.path, lambda p: p.before || p.after), ''), '')) AS proof_sha256,
       f.h AS folded_root, f.h = r.digest AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
JOIN (SELECT * FROM folded WHERE k = len(path)) f ON f.source IS NOT DISTINCT FROM l.source AND f.row_idx = l.idx, (SELECT digest FROM high WHERE n = 1) r
"""

QUERIES = {"op11_manifest": op11_manifest}
ORACLES = {"op11_manifest": ORACLE}
