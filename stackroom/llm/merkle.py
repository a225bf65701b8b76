"""Merkle manifest of a table: trees of digests, and a recursive query that climbs them.

Rows become leaves; the leaves of each language stand in order, eight in a row become the
digest of their digests, level by level, until one is left; the languages' last digests do the
same among themselves.  Built levels are stored as rows that name their parent: *families*, the lowest
runs with their leaves, and *runs*, the nodes above with the digests of their children.  To check rows, a
recursive query starts from all leaves at once; each step meets a leaf's present run, takes the
siblings out of it, folds the digest that came up from below with them, and goes on to
the parent.  The rows of all steps are the proofs.  Leaves of a family meet the same siblings
above it, so they climb in one row, with a digest for each.

A run is named by its level and the place of its first leaf.  High runs are met by very many
families, so a run is stored once for each block of leaves below it: a step never brings more
than a block's families to one key, and the copies of all levels stay a small part of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackroom.llm.common import ready, written
from stackroom.operators.skew import lookup_join

RUN = 8
BLOCK_BITS = 12  # leaves of a block: those whose places differ in the lowest bits only
FIRST_BITS = 48  # of a node's name; its level stands above them
OVER = 32  # levels from here on stand over the languages
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the size in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    others = [field(F.col(name)) for name in FIELDS if name != "text"]
    return F.sha2(F.concat(*others, field(text)), 256)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in this order without bringing them together: ranges are sorted, then counted."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # place in the range below, range above; written, so that no row is numbered twice
    parts = written(parts.withColumn("_at", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # one row for each range
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"))
    # no more rows than ranges: small enough to send
    found = parts.withColumn("_part", part).withColumn("_inside", inside)
    return found.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop(
        "_at", "_part", "_inside", "_before"
    )


@dataclass
class Manifest:
    """Built levels as written tables, whose digests are binary.

    ``families``: family (place of its first leaf), tree, alone, members (place, doc_id, leaf and changed of
    each), run, pos; ``runs``: name, block, children, run, pos; ``subroots``: tree, subroot.  ``run`` and ``pos``
    name a node's parent and its place there; they are null at the root.  ``root`` is null for an
    empty table.
    """

    families: DataFrame
    runs: DataFrame
    subroots: DataFrame
    root: str | None


def _name(level: int, first: Column) -> Column:
    return F.lit(level << FIRST_BITS).bitwiseOR(first)


def joined(digests: Column | str) -> Column:
    """Digests as hex text, one behind the other."""
    return F.array_join(F.transform(digests, lambda x: F.lower(F.hex(x))), "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _levels(nodes: DataFrame, most: int, base: int, first: Callable[[int], Column], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs above ``nodes`` (tree, ordinal, size, index, digest, low, high), written, and the last digests.

    ``most`` is the largest tree's number of nodes, ``size`` each tree's own on that level; a tree ends where it is 1.
    ``first`` tells a run of one level from the others.  Each level has an eighth of the rows of the one below.
    """
    columns = ["tree", "ordinal", "digest", "low", "high"]
    built, top, level = [], nodes.where("size = 1").select(*columns), 0
    while most > 1:
        level, most = level + 1, -(-most // RUN)
        child = F.sort_array(F.collect_list(F.struct("index", "digest", "low", "high")))
        size = F.ceil(F.col("size") / RUN).cast("bigint")
        runs = nodes.where("size > 1").groupBy("tree", "ordinal", "size", F.shiftright("index", 3).alias("index"))
        runs = runs.agg(child.alias("child")).select(
            "tree",
            "ordinal",
            size.alias("size"),
            "index",
            joined("child.digest").alias("children"),
            F.col("child")[0]["low"].alias("low"),
            F.element_at("child", -1)["high"].alias("high"),
        )
        runs = runs.withColumns({"name": _name(base + level, first(level)), "digest": _digest(F.col("children"))})
        nodes = written(runs, f"{name}-{level}")
        built.append(nodes)
        top = top.unionByName(nodes.where("size = 1").select(*columns))
    return built, top


def _linked(nodes: DataFrame, parent: Column, index: Column, has: Column) -> DataFrame:
    links = {"run": F.when(has, parent), "pos": F.when(has, index.bitwiseAND(RUN - 1).cast("int"))}
    return nodes.withColumns(links)


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Leaves and levels of the whole table; ``changed`` is the text that a later check will find (as stored, if not given).

    Leaves ascend by lang (null first) and doc_id (null first), then by their digest.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").isNotNull().alias("has_lang"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.unhex(leaf_digest(text)).alias("leaf"),
        F.unhex(leaf_digest(text if changed is None else changed)).alias("changed"),
        F.monotonically_increasing_id().alias("_row"),  # spreads equal rows over ranges
    )
    # texts are read once: what is sorted from here on has digests only
    rows = written(rows, "digests")
    order = [F.col("has_lang"), F.col("lang"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("_row")]
    leaves = placed(rows, order, "place").drop("_row")

    trees = leaves.groupBy("has_lang", "lang").agg(F.min("place").alias("tree"), F.count("*").alias("size"))
    trees = written(placed(trees, [F.col("tree")], "ordinal"), "trees")
    many, most = trees.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    leaves = lookup_join(leaves, trees, ["has_lang", "lang"], "inner").withColumn("index", F.col("place") - F.col("tree"))

    family = leaves.groupBy("tree", "ordinal", "size", F.shiftright("index", 3).alias("index"))
    families = family.agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "changed"))).alias("members"))
    low, high = F.col("members")[0]["place"], F.element_at("members", -1)["place"]
    # a language's only leaf is no run: it stands for itself
    alone = F.col("size") == 1
    families = families.select(
        "tree",
        "ordinal",
        F.ceil(F.col("size") / RUN).cast("bigint").alias("size"),
        "index",
        alone.alias("alone"),
        "members",
        F.when(alone, F.col("members")[0]["leaf"]).otherwise(_digest(joined("members.leaf"))).alias("digest"),
        low.alias("low"),
        high.alias("high"),
    )
    families = written(families, "families")

    within, subroots = _levels(families, -(-most // RUN), 1, lambda level: F.col("tree") + F.shiftleft("index", 3 * (level + 1)), "lang-level")
    subroots = written(subroots, "subroots")
    zero = F.lit(0).cast("bigint")
    size = F.lit(many).cast("bigint")
    nodes = subroots.select(zero.alias("tree"), F.col("ordinal").alias("index"), "digest", "low", "high", size.alias("size"))
    over, top = _levels(nodes.withColumn("ordinal", zero), many, OVER, lambda level: F.col("index"), "top-level")

    def link_within(nodes: DataFrame, height: int) -> DataFrame:
        """A tree's last node goes on to the run of languages, if there are others."""
        inner, last = F.col("size") > 1, F.lit(many > 1)
        up = _name(height + 1, F.col("tree") + F.shiftleft(F.shiftright("index", 3), 3 * (height + 1)))
        parent = F.when(inner, up).otherwise(_name(OVER + 1, F.shiftright("ordinal", 3)))
        return _linked(nodes, parent, F.when(inner, F.col("index")).otherwise(F.col("ordinal")), inner | last)

    linked = [link_within(nodes, level + 2) for level, nodes in enumerate(within)]
    for level, nodes in enumerate(over):
        up = _name(OVER + level + 2, F.shiftright("index", 3))
        linked.append(_linked(nodes, up, F.col("index"), F.col("size") > 1))
    block = F.explode(F.sequence(F.shiftright("low", BLOCK_BITS), F.shiftright("high", BLOCK_BITS)))
    runs = docs.sparkSession.createDataFrame([], RUNS)
    for nodes in linked:
        runs = runs.unionByName(nodes.select("name", block.alias("block"), "children", "run", "pos"))
    families = link_within(families, 1).select(F.col("low").alias("family"), "tree", "alone", "members", "run", "pos")
    found = top.select(F.lower(F.hex("digest"))).head(1)
    subroots = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(families, written(runs, "runs"), subroots, found[0][0] if found else None)


RUNS = "name bigint, block bigint, children string, run bigint, pos int"

CLIMB = f"""
WITH RECURSIVE climb (family, level, run, pos, siblings, folded) AS (
  SELECT family, 0, run, pos, CAST(NULL AS BINARY), folded FROM {{families}}
  UNION ALL
  SELECT family, level + 1, next_run, next_pos, unhex(concat(before, after)),
         transform(folded, x -> unhex(sha2(concat(before, lower(hex(x)), after), 256)))
  FROM (
    SELECT c.family, c.level, c.folded, r.run AS next_run, r.pos AS next_pos,
           substring(r.children, 1, 64 * c.pos) AS before, substring(r.children, 64 * c.pos + 65) AS after
    FROM climb c JOIN {{runs}} r ON c.run = r.name AND shiftright(c.family, {BLOCK_BITS}) = r.block
  )
)
SELECT family, level, siblings, CASE WHEN run IS NULL THEN folded END AS folded FROM climb
"""


def _others(digests: Column, i: Column) -> tuple[Column, Column]:
    """Hex text of the digests before and behind place ``i``."""
    return joined(F.slice(digests, 1, i)), joined(F.slice(digests, i + 2, RUN))


def climb(manifest: Manifest, digest: str = "leaf") -> DataFrame:
    """From every leaf to the root: family, level, the siblings met on that level, and the members' digests at the root.

    ``digest`` names the member whose digest is folded in.  The first step, out of the family, is
    taken on the way in: there each leaf has siblings of its own.
    """
    spark = manifest.families.sparkSession
    # the number of rows is that of families times levels, whatever the table's size
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    def fold(member: Column, i: Column) -> Column:
        before, after = _others(F.col("members.leaf"), i)
        return _digest(F.concat(before, F.lower(F.hex(member[digest])), after))

    folded = F.when(F.col("alone"), F.col(f"members.{digest}")).otherwise(F.transform("members", fold))
    start = manifest.families.select("family", "run", "pos", folded.alias("folded"))
    return spark.sql(CLIMB, families=start, runs=manifest.runs)


def proofs(manifest: Manifest, digest: str = "leaf") -> DataFrame:
    """One row a leaf: doc_id, leaf, tree, proof (all siblings as hex text, from the leaf up) and folded_root."""
    step = F.when(F.col("siblings").isNotNull(), F.struct("level", "siblings"))
    steps = climb(manifest, digest).groupBy("family")
    steps = steps.agg(F.sort_array(F.collect_list(step)).alias("steps"), F.max("folded").alias("folded"))
    members = F.posexplode("members").alias("i", "member")
    leaves = manifest.families.join(steps, "family").select("*", members)
    before, after = _others(F.col("members.leaf"), F.col("i"))
    own = F.when(F.col("alone"), F.lit("")).otherwise(F.concat(before, after))
    return leaves.select(
        "member.doc_id",
        F.lower(F.hex("member.leaf")).alias("leaf"),
        "tree",
        F.concat(own, joined("steps.siblings")).alias("proof"),
        F.lower(F.hex(F.col("folded")[F.col("i")])).alias("folded_root"),
    )


def tampered() -> Column:
    """The text with A-Z in lower case, where 3 divides the crc32 of doc_id; else as it is.  A null doc_id leaves it."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 3 == 0
    return F.when(chosen, F.translate(text, CAPITALS, SMALL)).otherwise(text)


def audit(docs: DataFrame) -> DataFrame:
    """Build the manifest, tamper with some rows, and climb from every leaf to the root.

    Needs doc_id, source, lang, n_chars and text; other columns are ignored.  One row for each
    input row, repeated or not: equal rows are leaves of their own, in a row; rows of equal
    lang and doc_id stand in the order of their digests.  Nulls count as ``-``; a null lang is
    a language of its own, before the others; a null doc_id comes first in its language and is
    not tampered with.  An empty table gives no rows; of one row, leaf, subroot and root are
    the same and the proof is empty.
    """
    ready(docs.sparkSession)
    manifest = build(docs, tampered())
    told = lookup_join(
        proofs(manifest, "changed").withColumn("proof_sha256", F.sha2("proof", 256)).drop("proof"), manifest.subroots, ["tree"], "inner"
    )
    root = F.lit(manifest.root).cast("string")
    verified = (F.col("folded_root") == root).alias("verified")
    return told.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", verified)
