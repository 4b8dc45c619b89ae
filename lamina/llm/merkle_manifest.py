"""Merkle manifest of a dataset: trees of arity 3 over ordered rows of each group, and one over the groups' roots.

Leaves are numbered by range partitions and offsets, never by one window over a group. Runs of 3 ** LEVELS consecutive
nodes become one row with an ordered array, whose levels are collapsed by sequence, transform, slice and aggregate; the
blocks' roots are the nodes of the next round. Proofs come down the same tables: a block's siblings are read off its
array and put before those of the block's own root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

ARITY, LEVELS = 3, 5
WIDE = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, `:` and the value; whole numbers are decimal."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows and pos (from 0 in the row's grp, by order, nulls first) and n (rows of the grp).

    Rows are dealt by ranges of grp and order, so a hot group spans many tasks; each task numbers its own rows, and a
    group's running sum goes over one row for each task that has some of it.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    at = keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = at.groupBy("grp", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("many"))
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("many").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("grp").alias("r_grp"), F.col("part").alias("r_part"), (before - F.col("low")).alias("shift"), F.sum("many").over(w).alias("n"))
    same = at["grp"].eqNullSafe(runs["r_grp"]) & (part == F.col("r_part"))
    return at.join(runs, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def height(n: Column) -> Column:
    """Levels above n nodes within a block: at most LEVELS."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(1, LEVELS)), F.when(n > 1, 1).otherwise(0))


def collapse(nodes: Column, times: Column) -> Column:
    """The levels of a block, its nodes first: each further one has the digests of runs of ARITY; the last run may be shorter."""

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, F.lit(ARITY)), ""), 256))

    rounds = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), times)
    return F.aggregate(rounds, F.array(nodes), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, F.lit(-1))))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks (grp, block, n, nodes, root), one for each round, from nodes (grp, pos, n, node, row). In the last, a group is one block."""
    rounds = []
    while True:
        blocks = nodes.groupBy("grp", F.expr(f"pos div {WIDE}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "row"))).alias("nodes"))
        last = F.element_at(collapse(F.col("nodes.node"), height(F.col("n"))), F.lit(-1))
        rounds.append(keep(blocks.withColumn("root", F.element_at(last, F.lit(1)))))
        most = rounds[-1].agg(F.max("n")).first()[0]
        if not most or most <= WIDE:
            return rounds
        nodes = rounds[-1].select("grp", F.col("block").alias("pos"), F.expr(f"(n + {WIDE - 1}) div {WIDE}").alias("n"), F.col("root").alias("node"), F.lit(0).alias("row"))


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """node, row and path of each node of the first round, with what else `above` has for its group.

    above: grp, path and more, one row a group. path: left and right siblings (digests joined) from the node upwards.
    """
    above = above.withColumn("pos", F.lit(0).cast("long"))
    powers = F.array(*[F.lit(ARITY**k) for k in range(LEVELS)])
    for blocks in reversed(rounds):

        def step(levels: Column, p: Column, k: Column) -> Column:
            at = F.floor(p / F.element_at(powers, k + 1)).cast("int")
            inside, nodes = at % ARITY, F.element_at(levels, k + 1)
            left, right = F.slice(nodes, at - inside + 1, inside), F.slice(nodes, at + 2, ARITY - 1 - inside)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        over = above.select(*[F.col(c).alias(f"o_{c}") for c in above.columns])
        at = blocks.drop("root").join(over, blocks["grp"].eqNullSafe(over["o_grp"]) & (blocks["block"] == over["o_pos"]))
        at = at.withColumn("times", height(F.col("n"))).withColumn("levels", collapse(F.col("nodes.node"), F.col("times")))
        which = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), F.col("times"))
        own = F.transform("nodes", lambda x, p: F.struct(x["pos"].alias("pos"), x["node"].alias("node"), x["row"].alias("row"), F.transform(which, lambda k: step(F.col("levels"), p, k)).alias("path")))
        more = [F.col(f"o_{c}").alias(c) for c in above.columns if c not in ("grp", "pos", "path", "node", "row")]
        at = at.select("grp", "o_path", *more, F.explode(own).alias("x"))
        above = at.select("grp", "x.pos", "x.node", "x.row", F.concat("x.path", "o_path").alias("path"), *[c for c in above.columns if c not in ("grp", "pos", "path", "node", "row")])
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof (the siblings, joined), proof_sha256, folded_root, verified of every row.

    A leaf is the digest of the row's columns (see field). Leaves of a group ascend by id (nulls first; rows that share
    an id by their digest). While a group has several nodes, every 3 consecutive ones become one; the groups' roots,
    null first and bytewise, make the root likewise. folded_root is computed from the row with its columns replaced as
    `changed` says and from the original siblings. Null, empty and very long values are ordinary; repeated rows are leaves
    of their own; other columns are not read, whatever their names; an empty table gives an empty table.
    """
    changed = changed or {}
    seen = leaf([changed.get(c, docs[c]) for c in columns]) if changed else F.lit(None).cast("string")
    rows = docs.select(docs[group_col].alias("grp"), docs[id_col].alias("id"), leaf([docs[c] for c in columns]).alias("node"), seen.alias("seen"))
    rows = rows.withColumn("seen", F.when(F.col("seen") != F.col("node"), F.col("seen")))  # null: unchanged
    leaves = numbered(keep(rows), ["id", "node"]).withColumn("row", F.struct("id", "seen"))
    rounds = climb(leaves)
    groups = rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"))
    top = climb(numbered(groups, ["name"]).withColumn("row", F.struct("name")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    subroots = descend(top, top[-1].select("grp", none.alias("path"), "root"))
    out = descend(rounds, subroots.select(F.col("row.name").alias("grp"), "path", F.col("node").alias("subroot"), "root"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("row.seen", "node"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = out.select(F.col("row.id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof"), folded.alias("folded_root"))
    return out.select(id_col, "leaf", "subroot", "root", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
