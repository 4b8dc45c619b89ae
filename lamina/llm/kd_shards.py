"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

Every node of the tree is cut along its widest dimension at a weighted median (weights are bytes), found by rounds of
histograms: 65,536 bins of the dimension, then 65,536 bins of a hash of the text within the one bin that the median
falls in. Equal texts share their coordinates (a group's source and language are its smallest) and so stay in one shard,
unless their bytes exceed a small share of a shard: such a group is cut by a hash of the id in a third round. Histograms
are aggregates; the driver gets one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

BINS = 1 << 16
#: Metadata dimensions, each on the scale 0 <= x < 65,536: log of size between the table's least and largest, source and language.
DIMENSIONS = {
    "d_size": "cast(floor(65535 * (ln(size) - ln(least)) / greatest(ln(most) - ln(least), 1e-9)) as int)",
    "d_source": "cast(pmod(xxhash64(source), 65536) as int)",
    "d_lang": "cast(pmod(xxhash64(lang), 65536) as int)",
}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16; null text: 16), text_crc32 (null text: that of no bytes, 0), dimensions, a hash for ties."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    have = {c: (F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")}
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *have.values())
    d = keep(d.select("*", F.xxhash64("text_crc32", "size").alias("key")))
    group = d.groupBy("key").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 40))
    ends = d.agg(F.min("size").alias("least"), F.max("size").alias("most"))  # one row
    d = d.drop("source", "lang").join(group, "key").crossJoin(F.broadcast(ends))
    return d.select("doc_id", "size", "text_crc32", *[F.expr(e).alias(c) for c, e in DIMENSIONS.items()], F.pmod("key", F.lit(BINS)).cast("int").alias("y"), tie.alias("tie"))


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 200_000, whole: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard (0..shards-1), slot (gapless from 0 in each shard) of every row.

    Leaves get near-equal bytes: a node of n leaves is cut at n//2 of n of its bytes. Null or repeated ids, null texts and
    equal coordinates are ordinary rows; rows equal in id and text may stay together. Texts of equal size and checksum form
    a group, which is cut only if it exceeds `whole` of a shard's bytes. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = keep(measured(docs, id_col, text_col))
    n_rows = rows.count()
    cut = rows.withColumn("node", F.lit(0))
    leaves, first = {0: shards}, {0: 0}
    dims = list(DIMENSIONS)
    while n_rows and any(n > 1 for n in leaves.values()):
        wide = cut.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(c) - F.min(c)).alias(c) for c in dims]).collect()
        active = {r["node"]: (max(dims, key=lambda c, r=r: (r[c], -dims.index(c))), r["bytes"] * (leaves[r["node"]] // 2) / leaves[r["node"]]) for r in wide if leaves[r["node"]] > 1}
        if not active:
            break
        pick = spark.createDataFrame([(k, c, float(want)) for k, (c, want) in active.items()], "node int, dim string, want double")
        pick = F.broadcast(pick)  # one row per node, at most `shards`
        coord = F.coalesce(*[F.when(F.col("dim") == c, F.col(c)) for c in dims])
        at = cut.join(pick, "node", "left").withColumn("x", coord).withColumn("z", F.shiftright("tie", 24).cast("int"))

        def crossing(hist: DataFrame, by: str) -> DataFrame:
            w = Window.partitionBy("node").orderBy(by)
            run = hist.withColumn("upto", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            hit = run.where("upto >= want").groupBy("node").agg(F.min(F.struct(by, "upto", "bytes")).alias("m"))
            return hit.select("node", F.col(f"m.{by}").alias(by), (F.col("m.upto") - F.col("m.bytes")).alias("below"), F.col("m.bytes").alias("bytes"))

        act = at.where("dim is not null")
        hx = act.groupBy("node", "x", "want").agg(F.sum("size").alias("bytes"))
        cx = {r["node"]: (r["x"], r["below"]) for r in crossing(hx, "x").collect()}
        px = F.broadcast(spark.createDataFrame([(k, x, float(active[k][1] - b)) for k, (x, b) in cx.items()], "node int, cx int, rest double"))
        inner = act.join(px, "node").where("x = cx").groupBy("node", "y", F.col("rest").alias("want")).agg(F.sum("size").alias("bytes"))
        cells = {r["node"]: (r["y"], active[r["node"]][1] - cx[r["node"]][1] - r["below"], r["bytes"]) for r in crossing(inner, "y").collect()}
        most = whole * sum(r["bytes"] for r in wide) / shards
        # A small cell goes whole to the side that it is nearer to; 65,535 and -1 stand for all and none of it.
        cz = {k: (y, BINS - 1 if 2 * want >= b else -1) for k, (y, want, b) in cells.items()}
        if big := [(k, cx[k][0], y, float(want)) for k, (y, want, b) in cells.items() if b > most]:
            py = F.broadcast(spark.createDataFrame(big, "node int, cx int, cy int, rest double"))
            hz = act.join(py, "node").where("x = cx and y = cy").groupBy("node", "z", F.col("rest").alias("want")).agg(F.sum("size").alias("bytes"))
            cz |= {r["node"]: (cells[r["node"]][0], r["z"]) for r in crossing(hz, "z").collect()}
        new_leaves, new_first, steps = {}, {}, []
        for k, n in leaves.items():
            if k in cx and n > 1:
                lo = n // 2
                new_leaves |= {2 * k + 1: lo, 2 * k + 2: n - lo}
                new_first |= {2 * k + 1: first[k], 2 * k + 2: first[k] + lo}
                steps.append((k, cx[k][0], *cz[k]))
            else:
                new_leaves[k], new_first[k] = n, first[k]
        step = F.broadcast(spark.createDataFrame(steps, "node int, cx int, cy int, cz int"))
        low = F.expr("x < cx or (x = cx and (y < cy or (y = cy and z <= cz)))")
        moved = at.join(step, "node", "left").withColumn("to", F.when(F.col("cx").isNull(), F.col("node")).when(low, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2))
        cut = keep(moved.select("doc_id", "size", "text_crc32", *dims, "y", "tie", F.col("to").alias("node")))
        leaves, first = new_leaves, new_first
    shard = spark.createDataFrame([(k, first[k]) for k in leaves], "node int, shard int")
    out = cut.join(F.broadcast(shard), "node")
    # Slots: rank within (shard, hash bucket), after the rows of the shard's earlier buckets.
    parts = max(1, -(-n_rows // (shards * slot_rows)))
    out = out.withColumn("part", F.pmod(F.col("tie"), F.lit(parts)).cast("int"))
    count = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = count.select("shard", "part", start.alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")) - 1
    return out.withColumn("rank", rank).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
