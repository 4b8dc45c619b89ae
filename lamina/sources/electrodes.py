"""Electrode grid files: a grammar of sections over numbered lines, as nested rows and back as the same lines.

A line that starts with # opens a section, other lines are its values. Running counts of the lines that open a grid and an
electrode tell which one a section belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import lines

#: Fixed values of the format: its first line, rulers, and the electrodes' sections in order.
FIRST, RULER = "#vtkpxElectrodeMultiGridSource File", "- - - - - - - - - - - - - - - - - - -"
GRID, ELECTRODE = "#vtkpxElectrodeGridSource File v2", "#vtkpxElectrodeSource2 File"
PROPERTIES = ("Motor Function", "Sensory Function", "Visual Function", "Language Function", "Auditory Function", "User1 Function", "User2 Function", "Seizure Onset", "Spikes Present", "Electrode Present", "Electrode Type", "Radius", "Thickeness")
GRID_SECTIONS = ("Description", "Dimensions", "Electrode Spacing", "Electrode Type", "Radius", "Thickeness", "Color")


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """file, patient, comment, grid (from 0), sections (map), dims, electrode (from 0; null: a grid without any), position, normal, props (map), values.

    One row an electrode. Files that do not start as the format does are left out; a section that is missing is null.
    """
    by = Window.partitionBy("file").orderBy("n")
    x = lines(spark, path).withColumn("line", F.rtrim("line"))
    x = x.withColumn("good", F.max(F.when((F.col("n") == 0) & (F.trim("line") == FIRST), 1)).over(Window.partitionBy("file"))).where("good = 1")
    opens = F.col("line").startswith("#")
    skip = F.col("line").startswith("# ") | F.col("line").startswith("#-") | F.col("line").startswith("- -") | F.col("line").contains(" File")
    x = x.withColumn("grid", F.sum((F.col("line") == GRID).cast("int")).over(by) - 1).withColumn("all", F.sum((F.col("line") == ELECTRODE).cast("int")).over(by))
    x = x.withColumn("before", F.min("all").over(Window.partitionBy("file", "grid"))).withColumn("electrode", F.col("all") - F.col("before") - 1)
    x = x.withColumn("key", F.last(F.when(opens, F.substring("line", 2, 200)), ignorenulls=True).over(by))
    values = x.where(~opens & ~skip).groupBy("file", "grid", "electrode", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda p: p["line"]).alias("text"))
    sections = values.groupBy("file", "grid", "electrode").agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("m"))
    top = sections.where("grid < 0").select("file", F.trim(F.col("m")["Description"][0]).alias("patient"), F.trim(F.col("m")["Comment"][0]).alias("comment"))
    one = lambda k: F.trim(F.col("m")[k][0])
    numbers = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda p: p.try_cast("double"))
    grids = sections.where("grid >= 0 and electrode < 0").select("file", "grid", F.create_map(*[v for k in GRID_SECTIONS for v in (F.lit(k), one(k))]).alias("sections"), F.transform(F.split(one("Dimensions"), r"\s+"), lambda p: p.try_cast("int")).alias("dims"))
    each = sections.where("electrode >= 0").select("file", "grid", "electrode", numbers(one("Position")).alias("position"), numbers(one("Normal")).alias("normal"), F.create_map(*[v for k in PROPERTIES for v in (F.lit(k), one(k))]).alias("props"),
        F.transform(F.slice(F.coalesce(F.col("m")["Values"], F.array(F.lit("0"))), F.lit(2), F.coalesce(one("Values").try_cast("int"), F.lit(0))), lambda p: F.trim(p).try_cast("double")).alias("values"))
    return top.join(grids, "file").join(each, ["file", "grid"], "left")


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{digits}f", c)


def electrode_lines(electrodes: DataFrame) -> DataFrame:
    """file, part, at, value: the lines of files of read_electrodes() rows, in order of part and at within a file."""
    ruler = F.lit(f"#{RULER}")
    three = lambda c, d: F.array_join(F.transform(c, lambda p: fixed(p, d)), " ")
    body = lambda keys, m: [y for k in keys for y in (F.lit(f"#{k}"), F.concat(F.lit(" " if k in ("Dimensions", "Electrode Spacing") else ""), F.col(m)[k]))]
    top = electrodes.groupBy("file").agg(F.first("patient").alias("patient"), F.first("comment").alias("comment"), (F.max("grid") + 1).alias("count"))
    top = top.select("file", F.lit(-1).alias("grid"), F.lit(-1).alias("electrode"), F.array(F.lit(FIRST), F.lit("#Description"), "patient", F.lit("#Comment"), "comment", F.lit("#Number of Grids"), F.concat(F.lit(" "), F.col("count").cast("string"))).alias("rows"))
    grids = electrodes.groupBy("file", "grid").agg(F.any_value("sections").alias("sections"))
    grids = grids.select("file", "grid", F.lit(-1).alias("electrode"), F.array(ruler, F.concat(F.lit("# Electrode Grid "), F.col("grid").cast("string")), F.lit(RULER), F.lit(GRID), *body(GRID_SECTIONS, "sections")).alias("rows"))
    e = F.col("electrode")
    place = F.concat(F.lit("# Electrode "), (e % F.col("dims")[0]).cast("int").cast("string"), F.lit(" "), F.floor(e / F.col("dims")[0]).cast("string"))
    values = F.concat(F.array(F.lit("#Values"), F.size("values").cast("string")), F.transform("values", lambda v: fixed(v, 6)))
    each = electrodes.where("electrode is not null").select("file", "grid", "electrode", F.concat(
        F.array(ruler, place, F.lit(RULER), F.lit(ELECTRODE), F.lit("#Position"), F.concat(F.lit(" "), three("position", 4)), F.lit("#Normal"), F.concat(F.lit(" "), three("normal", 4)), *body(PROPERTIES, "props")), values).alias("rows"))
    out = top.unionByName(grids).unionByName(each)
    return out.select("file", F.struct("grid", "electrode").alias("part"), F.posexplode("rows").alias("at", "value"))


def move_electrodes(electrodes: DataFrame, m: list[list[float]], flip_x: float | None = None, flip_y: float | None = None) -> DataFrame:
    """Positions counted from the other side of a width (x) or height (y) if one is given, then moved by a 3 x 4 transformation."""
    p = [F.col("position")[k] for k in range(3)]
    p[0] = p[0] if flip_x is None else F.lit(float(flip_x)) - p[0]
    p[1] = p[1] if flip_y is None else F.lit(float(flip_y)) - p[1]
    moved = F.array(*[sum((F.lit(float(r[c])) * p[c] for c in range(3)), F.lit(float(r[3]))) for r in m[:3]])
    return electrodes.withColumn("position", F.when(F.col("position").isNotNull(), moved))
