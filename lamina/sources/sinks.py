"""Writers of array tables through Spark's own sinks, and listings of files.

Text formats are written as ordered part files: concatenated in order of their names they are the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import to_csv_lines


def write_lines(lines: DataFrame, order: list[str], path: str, compression: str = "none", mode: str = "error") -> None:
    """Lines (value, and columns to order by) sorted over all part files; compression as in 'gzip'."""
    lines.orderBy(*order).select("value").write.mode(mode).text(path, compression=compression)


def write_matrix(matrix: DataFrame, path: str, compression: str = "none") -> None:
    """(row, vals) as comma-separated text in order of row."""
    write_lines(to_csv_lines(matrix), ["row"], path, compression)


def matr_lines(matrix: DataFrame, name: str = "matrix") -> DataFrame:
    """at, value: a .matr file of (row, vals): a header with the size, then a line for each row."""
    size = matrix.agg(F.count(F.lit(1)).cast("string").alias("r"), F.coalesce(F.max(F.size("vals")), F.lit(0)).cast("string").alias("c"))
    head = F.array(F.lit("#vtkpxMatrix File"), F.lit(f"# name: {name}"), F.lit("# type: matrix"), F.concat(F.lit("# rows: "), "r"), F.concat(F.lit("# columns: "), "c"))
    head = size.select(F.posexplode(head).alias("at", "value")).select((F.col("at") - 5).cast("long").alias("at"), "value")
    return head.unionByName(matrix.select(F.col("row").cast("long").alias("at"), F.array_join(F.transform("vals", lambda v: v.cast("string")), " ").alias("value")))


def write_matr(matrix: DataFrame, path: str, name: str = "matrix") -> None:
    write_lines(matr_lines(matrix, name), ["at"], path)


def binary_files(matrices: DataFrame, kind: str = "<f4") -> DataFrame:
    """name, content: a .binmatr file of each matrix of (name, row, vals); a matrix is one group, as its file is."""
    import numpy as np
    import pyarrow as pa

    from .files import binary_matrix_bytes

    def make(t: pa.Table) -> pa.Table:
        m = np.array(t.sort_by("row").column("vals").to_pylist(), kind)
        return pa.table({"name": t.column("name")[:1], "content": pa.array([binary_matrix_bytes(m)], pa.binary())})

    return matrices.select("name", "row", "vals").groupBy("name").applyInArrow(make, "name string, content binary")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files."""
    rows.write.mode("append").csv(path)


def write_frames(ser: DataFrame, path: str) -> None:
    """(t, voxel, v): a folder for each frame, which a reader of one frame reads alone."""
    ser.repartition("t").write.partitionBy("t").parquet(path)


def surface_lines(vertices: DataFrame, faces: DataFrame, kind: str = "ply") -> DataFrame:
    """part, at, value: an ASCII PLY or legacy VTK file of vertices(id, x, y, z) and faces(id, v0, v1, v2) as lines.

    Vertex ids count from 0. Headers hold the counts (an aggregate each) and are a few rows; all other lines are projections.
    """
    nv, nf = vertices.agg(F.count(F.lit(1)).alias("n")), faces.agg(F.count(F.lit(1)).alias("n"))
    count = F.col("n").cast("string")
    if kind == "ply":
        head = nv.select(F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), count, F.lit("\nproperty float x\nproperty float y\nproperty float z")).alias("value"))
        middle = nf.select(F.concat(F.lit("element face "), count, F.lit("\nproperty list uchar int vertex_indices\nend_header")).alias("value"))
    else:
        head = nv.select(F.concat(F.lit("# vtk DataFile Version 3.0\nvtk output\nASCII\nDATASET POLYDATA\nPOINTS "), count, F.lit(" float")).alias("value"))
        middle = nf.select(F.concat(F.lit("POLYGONS "), count, F.lit(" "), (F.col("n") * 4).cast("string")).alias("value"))
    at = lambda df, part: df.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), "value")
    body = lambda df, part, cols: df.select(F.lit(part).alias("part"), F.col("id").cast("long").alias("at"), F.concat_ws(" ", *cols).alias("value"))
    points = body(vertices, 2, [F.round(c, 4).cast("string") for c in "xyz"])
    sides = body(faces, 3, [F.lit("3"), *[F.col(c).cast("string") for c in ("v0", "v1", "v2")]])
    return at(head, 0).unionByName(at(middle, 1 if kind == "ply" else 2).withColumn("at", F.lit(1 if kind == "ply" else 2**62).cast("long"))).unionByName(points).unionByName(sides)


def write_surface(vertices: DataFrame, faces: DataFrame, path: str, kind: str = "ply") -> None:
    write_lines(surface_lines(vertices, faces, kind), ["part", "at"], path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of the files under a folder whose names match; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def read_demographics(spark: SparkSession, path: str, mark: str = "---") -> DataFrame:
    """file, n, fields: lines of demographics files cut at a mark, blanks around fields left out; empty lines are left out."""
    from .files import lines

    x = lines(spark, path).where("trim(line) <> ''")
    return x.select("file", "n", F.transform(F.split("line", F.lit(r"\Q" + mark + r"\E")), lambda p: F.trim(p)).alias("fields"))


def provenance(command: str, output: str, parameters: dict | None = None, system: dict | None = None) -> str:
    """What made an output, as one comment in JSON."""
    import json

    return json.dumps({"output": output, "command": command, **({"parameters": parameters} if parameters else {}), **({"system": system} if system else {})}, sort_keys=True)


def with_comment(objects: DataFrame, comment: str) -> DataFrame:
    """JSON objects (name, value) with a comment added to the list that each of them has; all other fields stay as they are."""
    old = F.from_json(F.get_json_object("value", "$.comments"), "array<string>")
    comments = F.to_json(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.array(F.lit(comment))))
    fields = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k != "comments")
    quoted = F.transform(F.map_entries(fields), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(F.to_json(F.try_parse_json(e["value"])), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))))
    return objects.select("name", F.concat(F.lit("{"), F.concat_ws(",", F.concat(quoted, F.array(F.concat(F.lit('"comments":'), comments)))), F.lit("}")).alias("value"))


def write_with_provenance(df: DataFrame, path: str, comment: str) -> None:
    """A table as Parquet, and beside it a row of text with what made it."""
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(comment,)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}.provenance")
