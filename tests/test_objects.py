"""Typed objects, parameter lists, electrode grids and MATLAB files: round trips byte by byte and line by line."""

import base64
import gzip
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.sources import electrodes, files, images, matlab, objects, sinks


def write_values(df, folder, ending=".json"):
    folder.mkdir()
    for r in df.collect():
        (folder / (r.name + ending)).write_text(r.value)
    return str(folder)


def test_matrix_objects(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = {"a": rng.integers(-9, 9, (4, 3)).astype("f4"), "b": rng.random((2, 5)).astype("f4")}
    df = spark.createDataFrame([(n, i, r.astype(float).tolist()) for n, x in m.items() for i, r in enumerate(x)], "name string, row long, vals array<double>")
    for kind in ("float", "double"):
        path = write_values(objects.matrix_objects(df, kind), tmp_path / kind)
        found = objects.read_objects(spark, path)
        assert {r.kind for r in found.collect()} == {objects.MATRIX}
        got = {}
        for r in objects.load(spark, path + "/*.json").collect():
            got.setdefault(r.file.rsplit("/", 1)[1][0], {})[r.row] = r.vals
        assert all([got[n][i] for i in range(len(x))] == x.astype(float).tolist() for n, x in m.items())
        raw = json.loads((tmp_path / kind / "a.json").read_text())
        assert zlib.decompress(base64.b64decode(raw["matrix"])) == m["a"].astype(objects.NUMBERS[kind]).tobytes()


def test_image_and_grid_objects(spark, tmp_path):
    v = np.arange(4 * 3 * 2 * 2).reshape(4, 3, 2, 2).astype("f4")
    rows = [("x.nii", *map(int, p), float(v[p])) for p in np.ndindex(v.shape)]
    img = spark.createDataFrame(rows, "name string, i int, j int, k int, t int, v double")
    path = write_values(objects.image_objects(images.nifti_files(img)), tmp_path / "i")
    got = {(r.t, r.voxel): r.v for r in objects.load(spark, path).collect()}
    assert got == {(t, i + 4 * (j + 3 * k)): float(v[i, j, k, t]) for i, j, k, t in np.ndindex(v.shape)}
    nodes = spark.createDataFrame([("g", *map(int, p), *(float(sum(p) * s) for s in (1, -0.5, 2))) for p in np.ndindex(3, 2, 2)], "name string, gi int, gj int, gk int, dx double, dy double, dz double")
    path = write_values(objects.grid_objects(nodes, [3, 2, 2], [1.0, 2.0, 3.0], [0.5, 0.0, -1.0]), tmp_path / "g")
    back = objects.load(spark, path)
    assert back.select("gi", "gj", "gk", "dx", "dy", "dz").exceptAll(nodes.drop("name")).count() == 0 and back.count() == 12
    assert back.first().dims == [3, 2, 2] and back.first().origin == [0.5, 0.0, -1.0]


def test_linear_and_unknown_objects(spark, tmp_path):
    m = [[1.0, 0, 0, 2.5], [0, 1, 0, 0], [0, 0, 1, -1], [0, 0, 0, 1]]
    (tmp_path / "x.json").write_text(json.dumps({objects.KIND: objects.LINEAR, "filename": "x", "comments": ["made by hand"], "matrix": m, "parameters": [2.5, 0, -1]}))
    r = objects.load(spark, str(tmp_path / "x.json")).first()
    assert r.m == [float(c) for row in m for c in row] and r.parameters == [2.5, 0, -1]
    assert objects.read_objects(spark, str(tmp_path / "x.json")).first().comments == ["made by hand"]
    (tmp_path / "y.json").write_text('{"other": 1}')
    assert objects.load(spark, str(tmp_path / "y.json")).first().kind is None


def test_parameter_lists(spark):
    text = '{"a": "7 mm", "b": [1, "2.5", 3], "c": true, "d": "false", "e": -1.5e2, "f": "none", "g": []}'
    p = objects.parameters(F.col("t"))
    df = spark.createDataFrame([(text,)], "t string").select(p.alias("p")).select(
        F.size("p").alias("n"), objects.int_value(F.col("p"), "a", 0).alias("a"), objects.float_value(F.col("p"), "b", 0, 1).alias("b1"), objects.int_value(F.col("p"), "b", -7, 5).alias("b5"), objects.bool_value(F.col("p"), "c", False).alias("c"), objects.bool_value(F.col("p"), "d", True).alias("d"),
        objects.float_value(F.col("p"), "e", 0).alias("e"), objects.int_value(F.col("p"), "f", 9).alias("f"), objects.text_value(F.col("p"), "z", "there is none").alias("z"), objects.bool_value(F.col("p"), "z", True).alias("zb"), objects.text_value(F.col("p"), "g", "x").alias("g"))
    assert tuple(df.first()) == (7, 7, 2.5, -7, True, False, -150.0, 0, "there is none", True, "x")


def sample(grids):
    """An electrode file written by hand from the format's description."""
    out = [electrodes.FIRST, "#Description", "someone", "#Comment", "no comment", "#Number of Grids", f" {len(grids)}"]
    n = 0
    for g, (a, b) in enumerate(grids):
        out += ["#" + electrodes.RULER, f"# Electrode Grid {g}", electrodes.RULER, electrodes.GRID, "#Description", f"GRID_{g}", "#Dimensions", f" {a} {b}", "#Electrode Spacing", " 10.0000 10.0000", "#Electrode Type", "0", "#Radius", "2.000000", "#Thickeness", "0.050000", "#Color", "1.000 0.500 0.000"]
        for j in range(b):
            for i in range(a):
                out += ["#" + electrodes.RULER, f"# Electrode {i} {j}", electrodes.RULER, electrodes.ELECTRODE, "#Position", f" {24.5 + n:.4f} {86.25 - i:.4f} {j:.4f}", "#Normal", " 1.0000 0.0000 0.0000"]
                for k, name in enumerate(electrodes.PROPERTIES):
                    out += [f"#{name}", {10: "0", 11: "2.000000", 12: "0.050000"}.get(k, str(k % 2))]
                out += ["#Values", "2", f"{0.5 * n:.6f}", "0.000000"] if n % 2 else ["#Values", "1", "0.000000"]
                n += 1
    return out


def test_electrodes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = {"one.mgrid": sample([(1, 3), (2, 2)]), "two.mgrid": sample([(1, 1)])}
    for name, rows in text.items():
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")
    (tmp_path / "in" / "bad.mgrid").write_text("something else\n")
    e = objects.load(spark, str(tmp_path / "in" / "*.mgrid"))
    assert e.count() == 8 and {r.patient for r in e.collect()} == {"someone"}
    r = e.where("file like '%one.mgrid' and grid = 1 and electrode = 3").first()
    assert r.position == [30.5, 85.25, 1.0] and r.dims == [2, 2] and r["values"] == [0.0] and r.props["Spikes Present"] == "0" and r.sections["Color"] == "1.000 0.500 0.000"
    out = {}
    for r in electrodes.electrode_lines(e).orderBy("file", "part", "at").collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append(r.value)
    assert out == text
    moved = electrodes.move_electrodes(e, [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 2, 0]], flip_x=256.0).where("file like '%two%'").first()
    assert moved.position == [256 - 24.5 + 1, 86.25, 0.0]


def element(kind, data, order="<"):
    head = np.array([kind, len(data)], f"{order}u4").tobytes()
    if 0 < len(data) <= 4 and kind != 14:
        first = np.array([(len(data) << 16) | kind], f"{order}u4").tobytes()
        return first + data + b"\0" * (4 - len(data))
    return head + data + b"\0" * (-len(data) % 8)


def mat_array(name, m, code, order="<", cls=6):
    body = element(6, np.array([cls, 0], f"{order}u4").tobytes(), order) + element(5, np.array(m.shape, f"{order}i4").tobytes(), order) + element(1, name.encode(), order)
    return element(14, body + element(code, m.astype(order + matlab.NUMBERS[code]).tobytes(order="F"), order), order)


def mat_file(parts, order="<"):
    return b"MATLAB 5.0 MAT-file".ljust(124) + (np.array([0x0100], f"{order}u2").tobytes()) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


@pytest.mark.parametrize("order", ["<", ">"])
def test_matlab(spark, tmp_path, order):
    a, b, c = np.arange(12.0).reshape(3, 4) / 8, np.array([[1, 2], [3, 4]]), np.array([[7]])
    inner = element(6, np.array([2, 0], f"{order}u4").tobytes(), order) + element(5, np.array([1, 1], f"{order}i4").tobytes(), order) + element(1, b"s", order) + element(5, np.array([8], f"{order}i4").tobytes(), order)
    fields = element(1, b"left".ljust(8, b"\0") + b"right".ljust(8, b"\0"), order)
    struct = element(14, inner + fields + mat_array("", b, 5, order) + mat_array("", c, 2, order), order)
    cell = element(14, element(6, np.array([1, 0], f"{order}u4").tobytes(), order) + element(5, np.array([1, 2], f"{order}i4").tobytes(), order) + element(1, b"long_name", order) + mat_array("", c, 3, order) + mat_array("", a, 7, order), order)
    text = mat_array("words", np.array([[72, 105]]), 4, order, cls=4)
    packed = zlib.compress(mat_array("p", a, 9, order))
    data = mat_file([mat_array("a", a, 9, order), text, struct, cell, np.array([15, len(packed)], f"{order}u4").tobytes() + packed, mat_array("b", b, 12, order)], order)
    (tmp_path / "x.mat").write_bytes(data)
    df = matlab.read_matlab(spark, str(tmp_path / "x.mat"), range_bytes=50)
    assert df.rdd.getNumPartitions() == 2 + 5  # a by two ranges of two columns; text, struct, cell, packed, b
    got = {}
    for r in objects.load(spark, str(tmp_path / "x.mat")).collect():
        got.setdefault(r.name, {})[r.row, r.col] = r.v
    want = {"a": a, "p": a, "b": b, "s.left": b, "s.right": c, "long_name{0}": c, "long_name{1}": a}
    assert got == {n: {p: float(m[p]) for p in np.ndindex(m.shape)} for n, m in want.items()}


def test_matr_and_binary_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0, [1.0, 2.5]), (1, [-3.0, 1e-7])], "row long, vals array<double>")
    sinks.write_matr(m, str(tmp_path / "m.matr"), "one")
    text = "".join(p.read_text() for p in sorted((tmp_path / "m.matr").glob("part-*")))
    assert text.splitlines() == ["#vtkpxMatrix File", "# name: one", "# type: matrix", "# rows: 2", "# columns: 2", "1.0 2.5", "-3.0 1.0E-7"]
    (tmp_path / "back.matr").write_text(text)
    assert {r.row: r.vals for r in objects.load(spark, str(tmp_path / "back.matr")).collect()} == {0: [1.0, 2.5], 1: [-3.0, 1e-7]}
    for kind in ("<f4", "<f8", "<i8"):
        content = sinks.binary_files(m.select(F.lit("x").alias("name"), "row", "vals"), kind).first().content
        assert content == files.binary_matrix_bytes(np.array([[1.0, 2.5], [-3.0, 1e-7]]).astype(kind))


def test_gzip_payload(spark, tmp_path):
    m = np.arange(6.0).reshape(2, 3).astype("<f4")
    (tmp_path / "g.json").write_text(json.dumps({objects.KIND: objects.MATRIX, "dimensions": [2, 3], "datatype": "float", "matrix": base64.b64encode(gzip.compress(m.tobytes())).decode()}))
    assert sorted(r.vals for r in objects.load(spark, str(tmp_path / "g.json")).collect()) == m.tolist()
