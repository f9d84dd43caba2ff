"""Rigid poses against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import poses as P
from framewright.operators.geometry import Camera

POSE = "struct<r: array<double>, t: array<double>>"


def rotation(q):
    x, y, z, w = q / np.linalg.norm(q)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * k + 2 * k @ k


def test_rotations_and_motions(spark):
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(20, 2, 4)), rng.normal(size=(20, 2, 3))
    rows = [(i, q[i, 0].tolist(), q[i, 1].tolist(), t[i, 0].tolist(), t[i, 1].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, qa array<double>, qb array<double>, ta array<double>, tb array<double>")
    df = df.withColumn("a", P.pose(P.rotation(F.col("qa")), F.col("ta"))).withColumn("b", P.pose(P.rotation(F.col("qb")), F.col("tb")))
    out = df.select("i", "a", P.composed(P.inverse(F.col("a")), F.col("b")).alias("m"), P.flipped(F.col("a.r"), (1, 1, -1)).alias("f"), P.camera_points(F.array("tb"), F.col("ta"), F.col("a.r"))[0].alias("c"))
    for r in out.collect():
        ra, rb = rotation(q[r["i"], 0]), rotation(q[r["i"], 1])
        ta, tb = t[r["i"]]
        assert np.allclose(np.reshape(r["a"]["r"], (3, 3)), ra)
        assert np.allclose(np.reshape(r["m"]["r"], (3, 3)), ra.T @ rb) and np.allclose(r["m"]["t"], ra.T @ (tb - ta))
        d = np.diag([1, 1, -1])
        assert np.allclose(np.reshape(r["f"], (3, 3)), d @ ra @ d)
        assert np.allclose(r["c"], ((tb - ta) @ ra) * [1, -1, 1])


def test_blend_stays_a_rotation(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, w in enumerate([0.0, 0.3, 0.5, 1.0]):
        a, b = rotation(rng.normal(size=4)), rotation(rng.normal(size=4))
        rows.append((i, (a.ravel().tolist(), [0.0, 0.0, 0.0]), (b.ravel().tolist(), [2.0, 4.0, 6.0]), w))
    df = spark.createDataFrame(rows, f"i long, p {POSE}, n {POSE}, share double")
    for r in P.blend_poses(df, "p", "n", "share").collect():
        m = np.reshape(r["blended"]["r"], (3, 3))
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
        assert np.allclose(r["blended"]["t"], np.array([2, 4, 6]) * r["share"])
        if r["share"] in (0.0, 1.0):
            assert np.allclose(r["blended"]["r"], (r["p"] if r["share"] == 0 else r["n"])["r"])


def test_arm_axis_falls_back(spark):
    camera = Camera(100.0, 100.0, 50.0, 40.0, 100.0, 80.0)
    hand = [[0.0, 0.0, 1.0] if i in (5, 9) else [9.0, 9.0, 1.0] for i in range(21)]
    rows = [(0, hand, [0.1, 0.0, 1.0], [0.3, 0.0, 1.0]), (1, hand, [5.0, 0.0, 1.0], [7.0, 0.0, 1.0]), (2, [[9.0, 9.0, 1.0]] * 21, [5.0, 0.0, 1.0], [7.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "f long, points array<array<double>>, w array<double>, e array<double>")
    got = {r["f"]: r["axis"] for r in P.arm_axis(df, "points", F.col("w"), F.col("e"), camera).collect()}
    assert np.isclose(got[0]["base"]["u"], 60) and np.isclose(got[0]["end"]["u"], 99) and np.isclose(got[1]["base"]["u"], 50) and got[2] is None
    prompt = P.arm_prompt(P.arm_axis(df.limit(1), "points", F.col("w"), F.col("e"), camera), "axis", camera).first()["prompt"]
    assert len(prompt["positives"]) == 5 and prompt["u1"] == 99 and prompt["u0"] == 0
