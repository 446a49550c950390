"""Round trips of readers, sinks, manifests and encoder plug-ins."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe import encoders as E
from trustframe.operators.deltas import attach_family, assert_vectors, match_check, taxonomy_frame
from trustframe.sources import files as S
from trustframe.sources import tables as T


def test_lidar_bin_round_trip(spark):
    d = tempfile.mkdtemp()
    a, b = np.arange(20, dtype=float).reshape(4, 5), np.arange(12, dtype=float).reshape(3, 4)
    S.write_bin(os.path.join(d, "s1__LIDAR_TOP__0012.bin"), a)
    S.write_bin(os.path.join(d, "s1__LIDAR_TOP__0003.bin"), b)
    rows = S.read_lidar_bin(spark, d).orderBy("sort_key", "point_idx").collect()
    assert [r["stream"] for r in rows] == ["s1"] * 7
    assert rows[0]["sort_key"] == "3".zfill(20) and [rows[1]["x"], rows[1]["feats"]] == [4.0, [7.0, 0.0]]
    assert S.infer_feature_dim(18, 5) == 6
    with pytest.raises(ValueError):
        S.infer_feature_dim(7, 5)


def test_episode_archive_defaults(spark):
    d = tempfile.mkdtemp()
    np.savez(os.path.join(d, "e.npz"), points=np.ones((2, 3, 5), np.float32))
    got = S.read_episode_npz(spark, d)
    r = got.first()
    assert got.count() == 6 and (r["stream"], r["clean_prefix"], r["frame_name"]) == ("unknown", 50, None)


def test_labelled_image_layouts(spark):
    d = tempfile.mkdtemp()
    os.makedirs(f"{d}/xray/test")
    img, lab = np.zeros((4, 2, 2), np.uint8), np.arange(4)[:, None]
    np.savez(f"{d}/xray/test/clean.npz", images=img, labels=lab)
    np.savez(f"{d}/xray/test/blur_severity_2.npz", images=img + 9, labels=lab)
    got = S.read_split_images(spark, d)
    assert got.where("corruption = 'blur' and severity = 2").count() == 4 and got.where("corruption is null").count() == 4
    assert [tuple(r) for r in S.discover_catalog(spark, d).collect()] == [("xray", "blur")]
    e = tempfile.mkdtemp()
    os.makedirs(f"{e}/ds")
    np.savez(f"{e}/ds/noise.npz", test_images=np.zeros((8, 2, 2, 3), np.uint8), test_labels=np.tile(lab, (2, 1)))
    n = spark.createDataFrame([("ds", 4)], "dataset string, n_clean int")
    st = S.read_stacked_corruptions(spark, e, n, [2])
    assert sorted(r["sample_index"] for r in st.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        S.read_stacked_corruptions(spark, e, n, [3])


def test_sinks_and_manifests(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("a", 1.5)], "metric string, value double")
    assert T.write_metrics_csv(df, f"{d}/m") and not T.write_metrics_csv(df.limit(0), f"{d}/none")
    assert not os.path.exists(f"{d}/none") and spark.read.option("header", True).csv(f"{d}/m").first()["metric"] == "a"
    T.write_report_json(df.select(F.struct("metric", "value").alias("r")), f"{d}/r")
    assert json.loads(spark.read.text(f"{d}/r").first()[0]) == {"r": {"metric": "a", "value": 1.5}}
    T.save_model(df, f"{d}/model")
    assert T.load_model(spark, f"{d}/model").collect() == df.collect()
    doc = {"families": {"noise": {"members": ["n1", "n2"], "default_representatives": ["n2"]}}}
    with open(f"{d}/tax.json", "w") as f:
        json.dump(doc, f)
    got = {(r["member"], r["is_representative"]) for r in T.read_taxonomy_manifest(spark, f"{d}/tax.json").collect()}
    assert got == {("n1", False), ("n2", True)}


def test_guards(spark):
    tax = taxonomy_frame(spark, {"f": ["a"], "g": ["a"]})
    df = spark.createDataFrame([("a",), ("z",)], "corruption string")
    with pytest.raises(ValueError):
        attach_family(df, tax)
    with pytest.raises(Exception, match="no family mapping"):
        attach_family(df, taxonomy_frame(spark, {"f": ["a"]})).collect()
    v = spark.createDataFrame([([1.0],)], "z array<double>")
    with pytest.raises(Exception, match="width 2"):
        assert_vectors(v, "z", 2).collect()
    clean = spark.createDataFrame([("s", 0, 1), ("s", 1, 1)], "scope string, i int, lab int")
    bad = spark.createDataFrame([("s", 0, 1, "c"), ("s", 1, 2, "c")], "scope string, i int, lab int, corr string")
    assert match_check(bad, clean, "scope", "i", "lab", ["corr"]).first()["mismatch_count"] == 1
    with pytest.raises(Exception, match="label mismatch"):
        match_check(bad, clean, "scope", "i", "lab", ["corr"], strict=True).collect()
    with pytest.raises(Exception, match="too few"):
        match_check(bad.where("i = 0"), clean, "scope", "i", "lab", ["corr"]).collect()


def test_encoder_plugin(spark):
    enc = E.register(E.channel_mean_encoder("mock", channels=3, width=8))
    frames = spark.createDataFrame([(i, [float(i + j) for j in range(12)]) for i in range(3)], "id long, pixels array<double>")
    z = E.encode_all(frames, ["mock"], ["pixels"], ["id"]).collect()
    assert len(z) == 3 and all(abs(np.linalg.norm(r["z"]) - 1) < 1e-9 for r in z)
    assert E.encode_tokens(frames, enc, "id", ["pixels"]).count() == 3
    broken = E.Encoder("broken", lambda pdf: [np.zeros((2, 2))] * (len(pdf) + 1))
    with pytest.raises(Exception, match="one .tokens, width. array per frame"):
        E.encode_frames(frames, broken, ["pixels"], ["id"]).collect()
    with pytest.raises(ValueError):
        E.get("absent")
