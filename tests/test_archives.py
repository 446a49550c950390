"""Archives: pushed-down selection, streamed members, text arrays without unpickling."""

import os
import pickle
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.sources import archives as A
from trustframe.sources import files as S


@pytest.fixture
def split_root(tmp_path):
    for m in ("ct", "xray"):
        for name in ("clean", "blur_severity_1", "blur_severity_2", "noise_severity_2"):
            os.makedirs(tmp_path / m / "test", exist_ok=True)
            img = np.arange(600 * 4, dtype=np.uint8).reshape(600, 2, 2) // (2 if m == "ct" else 1)
            (np.savez_compressed if m == "ct" else np.savez)(tmp_path / m / "test" / f"{name}.npz", images=img, labels=np.arange(600)[:, None])
    return tmp_path


def spoil(path):
    path.write_bytes(b"not an archive")


def test_only_selected_archives_are_opened(spark, split_root):
    """Every archive that is left out is unreadable, so opening it would fail."""
    all_ = S.read_split_images(spark, str(split_root))
    assert all_.count() == 8 * 600 and all_.where("corruption is null").count() == 2 * 600
    for m, name in [(m, n) for m in ("ct", "xray") for n in ("clean", "blur_severity_1", "blur_severity_2", "noise_severity_2")]:
        if (m, name) != ("xray", "blur_severity_2"):
            spoil(split_root / m / "test" / f"{name}.npz")
    got = S.read_split_images(spark, str(split_root), {"modality": ["xray"], "corruption": ["blur", "fog"], "severity": [2]})
    assert got.rdd.getNumPartitions() == 1
    assert got.agg(F.count("*"), F.min("sample_index"), F.max("sample_index")).first()[:] == (600, 0, 599)
    assert S.read_split_images(spark, str(split_root), {"modality": ["none"]}).count() == 0
    with pytest.raises(Exception, match="not a zip|zip file"):
        S.read_split_images(spark, str(split_root), {"modality": ["ct"], "corruption": [None]}).count()
    with pytest.raises(ValueError, match="not by sample_index"):
        S.read_split_images(spark, str(split_root), {"sample_index": [1]})


def test_one_table_serves_several_queries(spark, split_root):
    t = S.read_split_images(spark, str(split_root), {"modality": ["xray"], "corruption": [None, "noise"]})
    assert t.where("severity = 2").count() == 600 and t.count() == 1200


def test_rows_of_members_are_whole(spark, split_root):
    got = S.read_split_images(spark, str(split_root)).where("modality = 'ct' and severity = 1").orderBy("sample_index").collect()
    want = np.arange(600 * 4, dtype=np.uint8).reshape(600, 4) // 2
    assert [r["pixels"] for r in got] == want.tolist() and [r["label"] for r in got] == [[i] for i in range(600)]
    assert {(r["h"], r["w"], r["channels"], r["split"]) for r in got} == {(2, 2, 1, "test")}


def test_stacked_blocks_are_read_alone(spark, tmp_path):
    os.makedirs(tmp_path / "ds")
    img = np.arange(30, dtype=np.int64).reshape(30, 1, 1, 1) * np.ones((1, 2, 3, 3), np.int64)
    np.savez(tmp_path / "ds" / "fog.npz", test_images=np.asfortranarray(img), test_labels=np.arange(30))
    n = spark.createDataFrame([("ds", 10)], "dataset string, n_clean int")
    got = S.read_stacked_corruptions(spark, str(tmp_path), n, [1, 3])
    assert got.rdd.getNumPartitions() == 2
    rows = {(r["severity"], r["sample_index"]): (r["label"], r["pixels"][0]) for r in got.collect()}
    assert rows == {(s, i): ([(s - 1) * 10 + i], (s - 1) * 10 + i) for s in (1, 3) for i in range(10)}
    with pytest.raises(ValueError, match="too few"):
        S.read_stacked_corruptions(spark, str(tmp_path), n, [4])
    os.makedirs(tmp_path / "other")
    for left_out in ("ds/rain", "other/fog"):
        spoil(tmp_path / f"{left_out}.npz")
    assert S.read_stacked_corruptions(spark, str(tmp_path), n, [2], corruptions=["fog"]).count() == 10


def test_labels_of_another_length_fail(spark, tmp_path):
    os.makedirs(tmp_path / "m" / "test")
    np.savez(tmp_path / "m" / "test" / "clean.npz", images=np.zeros((3, 2, 2), np.uint8), labels=np.zeros(2, int))
    with pytest.raises(Exception, match="3 images but 2 labels"):
        S.read_split_images(spark, str(tmp_path)).count()


def saved(array, protocol=None):
    """Bytes of an array file, the pickle of an object array in the given protocol."""
    f = BytesIO()
    np.lib.format.write_array(f, array)
    if protocol is None:
        return f.getvalue()
    f.seek(0)
    A.header(f)
    return f.getvalue()[: f.tell()] + pickle.dumps(array, protocol=protocol)


@pytest.mark.parametrize("protocol", [2, 3, 4])
def test_text_arrays_of_objects(protocol):
    names = ["a.bin", "é 𝒳", "", "a.bin", "x" * 300] * 50
    assert A.text_array(saved(np.array(names, dtype=object), protocol)) == names
    assert A.text_array(saved(np.array([], dtype=object), protocol)) == []
    assert A.text_array(saved(np.array(["ab", "c"]))) == ["ab", "c"]


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/never-written-by-a-reader",)


@pytest.mark.parametrize("value", [Hostile(), 5, None, ["a"], {"a": 1}, b"x", ("a",), np.float64(1)])
def test_other_objects_are_refused(value):
    array = np.empty(2, dtype=object)
    array[:] = ["fine", None]
    array[1] = value
    with pytest.raises(ValueError, match="nothing but text"):
        A.text_array(saved(array, 4))
    assert not os.path.exists("/tmp/never-written-by-a-reader")


def test_episode_names_stored_as_objects(spark, tmp_path):
    np.savez_compressed(
        tmp_path / "e.npz", points=np.ones((2, 3, 5), np.float32), stream_name="s1", frame_names=np.asarray(["f0.bin", "f1.bin"], dtype=object),
        clean_prefix=np.int64(1), point_feature_dim=np.int64(5),
    )
    got = S.read_episode_npz(spark, str(tmp_path)).select("timestep", "frame_name", "stream", "clean_prefix").distinct().orderBy("timestep").collect()
    assert [tuple(r) for r in got] == [(0, "f0.bin", "s1", 1), (1, "f1.bin", "s1", 1)]
    np.savez(tmp_path / "e.npz", points=np.ones((1, 1, 3)), frame_names=np.array([Hostile()], dtype=object))
    with pytest.raises(Exception, match="nothing but text"):
        S.read_episode_npz(spark, str(tmp_path)).count()
