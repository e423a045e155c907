"""Resampling and the store of model output."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.sources import readers


def direct(x, up, down):
    """Zeros between the samples, one long filter, every down-th value."""
    rate = max(up, down)
    k = np.arange(-10 * rate, 10 * rate + 1)
    h = np.sinc(k / rate) * np.kaiser(len(k), 5.0)
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    return np.convolve(spread, h * up / h.sum())[10 * rate :][: len(spread)][::down]


@pytest.mark.parametrize("rate, target", [(8000, 16000), (44100, 16000), (48000, 16000), (22050, 16000), (16000, 11025)])
def test_filter_bank_is_a_direct_convolution(rate, target):
    x = np.random.default_rng(1).normal(size=900)
    common = np.gcd(rate, target)
    got = readers.resample(x, rate, target, block=100)
    assert len(got) == -(-len(x) * target // rate) and np.allclose(got, direct(x, target // common, rate // common)[: len(got)])


def test_tones_below_the_cut_stay_and_those_above_go():
    t = np.arange(44100) / 44100
    level = lambda f: np.abs(readers.resample(np.sin(2 * np.pi * f * t), 44100, 16000)[2000:-2000]).max()
    assert level(440) == pytest.approx(1, abs=0.01) and level(6000) == pytest.approx(1, abs=0.02) and level(12000) < 0.005


def test_samples_of_any_kind():
    assert readers.to_model_input(np.array([32767, -32767], np.int16), 16000).tolist() == [1.0, -1.0]
    assert readers.to_model_input(np.array([[1.0, 0.0]] * 3), 16000).tolist() == [0.5] * 3
    assert readers.to_model_input(np.array([[1.0] * 5, [0.0] * 5]), 16000).tolist() == [0.5] * 5
    assert readers.to_model_input(np.eye(2), 16000).tolist() == [0.5, 0.5] and readers.to_model_input(np.array([], np.int16), 8000).tolist() == []


def test_wave_files(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, -16384 + 32767]] * 800, "<i2").tobytes())
    got = spark.createDataFrame([(out.getvalue(),), (b"no wave",)], "content binary").select(readers.decode_wave("content").alias("a")).collect()
    assert len(got[0].a) == 1600 and np.mean(got[0].a[400:1200]) == pytest.approx(0.5, abs=1e-3) and got[1].a is None


def infer(rows):
    return rows.withColumns({"log_probs": F.array(F.col("id") * 1.0), "n_vocab": F.lit(1)})


def test_two_writers_add_a_key_once(spark, tmp_path):
    path, table = str(tmp_path / "store"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")

    def slow(rows):
        # while this writer infers, another one stores some of its keys, and a third one all of them
        assert sorted(r.id for r in readers.cached_log_probs(table(2, 3), path, ["id"], "m", "f", infer).collect()) == [2, 3]
        assert readers.cached_log_probs(table(1, 2, 5), path, ["id"], "m", "f", infer).count() == 3
        return infer(rows)

    assert sorted(r.id for r in readers.cached_log_probs(table(1, 2, 4, 4), path, ["id"], "m", "f", slow).collect()) == [1, 2, 4, 4]
    folder = f"{path}/model=m/fingerprint=f"
    stored = [r.id for r in spark.read.parquet(*readers._commits(spark, folder)).collect()]
    assert sorted(stored) == [1, 2, 3, 4, 5] and len(readers._commits(spark, folder)) == 3


def test_failed_jobs_leave_nothing_to_read(spark, tmp_path):
    path, table = str(tmp_path / "store"), spark.createDataFrame([(1,), (2,)], "id int")

    def broken(rows):
        return infer(rows).withColumn("n_vocab", F.when(F.col("id") == 2, F.raise_error(F.lit("stopped"))).otherwise(1))

    with pytest.raises(Exception, match="stopped"):
        readers.cached_log_probs(table, path, ["id"], "m", "f", broken)
    assert readers.cached_log_probs(table, path, ["id"], "m", "f", infer).count() == 2
    calls = []
    assert readers.cached_log_probs(table, path, ["id"], "m", "f", lambda rows: calls.append(rows.count()) or infer(rows)).count() == 2 and calls == [0]
