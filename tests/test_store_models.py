"""Stores, archives and models."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.operators import metrics, models
from phonolith.sources import archives, store


def packed(files, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def release(tmp_path, speakers=4, method=zipfile.ZIP_STORED):
    """Speakers of 30 sentences each, in zips in a zip, and one zip by itself; by (speaker, utterance) what is in it."""
    want, inner = {}, {}
    for s in range(speakers):
        files = {}
        for u in range(30):
            files[f"S{s}/annotation/u{u}.TextGrid"] = f"grid {s} {u} " * 20
            if u % 3:
                files[f"S{s}/wav/u{u}.wav"] = bytes([s, u]) * 500
            if u % 2:
                files[f"S{s}/transcript/u{u}.txt"] = f"text {u}"
            want[f"S{s}", f"u{u}"] = tuple(x.encode() if isinstance(x, str) else x for x in (files.get(f"S{s}/wav/u{u}.wav"), files[f"S{s}/annotation/u{u}.TextGrid"], files.get(f"S{s}/transcript/u{u}.txt")))
        files["S0/wav/other.wav"] = b"x"
        inner[f"S{s}.zip"] = packed(files, zipfile.ZIP_DEFLATED)
    (tmp_path / "release").mkdir()
    (tmp_path / "release" / "all.zip").write_bytes(packed({**inner, "README": "r"}, method))
    (tmp_path / "release" / "one.zip").write_bytes(packed({"X/annotation/a.TextGrid": "alone"}))
    (tmp_path / "release" / "empty.zip").write_bytes(packed({}))
    (tmp_path / "release" / "notes.txt").write_text("no zip")
    return str(tmp_path / "release"), want | {("X", "a"): (None, b"alone", None)}


def read(rows):
    return {(r.speaker, r.utterance): tuple(None if x is None else bytes(x) for x in (r.wave, r.textgrid, r.transcript)) for r in rows}


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archives_within_archives(spark, tmp_path, method):
    path, want = release(tmp_path, method=method)
    index = archives.release_index(spark, path)
    assert read(archives.read_sentences(index).collect()) == want and index.count() == len(want)
    done = index.select("speaker", "utterance").where("speaker <> 'S1'")
    left = store.not_done(index, done, ["speaker", "utterance"])
    assert read(archives.read_sentences(left).collect()) == {k: v for k, v in want.items() if k[0] == "S1"}
    assert archives.read_sentences(index.limit(0)).collect() == []


def test_one_release_is_read_by_many_tasks(spark, tmp_path):
    path, want = release(tmp_path)
    rows = archives.read_sentences(archives.release_index(spark, path), task_bytes=500)
    by_task = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == len(want) and len(by_task) > 4 and max(by_task) < len(want) / 3


def test_what_is_still_to_do(spark):
    wanted = spark.createDataFrame([("ABA",), ("SKA",)], "speaker string")
    assert [r.speaker for r in store.not_done(wanted, wanted.limit(1), ["speaker"]).collect()] == ["SKA"]


def test_results(spark, tmp_path):
    path = str(tmp_path / "metrics.json")
    store.merge_json(spark, path, {"a": 1, "b": {"x": "é"}})
    assert store.merge_json(spark, path, {"a": 2}) == {"a": 2, "b": {"x": "é"}}
    rows = spark.createDataFrame([("s1", 0.5, ["x"]), ("s2", None, [])], "speaker string, gop double, errors array<string>")
    store.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, store.read_csv(spark, str(tmp_path / "csv"), "speaker string, gop double").collect())) == [("s1", 0.5), ("s2", None)]
    people = spark.createDataFrame([(" Turkish1 ", "Turkish ", 30), ("english1", "English", 20), ("x", "Dutch", 1)], "speaker string, native_language string, age int")
    assert sorted(r.speaker for r in store.speakers_list(people, ["turkish", "English"]).collect()) == ["english1", "turkish1"]
    assert store.once(rows).count() == 2


def regression(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = 5 + x @ [1.0, -2.0, 0.0] + rng.normal(scale=0.1, size=n)
    return x, y, spark.createDataFrame([(f"s{i % 12}", i, *map(float, x[i]), float(y[i])) for i in range(n)], "speaker string, id int, a double, b double, c double, y double")


def test_ridge_from_products(spark):
    x, y, rows = regression(spark)
    sums = sum(models.products(rows.withColumn("f", F.lit(0)), ["a", "b", "c", "y"], "f").values())
    design = np.column_stack([np.ones(len(x)), x])
    assert models.ridge(sums, 0.0) == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert models.ridge(sums, 7.0) == pytest.approx([y.mean() - w @ x.mean(0), *w])
    beta = models.ridge(sums, 7.0)
    assert models.r_squared(sums, beta) == pytest.approx(1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    model, quality = models.fit_scorer(rows.withColumn("c", F.when(F.col("id") != 7, F.col("c"))), ["a", "b", "c"], "y", "speaker", rounds=5)
    assert isinstance(model, models.Linear) and quality["ridge"] > 0.99 and quality["baseline"] < 0.5
    scored = models.score(model, rows).toPandas()
    assert np.abs(scored["score"] - y.clip(0, 10)).max() < 0.5 and "prediction" not in scored


def test_importance(spark):
    _, _, rows = regression(spark)
    rows = rows.withColumn("wrong", F.col("b") > 0.5)
    copies = models.permuted(rows, ["a", "b"], "id", 2, 1, group_size=60).toPandas().sort_values("id")
    plain = rows.toPandas().sort_values("id")
    assert len(copies) == 5 * len(plain)
    for feature, other in (("a", "b"), ("b", "a")):
        for repeat in (0, 1):
            moved = copies[(copies["_feature"] == feature) & (copies["_repeat"] == repeat)]
            assert sorted(moved[feature]) == sorted(plain[feature]) and (moved[feature].to_numpy() != plain[feature].to_numpy()).mean() > 0.9
            assert moved[other].tolist() == plain[other].tolist()
    by_hand = metrics.auc_and_ap(rows.withColumn("p", F.col("b") + 0.01 * F.col("c")), "p", F.col("wrong")).first().ap
    by_group = {r.g: r.ap for r in metrics.auc_and_ap(rows.crossJoin(spark.range(2).withColumnRenamed("id", "g")).withColumn("p", F.col("b") + 0.01 * F.col("c")), "p", F.col("wrong"), "g").collect()}
    assert by_group == {0: by_hand, 1: by_hand}
    ranked = models.importance(lambda df: df.withColumn("p", F.col("b") + 0.01 * F.col("c")), rows, ["a", "b", "c"], "wrong", "id", 2).collect()
    assert ranked[0].feature == "b" and ranked[0].mean > 0.3 and {r.feature: r.mean for r in ranked}["a"] == 0
    assert [r.feature for r in models.importance(lambda df: df.withColumn("p", F.col("b") + 0.01 * F.col("c")), rows, ["a", "b", "c"], "wrong", "id", 2, top=1).collect()] == ["b"]
