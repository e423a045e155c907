"""Sources and sinks of the evaluation: annotation grids, transcriptions, manifests, audio and stored model output."""

from __future__ import annotations

import io
import json
import time
import uuid
import wave
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions.lazy import pandas_function

MANIFEST = "id string, speaker string, l1 string, gender string, audio string, seconds double, text string, tokens array<string>, canonical array<string>, expected array<string>, perceived array<string>, function array<boolean>, errors array<array<string>>"
SYSTEM = "name string, recognizer string, decision string, settings struct<gop_threshold:double,pattern_threshold:double,w_margin_threshold:double,hidden_thresholds:map<string,double>>"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_system(spark: SparkSession, path: str) -> DataFrame:
    """System settings; Infinity is a number in these files."""
    return spark.read.schema(SYSTEM).option("multiLine", True).json(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON file on any file system Spark knows; Infinity and NaN are numbers."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_split(spark: SparkSession, path: str, final: bool = False) -> DataFrame:
    """``part, speaker`` of a split file; the test part only with ``final``."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("part", "names"))
    rows = parts.select("part", F.explode(F.from_json("names", "array<string>")).alias("speaker"))
    return rows if final else rows.where("part <> 'test'")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def textgrid_tiers(text: Column) -> Column:
    """Interval tiers of a Praat TextGrid: map of name to array of (xmin, xmax, text); a doubled quote is one."""
    items = F.split(text, r"item \[\d+\]:")
    block = F.slice(items, F.lit(2), F.size(items) - 1)
    # fixed value: an interval in the file format
    number = r'intervals \[\d+\]:\s*xmin = (\S+)\s*xmax = (\S+)\s*text = "((?:[^"]|"")*)"'

    def tier(b: Column) -> Column:
        parts = [F.regexp_extract_all(b, F.lit(number), F.lit(i)) for i in (1, 2, 3)]
        rows = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("a", "b", "c"), strict=True)])
        intervals = F.transform(rows, lambda r: F.struct(r["a"].cast("double").alias("xmin"), r["b"].cast("double").alias("xmax"), F.replace(r["c"], F.lit('""'), F.lit('"')).alias("text")))
        return F.struct(F.regexp_extract(b, 'name = "([^"]*)"', 1).alias("name"), intervals.alias("intervals"))

    return F.map_from_entries(F.transform(block, tier))


def prompts(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id, text`` of lines like ``( id "text" )``."""
    parts = [F.regexp_extract(column, r'\(\s*(\S+)\s+"([^"]*)"\s*\)', i) for i in (1, 2)]
    return lines.select(parts[0].alias("id"), parts[1].alias("text")).where("id <> ''")


@lru_cache(32)
def _filter_bank(up: int, down: int) -> tuple[np.ndarray, int]:
    """The taps of each of ``up`` phases of a windowed sinc, and how many input samples they reach back.

    The cut is at the lower of both rates' limits; the window is Kaiser's (5.0) over ten zero crossings to each side.
    """
    rate = max(up, down)
    half = 10 * rate
    k = np.arange(-half, half + 1)
    h = np.sinc(k / rate) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    back = half // up
    # an output at t (in steps of the common rate) takes the samples n with |t - n * up| <= half; t = phase + up * place
    at = np.arange(up)[:, None] - up * np.arange(-back, back + 2)[None, :] + half
    return np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0), back


def resample(x: np.ndarray, rate: int, target: int, block: int = 1 << 14) -> np.ndarray:
    """Samples at another rate by a polyphase filter bank, in blocks; zeros stand before and after the samples. The result has
    len(x) * target / rate samples, rounded up."""
    common = gcd(rate, target)
    up, down = target // common, rate // common
    bank, back = _filter_bank(up, down)
    taps = bank.shape[1]
    padded = np.concatenate([np.zeros(back), np.asarray(x, np.float64), np.zeros(back + 2)])
    out = np.empty(-(-len(x) * up // down))
    for start in range(0, len(out), block):
        t = np.arange(start, min(start + block, len(out))) * down
        out[start : start + len(t)] = (padded[(t // up)[:, None] + np.arange(taps)] * bank[t % up]).sum(1)
    return out


def to_model_input(samples: np.ndarray, rate: int, target: int = 16_000) -> np.ndarray:
    """Mono float32 in [-1, 1] at the model's rate: integers scaled by the largest value of their type (unsigned ones around 128),
    channels averaged (rows are samples, unless there are fewer rows than columns), then resampled."""
    x = np.asarray(samples)
    if x.dtype.kind == "u":
        x = (x.astype(np.float32) - 128) / 128
    elif x.dtype.kind == "i":
        x = x.astype(np.float32) / np.iinfo(x.dtype).max
    x = x.astype(np.float32)
    if x.ndim == 2:
        x = x.mean(axis=1 if x.shape[1] <= x.shape[0] else 0)
    if rate != target and len(x):
        x = resample(x, rate, target).astype(np.float32)
    return x


@pandas_function("array<float>")
def decode_wave(content: pd.Series) -> pd.Series:
    """PCM wave files as model input; null for other bytes."""

    def one(data: bytes) -> np.ndarray | None:
        try:
            with wave.open(io.BytesIO(data)) as w:
                kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
                x = np.frombuffer(w.readframes(w.getnframes()), kind).reshape(-1, w.getnchannels())
                if kind != np.uint8:
                    x = x / -float(np.iinfo(kind).min)  # a file's samples are of [-1, 1)
                return to_model_input(x.mean(axis=1) if kind != np.uint8 else (x.astype(np.float32).mean(axis=1) - 128) / 128, w.getframerate())
        except (wave.Error, EOFError, KeyError):
            return None

    return content.map(one)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """``path, audio`` of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode_wave("content").alias("audio"))


def model_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def _commits(spark: SparkSession, folder: str) -> list[str]:
    """The data folders of a store's commits, in their order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(at))
    return [f"{folder}/{name.split('-', 1)[1]}" for name in names]


def _commit(spark: SparkSession, folder: str, number: int, name: str) -> bool:
    """Make a data folder commit number ``number``; False if another one is."""
    jvm = spark._jvm
    conf, parent = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
    files = parent.getFileSystem(conf)
    # the number is taken by a name that only one writer can create; the entry then says whose it is
    lock = jvm.org.apache.hadoop.fs.Path(f"{folder}/_numbers/{number:09d}")
    try:
        files.create(lock, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    files.create(jvm.org.apache.hadoop.fs.Path(parent, f"{number:09d}-{name}"), False).close()
    return True


def cached_log_probs(wanted: DataFrame, path: str, keys: list[str], model: str, fingerprint: str, infer) -> DataFrame:
    """Log probabilities of all wanted keys; only those that the store lacks for this model and fingerprint are inferred.

    The store has a folder for each model and fingerprint, so a changed model leaves old rows unread. A writer puts its rows in a
    folder of their own and then takes the next commit number; if another writer has taken it, the keys that it has added are left
    out of a new folder and the next number is tried. So every key is stored once, whoever else writes, and folders without a number
    (of jobs that failed) are never read. Only the columns of the keys are read to find out what is missing. ``infer(rows)`` adds
    ``log_probs`` and ``n_vocab``. Keys that are wanted twice are inferred once.
    """
    spark = wanted.sparkSession
    folder = f"{path}/model={model}/fingerprint={fingerprint}"
    seen = _commits(spark, folder)
    missing = wanted.dropDuplicates(keys)
    if seen:
        missing = missing.join(spark.read.parquet(*seen).select(*keys), keys, "left_anti")
    name = uuid.uuid4().hex
    infer(missing).select(*keys, "log_probs", "n_vocab").write.parquet(f"{folder}/{name}")
    while not _commit(spark, folder, len(seen), name):
        while len(now := _commits(spark, folder)) <= len(seen):
            time.sleep(0.05)  # the other writer has its number and is about to write its entry
        own, seen, name = spark.read.parquet(f"{folder}/{name}"), [*now], uuid.uuid4().hex
        own.join(spark.read.parquet(*now).select(*keys), keys, "left_anti").write.parquet(f"{folder}/{name}")
    return wanted.join(spark.read.parquet(*_commits(spark, folder)), keys)
