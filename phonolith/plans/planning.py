"""Plans of recordings to synthesise, and the facts behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions import phones as P

# fixed values: pattern name, tip and practice words
RECORDED = [
    ("th → t", "th_voiceless", "think thank three both"), ("th → s", "th_voiceless", "think thank three both"), ("ð → d", "th_voiced", "this that they mother"),
    ("ð → z", "th_voiced", "this that they mother"), ("w → v", "w", "west wine window"), ("ɪ → iː", "short_i", "ship sit fill"), ("iː → ɪ", "long_ee", "sheep seat feel"),
    ("æ → ɛ", "ae", "bad man cat"), ("ʊ → uː", "short_u", "pull full book"), ("final devoicing", "final_voicing", "bed dog bag love"),
    ("extra vowel before cluster", "epenthesis", "school street sport speak"), ("ŋ + g", "ng", "sing long singer"),
]

# fixed values: how a pattern changes the phonemes of a word, for an engine with mnemonics and one with IPA-like symbols
ERROR_RULES = {
    "mnemonic": {
        "th → t": [("T", "t")], "th → s": [("T", "s")], "ð → d": [("D", "d")], "ð → z": [("D", "z")], "w → v": [("w", "v")], "ɪ → iː": [("(?<![aeO])I", "i:")], "iː → ɪ": [("i:", "I")],
        "æ → ɛ": [("a(?![IU#])", "E")], "ʊ → uː": [("(?<![aoO])U", "u:")], "final devoicing": [("b$", "p"), ("d$", "t"), ("g$", "k"), ("v$", "f"), ("z$", "s")],
        "extra vowel before cluster": [("^", "I")], "ŋ + g": [("N", "Ng")],
    },
    "ipa": {
        "th → t": [("θ", "t")], "th → s": [("θ", "s")], "ð → d": [("ð", "d")], "ð → z": [("ð", "z")], "w → v": [("w", "v")], "ɪ → iː": [("ɪ", "i")], "iː → ɪ": [("i", "ɪ")],
        "æ → ɛ": [("æ", "ɛ")], "ʊ → uː": [("ʊ", "u")], "final devoicing": [("b$", "p"), ("d$", "t"), ("ɡ$", "k"), ("v$", "f"), ("z$", "s")],
        "extra vowel before cluster": [("^", "ɪ")], "ŋ + g": [("ŋ", "ŋɡ")],
    },
}


def spoken(pattern: Column, version: Column, phonemes: Column, symbols: str = "mnemonic") -> Column:
    """The phonemes to synthesise: unchanged for the correct version, else with the pattern's error."""
    changed = [F.when(pattern == name, P.apply_rules(phonemes, rules)) for name, rules in ERROR_RULES[symbols].items()]
    return F.when(version == "error", F.coalesce(*changed)).otherwise(phonemes)


def pair_summary(results: DataFrame) -> DataFrame:
    """By pattern and for ALL: recording pairs, errors caught and with the right pattern, false alarms on the correct
    version, errors whose reports were dismissed. results: engine, pattern, word, voice, speed, version, flagged,
    right_tip, hidden_by_gop."""
    keys = ["engine", "pattern", "word", "voice", "speed"]
    of = lambda column, version: F.max(F.when(F.col("version") == version, F.col(column)))
    pairs = results.groupBy(*keys).agg(of("flagged", "correct").alias("fa"), of("flagged", "error").alias("caught"), of("right_tip", "error").alias("tip"), of("hidden_by_gop", "error").alias("hidden"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    table = pairs.rollup("pattern").agg(F.count("*").alias("pairs"), share("caught").alias("catch"), share("tip").alias("right_tip"), share("fa").alias("false_alarm"), F.count_if("hidden").alias("hidden_by_gop"))
    order = results.sparkSession.createDataFrame([(n, i) for i, n in enumerate([*(r[0] for r in RECORDED), "ALL"])], "pattern string, ordinal int")
    return order.join(table.withColumn("pattern", F.coalesce("pattern", F.lit("ALL"))), "pattern", "left")


def plan_recordings(spark: SparkSession, engines: dict[str, tuple[list[str], list[float]]]) -> DataFrame:
    """engine x pattern x word x voice x speed x version; engines: voices and speeds by name."""
    patterns = spark.createDataFrame([(n, t, w.split()) for n, t, w in RECORDED], "pattern string, tip string, words array<string>")
    kinds = spark.createDataFrame([(e, v, s) for e, (v, s) in engines.items()], "engine string, voices array<string>, speeds array<double>")
    rows = kinds.crossJoin(patterns).select("engine", "pattern", "tip", F.explode("words").alias("word"), "voices", "speeds")
    rows = rows.select("engine", "pattern", "tip", "word", F.explode("voices").alias("voice"), "speeds").select("engine", "pattern", "tip", "word", "voice", F.explode("speeds").alias("speed"))
    return rows.withColumn("version", F.explode(F.array(F.lit("correct"), F.lit("error"))))


def latest_only(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose work isn't done yet."""
    return rows.join(done, keys, "left_anti")
