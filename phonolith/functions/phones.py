"""Functions of phones, phone sequences and labels as Column expressions; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonolith.functions import inventory as I


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _list_map(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])


def tokenize(text: Column) -> Column:
    """Words with inner apostrophes, which are all written ' afterwards."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+(?:['’][A-Za-z]+)*"), F.lit(0))
    return F.transform(words, lambda w: F.replace(w, F.lit("’"), F.lit("'")))


def is_vowel(phone: Column) -> Column:
    return F.coalesce(F.substring(phone, 1, 1).isin(*sorted(I.VOWELS)), F.lit(False))


def normalize(phones: Column, aliases: dict[str, str] | None = None, splits: dict[str, list[str]] | None = None) -> Column:
    """One spelling for each sound, and sounds of several symbols split; the order stays."""
    aliases, splits = literal_map(I.ALIASES if aliases is None else aliases), _list_map(I.SPLITS if splits is None else splits)
    one = lambda p: F.coalesce(F.try_element_at(aliases, p), p)
    return F.flatten(F.transform(phones, lambda p: F.coalesce(F.try_element_at(splits, one(p)), F.array(one(p)))))


def merge_repeats(items: Column) -> Column:
    """Without elements that equal the one before."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def is_acceptable(expected: Column, heard: Column, function_word: Column, extra: Column | None = None, accept: dict | None = None) -> Column:
    """Whether a heard sound is fine for an expected one. Directional: the pair is not symmetric."""
    table = _list_map({k: sorted(v) for k, v in (I.ACCEPT if accept is None else accept).items()})
    fine = (expected == heard) | F.array_contains(F.coalesce(F.try_element_at(table, expected), F.array().cast("array<string>")), heard)
    if extra is not None:
        fine = fine | F.coalesce(F.array_contains(extra, heard), F.lit(False))
    return F.coalesce(fine | (function_word & is_vowel(expected) & heard.isin(*sorted(I.REDUCED))), F.lit(False))


def describe(phone: Column) -> Column:
    example = F.try_element_at(literal_map(I.EXAMPLES), phone)
    return F.when(example.isNotNull(), F.format_string("/%s/ (as in '%s')", phone, example)).otherwise(F.concat(F.lit("/"), phone, F.lit("/")))


def substitution_tip(expected: Column, heard: Column, final: Column) -> Column:
    """The pattern of a substitution; devoicing at the end of a word comes first."""
    tips = literal_map({f"{e}>{h}": t for (e, h), t in I.SUBSTITUTION_TIPS.items()})
    devoiced = F.coalesce(final & (F.try_element_at(literal_map(I.DEVOICED), expected) == heard), F.lit(False))
    return F.when(devoiced, "final_voicing").otherwise(F.try_element_at(tips, F.concat(expected, F.lit(">"), heard)))


def starts_with_cluster(phones: Column) -> Column:
    return (F.size(phones) >= 2) & ~is_vowel(F.get(phones, F.lit(0))) & ~is_vowel(F.get(phones, F.lit(1)))


def final_cluster_start(phones: Column) -> Column:
    """Place of the first sound after the last vowel; 0 without a vowel."""
    back = F.array_position(F.reverse(F.transform(phones, is_vowel)), True)
    return F.when(back == 0, 0).otherwise(F.size(phones) - back + 1).cast("int")


def raw_wrong(expected: Column, heard: Column) -> Column:
    """Whether sequences differ apart from length marks; null for a word that was skipped."""
    short = lambda x: F.transform(x, lambda p: F.replace(p, F.lit("ː"), F.lit("")))
    return short(expected) != short(heard)


def arpabet_to_ipa(phone: Column) -> Column:
    """Null for an unknown sound."""
    base = F.regexp_replace(phone, r"\d", "")
    reduced = F.when(phone.endswith("0"), F.try_element_at(literal_map(I.UNSTRESSED), base))
    return F.coalesce(reduced, F.try_element_at(literal_map(I.ARPABET), base))


def perceived_to_ipa(perceived: Column, canonical: Column) -> Column:
    """A heard label: * marks an accent, AX is the reduced vowel, AH and ER take their stress from the expected sound."""
    base = F.upper(F.regexp_replace(F.rtrim(F.regexp_replace(perceived, r"\*+$", "")), r"\d", ""))
    stressed = F.coalesce(canonical.rlike("[12]$"), F.lit(False))
    return (
        F.when(perceived.endswith("*"), F.try_element_at(literal_map(I.ACCENTED), base))
        .when(base == "AX", "ə")
        .when(base.isin(*I.UNSTRESSED) & ~perceived.rlike(r"\d$"), F.try_element_at(F.when(stressed, literal_map(I.ARPABET)).otherwise(literal_map(I.UNSTRESSED)), base))
        .otherwise(arpabet_to_ipa(F.upper(perceived)))
    )


def parse_phone_label(label: Column) -> Column:
    """``canonical, perceived, kind, accented, unsure`` of an annotation; null for silence, an error for anything else."""
    text = F.trim(label)
    parts = F.transform(F.split(text, ","), F.trim)
    tag, expected, raw = F.lower(F.get(parts, F.lit(2))), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    accented = raw.endswith("*")
    bare = F.trim(F.regexp_replace(raw, r"\*+$", ""))
    heard = F.when(accented & F.upper(bare).isin(*I.ACCENTED), F.concat(bare, F.lit("*"))).otherwise(bare)
    unsure = F.lower(bare) == "err"
    row = lambda a, b, kind, c=F.lit(False), d=F.lit(False): F.struct(a.alias("canonical"), b.alias("perceived"), F.lit(kind).alias("kind"), c.alias("accented"), d.alias("unsure"))
    none = F.lit(None).cast("string")
    digits = lambda c: F.regexp_replace(c, r"\d", "")
    return (
        F.when(F.lower(text).isin(*I.SILENCE), F.lit(None))
        .when(~text.contains(","), row(text, text, "correct"))
        .when((F.size(parts) != 3) | ~tag.isin("s", "d", "a"), F.raise_error(F.concat(F.lit("unexpected label: "), label)))
        .when(tag == "d", row(expected, none, "del"))
        .when(tag == "a", row(none, F.when(~unsure, heard), "ins", accented, unsure))
        .when(unsure, row(expected, none, "sub", F.lit(False), F.lit(True)))
        .when(digits(heard) == digits(expected), row(expected, expected, "correct", F.lit(True)))
        .otherwise(row(expected, heard, "sub", accented))
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def apply_rules(phonemes: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular replacements, one after the other."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, phonemes)


def as_symbols(a: Column, b: Column) -> tuple[Column, Column]:
    """Two sequences as strings with one character for each different sound of the pair, for ``levenshtein``. Up to 6400
    different sounds in a pair; more are an error."""
    alphabet = F.lit("".join(map(chr, range(0xE000, 0xF900))))
    known = F.array_distinct(F.concat(a, b))
    code = lambda x: F.when(F.size(known) <= 6400, F.array_join(F.transform(x, lambda p: F.substring(alphabet, F.array_position(known, p).cast("int"), F.lit(1))), "")).otherwise(F.raise_error(F.lit("too many different sounds")))
    return code(a), code(b)


def sentence_of(choice: Column) -> Column:
    """A practice sentence without the remark after its dot."""
    return F.coalesce(F.split_part(choice, F.lit("  ·  "), F.lit(1)), F.lit(""))


def speaker_group(speaker: Column) -> Column:
    return F.regexp_replace(speaker, "[0-9]+$", "")


def pair_label(expected: Column, heard: Column) -> Column:
    return F.concat(F.coalesce(expected, F.lit("-")), F.lit(" → "), F.coalesce(heard, F.lit("-")))


def transcription_words(text: Column) -> Column:
    """Words inside the first brackets, over several lines if need be, else of the whole text."""
    inner = F.regexp_extract(text, r"(?s)\[(.*?)\]", 1)
    return F.filter(F.split(F.when(text.rlike(r"(?s)\[.*?\]"), inner).otherwise(text), r"\s+"), lambda w: w != "")


def word_score(ops: Column, n_expected: Column) -> Column:
    """Matches among expected and added sounds; 1 for a word without any."""
    count = lambda kind: F.size(F.filter(ops, lambda o: o["kind"] == kind))
    return F.coalesce(F.try_divide(count("match"), n_expected + count("ins")), F.lit(1.0))


def word_color(issues: Column, score: Column) -> Column:
    """How a word is shown by the rules: green without a report, else by its score."""
    return F.when(F.size(issues) == 0, "green").when(score >= 0.6, "amber").otherwise("red")


def level_color(level: Column) -> Column:
    """How a word is shown with the learned detector."""
    return F.coalesce(F.when(level == "red", "red").when(level == "yellow", "amber"), F.lit("green"))


def log_softmax_over(log_probs: Column, allowed: Column) -> Column:
    """Log probabilities of the allowed places (array of booleans) normalised among themselves; others get -1e30."""
    # one-element arrays hold the largest value and the total, so that each is computed once
    kept = F.filter(F.zip_with(log_probs, allowed, lambda lp, ok: F.when(ok, lp)), lambda x: x.isNotNull())
    both = F.transform(F.array(kept), lambda k: F.transform(F.array(F.array_max(k)), lambda top: top + F.log(F.aggregate(k, F.lit(0.0), lambda s, x: s + F.exp(x - top))))[0])
    return F.transform(both, lambda total: F.zip_with(log_probs, allowed, lambda lp, ok: F.when(ok, lp - total).otherwise(F.lit(-1e30))))[0]


def argmax(values: Column) -> Column:
    """Place of the largest value (0-based, the first of ties)."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
