"""The sounds, what counts as a variant of them, and the error patterns of Turkish speakers of English.

Sets and maps of IPA symbols. Everything here is a small dimension: kernels use it as it is, and ``phones.py`` turns it
into map literals, so no lookup needs a join.
"""

from __future__ import annotations

# --- fixed values: inventory, variants, patterns and examples, as the results to match need them ---------------------

VOWELS = {
    "a", "e", "i", "o", "u", "y", "æ", "ɑ", "ɒ", "ɐ", "ɔ", "ə", "ɚ", "ɛ", "ɜ", "ɪ", "ʊ", "ʌ", "ø", "œ", "ɤ", "ɯ", "ɨ", "ʉ", "ᵻ",
}
# sounds of several symbols that are compared symbol by symbol
SPLITS = {
    "ɑːɹ": ["ɑː", "ɹ"], "ɔːɹ": ["oː", "ɹ"], "oːɹ": ["oː", "ɹ"], "ɛɹ": ["eə", "ɹ"], "ɪɹ": ["iə", "ɹ"], "ʊɹ": ["ʊə", "ɹ"],
    "aɪɚ": ["aɪ", "ɚ"], "aɪə": ["aɪ", "ə"], "əl": ["ə", "l"], "n̩": ["ə", "n"], "l̩": ["ə", "l"],
}
ALIASES = {
    "g": "ɡ", "r̩": "ɹ", "ɝ": "ɜː", "ɫ": "l", "ɻ": "ɹ",
}
# what may be heard for an expected sound
ACCEPT = {
    "t": {"ɾ", "ʔ"}, "d": {"ɾ"}, "ɾ": {"t", "d"}, "ʔ": {"t"}, "i": {"iː", "ɪ"}, "iː": {"i"}, "ə": {"ɐ", "ᵻ", "ʌ", "ɪ"},
    "ɐ": {"ə", "ʌ"}, "ᵻ": {"ɪ", "ə", "i"}, "ʌ": {"ə", "ɐ"}, "ɚ": {"ɜː", "ə", "ɐ"}, "ɜː": {"ɚ"}, "ɑː": {"ɔː", "ɑ", "ɒ", "ɔ", "a"},
    "ɔː": {"ɑː", "ɔ", "ɒ", "oː", "a"}, "ɔ": {"ɔː", "ɑː", "ɒ"}, "oʊ": {"o", "oː", "əʊ"}, "oː": {"oʊ", "ɔː", "o", "ɔ"},
    "eɪ": {"e", "eː"}, "ɛ": {"e"}, "uː": {"u"}, "u": {"uː"}, "iə": {"iː", "ɪ", "i", "ɪə"}, "ʊə": {"ʊ", "uː", "u", "ɔː", "oː", "o"},
    "eə": {"ɛ", "e", "eɪ", "ɛː", "æ"},
}
# any vowel of a function word may become one of these
REDUCED = {
    "ə", "ɪ", "ᵻ", "ɐ", "ɚ",
}
FUNCTION_WORDS = {
    "a", "an", "the", "to", "of", "and", "for", "from", "at", "as", "but", "or", "nor", "can", "could", "would", "should", "will",
    "shall", "must", "was", "were", "are", "am", "is", "be", "been", "have", "has", "had", "do", "does", "you", "your", "he", "she",
    "we", "they", "them", "him", "his", "her", "our", "their", "that", "than", "then", "there", "some", "just", "into", "onto", "with",
    "by", "in", "on", "it",
}
DEVOICED = {
    "b": "p", "d": "t", "ɡ": "k", "v": "f", "z": "s", "ð": "θ", "ʒ": "ʃ", "dʒ": "tʃ",
}
# pattern: expected sound and what it is replaced with, in order of preference
PATTERNS = {
    "th_voiceless": ("θ", ["t", "s", "f", "d", "t̪"]), "th_voiced": ("ð", ["d", "z", "v", "θ", "d̪"]),
    "w": ("w", ["v", "β", "ʋ", "ɹ"]), "v": ("v", ["w", "β", "ʋ"]), "long_ee": ("iː", ["ɪ"]), "short_i": ("ɪ", ["i", "iː"]),
    "ae": ("æ", ["e", "ɛ", "a", "ɑ", "aː"]), "uh": ("ʌ", ["a", "ɑː", "ɑ", "aː"]), "short_u": ("ʊ", ["uː", "u"]),
    "long_oo": ("uː", ["ʊ"]), "er": ("ɜː", ["ø", "øː", "œ", "ɛ", "e"]), "ng": ("ŋ", ["n"]), "r": ("ɹ", ["r", "ɾ", "ʁ"]),
}
TIP_ORDER = [*PATTERNS, "final_voicing", "epenthesis"]
W_RIVALS = ("v", "β", "ʋ")
EXAMPLES = {
    "θ": "think", "ð": "this", "ʃ": "she", "ʒ": "measure", "tʃ": "church", "dʒ": "judge", "ŋ": "sing", "ɹ": "red", "j": "yes",
    "w": "we", "h": "hat", "p": "pen", "b": "bad", "t": "tea", "d": "dog", "k": "cat", "ɡ": "go", "f": "fish", "v": "very", "s": "see",
    "z": "zoo", "m": "man", "n": "no", "l": "leg", "æ": "cat", "ɛ": "bed", "ɪ": "sit", "iː": "see", "i": "happy", "ʊ": "book",
    "uː": "food", "ʌ": "cup", "ə": "about", "ɜː": "bird", "ɚ": "butter", "ɑː": "father", "ɔː": "law", "eɪ": "day", "aɪ": "my",
    "ɔɪ": "boy", "aʊ": "now", "oʊ": "go", "oː": "more", "iə": "here", "ʊə": "tour", "eə": "there",
}
ENGLISH_PHONES = [
    "ɪ", "n", "s", "ə", "t", "ɹ", "l", "k", "m", "d", "p", "æ", "ɛ", "ɑː", "ɚ", "b", "oʊ", "f", "i", "aɪ", "eɪ", "ʌ", "ɾ", "ɡ", "iː",
    "əl", "uː", "z", "ᵻ", "v", "ʃ", "ɐ", "ŋ", "dʒ", "h", "w", "j", "ɜː", "θ", "ɔː", "iə", "ɔːɹ", "tʃ", "ɑːɹ", "ʊ", "aʊ", "ɔ", "ɔɪ",
    "ʊɹ", "ð", "ʒ", "ɪɹ", "ɛɹ", "aɪɚ", "aɪə", "ʔ", "n̩", "r", "x", "ɬ", "ɔ̃", "ɑ̃",
]
LEARNER_PHONES = [
    "e", "a", "o", "ø", "œ", "ɯ", "y", "ɨ", "eː", "aː", "ɛː", "øː", "r", "ɾ", "t̪", "d̪", "β", "ʋ", "c", "ɟ", "ɣ", "ç", "ɫ",
]
ARPABET = {
    "AA": "ɑː", "AE": "æ", "AH": "ʌ", "AO": "ɔː", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɜː", "EY": "eɪ", "IH": "ɪ", "IY": "iː",
    "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "uː", "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h",
    "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ",
    "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
UNSTRESSED = {"AH": "ə", "ER": "ɚ"}
ACCENTED = {"R": "ɾ"}
SILENCE = ("", "sil", "sp", "spn")
STOPS = ["p", "b", "t", "d", "k", "ɡ", "ʔ", "ɾ"]
FRICATIVES = ["f", "v", "θ", "ð", "s", "z", "ʃ", "ʒ", "h", "x", "ç", "ɣ", "β"]
AFFRICATES = ["tʃ", "dʒ"]
NASALS = ["m", "n", "ŋ", "n̩"]
LIQUIDS = ["l", "ɹ", "r", "ɫ", "l̩"]
GLIDES = ["w", "j"]
VOICED = ["b", "d", "ɡ", "v", "ð", "z", "ʒ", "dʒ", "m", "n", "ŋ", "n̩", "l", "l̩", "ɹ", "r", "ɾ", "w", "j", "β", "ɣ"]
# narrow transcription: marks that change no sound
NARROW_MARKS = [
    "ˈ", "ˌ", "ː", "ˑ", "ʰ", "ʲ", "ʷ", "ˠ", "ˀ", "˺",  # length, stress and small letters above
    "\u031a", "\u0303", "\u0306",  # no audible release, nasal, extra short
    "\u0325", "\u032c",  # voiceless, voiced
    "\u032a", "\u033a", "\u033b", "\u033c",  # dental, apical, laminal, linguolabial
    "\u031d", "\u031e", "\u031f", "\u0320",  # raised, lowered, advanced, retracted
    "\u0318", "\u0319", "\u0339", "\u031c",  # tongue root, rounding
    "\u0308", "\u033d", "\u032f",  # centralised, non-syllabic
    "\u035c", "\u0361", "\u203f",  # ties
]
NARROW_LETTERS = {"ʧ": "tʃ", "ʤ": "dʒ", "g": "ɡ", "ɝ": "ɜ", "ʉ": "u", "ɨ": "ɪ"}
# sounds of several letters, and vowels that are only long
NARROW_MULTI = ["aɪ", "aʊ", "eɪ", "oʊ", "ɔɪ", "tʃ", "dʒ", "n\u0329", "l\u0329"]
NARROW_LONG = {"ɑ": "ɑː", "ɜ": "ɜː"}
# sounds that may be left out of some words
OMITTED = {
    "ɹ": ["for", "or", "nor", "are", "were", "your", "our", "their", "there"], "h": ["her", "him", "his", "he", "have", "has", "had"],
}
# other ways to say a sound in some words; "" is none at all
OTHERS = {
    "and": {"æ": ["ɛ"], "d": [""]}, "with": {"ð": ["θ"]}, "of": {"ʌ": ["ɔ", "ɑː", "ɒ"]}, "from": {"ʌ": ["ɔ", "ɑː", "ɒ"]},
    "into": {"ʊ": ["uː", "u"]},
}

# --- derived ---------------------------------------------------------------------------------------------------------

SUBSTITUTION_TIPS = {(expected, heard): tip for tip, (expected, sounds) in PATTERNS.items() for heard in sounds}
#: word -> sound -> (other ways to say it, whether it may be left out)
WORD_VARIANTS: dict[str, dict[str, tuple[frozenset[str], bool]]] = {
    **{w: {p: (frozenset(v) - {""}, "" in v) for p, v in by.items()} for w, by in OTHERS.items()},
    **{w: {p: (frozenset(), True)} for p, words in OMITTED.items() for w in words},
}
ALLOWED_PHONES = frozenset(
    [*ENGLISH_PHONES, *LEARNER_PHONES, *ALIASES, *SPLITS, *(p for v in SPLITS.values() for p in v), *ACCEPT, *(p for v in ACCEPT.values() for p in v), *(p for pair in SUBSTITUTION_TIPS for p in pair), *DEVOICED.values()]
)
