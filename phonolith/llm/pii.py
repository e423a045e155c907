"""Personal data: exact patterns, and further spans by a linear-chain conditional random field.

The field labels words by the shape of each word and its neighbours. It is trained here, on a small labelled table that
``labelled()`` writes out from templates. Whole texts are decoded by Viterbi, many lines at a time in NumPy; a line of
over ``LINE`` words is decoded in runs of that many, each with ``MARGIN`` more words of the line on either side, whose
labels are not used. Pattern spans always stay; a span of the field is added if it holds
what its kind needs and overlaps no pattern span.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("", *KINDS)
LINE, MARGIN = 256, 32
# Each pattern is tried once at a place from which it could begin, so that long runs of one kind take linear time. Emails
# are read from their @: what stands before it, and this after it.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# what a run of labelled words must hold to be a span of its kind
_CORES = {
    "email": re.compile(r"(?<![^\s\"'<>(),;:=@])[^\s\"'<>(),;:=@]++@[^\s\"'<>(),;:=]*[A-Za-z0-9]"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?\(?[0-9][0-9()\x20.-]*[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9_+/-]{16,}"),
}


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    while (at := text.find("@", low)) >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, low)):
            yield start, m.end()
            low = m.end()


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the exact patterns, leftmost and not overlapping for each kind, in order."""
    out = [("email", start, end) for start, end in _emails(text)]
    for kind, pattern in _PATTERNS.items():
        for m in pattern.finditer(text):
            found = m[0]
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x[-3:]) > 255 for x in found.split(".")):
                continue
            digits = re.sub("[^0-9]", "", found) if kind != "ip" else ""
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


# --- the field -------------------------------------------------------------------------------------------------------

_DIGITS = np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 20], np.arange(21), "right")
_FIELDS = (10, 3, 2, 2, 2, 2, 3, 2, 2, 2)  # values of each part of a shape
SHAPES = int(np.prod(_FIELDS))


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_DIGIT, _IS_LETTER = _marks(b"0123456789"), _marks(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def shapes_of(words: W.Words) -> np.ndarray:
    """The shape of each word: digits and letters by number, and whether it has or starts with certain signs."""
    data, n = words.data, len(words.starts)
    if not n:
        return np.empty(0, np.int32)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[words.ends] - total[words.starts]

    # few words hold digits or signs: the rest have one shape for each number of letters
    odd = count(_marks(b"0123456789@+()-.\"'=:")[data]) > 0
    letters = np.searchsorted([1, 4], words.ends - words.starts, "right")
    fields = [np.zeros(n, np.int32) for _ in _FIELDS]
    fields[1] = letters.astype(np.int32)
    at = np.flatnonzero(odd)
    if len(at):
        own = W.Words(words.data, words.offsets, words.starts[at], words.ends[at], words.doc[at])
        words = own
        digits, letters = count(_IS_DIGIT[data]), count(_IS_LETTER[data])
        first, dots = data[own.starts], count(data == 46)
        dots -= data[own.ends - 1] == 46
        parts = (
            _DIGITS[np.minimum(digits, 20)],
            np.searchsorted([1, 4], letters, "right"),
            count(data == 64) > 0,
            first == 43,
            first == 40,
            count(data == 45) > 0,
            np.clip(dots, 0, 3) // 2 + (dots == 1),
            count(_marks(b"\"'")[data]) > 0,
            count(_marks(b"=:")[data]) > 0,
            (digits >= 3) & (letters >= 3) & (digits + letters >= 16),
        )
        for field, part in zip(fields, parts, strict=True):
            field[at] = part
    out = np.zeros(n, np.int32)
    for size, field in zip(_FIELDS, fields, strict=True):
        out = out * size + field
    return out


# The labelled table: forms of each kind (# is a digit, x a hexadecimal digit, w a letter), words before them that name
# the kind, and what isn't personal. Addresses are of the ranges and names that are reserved for documentation.
_FORMS = {
    "phone": ["+# ### ### ####", "+# (###) ###-####", "(###) ###-####", "(###) ### ####", "###-###-####", "###.###.####", "+## # ## ## ## ##", "+## ## #### ####", "+############", "+#-###-###-####"],
    "card": ["################", "###################", "#### #### #### ####", "####-####-####-####", "#### ###### #####"],
    "email": ["wwww.wwwwww@example.com", "w.wwwwww##@wwww.example.org", "wwwww_ww@example.net", "www##@wwww#.example.com", "wwww@localhost"],
    "ip": ["192.0.2.#", "198.51.100.##", "203.0.113.###", "###.##.##.###"],
    "secret": ["x" * 32, "x" * 40, "x" * 64, '"' + "x" * 24 + '"', '"' + "x" * 40 + '"'],
    "": ["#", "##", "###", "####", "#,###", "###,###", "#.##", "##.", "(##)", "##%", "$##.##", "###$", "=###", "##:##", "####-##-##", "####-####", "v#.#.#", "##w", "w#", "(c) ####", "(www", "...", "=", "w.w.", "www-wwwww", "ww'w", '"www', "www'"],
}
_CUES = {
    "phone": ["phone", "tel:", "call", ""], "card": ["card", "paid with", ""], "email": ["mail", "write to", ""], "ip": ["host", "address", ""],
    "secret": ["token =", "key:", "secret =", "password =", "api key"], "": [""],
}
_PLAIN = ["w", "ww", "www", "wwww", "wwwww", "wwwwww,", "wwwwwwww.", "wwwwwww!", "www?", "é", "wwwé", "***", "--"]


def labelled(forms: dict[str, list[str]] = _FORMS, cues: dict[str, list[str]] = _CUES, plain: list[str] = _PLAIN, times: int = 12, seed: int = 7) -> list[list[tuple[str, str]]]:
    """A training table: lines as lists of (word, label), each form between plain words, with and without a cue."""
    rng = np.random.default_rng(seed)
    draw = {"#": "0123456789", "x": "0123456789abcdef", "w": "abcdefghijklmnopqrstuvwxyz"}
    filled = lambda form: "".join(draw[c][rng.integers(0, len(draw[c]))] if c in draw else c for c in form)
    some = lambda: [(filled(plain[rng.integers(0, len(plain))]), "") for _ in range(rng.integers(0, 6))]
    out = []
    for label, own in forms.items():
        for form in own:
            for _ in range(times if label else times * 4 // 3):
                cue = cues[label][rng.integers(0, len(cues[label]))].split()
                mark = ["", "", "", ",", "."][rng.integers(0, 5)]
                out.append([*some(), *((w, "") for w in cue), *((w, label) for w in (filled(form) + mark).split(" ")), *some()])
    return out


def _attributes() -> np.ndarray:
    """Attribute numbers of each shape: its parts, and digits with letters together."""
    parts = np.array(np.unravel_index(np.arange(SHAPES), _FIELDS)).T
    start = np.concatenate([[0], np.cumsum(_FIELDS)[:-1]])
    both = sum(_FIELDS) + parts[:, 0] * 3 + parts[:, 1]
    signs = sum(_FIELDS) + 30 + parts[:, 0] * 4 + parts[:, 3] + 2 * parts[:, 4]
    return np.column_stack([parts + start, both, signs])


N_ATTRIBUTES = sum(_FIELDS) + 30 + 40


def train(rows: list[list[tuple[str, str]]] | None = None, steps: int = 120, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each label by shape of the previous, own and next word, and of each label after another.

    Full-batch gradient ascent (Adam) on the log likelihood with weight decay; no random start, so reruns agree.
    """
    rows = labelled() if rows is None else rows
    words = [W.split(pa.array([" ".join(w for w, _ in row)])) for row in rows]
    most, n_labels = max(map(len, rows)), len(LABELS)
    shape = np.full((len(rows), most + 2), SHAPES)
    gold = np.zeros((len(rows), most), np.int64)
    for i, (row, own) in enumerate(zip(rows, words, strict=True)):
        shape[i, 1 : len(row) + 1] = shapes_of(own)
        gold[i, : len(row)] = [LABELS.index(x) for _, x in row]
    sizes = np.array([*map(len, rows)])
    attributes = np.vstack([_attributes(), np.full(_attributes().shape[1], N_ATTRIBUTES)])  # outside the line: one of its own
    around = np.stack([attributes[shape[:, :-2]], attributes[shape[:, 1:-1]], attributes[shape[:, 2:]]])  # 3, rows, time, parts
    inside = np.arange(most) < sizes[:, None]
    flat = around.reshape(3, -1)
    weights, follow = np.zeros((3, N_ATTRIBUTES + 1, n_labels)), np.zeros((n_labels, n_labels))
    moments = [np.zeros_like(x) for x in (weights, weights, follow, follow)]
    gold_hot = np.eye(n_labels)[gold] * inside[..., None]
    pairs = inside[:, 1:, None, None] * np.eye(n_labels)[gold[:, :-1]][..., :, None] * np.eye(n_labels)[gold[:, 1:]][..., None, :]
    for step in range(1, steps + 1):
        score = sum(weights[c][around[c]].sum(2) for c in range(3))
        ahead = np.empty_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, most):
            x = ahead[:, t - 1, :, None] + follow
            top = x.max(1)
            ahead[:, t] = np.where(inside[:, t, None], score[:, t] + top + np.log(np.exp(x - top[:, None]).sum(1)), ahead[:, t - 1])
        back = np.zeros_like(score)
        for t in range(most - 2, -1, -1):
            x = follow + (score[:, t + 1] + back[:, t + 1])[:, None, :]
            top = x.max(2)
            back[:, t] = np.where(inside[:, t + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
        top = ahead[:, -1].max(1)
        total = top + np.log(np.exp(ahead[:, -1] - top[:, None]).sum(1))
        node = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + follow + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        slope = np.zeros_like(weights)
        off = (gold_hot - node) / len(rows)
        for c in range(3):
            for label in range(n_labels):
                slope[c, :, label] = np.bincount(flat[c], np.repeat(off[..., label].ravel(), around.shape[3]), N_ATTRIBUTES + 1)
        slopes = (slope - decay * weights, (pairs - edge).sum((0, 1)) / len(rows) - decay * follow)
        for value, grad, m, v in ((weights, slopes[0], *moments[:2]), (follow, slopes[1], *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.stack([weights[c][attributes].sum(1) for c in range(3)]).astype(np.float32), follow.astype(np.float32)


@lru_cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train()


def decode(shape: np.ndarray, starts: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The best label of each word (Viterbi; ties to the lower label). starts: of the lines among the words."""
    emit, follow = model
    n = len(shape)
    if not n:
        return np.empty(0, np.int8)
    ends = np.append(starts[1:], n)
    before, after = np.append(SHAPES, shape[:-1]), np.append(shape[1:], SHAPES)
    before[starts], after[ends - 1] = SHAPES, SHAPES
    score = emit[0][before] + emit[1][shape] + emit[2][after]
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), "left")  # lines longer than t
    trace = np.zeros((n, len(LABELS)), np.int8)
    best = score[starts]
    for t in range(1, int(lengths[0])):
        at = starts[: live[t]] + t
        x = best[: live[t], :, None] + follow
        trace[at] = x.argmax(1)
        best[: live[t]] = x.max(1) + score[at]
    out = np.zeros(n, np.int8)
    label = best.argmax(1).astype(np.int8)
    for t in range(int(lengths[0]) - 1, -1, -1):
        at = starts[: live[t]] + t
        out[at] = label[: live[t]]
        if t:
            label[: live[t]] = trace[at, label[: live[t]]]
    return out


def _decode_lines(shape: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``decode()`` of lines, the long ones in runs that overlap."""
    pieces = -(-lengths // LINE)
    line = np.repeat(np.arange(len(starts)), pieces)
    low = starts[line] + LINE * (np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = (starts + lengths)[line]
    high = np.minimum(low + LINE, end)
    first, last = np.maximum(low - MARGIN, starts[line]), np.minimum(high + MARGIN, end)
    sizes = last - first
    at = np.cumsum(sizes) - sizes
    place = np.repeat(first - at, sizes) + np.arange(sizes.sum())
    own = (place >= np.repeat(low, sizes)) & (place < np.repeat(high, sizes))
    return decode(shape[place], at, model)[own]


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that spans cover together, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def spans_of(texts: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans (kind, start, end, whether a pattern has it), by kind and start, in code points."""
    words = W.split(texts)
    data, n_docs = words.data, len(words.offsets) - 1
    out: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(n_docs)]
    if not len(words.starts):
        return out
    counts = [np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in (_IS_DIGIT[data], data == 64)]
    digits, ats = (c[words.offsets[1:]] - c[words.offsets[:-1]] for c in counts)
    if np.any(may := (digits >= 4) | (ats > 0)):
        for i in np.flatnonzero(may):
            out[i] = [(*s, True) for s in pattern_spans(texts[i].as_py())]
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])[words.starts]
    new = np.ones(len(words.starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (words.doc[1:] != words.doc[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(new)))
    labels = _decode_lines(shapes_of(words), starts, lengths, model)
    hit = np.flatnonzero(labels)
    run = np.ones(len(hit), bool)
    run[1:] = (hit[1:] != hit[:-1] + 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (words.doc[hit[1:]] != words.doc[hit[:-1]])
    edge = np.append(np.flatnonzero(run), len(hit))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    blob, taken = data.tobytes(), {}
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        i, j, k = int(words.doc[hit[a]]), int(words.starts[hit[a]]), int(words.ends[hit[b - 1]])
        kind = LABELS[labels[hit[a]]]
        shift = int(points[j] - points[words.offsets[i]])
        if i not in taken:
            taken[i] = _union([(s, e) for _, s, e, _ in out[i]])
        for m in _CORES[kind].finditer(blob[j:k].decode("utf-8")):
            n = sum("0" <= c <= "9" for c in m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "phone" and not 7 <= n <= 15) or (kind == "card" and not _luhn(re.sub("[^0-9]", "", m[0]))) or (kind == "secret" and (n < 3 or n == len(m[0]))):
                continue
            start, end = shift + m.start(), shift + m.end()
            starts_, ends_ = taken[i]
            at = bisect.bisect_right(ends_, start)  # spans of the field follow each other, so only those of patterns can be in the way
            if at == len(starts_) or starts_[at] >= end:
                out[i].append((kind, start, end, False))
    for own in out:
        own.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


_SPANS = "array<struct<kind:string,start:int,end:int,by_pattern:boolean>>"


def find(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``documents`` with ``pii``: spans (kind, start, end, by_pattern) of every text, in code points, end exclusive.

    Null and empty texts have none. Every row is read on its own, so repeated rows agree; a column ``pii`` is replaced,
    others pass through. The model (a few MB at any size of the data) goes to the tasks with the code.
    """
    model = default_model() if model is None else model
    kept = documents.drop("pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("by_pattern", pa.bool_())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = [[dict(zip(("kind", "start", "end", "by_pattern"), s, strict=True)) for s in own] for own in spans_of(part.column("text"), model)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "pii"])

    return kept.mapInArrow(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"pii {_SPANS}"]))


def redact(found: DataFrame) -> DataFrame:
    """The texts with every span replaced by its kind in angle brackets (``<EMAIL>``).

    Overlapping spans are replaced as one, by the kind of the one that starts first, then of the longest.

    Takes and drops ``pii``, as ``find()`` returns it; null texts stay null.
    """
    # walk the spans by place: what is written so far, and where the rest of the text starts
    step = F.aggregate(
        F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end")))),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda x, s: F.when(s["start"] < x["at"], F.struct(x["done"].alias("done"), F.greatest(x["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(x["done"], F.col("text").substr(x["at"] + 1, s["start"] - x["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("done"), s["end"].alias("at"))
        ),
        lambda x: F.concat(x["done"], F.col("text").substr(x["at"] + 1, F.length("text"))),
    )
    return found.withColumn("text", F.when(F.size("pii") > 0, step).otherwise(F.col("text"))).drop("pii")
