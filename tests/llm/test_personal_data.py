"""Personal data: the patterns against plain regular expressions, long lines and texts, and a held-out labelled table."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa

from phonolith.llm import pii, queries

SMALL = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_patterns_are_the_plain_expressions():
    rng = np.random.default_rng(0)
    for _ in range(20000):
        text = "".join(rng.choice(list("a@.+-1 2(9)é%4\n"), rng.integers(1, 60)))
        assert pii.pattern_spans(text) == plain_spans(text)
    for text in ("0000000001.002.3.255", "1.2.3.4.5.6.7.8", "1.2.3.256.1.1.1", "a@b.c@d.e", "x@@b.c", "@b.c", "4111-1111 1111 1111-", "a@b..c", "+1 (2) 3-4.5 6 78 +", "00000000000000000.0.0.0"):
        assert pii.pattern_spans(text) == plain_spans(text)


def test_query_is_the_plain_expressions_on_all_rows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op7_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in PLAIN)
        written = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        found = [s.split(":") for s in r.spans.split(",") if s]
        assert set(written) <= {":".join(s) for s in found}
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in found] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in found)
        for k, a, b in found:
            if f"{k}:{a}:{b}" not in written:
                assert not any(int(a) < e and s < int(b) for _, s, e in base)


def test_a_phone_is_found_at_every_place_of_a_long_line():
    texts = [" ".join(["word"] * n + ["call", "(743)", "555-3824"] + ["word"] * 40) for n in range(236, 300)]
    for text, own in zip(texts, pii.spans_of(pa.array(texts), pii.default_model()), strict=True):
        assert [(k, text[s:e]) for k, s, e, _ in own] == [("phone", "(743) 555-3824")]


def test_spans_of_several_kinds_keep_the_patterns():
    text = "é 4111 1111 1111 1111@b.example 10.1.2.3@b.example +12025550143@c.example"
    own = pii.spans_of(pa.array([text]), pii.default_model())[0]
    assert [s[:3] for s in own if s[3]] == plain_spans(text)


def test_time_grows_with_the_text():
    model = pii.default_model()
    many = " ".join(f"call (212) 555-{i % 10000:04d} a{i}@b.example" for i in range(50_000))
    long_words = ["a" * 1_000_000 + " 1234 @", "1" * 1_000_000, "1.1." * 250_000, "+1" + "(" * 1_000_000, "a.b" * 300_000 + "@" + "c." * 100, "x1@" * 300_000]
    began = time.time()
    assert len(pii.spans_of(pa.array([many]), model)[0]) == 100_000
    for text in long_words:
        pii.spans_of(pa.array([text]), model)
    assert time.time() - began < 30


def held_out():
    """Other forms, cues and words than the training table's."""
    forms = {
        "phone": ["(##) ####-####", "+### ## ### ####", "### #### ####", "+# ###.###.####"], "card": ["#### #### #### ### ####", "#################", "####-######-#####"],
        "email": ["ww-www@wwwww.wwww.example", "w##w@www-www.example.org", "WWW.www+ww@www.example"], "ip": ["10.##.#.###", "172.16.#.##", "#.#.#.#"],
        "secret": ["wxwx##wxwxw#wxw##wwx", "x" * 48, "ww_wwww_##xx#xx#xx#xxx#xx#"], "": ["#/#", "####/##", "w-####", "#.#.#", "p.##", "##w##", "#####", "#th", "##°", "[##]", "~##", "w=#", "##:##:##"],
    }
    cues = {"phone": ["ring", "fax", ""], "card": ["visa", ""], "email": ["at", ""], "ip": ["from", "server", ""], "secret": ["credential:", "bearer", "auth ="], "": ["about", ""]}
    return pii.labelled(forms, cues, ["Ww", "wwwwwwwww", "ww,", "www;", "(www", "www)", "wwww:", "œuvre", "ww-www"], times=40, seed=99)


def precision_and_recall():
    """Of the labels of words, on the held-out table."""
    table = held_out()
    shapes = [pii.shapes_of(pii.W.split(pa.array([" ".join(w for w, _ in row)]))) for row in table]
    lengths = np.array([*map(len, shapes)])
    got = pii._decode_lines(np.concatenate(shapes), np.cumsum(lengths) - lengths, lengths, pii.default_model())
    gold = np.array([pii.LABELS.index(label) for row in table for _, label in row])
    hit = ((got == gold) & (gold > 0)).sum()
    return hit / (got > 0).sum(), hit / (gold > 0).sum()


def test_field_on_a_held_out_table():
    precision, recall = precision_and_recall()
    assert precision > 0.8 and recall > 0.7
