"""The pipeline's stages against brute force on a small table."""

import numpy as np
from tests.llm.test_documents import classes, naive_measures
from tests.llm.test_near_copies import close, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from phonolith.llm import queries


def test_stages_are_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["quality_rules"]

    def clean(text):
        n, chars, symbols, lines, dup, again, letters, upper, echoes = naive_measures(text)
        return not (n < 20 or 100 * again > 30 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 15 * n or 2 * upper > letters > 0 or 2 * echoes > n)

    assert {r.doc_id for r in after} == {r.doc_id for r in before if clean(r.text)}

    before, after = kept["near_duplicates"]
    # stages on word shingles take five words and a similarity of 0.8 or more
    sets = {r.doc_id: shingles(r.text) for r in before}
    smallest = classes(list(sets), lambda a, b: close(sets[a], sets[b]))
    assert sorted(r.doc_id for r in after) == sorted(set(smallest.values()))

    before, after = kept["personal_data"]
    old = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(old)
    assert all(r.text == old[r.doc_id] or "<" in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
    assert not any("@mail" in r.text for r in after)

    before, after = kept["source_mix"]
    uses = {i: sum(r.doc_id == i for r in after) for i in {r.doc_id for r in before}}
    assert set(uses.values()) <= {0, 1, 2} and any(n == 2 for n in uses.values())

    before, after = kept["token_packing"]
    tokenizer = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == want == sum(len(np.frombuffer(r.ids, "<u4")) for r in after)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = "row string, uses string, quality string, pii string, size string, members string, bucket string, node string, text_hash string, rest string, doc string, ids string, start string"


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those that the stages use."""
    good = lambda k: " ".join(f"word{k}x{j}" for j in range(40 + k % 7))
    rows = [(k, good(k), "en", f"s{k % 3}", 9) for k in range(60)]
    rows += [(100, None, "en", "s0", 0), (101, "", "en", None, 0), (102, " \n\t", None, "s1", 3), (103, " ".join(good(1000 + k) for k in range(3000)), "en", "s1", 9)]
    rows += [(None, good(200), "en", "s1", 9), (None, good(200), "en", "s1", 9), (104, good(201) + " a.b@c.example", None, None, None), (5, good(5), "en", "s2", 9), (6, good(202), "en", "s2", 9)]
    return spark.createDataFrame([(*r, *["x"] * 13) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}").repartition(3)


def test_stages_of_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = out.collect()
        if name == "quality_rules":
            assert len(kept) == 66 and not {100, 101, 102} & {r.doc_id for r in kept}
        if name == "near_duplicates":
            # of the texts without a word one is left, of (5, ...) one, of rows without an id all, both texts of 6
            ids = [r.doc_id for r in kept]
            assert len(kept) == 66 and sum(i is None for i in ids) == 2 and ids.count(5) == 1 and ids.count(6) == 2 and {100, 101, 102} & set(ids) == {100}
        if name == "personal_data":
            held = {(r.doc_id, r.text): r.n_chars for r in kept}
            assert len(kept) == 69 and held[100, None] is None and held[101, ""] == 0 and any(t and t.endswith(" <EMAIL>") for _, t in held)
        if name == "source_mix":
            assert all(r.text and r.text.strip() for r in kept) and sum(r.doc_id is None for r in kept) > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and all(r.doc_tokens == 1 for r in packed if r.doc_id in (100, 101))
