"""Media of any bytes is read without stopping the job, and every part of a mix goes through the flow."""

import random

import pytest

from phonolith.llm import matroska as M
from phonolith.llm import mixing, queries

NAMES = [v for k, v in vars(M).items() if k.isupper() and isinstance(v, int) and v > 0x80 and k not in ("FRAME", "RATE")]


def anything(rng, depth=0):
    """Random elements: known and unknown names, sizes that are right, too large or unknown, integers of any length, blocks of any kind."""
    out = b""
    for _ in range(rng.randrange(1, 5)):
        name = rng.choice([*NAMES, 0xEC])
        if name in M._MASTERS and depth < 6:
            content = anything(rng, depth + 1)
        elif name in (M.SIMPLE_BLOCK, M.BLOCK):
            content = M.vint(rng.choice([1, 5, 2**40])) + rng.randbytes(2) + bytes([rng.randrange(256)]) + rng.randbytes(rng.randrange(30))
            content = content[: rng.choice([len(content), rng.randrange(len(content) + 1)])]
        else:
            content = rng.randbytes(rng.choice([0, 1, 8, 9, 200]))
        head = name.to_bytes((name.bit_length() + 7) // 8, "big")
        size = rng.choice([M.vint(len(content)), M.vint(len(content)), M.vint(len(content) + rng.randrange(99), 8), b"\xff", b"\x00"])
        out += head + size + content
    return out


def test_any_bytes_are_read(spark):
    rng = random.Random(1)
    media = [anything(rng) for _ in range(3000)] + [rng.randbytes(rng.randrange(300)) for _ in range(500)] + [b"", None]
    whole = M.mux(bytes(range(256)) * 30)
    for _ in range(1500):
        cut = bytearray(whole[: rng.randrange(len(whole))])
        for _ in range(rng.randrange(4) if cut else 0):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        media.append(bytes(cut))
    got = M.read_media(spark.createDataFrame([(k, m) for k, m in enumerate(media)], "id int, media binary")).collect()
    assert len(got) == len(media) and any(r.error for r in got) and any(r.packets and r.error for r in got)
    for r in got:
        assert all(0 <= p.offset and 0 <= p.length and p.offset + p.length <= len(r.media) for p in r.packets)


@pytest.mark.parametrize("bad", [M.element(M.TIMESTAMP, b"\xff" * 200), M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\0"), M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\0\0\x86")])
def test_what_came_before_a_break_is_kept(bad):
    block = M.element(M.SIMPLE_BLOCK, M.vint(2**40) + b"\0\0\0abc")
    read = M.parse(M.element(M.SEGMENT, M.element(M.CLUSTER, block + bad + block)))
    assert [(p.track, p.length) for p in read.packets] == [(2**40, 3)] and read.error


def test_every_part_goes_through_the_flow(spark, monkeypatch):
    calls = []
    flow = mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", lambda *a: calls.append(set(a[0])) or flow(*a))
    got = queries.op6_source_mixing(spark, "/root/testdata/sf0.001").collect()
    sources = {r.source for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source").collect()}
    assert set().union(*calls) == {(s,) for s in sources} and len(calls) == len(sources) and sum(r.taken for r in got) > 0
