from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modlark.llm import matroska as M
from modlark.llm import media


@given(st.binary(min_size=1, max_size=5000))
@settings(max_examples=60, deadline=None)
def test_round_trip(samples):
    data = M.mux(samples)
    parsed = M.parse(data)
    assert b"".join(data[at : at + n] for _, _, _, _, at, n in parsed.packets) == samples
    assert parsed.doc_type == "matroska" and parsed.tracks[1][M.BIT_DEPTH] == 8


def test_long_file_has_clusters_cues_and_times():
    data = M.mux(bytes(range(256)) * 3000)
    m = M.parse(data)
    assert len(m.clusters) == len(m.cues) == 4 and len(m.packets) == 4000
    times = [p[1] for p in m.packets]
    assert times == [k * 24_000_000 for k in range(4000)]
    assert all(data[c - 12 : c].find(b"\x1f\x43\xb6\x75") >= 0 or data[at : at + 4] == b"\x1f\x43\xb6\x75" for c, (_, _, at) in zip(m.clusters, m.cues))
    assert [time for time, _, _ in m.cues] == [k * 1024 * 24_000_000 for k in range(4)]


def element(key, payload, unknown=False):
    head = key.to_bytes((key.bit_length() + 7) // 8, "big")
    return head + (b"\xff" if unknown else M._size(len(payload))) + payload


def block(lacing, head, frames, key=M.SIMPLE_BLOCK, time=5):
    return element(key, b"\x81" + time.to_bytes(2, "big", signed=True) + bytes([128 | lacing << 1]) + head + b"".join(frames))


@pytest.mark.parametrize("unknown", [False, True])
def test_every_lacing(unknown):
    frames = [b"a" * 300, b"b" * 10, b"c" * 600, b"d"]
    xiph = bytes([3, 255, 45, 10, 255, 255, 90])
    cluster = M._uint(M.TIMESTAMP, 7) + block(M.NONE, b"", [b"zz"], time=-2) + block(M.XIPH, xiph, frames) + block(*(lambda l: (l[0], l[1], frames))(M._lace(frames)))
    cluster += element(M.BLOCK_GROUP, block(M.FIXED, b"\x02", [b"ab", b"cd", b"ef"], key=M.BLOCK))
    data = element(M.EBML, b"") + element(M.SEGMENT, element(M.CLUSTER, cluster, unknown) + element(M.CLUSTER, M._uint(M.TIMESTAMP, 9)), unknown)
    m = M.parse(data)
    got = [data[at : at + n] for _, _, _, _, at, n in m.packets]
    assert got == [b"zz", *frames, *frames, b"ab", b"cd", b"ef"] and len(m.clusters) == 2
    assert [p[1] for p in m.packets][:2] == [5_000_000, 12_000_000]
    assert [p[3] for p in m.packets] == [0, 1, 1, 1, 1, 3, 3, 3, 3, 2, 2, 2]


def test_malformed_media_are_null(spark):
    good = M.mux(b"x" * 400)
    df = spark.createDataFrame([(1, good), (2, good[:-5]), (3, b"\x00\x01"), (4, None), (5, b"")], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.parse_media(df).collect()}
    assert len(rows[1].packets) == 3 and rows[2].packets is None and rows[3].packets is None and rows[4].packets is None and rows[5].packets == []
    assert media.packet_table(df).count() == 3
    assert {r.doc_id: r.payload for r in media.read_samples(media.parse_media(df)).collect()}[1] == b"x" * 400


def test_digest(odd, empty):
    found = media.media_digest(odd).collect()
    expected = []
    for r in odd.collect():
        raw = (r.text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), hashlib.sha256(M.mux(padded)).hexdigest()))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in found) == sorted(expected)
    assert media.media_digest(empty).count() == 0


def test_odd_bytes_are_null_and_never_crash(spark):
    r, good = random.Random(7), M.mux(bytes(range(256)) * 9)
    nested = b""
    for _ in range(3_000):
        nested = M._element(M.BLOCK_GROUP, nested)
    unknown = (M.BLOCK_GROUP.to_bytes(1, "big") + b"\xff") * 3_000
    rows = [M._element(M.EBML, M._element(M.DOC_TYPE, b"\xff\xfe\x80")), nested, unknown, M._element(M.CUES, M._element(M.CUE, M._element(M.CUE_TIME, b"\xff" * 9)))]
    for _ in range(1_500):
        data = bytearray(good)
        for _ in range(r.randint(1, 12)):
            data[r.randrange(len(data) if r.random() < 0.5 else 300)] = r.randrange(256)
        rows.append(bytes(data[: r.randint(1, len(data))] if r.random() < 0.3 else data))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, media binary")
    found = {x.doc_id: x.packets for x in media.parse_media(df).collect()}
    assert len(found) == len(rows) and found[0] == [] and found[1] is found[2] is found[3] is None
    assert M.parse(rows[0]).doc_type
