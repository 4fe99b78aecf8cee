from __future__ import annotations

import hashlib
import random

import pytest

from millrace.llm import warc

PAGE = "page_id bigint, url string, html string, n int"
LONG = "<p>" + "x" * 2000 + "</p>"


def sound(i=1, body=b"hello"):
    return warc.page_record(i, f"http://a.example/{i}", body, hashlib.sha1(body).hexdigest(), None)


def pieces(data):
    return [(start, size, r and r["fields"]["warc-record-id"]) for start, size, r, _ in warc.salvage(data)]


def test_round_trip(spark):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://b/3", LONG), (4, "u", "short"), (5, "u", "short"), (6, None, None),
            (7, "u\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\né"), (None, "u", LONG), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", "é" * 500), (11, "u", "é" * 500), (11, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], PAGE)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        response = {1: 3, 2: 3, None: 3, 10: 11}.get(i)
        want.append(((i or 0), len(body), hashlib.sha1(body).hexdigest(), "revisit" if response else "response", response))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}\r\n\r\n{'é' * i}</p>", 0) for i in range(50)], PAGE)
    folder = warc.new_folder(spark, "warc")
    warc.write(pages.coalesce(1), folder, file_bytes=1500)
    rows = warc.read(spark, folder).collect()
    assert {r.kind for r in rows} == {"record"}
    bodies = {r.uri: r.payload.decode() for r in rows if r.record_type == "response"}
    assert bodies == {f"http://h/{i}": f"<p>{i}\r\n\r\n{'é' * i}</p>" for i in range(50)}
    assert len({r.path for r in rows}) > 2


@pytest.mark.parametrize("pack", [warc.member, bytes], ids=["gzip", "plain"])
def test_salvage(pack):
    parts = [pack(sound(i, f"body {i} ".encode() * 40)) for i in range(4)]
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(5)]
    every = [(starts[i], len(parts[i]), f"<urn:page:{i}>") for i in range(4)]
    assert pieces(whole) == every
    hurt = bytearray(whole)
    hurt[starts[1] + 12 : starts[1] + 60] = b"\xff" * 48
    assert pieces(bytes(hurt)) == [every[0], (starts[1], len(parts[1]), None), *every[2:]]
    assert pieces(b"junk" + whole) == [(0, 4, None), *[(a + 4, b, c) for a, b, c in every]]
    # what is cut off a member is only its checksum: the record is whole
    before_cut = [(starts[3], 0, "<urn:page:3>")] * (pack is warc.member)
    assert pieces(whole[:-5]) == [*every[:3], *before_cut, (starts[3], len(parts[3]) - 5, None)]
    assert pieces(whole[: starts[1] + 30] + whole[starts[2] :]) == [
        every[0], (starts[1], 30, None), (starts[1] + 30, len(parts[2]), "<urn:page:2>"), (starts[1] + 30 + len(parts[2]), len(parts[3]), "<urn:page:3>"),
    ]


def test_wrong_digest_is_a_gap_and_its_inside_no_record():
    inner = sound(9)
    outer = warc.page_record(1, "http://a/", inner, "0" * 40, None)
    assert pieces(outer + sound(2)) == [(0, len(outer), None), (len(outer), len(sound(2)), "<urn:page:2>")]


@pytest.mark.parametrize("seed", range(20))
def test_random_damage_is_covered_and_sound_records_survive(seed):
    rng = random.Random(seed)
    parts = [rng.choice([warc.member, bytes])(sound(i, rng.randbytes(rng.randrange(300)))) for i in range(12)]
    hurt = set(rng.sample(range(12), 3))
    data, places = bytearray(), {}
    for i, part in enumerate(parts):
        places[len(data)] = i
        part = bytearray(part)
        if i in hurt:
            part = part[: len(part) // 2]
        data += part
    found = list(warc.salvage(bytes(data)))
    assert sum(size for _, size, _, _ in found) == len(data)
    assert all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert {places[s] for s, _, r, _ in found if r} == set(range(12)) - hurt


def test_nothing_and_only_junk():
    assert pieces(b"") == [] and pieces(b"\x1f\x8b\x08WARC/1.1\r\n") == [(0, 13, None)]


def test_all_records_of_one_member():
    bodies = [f"body {i} ".encode() * 50 for i in range(20)]
    whole = warc.member(b"".join(sound(i, b) for i, b in enumerate(bodies)))
    found = list(warc.salvage(whole + warc.member(sound(99))))
    assert [r["fields"]["warc-record-id"] for _, _, r, _ in found] == [f"<urn:page:{i}>" for i in [*range(20), 99]]
    assert [r["payload"] for _, _, r, _ in found[:20]] == bodies
    assert [(start, size) for start, size, _, _ in found] == [(0, len(whole)), *[(0, 0)] * 19, (len(whole), len(found) and len(warc.member(sound(99))))]


@pytest.mark.parametrize("cut", [6, 400])
def test_records_before_the_cut_of_a_member(cut):
    rng = random.Random(1)
    member = warc.member(sound(1, b"first " * 30) + sound(2, rng.randbytes(3000)))
    found = list(warc.salvage(member[:-cut] + warc.member(sound(3))))
    ids = [r and r["fields"]["warc-record-id"] for _, _, r, _ in found]
    assert ids == ["<urn:page:1>", *["<urn:page:2>"] * (cut == 6), None, "<urn:page:3>"]
    assert sum(size for _, size, _, _ in found) == len(member) - cut + len(warc.member(sound(3)))
    assert found[0][2]["payload"] == b"first " * 30 and found[0][1] == 0


def test_records_before_the_damage_of_a_member():
    rng = random.Random(2)
    member = bytearray(warc.member(b"".join(sound(i, rng.randbytes(40_000)) for i in range(4))))
    place = len(member) * 5 // 8
    member[place : place + 2000] = b"\xff" * 2000
    ids = [r and r["fields"]["warc-record-id"] for _, _, r, _ in warc.salvage(bytes(member))]
    assert ids[:2] == ["<urn:page:0>", "<urn:page:1>"] and ids[-1] is None


def test_a_damaged_record_inside_a_sound_member():
    parts = [sound(i, b"text " * 20) for i in range(3)]
    parts[1] = parts[1].replace(b"text text", b"TEXT text", 1)  # no longer what its digest says
    member = warc.member(b"".join(parts))
    found = list(warc.salvage(member))
    assert [r and r["fields"]["warc-record-id"] for _, _, r, _ in found] == ["<urn:page:0>", "<urn:page:2>", None]
    assert sum(size for _, size, _, _ in found) == len(member) and "digest" in found[-1][3]
