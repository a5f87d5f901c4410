import hashlib
import random
import zlib

import pytest

from pagewright.llm import mpeg as M
from pagewright.llm import warc as W


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1416, 1417, 1418, 1344, 5000, 100_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = M.encode(data)
    audio = M.decode(media)
    assert M.payload_of(audio) == (n, M.pad(data)) and media == M.encode(data)
    assert len(M.pad(data)) % 64 == 0 and len(M.pad(data)) >= 64
    assert audio.table_frames == len(audio.offsets) and not audio.gaps and not audio.bad_checksums
    assert audio.table_bytes == len(media) - media.find(b"\xff\xfa") and len(audio.toc) == 100 and list(audio.toc) == sorted(audio.toc)
    assert audio.duration_us == len(audio.offsets) * 1152 * 1_000_000 // 32000


def test_checksum_polynomial():
    # CRC-16 with polynomial 0x8005 and start value 0xFFFF of the usual nine digits.
    assert M.crc16(b"123456789") == 0xAEE7


def test_frame_lengths_of_common_headers():
    assert M.read_header(bytes.fromhex("fffb9064")).length == 417  # 128 kbit/s, 44.1 kHz
    assert M.read_header(bytes.fromhex("fffb9264")).length == 418  # with padding
    assert M.read_header(bytes.fromhex("fff38064")).samples == 576  # version 2
    assert M.read_header(bytes.fromhex("ffff9064")).layer == 1
    for bad in ("fffbf064", "fffb0064", "fffb9c64", "ffe39066"[:6] + "66", "00fb9064", "fff9"):
        assert M.read_header(bytes.fromhex(bad)) is None


def test_damage_is_skipped():
    media = M.encode(("word " * 5000).encode())
    good = M.decode(media)
    broken = bytearray(media)
    broken[good.offsets[4] : good.offsets[4] + 4] = b"xxxx"
    found = M.decode(bytes(broken))
    assert len(found.offsets) == len(good.offsets) - 1 and found.gaps == [(good.offsets[4], good.offsets[5])]
    assert M.payload_of(found) is None
    cut = media[: good.offsets[6] - 500] + media[good.offsets[6] :]
    found = M.decode(cut)
    assert len(found.offsets) == len(good.offsets) - 1 and len(found.gaps) == 1
    side = bytearray(media)
    side[good.offsets[2] + 10] ^= 1  # inside the side information
    assert M.decode(bytes(side)).bad_checksums == 1
    tagged = M.decode(media + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["TIT2"] == b"Title" and len(tagged.offsets) == len(good.offsets)
    for junk in (b"", b"ID3", b"\xff" * 50, random.Random(1).randbytes(3000)):
        assert M.payload_of(M.decode(junk)) is None


def test_media_column(spark, odd, none):
    rows = M.media_features(odd).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(M.pad((r.text or "").encode())).hexdigest()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.payload_sha256) for r in rows) == want
    text = {str(r.doc_id): M.pad((r.text or "").encode()) for r in odd.collect()}
    for r in rows:
        if str(r.doc_id) != "3":
            payload = text[str(r.doc_id)]
            assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
            assert r.media_sha256 == hashlib.sha256(M.encode(payload[: r.n_bytes])).hexdigest()
    assert M.media_features(none).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert M.read_media(null).first().frames == 0


PAYLOAD = b"<html>" + b"x" * 200


def pages(spark):
    rows = [
        (5, "http://a/", PAYLOAD.decode()), (2, "http://b/\r\nX: y", PAYLOAD.decode()), (9, None, PAYLOAD.decode()), (1, "http://c/", "short"),
        (3, "http://d/", "short"), (4, "http://e/", None), (6, "http://f/", ""), (7, "http://\u00e9/", "\u00e9" * 50), (8, "u", "\u00e9" * 50),
        (10, "u", "\u00e9" * 49 + "x"), (11, "u", "WARC/1.1\r\n" * 30), (2, "http://b/", PAYLOAD.decode()), (None, "n", PAYLOAD.decode()),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)


def test_write_and_read(spark):
    df = pages(spark)
    found = W.read_archives(W.write_archives(df, segment_bytes=600), with_payload=True).collect()
    assert not [r for r in found if r.gap_reason]
    assert len(found) == 13
    by = {}
    for r in found:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in by[5]] == [("revisit", 2, len(PAYLOAD))]
    assert {r.record_type for r in by[2]} == {"response"} and by[9][0].refers_to == 2 and by[None][0].refers_to == 2
    assert {by[k][0].record_type for k in (1, 3, 4, 6, 7, 10, 11)} == {"response"}
    assert by[8][0].refers_to == 7 and by[8][0].payload_bytes == 100 and by[10][0].payload_bytes == 99
    for r in df.collect():
        payload = (r.html or "").encode()
        own = by[r.page_id][0]
        assert (own.payload_bytes, own.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        if own.record_type == "response":
            assert bytes(own.payload) == payload
    assert "\r" not in by[2][0].url
    assert W.read_archives(W.write_archives(df.filter("1 = 0"))).count() == 0


def blob(n, packed):
    out = []
    for i in range(n):
        p = f"payload {i} ".encode() * i
        record = W.make_record(i, "http://x/", p, hashlib.sha256(p).hexdigest())
        out.append(W.member(record) if packed else record)
    return out


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(60))
def test_salvage(seed, packed):
    r = random.Random(seed)
    parts = blob(12, packed)
    data = bytearray(b"".join(parts))
    at, n = r.randrange(len(data)), r.randrange(1, 60)
    if seed % 3 == 0:
        del data[at : at + n]
    else:
        data[at : at + n] = r.randbytes(min(n, len(data) - at)) if seed % 3 == 1 else b"\x1f\x8b\x08" * 3
    found = W.salvage(bytes(data))
    assert sum(x.length for x in found.records) + sum(b - a for a, b, _ in found.gaps) == len(data)
    ids = [x.page_id for x in found.records]
    touched, begin = set(), 0
    for i, p in enumerate(parts):
        if begin < at + n and at < begin + len(p):
            touched.add(i)
        begin += len(p)
    # Nothing protects the headers of a record that is not compressed, so a touched one may come with any id.
    whole = [i for i in ids if i in set(range(12)) - touched]
    assert whole == sorted(set(range(12)) - touched)
    for x in found.records:
        assert x.payload is None or not packed or hashlib.sha256(x.payload).hexdigest() == x.digest


def test_salvage_of_junk():
    assert W.salvage(b"").records == [] and W.salvage(b"junk").gaps == [(0, 4, "version line")]
    cut = b"".join(blob(3, True))[:-5]
    found = W.salvage(cut)
    assert len(found.records) == 2 and found.gaps[-1][1] == len(cut)


def test_archive_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(blob(5, True)))
    (tmp_path / "b.warc").write_bytes(b"xx" + b"".join(blob(4, False)))
    rows = W.read_archive_files(spark, str(tmp_path)).collect()
    assert sum(r.gap_reason is None for r in rows) == 9 and sum(r.gap_reason is not None for r in rows) == 1


@pytest.mark.parametrize("hurt", range(6))
def test_a_damaged_record_inside_a_member_of_several(hurt):
    records = blob(6, False)
    broken = [bytearray(r) for r in records]
    broken[hurt][-10 if hurt else 3] ^= 1
    before, after = W.member(records[1]), W.member(records[2])
    data = before + W.member(b"".join(map(bytes, broken))) + after
    found = W.salvage(data)
    assert [x.page_id for x in found.records] == [1, *(i for i in range(6) if i != hurt), 2]
    assert len(found.gaps) == 1 and found.gaps[0][:2] == (len(before), len(data) - len(after))
    assert sum(x.length for x in found.records) + sum(b - a for a, b, _ in found.gaps) == len(data)


def test_a_cut_member_of_several_gives_the_records_before_the_cut():
    r = random.Random(4)
    records = []
    for i in range(6):
        p = r.randbytes(5000)
        records.append(W.make_record(i, "http://x/", p, hashlib.sha256(p).hexdigest()))
    whole, last = W.member(b"".join(records)), W.member(records[3])
    for data, ids in ((whole[: len(whole) // 2] + last, [0, 1, 3]), (whole[: len(whole) * 9 // 10], [0, 1, 2, 3, 4]), (whole[:-4] + b"xxxx" + last, [*range(6), 3])):
        found = W.salvage(data)
        assert [x.page_id for x in found.records][: len(ids) - 1] == ids[:-1] and found.records[-1].page_id == ids[-1]
        assert sum(x.length for x in found.records) + sum(b - a for a, b, _ in found.gaps) == len(data)


def test_files_that_are_too_large_become_gaps(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(blob(5, True)))
    (tmp_path / "b.warc").write_bytes(b"".join(blob(40, False)))
    monkeypatch.setattr(W, "LARGEST_FILE", 5000)
    rows = W.read_archive_files(spark, str(tmp_path), with_payload=True).collect()
    assert sum(r.gap_reason is None for r in rows) == 5
    assert [r.gap_reason for r in rows if r.archive.endswith("b.warc")] == ["larger than one task reads"]


def test_a_payload_that_a_third_of_all_pages_share(spark, monkeypatch):
    from pagewright.llm import common

    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(common, "MOST_HOT", 3)
    rows = [(i, "u", PAYLOAD.decode() if i % 3 == 0 else f"page {i % 7} " * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: (r.record_type, r.refers_to) for r in W.read_archives(W.write_archives(df)).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert found == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h in rows}


def bits(text):
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def crc_of_bits(text):
    crc = 0xFFFF
    for b in text:
        top = (crc >> 15) ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def layered(layer, word, fields):
    """A protected frame of layer I or II whose first bits after the checksum are ``fields``."""
    head = M.read_header(word)
    assert head.layer == layer and head.protected
    crc = crc_of_bits("".join(f"{b:08b}" for b in word[2:]) + fields)
    return (word + crc.to_bytes(2, "big") + bits(fields)).ljust(head.length, b"\0")


#: Widths of the bit allocation of the subbands, for the two headers of layer II below.
WIDE = [4] * 11 + [3] * 12 + [2] * 7
LOW = [4] * 4 + [3] * 7 + [2] * 19


@pytest.mark.parametrize(
    "layer, word, widths, channels, bound",
    [
        (1, "fffe80c0", [4] * 32, 1, 32),  # mono
        (1, "fffe8000", [4] * 32, 2, 32),  # stereo
        (1, "fffe8050", [4] * 32, 2, 8),  # joint from subband 8 on
        (2, "fffca0c0", WIDE, 1, 30),
        (2, "fffcc000", WIDE, 2, 30),
        (2, "fffcc060", WIDE, 2, 12),
        (2, "fff480c0", LOW, 1, 30),  # version 2
    ],
)
def test_checksums_of_layers_one_and_two(layer, word, widths, channels, bound):
    r = random.Random(f"{layer}{word}")
    allocation, chosen = "", ""
    for band, n in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = r.choice([0, r.randrange(1 << n)])
            allocation += f"{value:0{n}b}"
            shared = 1 if band < bound else channels
            chosen += "".join(f"{r.randrange(4):02b}" for _ in range(shared)) if value else ""
    fields = allocation + (chosen if layer == 2 else "")
    frame = layered(layer, bytes.fromhex(word), fields)
    found = M.decode(frame * 3)
    assert len(found.offsets) == 3 and found.bad_checksums == 0
    for at in {0, len(fields) // 2, len(fields) - 1}:
        hurt = bytearray(frame)
        hurt[6 + at // 8] ^= 128 >> at % 8
        assert M.decode(frame + bytes(hurt) + frame).bad_checksums == 1


def test_durations_over_changing_rates():
    a, b = bytes.fromhex("fffb9064"), bytes.fromhex("fffb9464")  # 44.1 and 48 kHz
    one, two = (h.ljust(M.read_header(h).length, b"\0") for h in (a, b))
    found = M.decode(one * 5 + two * 7)
    assert found.rates == {44100: 5 * 1152, 48000: 7 * 1152}
    assert found.duration_us == (5 * 1152 * 1_000_000 * 48000 + 7 * 1152 * 1_000_000 * 44100) // (44100 * 48000)
