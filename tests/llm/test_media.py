"""Signatures: every format inside foreign bytes, truncated, falsely announced, and several in one blob."""

from __future__ import annotations

import gzip
import struct

import pytest

from barograph.llm import media

SAMPLES = bytes(range(256)) * 9
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b";"
JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xda\x00\x04cd" + b"\x01\xff\x00\x02\xff\xd0\x03" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
BLOBS = {"image/png": media.write_png(SAMPLES), "image/bmp": media.write_bmp(SAMPLES), "audio/wav": media.write_wav(SAMPLES), "audio/basic": media.write_au(SAMPLES), "image/gif": GIF, "image/jpeg": JPEG, "application/gzip": gzip.compress(b"text" * 50), "application/pdf": PDF}


@pytest.fixture(scope="module")
def magics():
    return media.automaton()


@pytest.mark.parametrize("kind", sorted(BLOBS))
def test_a_format_is_found_where_it_lies(magics, kind):
    blob = BLOBS[kind]
    assert media.sniff(blob, magics) == [(0, len(blob), kind)]
    assert media.sniff(b"junk " + blob + b" tail", magics) == [(5, len(blob), kind)]


@pytest.mark.parametrize("kind", sorted(BLOBS))
def test_a_truncated_one_is_not_confirmed(magics, kind):
    assert kind not in [k for _, _, k in media.sniff(BLOBS[kind][:-3], magics)]


@pytest.mark.parametrize("kind", ["image/png", "image/bmp", "audio/wav", "audio/basic"])
def test_samples_come_back(kind):
    assert media.READERS[kind](BLOBS[kind]) == SAMPLES


def test_false_magics_are_passed_over(magics):
    for blob in (b"BMW drives", b"RIFF of guitars", b"see .snd files", b"\xff\xd8\xff\xff", b"%PDF- is a mark", b"GIF89a", b"\x1f\x8b\x08 no stream", media.PNG_MAGIC * 3, b"", None):
        assert media.sniff(blob, magics) == []


def test_several_in_one_blob_and_none_inside_another(magics):
    inner = BLOBS["audio/basic"]
    samples = inner + bytes(-len(inner) % media.UNIT)
    outer = media.write_wav(samples)
    blob = b"x" + outer + b"y" + GIF + PDF
    assert [k for _, _, k in media.sniff(blob, magics)] == ["audio/wav", "image/gif", "application/pdf"]


def test_a_column_is_carved_and_its_types_corrected(spark):
    rows = [(1, GIF, "image/png"), (2, b"a" + JPEG + b"b" + PDF, None), (3, b"nothing", "text/plain"), (4, None, "text/plain"), (5, b"", None)]
    got = {r["id"]: r for r in media.sniff_column(spark.createDataFrame(rows, "id int, blob binary, declared string"), "blob", "declared").collect()}
    assert {k: r["true_type"] for k, r in got.items()} == {1: "image/gif", 2: "image/jpeg", 3: "text/plain", 4: "text/plain", 5: None}
    assert [bytes(m["bytes"]) for m in got[2]["media"]] == [JPEG, PDF] and got[2]["media"][0]["offset"] == 1
    assert got[3]["media"] == got[4]["media"] == got[5]["media"] == []
