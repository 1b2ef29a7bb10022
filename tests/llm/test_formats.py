"""Round trips of the media, SentencePiece and archive operators, against plain libraries."""

import base64
import hashlib
import zlib

import pytest
import sentencepiece

from dotloom.llm import media, spiece, warc

TEXTS = ["", None, "one", "one", "a b  c\n\tü 漢字 🙂 \x00 end", "word " * 20_000, "x" * 64, "ÿ" * 63]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "m", 7) for i, t in enumerate(TEXTS)] + [(2, "one", "m", 7), (None, "one", "m", 7)], "doc_id long, text string, media string, n_bytes int").repartition(3)


def test_media_holds_every_byte(docs):
    rows = media.media_digests(media.text_to_media(docs)).collect()
    assert len(rows) == docs.count()
    seen = {}
    for r in rows:
        raw = (TEXTS[r.doc_id if r.doc_id is not None else 2] or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-64:])
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_media_damage_is_reported():
    good = media.write_jpeg([bytes(range(128))])[0]
    assert isinstance(media.read_jpeg([b"no jpeg", good[:20]])[0], str)
    width, _, thumb = media.read_jpeg([good])[0]
    assert width == 64 * 8 and bytes(thumb.astype("uint8").ravel()) == bytes(range(128))


def test_ids_are_those_of_the_library(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=spiece.DEFAULT_MODEL)
    for r in spiece.encode(docs).collect():
        t = TEXTS[r.doc_id if r.doc_id is not None else 2] or ""
        if "\x00" not in t:
            assert list(r.token_ids) == lib.encode(t)


def test_decoding_gives_the_text(docs):
    for r in spiece.decode(spiece.encode(docs)).collect():
        assert r.text == (TEXTS[r.doc_id if r.doc_id is not None else 2] or "")


@pytest.mark.parametrize("op", [lambda d: media.media_digests(media.text_to_media(d)), lambda d: spiece.decode(spiece.encode(d))])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_arc_versions_read_alike():
    for version in (1, 2):
        block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\n\n</p>"
        head = warc.arc_head(version, "a.arc")
        data = head + warc.arc_record(version, "http://a/", "20010203040506", "text/html", block, len(head), "a.arc")
        got = list(warc.parse_arc(data))
        assert got[-1]["block"] == block and warc.split_http(block)[1] == b"<p>\n\n</p>"
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.sha1_32(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def _read_back(pages):
    arc = warc.read_arc(warc.pages_to_arc(pages))
    return warc.read_warc(warc.write_warc(warc.mark_revisits(arc, warc.first_responses(arc))))


def test_archives_hold_every_page(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = {r.page_id: r for r in _read_back(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None)}
    assert got[2].refers_to_id == got[1].record_id and got[4].refers_to_id == got[3].record_id and got[1].refers_to_id is None
    for i, _, html in rows:
        assert got[i].payload_digest == warc.sha1_32((html or "").encode())


def test_null_ids_repeats_and_an_empty_table(spark):
    kind = "page_id long, url string, html string"
    rows = [(None, "http://n", "<p>x</p>"), (7, "http://a", "<p>x</p>"), (7, "http://a", "<p>x</p>"), (9, "http://b", "<p>x</p>"), (None, None, "alone"), (None, None, "alone")]
    got = _read_back(spark.createDataFrame(rows, kind).repartition(3)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(None, "revisit", 7), (7, "response", None), (7, "response", None), (9, "revisit", 7), (None, "response", None), (None, "response", None)], key=str)
    assert len({r.record_id for r in got}) == len(rows) and all(r.error is None for r in got)
    assert _read_back(spark.createDataFrame([], kind)).count() == 0


def test_damage_gives_the_records_before_it(spark):
    record = lambda k: warc.arc_record(1, f"http://{k}/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\n" + b"x" * k, 0, "a.arc")
    whole = warc.arc_head(1, "a.arc") + record(5) + record(6)
    cases = {"whole": whole, "cut": whole[:-4], "line": whole + b"http://z/ 1.2.3.4\n", "length": whole + b"http://z/ 0.0.0.0 20010203040506 text/html xx\n", "none": None}
    arc = warc.read_arc(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "name string, bytes binary")).collect()
    count = {k: sum(r.error is None for r in arc if r.record_id is not None and r.record_id in {warc.record_id(k, str(o), u, r.payload_digest) for o, u in ((len(warc.arc_head(1, "a.arc")), "http://5/"), (len(warc.arc_head(1, "a.arc") + record(5)), "http://6/"))}) for k in cases}
    assert count == {"whole": 2, "cut": 1, "line": 2, "length": 2, "none": 0}
    assert sum(r.error is not None for r in arc) == 3
    good = warc.to_warc("http://a", "20010203040506", b"", b"abc", warc.sha1_32(b"abc"), "<urn:uuid:1>")
    lied = warc.to_warc("http://a", "20010203040506", b"", b"abc", warc.sha1_32(b"abd"), "<urn:uuid:2>")
    rows = warc.read_warc(spark.createDataFrame([(bytearray(good + good[:-9]),), (bytearray(good + lied),)], "bytes binary")).collect()
    assert sorted(str(r.error) for r in rows) == ["None", "None", "gzip member without end", "payload digest differs"]
