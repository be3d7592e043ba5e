"""Sharding, license scans and WARC derivatives."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import licenses, sharding, warc
from tests.llm.conftest import EDGE_ROWS

NAMES = [f"s{i}" for i in range(7)]


def brute_table(shards, size):
    orders = []
    for name in shards:
        offset, stride = (int(hashlib.md5(f"{kind}:{name}".encode()).hexdigest()[:15], 16) for kind in ("offset", "stride"))
        orders.append([(offset % size + j * (stride % (size - 1) + 1)) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for shard, order in enumerate(orders):
            if len(table) < size:
                table[next(slot for slot in order if slot not in table)] = shard
    return [table[slot] for slot in range(size)]


def test_table_equals_brute_force_and_is_even():
    table = sharding.fill_table(NAMES, 251)
    assert table == brute_table(NAMES, 251)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_a_lost_shard_moves_few_slots():
    before, after = sharding.fill_table(NAMES, 2003), sharding.fill_table(NAMES[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after) if a != len(NAMES) - 1)
    assert moved < 0.1 * 2003


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 0 + ["a", "b", "c"], 2)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size)


def test_placement(make_docs):
    docs = make_docs(EDGE_ROWS)
    placed = sharding.place(docs, "doc_id", NAMES, 251)
    table = sharding.fill_table(NAMES, 251)
    rows = placed.collect()
    assert len(rows) == len(EDGE_ROWS) and sorted(placed.columns) == sorted(docs.columns)
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, NAMES[table[slot]])
    assert sharding.place(make_docs([]), "doc_id", NAMES).count() == 0


def test_written_shards_hold_every_row(spark, make_docs, tmp_path):
    docs = make_docs([(i, "t") for i in range(100)] + [(7, "hot")] * 50, clash=False)
    sharding.write_shards(docs, "doc_id", NAMES, str(tmp_path / "out"), files=2, size=251)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 150
    assert back.where("doc_id = 7").select("shard").distinct().count() == 1


def test_licenses(spark, make_docs, words):
    gpl = licenses.TEMPLATES["gpl-3.0"]
    rows = [
        (1, words(100, 1) + "\n" + gpl + "\n" + words(50, 2)),
        (2, gpl.upper()),
        (3, "This work is licensed under the GNU something else entirely"),
        (4, licenses.TEMPLATES["mit"] + " " + words(31, 3) + " " + licenses.TEMPLATES["apache-2.0"]),
        (5, " ".join(licenses.TEMPLATES.values())),
        (6, words(30, 6) + " " + gpl.replace("version 3", "version 2")),
    ] + EDGE_ROWS
    got = licenses.scan(make_docs(rows), licenses.template_table(spark)).collect()
    found = Counter((r.doc_id, r.template) for r in got)
    want = [(1, "gpl-3.0"), (2, "gpl-3.0"), (4, "mit"), (4, "apache-2.0"), *((5, name) for name in licenses.TEMPLATES), (6, "gpl-3.0")]
    assert found == Counter(want)
    assert {r.position for r in got if r.doc_id == 1} == {100}
    assert licenses.scan(make_docs([]), licenses.template_table(spark)).count() == 0
    assert licenses.scan(make_docs(rows), licenses.template_table(spark).limit(0)).count() == 0
    shuffled = licenses.scan(make_docs(rows), licenses.template_table(spark), max_shingles=2)
    assert Counter((r.doc_id, r.template) for r in shuffled.collect()) == found
    plan = licenses.scan(make_docs(rows), licenses.template_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def records(spark):
    html = "<html><head><title> A &amp; B </title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p>One<br>two</p><div>three &lt;b&gt; <a class=x HREF='u'>four</a></div><noscript>off"
    rows = [("response", "<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nServer: s", html.encode(), "sha1:KEPT")]
    rows += [("request", "<urn:uuid:2>", "http://a/", None, None, b"x", None), ("response", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, warc_date string, http_header string, payload binary, payload_digest string").withColumn("block", F.lit("clash"))


def test_derivatives_keep_what_they_refer_to(records):
    got = {(r.refers_to, r.record_type): r for r in warc.derivatives(records).collect()}
    assert len(got) == 4
    text, meta = got[("<urn:uuid:1>", "conversion")], got[("<urn:uuid:1>", "metadata")]
    assert bytes(text.block).decode() == "A & B\nOne\ntwo\nthree <b> four"
    assert text.payload_digest == meta.payload_digest == "sha1:KEPT" and text.target_uri == "http://a/"
    assert text.content_length == len(text.block) and text.block_digest == "sha256:" + hashlib.sha256(bytes(text.block)).hexdigest()
    fields = bytes(meta.block).decode()
    assert "title: A & B\r\n" in fields and "http-status: 404\r\n" in fields and "source-http-header: HTTP/1.1 404 Not Found\r\n Server: s\r\n" in fields and "links: 1\r\n" in fields
    assert text.record_id != meta.record_id
    assert bytes(got[(None, "conversion")].block) == b""


def test_serialized_records_can_be_read_back(records):
    for r in warc.serialize(warc.derivatives(records)).collect():
        data = bytes(r.record)
        head, rest = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Record-ID"] == r.record_id
        assert rest == rest[: int(fields["Content-Length"])] + b"\r\n\r\n"


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "http://x/", None), (None, None, ""), (2, "http://y/", "plain"), (2, "http://y/", "plain")], "page_id bigint, url string, html string")
    got = warc.digests(warc.derivatives(warc.responses_of_pages(pages))).collect()
    assert len(got) == 8 and warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_sharding_keys_named_like_outputs(spark):
    for name in ("shard", "slot", "_file"):
        df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], f"{name} string, other int")
        plain = sharding.place(df.withColumnRenamed(name, "key"), "key", ["a", "b", "c"])
        want = {r["other"]: (r["slot"], r["shard"]) for r in plain.collect()}
        assert {r["other"]: (r["slot"], r["shard"]) for r in sharding.place(df, name, ["a", "b", "c"]).collect()} == want


def test_warc_charsets(spark):
    def page(body, charset):
        header = f"HTTP/1.1 200 OK\r\nX: 1\r\nContent-Type: text/html{charset}\r\n"
        return ("response", f"<{body!r}{charset}>", "http://x.example", None, header, body, None)

    latin = "<title>caf\xe9</title><p>na\xefve</p>".encode("latin-1")
    rows = [
        page(latin, "; charset=ISO-8859-1"),
        page(b"<p>\x93quoted\x94 \x80</p>", ';charset="windows-1252"'),
        page(latin, ""),
        page("<p>漢字</p>".encode()[:-6], "; charset=utf-8"),
        page(b"\xff\xfe<p>x</p>", "; charset=made-up"),
    ]
    schema = "record_type string, record_id string, target_uri string, warc_date string, http_header string, payload binary, payload_digest string"
    made = warc.derivatives(spark.createDataFrame(rows, schema))
    got = {r["refers_to"]: bytes(r["block"]).decode() for r in made.where("record_type = 'conversion'").collect()}
    assert [got[row[1]] for row in rows] == ["café\nnaïve", "“quoted” €", "caf\ufffd\nna\ufffdve", "漢\ufffd", "\ufffd\ufffd\nx"]
