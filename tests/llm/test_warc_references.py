"""Character references in conversion records, against ``html.unescape``."""

from __future__ import annotations

import html
from html.entities import html5

from broadsheet.llm import warc

WRITTEN = [
    "it&#8217;s caf&eacute; &mdash; x&#xE9;y&hellip;", "&#x1F600; &#128512;", "&amp;lt; &amp;amp;eacute;", "&copy 2024 &notit; &notin; &ampx",
    "&#150; &#x80; &#0; &#1; &#13x", "&#xD800; &#99999999; &#x110000; &#00000000233; &#xFFFE;", "&unknown; & && &; &#; &#x; a&b", "&nbsp;x&#160;y&#xa0;z&nbspw &#1600; &#xA01;",
    "&NotEqualTilde; &fjlig; &Aacute", "no reference",
]
WRITTEN += [f"a &{name} b" for name in sorted(html5)[::9]]
WRITTEN += [f"a &#{n}; b" for n in [*range(1, 300), 0xFDD0, 0x1FFFF, 0x10FFFF]]


def text_of(written):
    """Blanks of the kinds the operator collapses, in its way."""
    out = html.unescape(warc_blank(written))
    lines = [" ".join(part for part in line.replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if part) for line in out.split("\n")]
    return "\n".join(line for line in lines if line)


def warc_blank(written):
    for name in ("&nbsp;", "&nbsp", "&#160;", "&#xa0;"):
        written = written.replace(name, " ")
    return written


def test_references_equal_unescape(spark):
    rows = [("response", f"<urn:uuid:{k}>", "http://a/", None, None, f"<p>{w}</p>".encode(), None) for k, w in enumerate(WRITTEN)]
    records = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, warc_date string, http_header string, payload binary, payload_digest string")
    got = {r.refers_to: bytes(r.block).decode() for r in warc.derivatives(records).collect() if r.record_type == "conversion"}
    wrong = [(w, got[f"<urn:uuid:{k}>"], text_of(w)) for k, w in enumerate(WRITTEN) if got[f"<urn:uuid:{k}>"] != text_of(w)]
    assert not wrong
