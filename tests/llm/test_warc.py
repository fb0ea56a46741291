import hashlib
from html.parser import HTMLParser

import duckdb
import pytest

from siftmill.llm import queries, warc


def parsed(record):
    """(header fields, block) of a record, read as a WARC reader does."""
    head, block = record.split("\r\n\r\n", 1)
    version, *lines = head.split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    assert version == "WARC/1.1" and len(fields) == len(lines) == len(warc.HEADER)
    size = int(fields["Content-Length"])
    data = block.encode()
    assert data[size:] == b"\r\n\r\n"
    return fields, data[:size]


def test_derivatives(spark):
    html = "<html><script>x<p></script><p>a &amp; b</p><!-- c --><div>d<br>é</div></html>"
    df = spark.createDataFrame([(1, "http://a/", html), (2, None, None)], "page_id long, url string, html string")
    got = {(r["page_id"], r["kind"]): r for r in warc.derivatives(df).collect()}
    c, m = got[1, "conversion"], got[1, "metadata"]
    assert c["body"] == "a & b\nd\né" and c["refers_to"] == m["refers_to"] and c["record_id"] != m["record_id"]
    assert c["block_digest"] == "sha256:" + hashlib.sha256(c["body"].encode()).hexdigest() and c["content_length"] == len(c["body"].encode())
    assert m["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and m["source_digest"] in m["body"]
    assert c["related_id"] == m["record_id"] and m["related_id"] == c["record_id"] and c["record_id"] in m["body"]
    assert got[2, "conversion"]["body"] == "" and len(got) == 4 and warc.derivatives(df.limit(0)).count() == 0
    for r in got.values():
        fields, block = parsed(r["record"])
        assert block == r["body"].encode() and fields["WARC-Type"] == r["kind"] and fields["WARC-Refers-To"] == r["refers_to"]


def test_text_of():
    assert warc.text_of("caf&eacute; &#233;&#x2019;&amp;lt; a < b <3 <i>x</i>") == "café é’&lt; a < b <3 x"
    assert warc.text_of("kept<script>lost <p>all") == "kept" and warc.text_of("a<!-- open") == "a" and warc.text_of(None) == ""
    assert warc.text_of("<p>" + "word &copy; " * 200_000 + "</p>").count("©") == 200_000


def test_repeated_rows_and_odd_urls(spark):
    bad = "http://a/\r\nWARC-Type: response\r\n\r\nx"
    rows = [(1, bad, "p", 0, "k")] * 5 + [(None, "u", "q", 1, "k"), (2, "u", "<p>" + "long text " * 50_000, 2, "k"), (1, bad, "other", 0, "k")]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string, copy int, kind string").repartition(3)).collect()
    assert len(got) == 16 and len({r["record_id"] for r in got}) == 16 and len({r["refers_to"] for r in got}) == 8
    for r in got:
        fields, _ = parsed(r["record"])
        assert fields["WARC-Type"] == r["kind"] and "\n" not in r["target_uri"]
    by_id = {r["record_id"]: r for r in got}
    assert all(by_id[r["related_id"]]["refers_to"] == r["refers_to"] for r in got)


def test_source_values_are_passed_on(spark):
    rows = [(1, "u", "p", "<urn:uuid:1>", "2020-02-02T02:02:02Z", {"Server": "x\r\ny: z", "Content-Type": "text/html"}, "sha1:ABC"), (2, "u", "p", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, warc_date string, http_headers map<string,string>, payload_digest string")
    got = {(r["page_id"], r["kind"]): r for r in warc.derivatives(df).collect()}
    m = got[1, "metadata"]
    assert m["refers_to"] == got[1, "conversion"]["refers_to"] == "<urn:uuid:1>" and m["warc_date"] == "2020-02-02T02:02:02Z" and m["source_digest"] == "sha1:ABC"
    assert "http-header-content-type: text/html\r\nhttp-header-server: x%0D%0Ay: z\r\n" in m["body"]
    assert got[2, "metadata"]["source_digest"].startswith("sha256:") and got[2, "metadata"]["refers_to"].startswith("<urn:uuid:")
    assert [r["record_id"] for r in warc.derivatives(df.union(df)).collect()].__len__() == len({r["record_id"] for r in warc.derivatives(df.union(df)).collect()})


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_all_pages_against_sql_and_an_html_parser(spark, size):
    folder = f"/root/testdata/{size}"
    df = queries.op1_warc_derivatives(spark, folder)
    got = sorted(df.collect(), key=lambda r: (r["page_id"], r["kind"]))
    con = duckdb.connect()
    pages = {r[0]: r[1] for r in con.execute(f"select page_id, html from '{folder}/pages.parquet'").fetchall()}
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_warc_derivatives"]).df()
    assert sorted(want.columns) == sorted(df.columns)
    want = want.sort_values(["page_id", "kind"]).to_dict("records")
    assert [{c: r[c] for c in df.columns} for r in got] == [{c: r[c] for c in df.columns} for r in want]
    for r in got:
        if r["kind"] == "conversion":
            reader = _Reader()
            reader.feed(pages[r["page_id"]])
            reader.close()
            assert "".join(r["body"].split()) == "".join("".join(reader.words).split())
