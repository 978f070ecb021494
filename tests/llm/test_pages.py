import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from llm.llm_support import SF
from pyspark.sql import functions as F

from arrearly.llm import html_text, queries, warc


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "- x\n- y\n  3. q\n  4. r\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>Al<td>10<tr><td>Bobby<td>2</table>",
         "Name   N\nAl     10\nBobby  2"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td>1<td>2<td>3</table>", "wide     c\n1     2  3"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("<div hidden>no</div><p style='display: none'>no<p>yes<script>no</script>", "yes"),
        ("<title>no</title><style>p{}</style>x<!-- no -->y<br>w&amp;&lt;", "xy\nw&<"),
        ("a < b <c", "a < b"),
        ("</p></div>text<td>x</td>", "textx"),
        ("<details><summary>s</summary>no</details><dialog>no</dialog>", "s"),
        ("", ""), (None, None), ("<<<>>>", "<<<>>>"),
    ],
)
def test_layout(html, want):
    assert html_text.html_text(html) == want


def test_deep_and_long_pages():
    assert html_text.html_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_text.html_text("<b>y " * 20_000).count("y") == 20_000
    assert len(html_text.html_text("word " * 200_000)) == 999_999


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (None, None, None), (1, "<p>a", "old")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [
        (1, "<p>a", "a"), (None, None, None), (1, "<p>a", "a"),
    ]
    assert html_text.extract(df.limit(0)).count() == 0
    assert queries.op3_html_extraction(spark, SF).where("text = ''").count() == 0


# --- archives --------------------------------------------------------------------

PAGES = [
    (5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "other"), (3, "u", None), (4, "u", ""),
    (None, "n", "same"), (None, "n", "nobody"), (None, "n", "nobody"), (2, "again", "same"),
    (7, "é", "é" * 300_000),
]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "files")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    warc.write_archives(warc.page_records(pages), path)
    return path


def test_payloads_are_stored_once(spark, archive):
    rows = warc.read_archives(spark, archive).withColumn("id", warc.page_id("record_id")).collect()
    got = sorted(
        ((r.id, r.record_type, r.payload_digest, int(r.payload_length), bytes(r.payload)) for r in rows),
        key=repr,
    )
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        kind = "response" if not ids or i == min(ids) else "revisit"
        want.append((i, kind, "sha1:" + digest(b), len(b), b if kind == "response" else b""))
    assert got == sorted(want, key=repr)
    refers = {r.id: r.refers_to for r in rows if r.record_type == "revisit"}
    assert refers[5] == "<urn:page:2>" and refers[4] == "<urn:page:3>"
    assert {r.target_uri for r in rows if r.id == 9} == {None}
    assert {r.target_uri for r in rows if r.id == 2} == {"http://b/ X: y", "again"}


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = warc.page_records(pages, min_bytes=5).groupBy("payload_length", "record_type").count()
    assert {r.record_type for r in kinds.where("payload_length = '4'").collect()} == {"response"}
    assert warc.page_records(pages.limit(0)).count() == 0


def test_archives_are_standard_gzip(archive):
    from pathlib import Path

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(archive).glob("*.warc.gz")))
    assert whole.count(b"WARC/1.0\r\n") == len(PAGES)


def test_predicates_reach_the_reader(spark, archive):
    df = warc.read_archives(spark, archive).where("record_type = 'revisit' AND target_uri = 'n'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan and df.count() == 1
    reader = warc.WarcReader(warc.StructType.fromDDL("record_id string"), {"path": archive})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(kept) == 1 and len(reader.tests) == 1
    for filters, n in (
        ([warc.In(("record_type",), ("response",))], 7),
        ([warc.IsNull(("target_uri",))], 1),
        ([warc.IsNotNull(("refers_to",))], 3),
        ([warc.StringStartsWith(("target_uri",), "http://")], 2),
    ):
        reader = warc.WarcReader(warc.StructType.fromDDL("record_id string"), {"path": archive})
        assert not list(reader.pushFilters(filters))
        found = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        assert found == n


def test_unwanted_payloads_are_not_inflated(spark, archive, monkeypatch):
    """Members are stepped over: far less is inflated than the payloads hold."""
    inflated = 0
    read = warc._Inflated.readinto

    def counting(self, into):
        nonlocal inflated
        n = read(self, into)
        inflated += n or 0
        return n

    monkeypatch.setattr(warc._Inflated, "readinto", counting)
    reader = warc.WarcReader(warc.StructType.fromDDL("record_id string"), {"path": archive})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(PAGES)
    assert inflated < 4096 * (len(PAGES) + 1) < 600_000


def test_foreign_archives(spark, tmp_path):
    """Plain files, and members that do not say how long they are."""
    records = [
        b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nde\r\n\r\n",
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.txt").write_text("no archive")
    rows = warc.read_archives(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"abc", b"abc", b"de", b"de"]
    assert warc.read_archives(spark, str(tmp_path), "record_type string").count() == 6


def test_empty_folder(spark, tmp_path):
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    by = defaultdict(list)
    for p in pages:
        by[(p.html or "").encode()].append(p.page_id)
    found = {r.page_id: r for r in queries.op7_warc_round_trip(spark, SF).collect()}
    assert len(found) == len(pages)
    for p in pages:
        b = (p.html or "").encode()
        r, first = found[p.page_id], min(by[b])
        assert (r.payload_bytes, r.payload_digest) == (len(b), digest(b))
        assert (r.record_type, r.refers_to) == (
            ("response", None) if first == p.page_id else ("revisit", first)
        )
