"""WARC round trips and template-based extraction."""

import hashlib

import pytest
from pyspark.sql import functions as F

from keystrata.llm import html_extract, warc
from keystrata.llm.common import row_keyed

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ROWS = [(1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (3, None, None), (4, "ü \n", "é" * 600), (5, "u", "small"), (6, "u", "small"), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "é" * 600), (10, "u", "a\r\n\r\nb"), (None, "z", "x" * 2000)]


def test_warc_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    files = warc.write_warc(pages(spark, ROWS).withColumn("__sha", F.lit(1)), folder, roll_bytes=200)
    assert len(files) > 3 and files == warc.manifest_files(spark, folder)
    got = {r["record_id"]: r for r in warc.read_warc(spark, files).collect()}
    for i, _, html in ROWS:
        body = (html or "").encode()
        same = [j for j, _, h in ROWS if j is not None and (h or "").encode() == body]
        revisit = i is not None and len(body) >= 1000 and i < max(same)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", max(same)) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else body)
    assert len(got) == len(ROWS)


def test_warc_bytes_are_deterministic(spark, tmp_path):
    rows = [(i * 37 % 400, f"http://h/{i}", f"page {i} " * (i % 60)) for i in range(400)] + ROWS + ROWS[:4] + [(None, "z", f"{i}" * 900) for i in range(30)]
    rows += [(10**18, "far", "x"), (-(10**18), "far", "y" * 5000), (7, "same", "s" * 3000), (7, "same", "s" * 3000)]
    written = []
    for k, parts in enumerate((3, 16)):
        df = spark.createDataFrame(rows[::-1] if k else rows, SCHEMA).repartition(parts)
        files = warc.write_warc(df, f"file://{tmp_path}/{k}", range_bytes=20_000, roll_bytes=3000)
        written.append((tmp_path / f"{k}/manifest.json").read_bytes())
    assert written[0] == written[1] and len({f.split("part-")[1][:6] for f in files}) > 10
    assert not [p for p in (tmp_path / "0").iterdir() if ".tmp" in p.name]
    got = warc.read_warc(spark, files).collect()
    text = lambda i: "" if i is None else str(i)
    assert sorted(text(r["record_id"]) for r in got) == sorted(text(i) for i, _, _ in rows)
    assert sorted(r["payload_digest"] for r in got) == sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows)
    raw = [m for f in files for m in warc.members(open(f.removeprefix("file://"), "rb").read())]
    ids = [warc.parse_record(m)["headers"]["warc-record-id"] for m in raw]
    assert len(ids) == len(set(ids)) == len(rows) + len(files)  # each file opens with a warcinfo record


def test_warc_empty_and_damaged(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    assert warc.write_warc(pages(spark, ROWS).limit(0), folder) == [] and warc.read_warc(spark, []).count() == 0
    raw = next(warc.members(warc.record_bytes(1, "u", b"body", None)))
    assert warc.parse_record(raw)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"body", b"bodx"))
    with pytest.raises(ValueError):
        list(warc.members(warc.record_bytes(1, "u", b"body", None)[:-3]))


def page(i, body, main=True):
    inner = f"<article><h1>Title {i}</h1>{body}</article>" if main else f'<div class="content"><h1>Title {i}</h1>{body}</div>'
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home {i}</a></ul></nav><!-- c -->'
        f'<div class="cookie-notice">We use cookies {i}</div>{inner}<div class="ad">Buy {i}</div><div id="comments"><p>First! {i}</p></div>'
        f'<p>Imprint of this site</p><form><input value=x>Search</form><aside>Side {i}</aside><script>var t="</p>";x()</script><footer>&copy; {i}</footer>'
    )


def test_extraction_keeps_the_article_only(spark):
    body = "<p>A &amp; b\n  c&nbsp;<b>d</b>e.<br>f<p><ul><li>one<li>two &lt;x&gt;</ul>tail<div class='related'>More</div>"
    rows = [(i, f"https://host.example/{i}", page(i, body + f"<p>own {i}", i < 6)) for i in range(6)]
    rows += [(20 + i, f"https://other.example/{i}", page(i, f"<p>plain {i} text that is long enough", False)) for i in range(5)]
    rows += [(40, None, None), (41, "odd", ""), (42, "http://solo/x", "just text"), (43, "http://solo/y", "<p>a<p>b"), (44, "http://s2/", page(9, "<p>solo"))]
    df = pages(spark, rows).withColumn("slots", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Title {i}\n\nA & b c de. f\n\none\n\ntwo <x>\n\ntail\n\nown {i}"
    for i in range(5):
        assert got[20 + i]["text"] == f"Title {i}\n\nplain {i} text that is long enough"  # the imprint is template text
    assert [got[i]["text"] for i in (40, 41, 42, 43, 44)] == ["", "", "just text", "a\n\nb", "Title 9\n\nsolo"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[1]["url"] == "https://host.example/1"
    salted = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df, broadcast_hosts=0).collect()}
    assert salted == {i: r["text"] for i, r in got.items()}
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_template_text_inside_articles_goes_unless_the_page_is_a_copy(spark):
    note = "<p>Get our <i>letter</i> every week</p><div>All rights of this text are ours</div>"
    rows = [(i, f"http://notes/{i}", page(i, f"<p>Report {i} of the day, <b>long</b> enough {'to count ' * 9}as {i}</p>{note}<p>And {i}, <b>long</b> ago")) for i in range(6)]
    rows += [(10 + i, f"http://copies/{i}", page(0, f"<p>The only article here{note}")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\n\nReport {i} of the day, long enough {'to count ' * 9}as {i}\n\nAnd {i}, long ago"
    for i in range(10, 14):
        assert got[i] == "Title 0\n\nThe only article here\n\nGet our letter every week\n\nAll rights of this text are ours"


def test_templates_group_equal_vectors(spark):
    rows = [(i, "http://h/x", page(i, f"<p>{'word ' * i}")) for i in range(1, 5)]
    found = html_extract.templates(html_extract.host_tokens(row_keyed(pages(spark, rows)), "url", "html")).collect()
    assert len(found) == 1 and len(found[0]["slots"]) == 1


def plain_page(host, i, own):
    """A page without article, main, or telling names; only what the host's pages share tells its template."""
    top = "".join(f'<div class="q{host}{k}"><a href="/{k}">{host} section {k}</a></div>' for k in range(4))
    return f"<html><body><div class='x{host}'>{top}</div><div class='z{host}'><p>Welcome to {host}, all about {host}</p>{own}<p>Printed by {host} and friends</p></div><div>Call {host} now</div></body></html>"


def test_the_template_decides_where_tags_tell_nothing(spark, monkeypatch):
    rows, want = [], {}
    for host in ("aa", "bb"):
        for i in range(7):
            rows.append((len(rows), f"http://{host}/{i}", plain_page(host, i, f"<p>Own words {host} {i} " + f"w{i} " * 30 + f"</p><p>more of {i}</p>")))
            want[len(rows) - 1] = f"Own words {host} {i} " + (f"w{i} " * 30).strip() + f"\n\nmore of {i}"
    run = lambda rows: html_extract.extract_main_text(pages(spark, rows)).collect()
    assert {r["page_id"]: r["text"] for r in run(rows)} == want
    twice = run(rows + rows + [(None, u, h) for _, u, h in rows])  # repeated rows and null identifiers don't cancel
    assert sorted(r["text"] for r in twice) == sorted(list(want.values()) * 3)
    empty = html_extract.templates
    monkeypatch.setattr(html_extract, "templates", lambda tokens: empty(tokens).limit(0))
    assert all("Welcome" in r["text"] and "Call" in r["text"] for r in run(rows))  # without templates all of it stays
    long = [(i, "http://long/x", f"<article><p>{'long text ' * 200_000}{i}</article>") for i in range(2)]
    assert [r["n_chars"] for r in run(long)] == [2_000_001] * 2


def test_host_in_spark_equals_host_in_python():
    assert html_extract.host_of("https://u:p@Host.Example:8/x?y") == "host.example:8"
    assert html_extract.host_of(None) == html_extract.host_of("nothing") == ""
