"""Archives and page extraction."""

import gzip
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kairos.llm import warc, wrapper
from kairos.session import checkpoint_dir

PAGE = "page_id long, url string, html string"


def _pages():
    rows = [(1, "http://a.example/x y", "<p>one</p>"), (2, None, None), (3, "http://a.example/2", "<p>one</p>"),
            (4, "http://b.example/é", "line\nline\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (5, "http://b.example", ""),
            (6, "bad url", "\r\n"), (7, "http://c.example", "café \U0001F600\r"), (None, "http://c.example", "<p>one</p>"),
            (8, "http://d.example", "x" * 300_000 + "\n" * 50), (9, "http://d.example", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
            (9, "http://d.example", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (10, "filedesc://x", "1 0 kairos\nURL IP\n")]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(_pages(), PAGE).repartition(3)


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip_gives_every_payload_and_type(pages, monkeypatch, few):
    """Verdicts broadcast, and joined by shuffle."""
    monkeypatch.setattr(warc, "BROADCAST_VERDICTS", few)
    more = pages.select("*", *[F.lit(1).alias(c) for c in ("id", "u", "h", "arc", "digest", "record_type")])
    got = warc.archive_round_trip(more).collect()
    want = []
    for i, _, html in _pages():
        data = (html or "").encode()
        same = [p for p, _, h in _pages() if (h or "").encode() == data and p is not None]
        want.append((i, len(data), warc.sha1_base32(data), max(same)))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == \
        sorted((w[:3] for w in want), key=str)
    assert all(r.declared_digest == r.payload_digest for r in got)
    last = {w[2]: w[3] for w in want}
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == last[r.payload_digest] and r.refers_to_record in {x.record_id for x in got}
        else:
            assert r.record_type == "response" and r.page_id == last[r.payload_digest] and r.refers_to is None
    assert sum(r.record_type == "response" for r in got) == len(last)       # ties: one response, the other revisits
    assert len({r.record_id for r in got}) == len(got)


def test_small_payloads_are_all_responses(pages):
    got = warc.archive_round_trip(pages, revisit_from=11).collect()
    assert {r.record_type for r in got if r.payload_bytes <= 10} == {"response"}
    assert sum(r.record_type == "revisit" for r in got) == 1
    none = pages.where("page_id > 99")
    assert warc.archive_round_trip(none).count() == 0


def test_both_arc_versions_and_damage_are_read(spark):
    """Version 1 and 2 headers, short dates, junk between records and a cut-off last record."""
    root = f"{checkpoint_dir(spark).removeprefix('file:')}/arc-test"
    one = ("filedesc://one.arc 0.0.0.0 1999 text/plain 55\n1 0 old\nURL IP-address Archive-date Content-type "
           "Archive-length\n").replace(" 55\n", f" {len('1 0 old') + 1 + len('URL IP-address Archive-date Content-type Archive-length') + 1}\n")
    one += "\nhttp://x.example/a 1.2.3.4 199912312359 text/html 5\nab\ncd\njunk that is no header\n\n"
    one += "http://x.example/b 1.2.3.4 19991231235958 text/html 9999\nHTTP/1.0 200 OK\r\n\r\ncut"
    fields = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = f"2 0 old\n{fields}\n"
    two = (f"filedesc://two.arc 0.0.0.0 2001 text/plain 200 - - 0 two.arc {len(block)}\n{block}\n"
           "http://y.example/ 5.6.7.8 20010101 image/png 200 - - 0 two.arc 4\n\u0001\n\n!\n")
    import os
    os.makedirs(root, exist_ok=True)
    for name, body in (("one", one), ("two", two)):
        with gzip.open(f"{root}/{name}.txt.gz", "wb") as f:
            f.write(body.encode())
    got = {(r.arc, r.ordinal): r for r in warc.read_arc(spark, root).collect()}
    assert set(got) == {("one.arc", 1), ("one.arc", 2), ("two.arc", 1)}
    assert got["one.arc", 1].payload == b"ab\ncd" and got["one.arc", 1].version == 1
    assert got["one.arc", 2].payload == b"cut" and got["one.arc", 2].head == b"HTTP/1.0 200 OK\r\n\r\n"
    assert got["two.arc", 1].payload == b"\x01\n\n!" and got["two.arc", 1].status == "200"
    warc.convert(spark, root, root + "-warc")
    back = {r.url: r for r in warc.read_warc(spark, root + "-warc").collect()}
    assert back["http://x.example/a"].date == "1999-12-31T23:59:00Z"
    assert back["http://y.example/"].date == "2001-01-01T00:00:00Z" and back["http://y.example/"].record_type == "resource"


def test_iso_dates():
    assert [warc.iso_date(d) for d in ("20240229123456", "2024", "202402291", "x", "")] == [
        "2024-02-29T12:34:56Z", "2024-01-01T00:00:00Z", "2024-02-29T10:00:00Z", "1970-01-01T00:00:00Z",
        "1970-01-01T00:00:00Z"]
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest()[:4] == "da39"


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header class=top><a href="/">Site name</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy now</div><!-- <p>hidden</p> -->
{main}
<aside class="sidebar"><p>Most read</p></aside><section id="comments"><h2>Comments</h2><p>First!</p></section>
<form><p>Subscribe</p><input><button>Go</button></form><footer><p>&copy; 2024</p></footer></body></html>"""


def _article(rnd, same=""):
    paras = [" ".join(rnd.choice(["alpha", "beta &amp; gamma", "d&eacute;lta", "<b>bold</b>", "x &lt; y"])
                      for _ in range(rnd.randint(3, 20))) for _ in range(rnd.randint(1, 6))]
    body = "".join(f"<p>{p}</p>\n" for p in paras[:-1]) + f"<p>{paras[-1]}"       # the last one is not closed
    return f"<h1>Title\n  {rnd.random()}</h1>{body}{same}", paras


def _plain(x):
    for a, b in (("<b>", ""), ("</b>", ""), ("&lt;", "<"), ("&eacute;", "é"), ("&amp;", "&")):
        x = x.replace(a, b)
    return " ".join(x.split())


def test_article_text_is_exact(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        body, paras = _article(rnd, "<p>The same licence line.</p>")
        wrap = {0: "<article>{}</article>", 1: "<main><div class=wide>{}</div></main>",
                2: '<div class="post-content">{}</div>'}[i % 3]
        rows.append((i, f"https://User@Host{i % 3}.example:80/p/{i}", SITE.format(main=wrap.format(body))))
        title = _plain(re.search(r"<h1>(.*?)</h1>", body, re.S)[1])
        want[i] = "\n".join([title, *map(_plain, paras), "The same licence line."])
    d = spark.createDataFrame(rows, PAGE).repartition(4)
    got = {r.page_id: r for r in wrapper.extract(d).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_pages_without_article_elements_lose_the_template(spark):
    rows = [(i, "http://plain.example/", f"<body><ul><li><a href=x>Home</a></ul><table><tr><td>Text of page {i}, "
             f"long enough.</td></tr></table><p>All rights reserved</p></body>") for i in range(5)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"Text of page {i}, long enough." for i in range(5)}


def test_templates_of_one_host_leave_each_other_alone(make):
    """Every page is read by its own best slots, on a host of three templates and among pages without one."""
    wrap = ["<article><p>{}</p></article>", "<main><p>{}</p></main>", '<div class="content"><p>{}</p></div>',
            "<table><tr><td>{}</td></tr></table>"]
    rows = [(i, ["http://mixed.example/", None, "odd url"][i // 4 % 3], "<nav><p>Menu</p></nav>" + wrap[i % 4].format(
        f"Text of page {i}.")) for i in range(24)]
    got = {r.page_id: r.text for r in wrapper.extract(make(rows, PAGE)).collect()}
    assert got == {i: f"Text of page {i}." for i in range(24)}


def test_only_whole_equal_texts_of_different_pages_are_template(make):
    """Copies of a page, equal openings and equal paragraphs of one page stay; a page's only text stays too."""
    same = "The same opening words " * 5
    rows = [(i, "http://copies.example/", "<table><tr><td>One text, three times.</td></tr></table>") for i in range(4)]
    rows += [(10 + i, "http://opening.example/", f"<div><p>{same}{i}</p></div>") for i in range(4)]
    rows += [(20, "http://paragraphs.example/", "<div><p>again</p><p>again</p><p>again</p></div>")]
    rows += [(30 + i, "http://only.example/", f"<nav><p>Date {i}</p></nav><div>All there is.</div>") for i in range(4)]
    rows += [(40 + i, "http://lines.example/", f"<div>Own words {i}</div><p>All rights reserved</p>") for i in range(4)]
    got = {r.page_id: r.text for r in wrapper.extract(make(rows, PAGE)).collect()}
    want = {i: "One text, three times." for i in range(4)} | {10 + i: f"{same}{i}" for i in range(4)}
    want |= {20: "again\nagain\nagain"} | {30 + i: "All there is." for i in range(4)}
    assert got == want | {40 + i: f"Own words {i}" for i in range(4)}


def test_odd_pages(make):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://z/", "just text &am &#x41; &bogus; <"),
            (4, "http://y/", "<article><p>cut off<p"), (4, "http://y/", "<article><p>cut off<p"),
            (None, "http://x/", "<article><!-- open <p>x"), (5, "http://w/", "<article>" + "<div>" * 3000 + "deep"),
            (6, "http://v/", "<article>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(["p", "h2", "ul", "pre"] * 50)))]
    d = make(rows, PAGE).select("*", F.lit("c").alias("host"), F.lit(1).alias("slots"), F.lit(2).alias("text"))
    got = sorted(((r.page_id, r.text) for r in wrapper.extract(d).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "just text &am A &bogus; <"), (4, "cut off"), (4, "cut off"), (None, ""),
                          (5, "deep"), (6, "\n".join(map(str, range(200))))], key=str)
    assert wrapper.extract(make([], PAGE)).count() == 0


@pytest.mark.parametrize("piece, tail", [("<a ", '">'), ("<script ", '">'), ("<a b='", ""), ("<b>x", ""), ("<div>", "</div>"),
                                         ("<!--", ""), ("<", ""), ("</", ""), ('<a b="', "'>"), ("<p ='\"", ">")])
def test_hostile_markup_takes_linear_time(piece, tail):
    page = piece * (1_000_000 // len(piece)) + tail
    start = time.process_time()
    wrapper.read(page[:len(page) // 4])
    quarter = time.process_time() - start
    wrapper.read(page)
    assert time.process_time() - start - quarter < max(1.0, 8 * quarter)


def test_tags_end_outside_quoted_values():
    page = """<p title="a > b" id='x>y'>one<a href=it's>two</a> 3 < 4</p><P class = "n>" >five<p data-x="never>six"""
    blocks = wrapper.read(page)[1]
    assert [b[1] for b in blocks] == ["onetwo 3 < 4", "five", "six"]


def test_wrapper_is_a_union_free_expression():
    """Mismatches become optional parts, repeats become groups, in either order of alignment."""
    a, _ = wrapper.read("<div><h1>t</h1><p>a<p>b<ul><li>1<li>2</ul></div>")
    b, _ = wrapper.read("<div><h1>u</h1><dl><dt>k<dd>v<dt>k<dd>v</dl><p>c</div>")
    assert a.pattern() == "<page> <div> <h1> # </> (<p> # </>)+ <ul> (<li> # </>)+ </> </> </>"
    both = wrapper._merge(a, b).pattern()
    assert both == ("<page> <div> <h1> # </> (<dl> (<dt> # </> <dd> # </>)+ </>)? (<p> # </>)+ "
                    "(<ul> (<li> # </>)+ </>)? </> </>")
    again = wrapper.Slot.load(wrapper._merge(wrapper.read("<p>x")[0], wrapper.read("<p>x")[0]).dump())
    assert again.kids[0].kids[0].pages == 2 and again.kids[0].kids[0].fixed == "x"
