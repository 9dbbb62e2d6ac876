"""WARC round trips and main text extraction."""

import base64
import gzip
import hashlib
import random
import time

import pytest

from pairwright.llm import html_text, warc
from pairwright.llm.common import shared_folder


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (5, "http://a/5", "<p>x</p>", "c"), (2, "http://a/2", "<p>x</p>", "c"), (9, None, "<p>x</p>", "c"),
    (1, "http://a/1?a=\n b", None, "c"), (3, "http://a/3", "", "c"),
    (4, "http://a/4", "WARC/1.1\r\n\r\n" + "é漢" * 40_000, None), (4, "http://a/4", "other", None),
]


def read(spark, pages, **options):
    warc.register(spark)
    path = shared_folder(spark, "test-warc")
    warc.page_records(pages, **options).write.format("warc").mode("append").option("file_bytes", 200).save(path)
    return path, spark.read.format("warc")


def test_pages_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string")
    path, reader = read(spark, pages)
    rows = reader.load(path).collect()
    found = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    first = {}
    for i, _, h, _ in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    expected = []
    for i, _, h, _ in PAGES:
        data = (h or "").encode()
        later = first[h or ""] != i
        expected.append((
            f"<urn:page:{i}>", "revisit" if later else "response", f"<urn:page:{first[h or '']}>" if later else None,
            len(data), sha1(data),
        ))
    assert found == sorted(expected)
    whole = {(r.record_id, bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert whole == {(f"<urn:page:{i}>", (h or "").encode()) for i, _, h, _ in PAGES if first[h or ""] == i}
    assert all(r.digest_ok for r in rows if r.record_type == "response")


def test_small_payloads_are_not_shared(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string")
    path, reader = read(spark, pages, least_bytes=9)
    assert reader.load(path).where("record_type = 'revisit'").count() == 0


def test_predicates_reach_the_reader(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string")
    path, reader = read(spark, pages)
    revisits = reader.load(path).where("record_type = 'revisit' and target_uri like 'http://a/%'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert {r.record_id for r in revisits.collect()} == {"<urn:page:5>", "<urn:page:3>"}
    assert reader.load(path).where("content_length > 1000").count() == 1


def test_unwanted_payloads_are_passed_by(tmp_path, monkeypatch):
    rows = [{"record_id": f"<r:{i}>", "record_type": "response", "payload": random.Random(i).randbytes(400_000)} for i in range(3)]
    file = tmp_path / "a.warc.gz"
    file.write_bytes(b"".join(warc.member(warc.record(r), 1) for r in rows))
    read_bytes = 0

    class Counting(warc.io.BufferedReader):
        def read(self, n=-1):
            nonlocal read_bytes
            data = super().read(n)
            read_bytes += len(data)
            return data

    with Counting(open(file, "rb", buffering=0)) as f:
        assert [e.fields["warc-record-id"] for e in warc.entries(f)] == ["<r:0>", "<r:1>", "<r:2>"]
    assert read_bytes < 200_000 < file.stat().st_size


@pytest.mark.parametrize("name", ["plain.warc", "foreign.warc.gz"])
def test_archives_of_others(spark, tmp_path, name):
    rows = [{"record_id": f"<r:{i}>", "record_type": "response", "payload": b"p" * i * 30_000} for i in range(4)]
    data = [warc.record(r) for r in rows]
    (tmp_path / name).write_bytes(b"".join(map(gzip.compress, data)) if name.endswith("gz") else b"".join(data))
    warc.register(spark)
    found = spark.read.format("warc").load(f"file://{tmp_path}").where("record_id <> '<r:1>'").collect()
    assert sorted((r.record_id, r.payload_bytes, r.digest_ok) for r in found) == [("<r:0>", 0, True), ("<r:2>", 60_000, True), ("<r:3>", 90_000, True)]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path, reader = read(spark, pages)
    assert reader.load(path).count() == 0


CASES = {
    "": "",
    "<script>var a = '<p>no</p>'</script>": "",
    "<article><h1>T &lt;x&gt;&amp</h1><p>One  two\n three.<p>Four<br>five<div class='ad-box'>Buy</div></article>": "T <x>&\nOne two three.\nFour five",
    "<body><nav><a href=x>Home</a></nav><main><header><h1>Title</h1></header><p>Text of it.</p>"
    "<aside>beside</aside><form><label>Name</label><input></form><section id=comments><p>Well said, all of it.</p></section>"
    "</main><footer>&copy; me</footer><div class='cookie-notice'>We use cookies.</div>": "Title\nText of it.",
    "<article><p>a<!-- <p>b</p> -->c</p><p hidden>d</p><p style='display: none'>e</p></article>": "ac",
    "<article><p>cut <b>short": "cut short",
    "<article><p>1 < 2 & 3 > 2</p></article>": "1 < 2 & 3 > 2",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert html_text.main_text(page) == CASES[page]


_P = "<p>Whole text of it, with <b>all</b> words.</p>"
_T = "Whole text of it, with all words."
LOST = {
    # the end tag of the head may be left out, and so may the body's start tag
    f"<html><head><title>no</title><body><article>{_P}</article></body></html>": _T,
    f"<head><meta charset=x><script>no()</script><title>no</title><article>{_P}</article>": _T,
    f"<head><title>no</title><noscript><link><body><article>{_P}</article>": _T,
    f"<head><title>no</title><noscript><p>no</p></noscript></head><article>{_P}</article>": _T,
    # unclosed or closed in themselves
    **{f"<article><{t}/>{_P}<{t} a='b' />{_P}</article>": f"{_T}\n{_T}" for t in ("svg", "math", "object", "canvas", "iframe", "select")},
    **{f"<article><p>A.</p><{t} aria-hidden=true>{_P}</article><{t}>no</{t}>": f"A.\n{_T}" for t in ("svg", "object", "canvas", "button", "template")},
    f"<svg><article>{_P}</article>": _T,
    f"<article><svg><title/><style/><path d='M0'/></svg>{_P}<!-->{_P}<!--->{_P}</article>": f"{_T}\n{_T}\n{_T}",
    # names that only begin like others
    f"<head-line>x</head-line><article><svg-icon name=a></svg-icon><button-group>B.</button-group>{_P}<title-bar></title-bar></article>": f"B.\n{_T}",
    # closed ones still hide all, and break no text
    f"<article><p>a <button><div>no</div></button><svg><svg></svg>no</svg><select><option>no<option>no</select>b</p><object><p>no</p></object>{_P}</article>": f"a b\n{_T}",
    f"<article><textarea><p>no</p></textarea>{_P}<script>'</scripted>'; no</article>": _T,
    # nothing tells what is content
    "<body><h1>A title of some forty characters, no more</h1><p>Short one</p><div>" + "Long text of it. " * 20 + "</div><ul><li><a href=x>Home</a></ul>":
        "A title of some forty characters, no more\nShort one\n" + ("Long text of it. " * 20).strip(),
    f"<div><h1>A title of some forty characters, no more</h1></div><article>{_P}</article><div>Beside it</div>":
        f"A title of some forty characters, no more\n{_T}",
    # names that do not tell what the element holds
    f"<body class='has-sidebar'>{_P}{_P}": f"{_T}\n{_T}",
    f"<div class='legal'>{_P}{_P}</div>": f"{_T}\n{_T}",
    f"<nav>menu</nav><div class='legal'><div id=widget>{_P}{_P}</div></div><footer>foot</footer>": f"{_T}\n{_T}",
    f"<main><section class='related-work'>{_P}</section>{_P}</main>": f"{_T}\n{_T}",
    f"<article><p class='no-comment'>He had no comment.</p>{_P}</article>": f"He had no comment.\n{_T}",
    # and names that do
    f"<article>{_P}</article><div class='related-posts'>{_P}</div><div class='cookie-banner'>We use them.</div><section id=comments>{_P}</section>": _T,
    f"<article>{_P}<ul class='share-links'><li>Send it</ul><div class='comment-list'><div class='comment' id='comment-7'>{_P}</div></div></article>": _T,
    f"<nav>menu</nav><article></article><div class=comments>{_P}</div>": "",
    f"<div class=sidebar>{_P}</div><div>{_P * 3}</div><div class=comments>{_P}</div>": "\n".join([_T] * 3),
}


@pytest.mark.parametrize("page", LOST)
def test_no_text_is_lost(page):
    assert html_text.main_text(page) == LOST[page]


def test_long_page_is_whole():
    words = " ".join(f"word{i}" for i in range(60_000))
    page = f"<nav>menu</nav><article><p>{words}</p>" + "<p>line</p>" * 3000 + "</article>"
    assert html_text.main_text(page) == "\n".join([words] + ["line"] * 3000)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000, "<div>x" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000, "<i>" * 100_000 + "</u>" * 100_000,
        "<head><svg>" + "<g>" * 100_000 + "</svg>x", "<div>" * 100_000 + "<p>x</p>" * 100_000, "<svg>" * 100_000 + "x",
    ],
    ids=range(7),
)
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    assert html_text.main_text(page).count("x") == page.count("x")
    assert time.process_time() - start < 10


def test_minimum_cut_against_all_cuts():
    draw = random.Random(3)
    for _ in range(60):
        n = draw.randint(1, 7)
        capacity = [draw.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, draw.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.5]

        def cost(kept):
            lost = sum(c for c, k in zip(capacity, kept) if c > 0 and not k) - sum(c for c, k in zip(capacity, kept) if c < 0 and k)
            return lost + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.source_side(capacity, edges)) - best) < 1e-6


def test_extraction_keeps_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article><p>A</p></article>", "x"), (1, "u", "<article><p>A</p></article>", "x"), (None, None, None, None)],
        "page_id long, url string, html string, text string",
    )
    found = html_text.extract_main_text(pages).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, "u", "A"), (1, "u", "A"), (None, None, "")], key=str)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
