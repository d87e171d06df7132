"""Operators on web pages: archives and main text."""

import glob
import gzip
import hashlib
import time

import numpy as np
import pytest

from folium.llm import common, html_text, warc

SCHEMA = "page_id long, url string, html string, type string, digest string, record_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "d", "r") for i, u, h in rows], SCHEMA).repartition(3)


LONG = "<p>" + "long text " * 200
PAGES = [
    (1, "http://a.com/1", LONG), (2, "http://a.com/2", LONG), (3, "http://b.com/\r\nX: y", LONG), (4, None, LONG + "!"), (5, "http://a.com/5", None), (6, "http://a.com/6", ""),
    (7, "http://a.com/7", "a\r\n\r\nb\r\n\r\n"), (8, "http://a.com/8", "\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n"), (9, "http://a.com/9", "é漢😀\r\n"),
    (10, "http://a.com/10", "short"), (11, "http://a.com/11", "short"), (None, "http://a.com/n", "no id"), (12, "http://a.com/12", "twice"), (12, "http://a.com/12", "twice"), (12, "http://a.com/other", "twice"), (13, "http://a.com/13", "\r\n" * 3000),
    (20, "http://a.com/20", LONG + "?"), (20, "http://a.com/20", LONG + "?"), (20, "http://a.com/19", LONG + "?"), (20, None, LONG + "?"), (None, "http://a.com/n", LONG + "?"),
]


def test_archives(spark):
    got = warc.round_trip(table(spark, PAGES)).collect()
    assert len(got) == len(PAGES)
    want, first = [], {}
    for i, u, h in sorted(PAGES, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, [-ord(c) for c in x[1] or ""])):
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and raw in first
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
        first.setdefault(raw, i)
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)[:5]) for x in got)
    assert warc.round_trip(table(spark, PAGES).limit(0)).count() == 0


def test_archive_files_are_whole_records(spark):
    folder = common.new_path(spark, "warc")
    warc.write_captures(table(spark, PAGES), folder)
    content = b"".join(gzip.open(f).read() for f in sorted(glob.glob(folder.removeprefix("file://") + "/*.gz")))
    kinds = []
    at = 0
    while at < len(content):
        head, _, _ = content[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        at += len(head) + 4 + int(fields[b"Content-Length"])
        assert content[at : at + 4] == b"\r\n\r\n"
        at += 4
        kinds.append(fields[b"WARC-Type"])
    assert kinds.count(b"request") == kinds.count(b"metadata") == kinds.count(b"response") + kinds.count(b"revisit") == len(PAGES)


def test_transactions(spark):
    folder = common.new_path(spark, "warc")
    warc.write_captures(table(spark, PAGES[:11]), folder)
    records = warc.read_records(spark, folder)
    for x in warc.assemble(records).collect():
        assert x.request.block.startswith(b"GET ") and len(x.metadata) == 1
        html = dict((i, h) for i, _, h in PAGES)[x.metadata[0].page_id]
        if x.response.type == "response":
            assert x.response.block.partition(b"\r\n\r\n")[2] == (html or "").encode()
    alone = warc.assemble(records.where("type <> 'request'"))
    assert alone.count() == 11 and alone.where("request IS NULL").count() == 11


def test_blocks():
    text = lambda p: [(k, t) for k, t in html_text.blocks(p)]
    main, other, open_ = html_text.MAIN, html_text.OTHER, html_text.OPEN
    assert text("<title>no</title><nav>menu</nav><article><h1>T &amp; U</h1><p><b>a\n b<br><p>c</article><footer>f</footer>") == [(other, "menu"), (main, "T & U"), (main, "a b"), (main, "c"), (other, "f")]
    assert text('<script>var t="</p>";</script><p>x <!-- y --> z<style>p{}</style>') == [(open_, "x z")]
    assert text('<div class="sideBar">s</div><main><p>m<form>f</form><aside>a</aside><div id="comments"><article>c</article></div>n</main>') == [(other, "s"), (main, "m"), (other, "f"), (other, "a"), (other, "c"), (main, "n")]
    assert text('a > b < c <1 <a title="x>y">d</a>') == [(open_, "a > b < c <1 d")]
    assert text("<p hidden>no<p>yes<br>two") == [(other, "no"), (open_, "yes"), (open_, "two")]
    assert text("") == [] and text("<!-- open") == [] and text("plain") == [(open_, "plain")]


@pytest.mark.parametrize("piece", ["<", "<p>", '<a href="', "</p>", "<!--", "<script>", "<p class='ad>", "<li>", "<svg>", "&amp;"])
def test_hard_pages_take_linear_time(piece):
    began = time.time()
    html_text.blocks(piece * 50_000)
    assert time.time() - began < 20


def test_suffixes():
    r = np.random.default_rng(3)
    tokens = np.append(r.integers(0, 3, 200), -1)
    order, rank = html_text.equal_suffixes(tokens, 8)
    cut = lambda i: list(tokens[i : i + 8])
    assert [cut(i) for i in order] == sorted(cut(i) for i in range(len(tokens)))
    for i in range(0, 200, 7):
        for j in range(200):
            assert (rank[i] == rank[j]) == (cut(i) == cut(j))


def test_main_text(spark):
    frame = lambda b: f"<html><div>Welcome to our site home about contact press jobs help faq</div><div>{b}</div><div>All rights reserved by the example company 2024 terms privacy imprint</div>"
    own = [f"Number{i} speaks of topic{i * 7} in{i} its{i} own{i} words &amp; more{i}" for i in range(6)]
    rows = [(i, f"http://h.com/{i}", frame(b)) for i, b in enumerate(own)]
    rows += [(7, "http://other.com/", frame("alone on its host")), (8, None, None), (9, "http://h.com/9", "<article>All rights reserved by the example company 2024 terms privacy imprint</article>"), (10, "http://c.com/a", frame("copy")), (11, "http://c.com/b", frame("copy"))]
    large = "".join(f"<div>{' '.join(f'frame{k}x{j}' for j in range(100))}</div>" for k in range(3))
    rows += [(40 + i, f"http://large.com/{i}", large + "<div>" + " ".join(f"{'own' if not i else 'other'}{k}" for k in range(30)) + "</div>") for i in range(2)]
    got = {x.page_id: x for x in html_text.main_text(table(spark, rows)).collect()}
    for i, b in enumerate(own):
        assert got[i].text == b.replace("&amp;", "&") and got[i].n_chars == len(got[i].text)
    assert got[7].text.count("\n") == 2 and got[8].text == "" and got[8].n_chars == 0
    assert got[9].text.startswith("All rights") and got[10].text == got[11].text and "copy" in got[10].text
    assert html_text.main_text(table(spark, rows)).where("page_id = 40").head().text == " ".join(f"own{k}" for k in range(30))
    twice = html_text.main_text(table(spark, rows + rows))
    assert twice.count() == 2 * len(rows) and twice.distinct().count() == len(rows)
    assert html_text.main_text(table(spark, rows).limit(0)).count() == 0


def test_boilerplate_in_articles(spark):
    notice = "Read our other stories and subscribe to the weekly letter of this paper"
    shared = "a passage that only two of the articles share is content and so it stays"
    own = [f"Story{i} has its{i} own{i} words{i} about{i} things{i} nobody{i} else{i} tells{i}" for i in range(8)]
    rows = [(i, f"http://h.com/{i}", f"<article><p>{b}</p><p>{shared if i < 2 else ''}</p><p>{notice}</p></article>") for i, b in enumerate(own)]
    rows += [(20 + i, f"http://few.com/{i}", f"<article><p>{b}</p><p>{notice}</p></article>") for i, b in enumerate(own[:3])]
    rows += [(30 + i, f"http://h.com/copy{i}", rows[2][2]) for i in range(20)]
    got = {x.page_id: x.text for x in html_text.main_text(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, b in enumerate(own):
        assert got[i] == b + ("\n" + shared if i < 2 else "")
    assert all(got[20 + i] == f"{own[i]}\n{notice}" for i in range(3)) and all(got[30 + i] == own[2] for i in range(20))


def plain_runs(pages):
    """The runs to remove, by counting every substring of RUN tokens in every distinct stream."""
    streams = {}
    for _, url, page in pages:
        main, _, outside = html_text._parts(page)
        host = url.split("/")[2]
        for part, text in ((html_text.ARTICLE, "\n".join(main)), (html_text.OUTSIDE, outside)):
            if text:
                streams.setdefault((host, part), set()).add(tuple(text.lower().split()))
    found = {}
    for key, texts in streams.items():
        count = {}
        for t in texts:
            for run in {t[i : i + html_text.RUN] for i in range(len(t) - html_text.RUN + 1)}:
                count[run] = count.get(run, 0) + 1
        found[key] = {run for run, n in count.items() if n >= html_text.need(key[1], len(texts))}
    return found


def plain_text(page, host, runs):
    main, open_, _ = html_text._parts(page)
    words = [(k, w) for k, b in enumerate(main or open_) for w in b.split()]
    own, gone = runs.get((host, html_text.ARTICLE if main else html_text.OUTSIDE), set()), set()
    for i in range(len(words)):
        if tuple(w.lower() for _, w in words[i : i + html_text.RUN]) in own:
            gone |= set(range(i, i + html_text.RUN))
    if len(words) - len(gone) < html_text.RUN:
        return "\n".join(main or open_)
    lines = {}
    for i, (k, w) in enumerate(words):
        if i not in gone:
            lines.setdefault(k, []).append(w)
    return "\n".join(" ".join(lines[k]) for k in sorted(lines))


def test_main_text_equals_plain_counting(spark, monkeypatch):
    r = np.random.default_rng(11)
    phrases = [" ".join(f"p{k}w{j}" for j in range(int(r.integers(5, 20)))) for k in range(12)]
    rows = []
    for i in range(120):
        own = [" ".join(f"Own{r.integers(0, 50)}" for _ in range(int(r.integers(0, 25)))) for _ in range(3)]
        shared = [phrases[k] for k in r.choice(12, int(r.integers(0, 7)), p=np.arange(1, 13) / 78)]
        body = "".join(f"<p>{x}</p>" for x in r.permutation(own + shared))
        rows.append((i, f"http://h{int(r.integers(0, 3))}.com/{i}", f"<nav>{phrases[3]}</nav><article>{body}</article>" if i % 2 else body))
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]
    runs = plain_runs(rows)
    want = {i: plain_text(page, url.split("/")[2], runs) for i, url, page in rows}
    pages = table(spark, rows)
    for salted, stretch, of_round in ((2000, 1 << 20, 500_000), (5, 300, 40)):
        for name, value in (("SALTED", salted), ("STRETCH", stretch), ("ROUND", of_round)):
            monkeypatch.setattr(html_text, name, value)
        got = {x.page_id: x.text for x in html_text.main_text(pages).collect()}
        assert got == want
    assert sum(map(len, runs.values())) > 50 and sum(want[i] != "\n".join(html_text._parts(p)[0] or html_text._parts(p)[1]) for i, _, p in rows) > 40
