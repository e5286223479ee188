"""WARC archives in ZIP files, and page text."""

import random
import struct
import zipfile

import pytest

from sitelens.llm import pagetext, warczip


def reader(path):
    data = open(path, "rb").read()
    return lambda at, n: data[at:at + n], len(data)


@pytest.mark.parametrize("wide", [False, True])
def test_directory_agrees_with_zipfile(tmp_path, monkeypatch, wide):
    path = tmp_path / "a.zip"
    if wide:  # every size, offset and count takes its ZIP64 form
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"a note"
        for k in range(5):
            z.writestr(zipfile.ZipInfo(f"dir/é{k}.bin"), b"x%d" % k * (20 * k + 20))
        z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
    monkeypatch.undo()
    read, size = reader(path)
    members = warczip.directory(read, size)
    with zipfile.ZipFile(path) as z:
        assert [m.name for m in members] == z.namelist()
        for m in members:
            if m.stored:
                at = warczip.member_start(read, m)
                assert read(at, m.size) == z.read(m.name)
    with pytest.raises(warczip.BadArchive):
        warczip.member_start(read, members[-1])
    with pytest.raises(warczip.BadArchive):
        warczip.directory(lambda at, n: b"\0" * n, 500)


def test_zip64_end_is_followed():
    body = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 7, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0,
                                       0xFFFFFFFF) + b"m" + struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, 6 << 32)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(body), 0)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(body), 1)
    data = body + end + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (m,) = warczip.directory(lambda at, n: data[at:at + n], len(data))
    assert (m.name, m.size, m.header, m.stored) == ("m", 5 << 32, 6 << 32, True)


def test_archives_round_trip(shipped):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, None, "same"), (3, "http://a/3\r\nX: y", None),
            (4, "http://a/4", ""), (6, "http://a/6", "x\r\n\r\n" * 1000), (None, "http://a/7", "same"), (5, "z", "same"),
            (-2, "n", "\u0000é😀")]
    pages = shipped.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, same string")
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warczip.archived_pages(pages).collect())
    assert got == sorted(map(str, [
        (1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None),
        (3, 0, "revisit", 4), (4, 0, "response", None), (6, 5000, "response", None), (None, 4, "response", None),
        (-2, 7, "response", None)]))
    assert warczip.archived_pages(pages.limit(0)).collect() == []


def test_damage_is_found(tmp_path):
    raw = warczip.record(1, "u", b"payload", warczip.digest(b"payload"), None)
    headers, block = warczip.parse_record(raw)
    assert headers["warc-type"] == "response" and block.endswith(b"payload")
    with pytest.raises(warczip.BadArchive):
        warczip.parse_record(raw[:-12])


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="header-fixed"><header>Site</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy<p>now</div><article class="post has-sidebar"><h1>Title &lt;1&gt;</h1>
<p><b>First&nbsp;para&#x67;raph<br>goes  on
<p>Second <i>one</i><aside>Aside</aside><form>Mail <input name=x></form>
<blockquote>Quoted</blockquote><section id="comments"><article>A reader</article></section></article>
<footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert pagetext.chunk_texts([ARTICLE]) == ["Title <1>\nFirst paragraph goes on\nSecond one\nQuoted"]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<article>a <b>b</article", "a b"),
    ("<main><p>x < y &amp; z</main>", "x < y & z"), ("<article>one<article>two</article>three</article>four", "one\ntwo\nthree"),
    ("<script>never closed <p>x", ""), ("<article><script>if (a<b) {}</script>text</article>", "text"),
    ("<article>a<!-- b --><p>&unknown; &#0; c", "a\n&unknown; � c"), ("<div class=ad>x<article>y</article>", "y")])
def test_odd_pages(page, want):
    assert pagetext.chunk_texts([page]) == [want]


def test_pages_without_article_lose_repeated_runs():
    menu = "home products about us contact jobs press legal"
    own = [" ".join(f"word{k * 100 + i}" for i in range(12)) + " of the site" for k in range(5)]
    pages = [f"<div>{menu}</div><div>{own[k]}</div><div>copyright by the owners of this site all rights kept</div>"
             for k in range(5)]
    assert pagetext.chunk_texts(pages) == own
    # two pages are too few to tell
    assert pagetext.chunk_texts(pages[:2])[0].startswith(menu)


def test_suffix_runs_against_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        streams = [[rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        run, least = rng.randint(1, 7), rng.randint(1, 3)
        got = [m.tolist() for m in pagetext.repeated_tokens(streams, run, least)]
        seen = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                seen.setdefault(tuple(s[i:i + run]), set()).add(k)
        want = []
        for s in streams:
            mask = [False] * len(s)
            for i in range(len(s) - run + 1):
                if len(seen[tuple(s[i:i + run])]) >= least:
                    mask[i:i + run] = [True] * run
            want.append(mask)
        assert got == want


def test_hosts_count_as_a_whole(shipped):
    """Copies of a page keep their text, and neither partitions nor the number of pages leave menus in."""
    menu = "home products about us contact jobs press legal"
    own = [" ".join(f"word{k * 100 + i}" for i in range(12)) for k in range(2060)]
    rows = [(k, "http://large/x", f"<div>{menu}</div><div>{own[k]}</div>") for k in range(2060)]
    rows += [(k, "http://small/x", f"<div>{menu}</div><div>{own[k - 3000]}</div>") for k in range(3000, 3004)]
    rows += [(k, "http://copies/x", f"<div>{menu}</div><div>{own[0]}</div>") for k in range(4000, 4005)]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pagetext.extract_text(pages).collect()}
    assert len(got) == len(rows) and all(got[k] == own[k] for k in range(2060))
    assert [got[k] for k in range(3000, 3004)] == own[:4]
    assert {got[k] for k in range(4000, 4005)} == {f"{menu}\n{own[0]}"}
    assert pagetext.chunk_texts([rows[-1][2]] * 5) == [f"{menu}\n{own[0]}"] * 5


def test_page_query_on_odd_rows(shipped):
    rows = [(1, "http://h/1", ARTICLE), (1, "http://h/1", ARTICLE), (None, None, None), (2, "not a url", "<p>x")]
    pages = shipped.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, text string")
    got = pagetext.extract_text(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 2} == {"x"}
    assert pagetext.extract_text(pages.limit(0)).collect() == []


def test_menus_of_every_page_are_evidence(shipped, monkeypatch):
    """The array holds what every page has outside its article, and cutting a host into ranges changes nothing."""
    menu = "home products about us contact jobs press legal"
    own = [" ".join(f"word{k * 100 + i}" for i in range(12)) for k in range(40)]
    html = [f"<nav>{menu}</nav><article>{own[k]}</article>" for k in range(20)]
    html += [f"<div>{menu}</div><div class=ad>{own[k]} {k}</div><div>{own[k]} of it</div>" for k in range(20, 22)]
    # copies that differ in their adverts only are one page
    html += [f"<div class=ad>{own[k]}</div><div>{own[39]}</div>" for k in range(22, 26)]
    rows = [(k, "http://h/x", page) for k, page in enumerate(html)] + [(90, "http://other/x", f"<div>{menu}</div>")]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = own[:20] + [f"{own[k]} of it" for k in (20, 21)] + [own[39]] * 4
    assert pagetext.chunk_texts(html) == want
    for tokens in (1 << 18, 30, 1):
        monkeypatch.setattr(pagetext, "RANGE_TOKENS", tokens)
        got = {r.page_id: r.text for r in pagetext.extract_text(pages).collect()}
        assert [got[k] for k in range(len(html))] == want and got[90] == menu


def test_every_host_goes_through_the_array(shipped, monkeypatch):
    """The array judged nothing on hosts whose pages all have an article; now every page is told what repeats."""
    menu = "home products about us contact jobs press legal"
    own = [" ".join(f"word{k * 100 + i}" for i in range(12)) for k in range(9)]
    html = [f"<nav>{menu}</nav><article>{own[k]}</article><div class=ad>{own[k + 4]}</div>" for k in range(4)]
    rows = [(k, "http://all/x", page) for k, page in enumerate(html)] + [(0, "http://all/x", html[0])] * 2
    # two pages and their copies are too few on a host of their own; no blocks, no article, no page
    rows += [(k, "http://few/x", html[k % 2]) for k in range(10, 14)]
    rows += [(20, "http://all/x", f"<article>{own[8]}</article>"), (21, "http://all/x", f"<div>{menu}</div><p>{own[8]}"),
             (22, "http://all/x", None)]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for tokens in (1 << 18, 10):
        monkeypatch.setattr(pagetext, "RANGE_TOKENS", tokens)
        got = sorted((r.page_id, r.text, r.n_outside, r.n_repeated) for r in pagetext.extract_text(pages).collect())
        assert got == sorted([*[(k, own[k], 2, 1) for k in (0, 0, 0, 1, 2, 3)], *[(k, own[k % 2], 2, 0) for k in range(10, 14)],
                              (20, own[8], 0, 0), (21, own[8], 2, 1), (22, "", 0, 0)])
