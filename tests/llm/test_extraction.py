from seriesloom.llm import extraction as X
from seriesloom.llm import media
from seriesloom.llm.html_tree import parse


def text(html, templates=frozenset()):
    return X.main_text(parse(html), templates)


def test_article_without_boilerplate():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad-box">buy</div>
    <main><article><h1>Head &amp; line</h1><p><b>One &lt;two&gt;<br>  three\n four<p>Five</p><ul><li>a<li>b</ul><form><p>mail</p></form>
    <div class="share-buttons">share</div><section id="comments"><article><p>a reader</p></article></section><table><tr><td>x<td>y</table></article></main>
    <aside>side</aside><div class="cookieNotice">cookies</div><footer>&copy;</footer></body></html>"""
    assert text(html) == "Head & line\nOne <two> three four\nFive\na\nb\nx\ny"


def test_names_of_the_articles_own_parts():
    html = """<article><div class="entry-header"><h1>Title</h1></div><section id="related-work"><p>Earlier.</p></section><div class="side-by-side"><p>Body</p></div>
    <div class="post-content has-sidebar-left"><p>More</p></div><div class="shareButtons">share</div><div class="x comments-list">they say</div><p>End</p></article>"""
    assert text(html) == "Title\nEarlier.\nBody\nMore\nEnd"


def test_odd_pages():
    assert text("") == "" and text("plain   text") == "plain text" and text("<p>a") == "a"
    assert text("<div>a</span></div>b</p>c") == "a\nbc"
    assert text("a &nosuch; &#233;&#x41;&nbsp;b") == "a &nosuch; éA b"
    assert text("<script>never closed <p>x</p>") == ""
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end</p>") == "deep\nend"
    assert text("<p hidden>x</p><div role=navigation>y</div><p style='display:none'>z</p><p>w</p>") == "w"
    assert len(text("<article>" + "<p>word word</p>" * 50000 + "</article>").split("\n")) == 50000


def test_site_templates(spark):
    same = "<div><b>About this site</b><p>All our pages say so.</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{same}<p>Own text of page {i}.</p></body>") for i in range(12)]
    rows += [(100 + i, "http://b.example/x", f"<body>{same}<p>Other {i}.</p></body>") for i in range(3)]
    rows += [(200, "http://c.example/", "<body><p>copied</p></body>")] * 12
    rows += [(300 + i, f"http://d.example/{i}", f"<article><p>Repeated line.</p><p>{i}</p></article>") for i in range(12)]
    rows += [(400, None, None), (401, "::bad[", ""), (None, "http://a.example/0", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "x").selectExpr("*", "1 as page", "2 as host", "3 as _page", "4 as templates").repartition(3)
    got = {}
    for r in X.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Own text of page 3."]
    assert got[100] == ["About this site\nAll our pages say so.\nOther 0."]
    assert got[200] == ["copied"] * 12
    assert got[305] == ["Repeated line.\n5"]
    assert got[400] == [""] and got[401] == [""] and got[None] == ["x"]
    assert X.extract(df.where("page_id < 0")).count() == 0


def test_site_templates_inside_articles(spark):
    promo = "<div class='x1'><b>Read us</b><p>Every day, on paper.</p></div>"
    page = lambda body: f"<html><body><article>{body}</article></body></html>"
    rows = [(i, f"http://a.example/{i}", page(f"<h1>Title {i}</h1><p>The same sentence.</p><p>Own text number {i}, long enough.</p>{promo}")) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(f"<p>Few have it: {i}, so it stays here.</p>{promo}")) for i in range(7)]
    copied = page("<div><p>One half.</p></div><div><p>The other half.</p></div>")
    rows += [(200 + i, f"http://c.example/{i}", copied.replace("<body>", f"<body><nav>{i}</nav>")) for i in range(12)]
    rows += [(300 + i, f"http://d.example/{i}", page(f"<div><p>Most of this article is the same.</p></div><p>{i}</p>")) for i in range(12)]
    rows += [(400 + i, f"http://e.example/{i}", page(f"<p>Own text number {i}, long enough to be more.</p>{promo if i < 9 else ''}")) for i in range(120)]
    rows += [(600 + i, f"http://f.example/{i}", "<body><div>One page</div><p>under many addresses</p></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in X.extract(df).collect()}
    assert got[3] == "Title 3\nThe same sentence.\nOwn text number 3, long enough."
    assert got[100] == "Few have it: 0, so it stays here.\nRead us\nEvery day, on paper."
    assert got[200] == "One half.\nThe other half."
    assert got[300] == "Most of this article is the same.\n0"
    assert got[400].endswith("Every day, on paper.")
    assert got[600] == "One page\nunder many addresses"


def test_interleaved_sequences(spark):
    html = "<p>a</p><figure><img src='sha256:aa' alt='no'><figcaption>cap <b>1</b></figcaption></figure><p>b<img src=bb alt=two>c</p><img>"
    items = media.interleave(html)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "a", None, None), (1, "image", None, "aa", "cap 1"), (2, "text", "b", None, None), (3, "image", None, "bb", "two"), (4, "text", "c", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (1, html)], "id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = sorted((r.id, r.position, r.digest, r.caption, r.size) for r in media.resolve(media.sequences(pages, "id"), "id", store).collect())
    assert got == [(1, 1, "aa", "cap 1", 7), (1, 1, "aa", "cap 1", 7), (1, 3, "bb", "two", None), (1, 3, "bb", "two", None)]


def test_payloads_come_back(spark, documents):
    import hashlib
    import zlib

    import pytest

    rows = [(1, "é" * 96), (2, "é" * 96), (3, None), (4, ""), (5, "x" * 193), (6, "日本" * 40000), (None, "n"), (1, "other")]
    written = media.store_texts(documents(rows))
    facts = {r.digest: r for r in media.facts(written.where("media is not null")).collect()}
    by = {}
    for r in written.collect():
        by.setdefault(r.doc_id, []).append((r.n_bytes, facts[r.digest]))
    for i, x in rows:
        raw = (x or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert any(n == len(raw) and (f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])) for n, f in by[i])
    png = media.encode(b"a" * 192)
    assert media.decode(png) == b"a" * 192
    with pytest.raises(ValueError):
        media.decode(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    assert media.facts(media.store_texts(documents(rows).where("doc_id < 0")).where("media is not null")).count() == 0
