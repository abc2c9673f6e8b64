import html
import re

from murmur.llm import queries, sitetree


def article(page):
    """Main text by splitting the article's source at paragraph and heading tags."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not inside:
        return ""
    blocks = (re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside[1]))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_matches_the_articles(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_site_style_tree"](spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_furniture_and_blocks():
    page = (
        "<body><header>top</header><div class='cookie-notice'>we use</div><main><article><h1>T &amp; t</h1>"
        "<p>one\n two<br>three<p>four <b>bold</b>&nbsp;x<ul><li>a<li>b</ul><script>var t='</p>'</script>"
        "<div class='comments'><p>nice</p></div><form><label>mail</label></form><blockquote>q</blockquote></article>"
        "<aside>also</aside></main><footer>end</footer>"
    )
    assert sitetree.main_text(page) == "T & t\none two three\nfour bold x\na\nb\nq"
    assert sitetree.main_text("") == sitetree.main_text(None) == ""
    assert sitetree.main_text("just text & more") == "just text & more"
    assert sitetree.main_text("<div>" * 3000 + "deep") == "deep"


def test_classes_that_name_no_part_and_articles_that_are_comments():
    page = "<div id='page' class='has-sidebar wide'><article><div class='entry-header'><h1>T</h1></div><p>a</p></article><article class='comment'><p>nice</p></article></div>"
    assert sitetree.main_text(page) == "T\na"
    assert sitetree.main_text("<div class='no-sidebar'><p>b</p></div><div class='sidebar'>x</div>") == "b"
    assert sitetree.main_text("<article><p>a</p><div class='entry-footer share'>x</div><ol class='comment-list'><li>c</li></ol></article>") == "a"


def test_repeated_branch_is_removed_by_entropy(spark):
    """A box that no tag or class gives away, the same on every page of one host."""
    def page(i, box):
        return f"<html><body><div class='story{i}'><p>Story number {i} told once {i * 7}.</p></div><div class='zone'>{box}</div></body></html>"

    rows = [(i, f"https://a.example/{i}", page(i, "Latest from our network")) for i in range(60)]
    rows += [(100 + i, f"https://b.example/{i}", page(i, f"Own remark {i}")) for i in range(60)]
    rows += [(200, None, None), (201, "", ""), (202, "https://a.example/x", page(5, "Latest from our network"))] * 2
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for limit in (50_000, 0):
        found = sitetree.extract(pages, broadcast_rows=limit).collect()
        assert len(found) == len(rows)
        by = {r.page_id: r.text for r in found}
        assert by[3] == "Story number 3 told once 21."
        assert by[103] == "Story number 3 told once 21.\nOwn remark 3"
        assert by[200] == by[201] == "" and by[202].startswith("Story number 5")
    assert sitetree.extract(pages.limit(0)).count() == 0


def test_host_of():
    assert sitetree.host_of("https://u@A.example:80/x?y") == "a.example"
    assert sitetree.host_of("//b.example") == "b.example" and sitetree.host_of("nonsense") == sitetree.host_of(None) == ""
