import html as entities
import re

from tallymast.llm import html

from .conftest import FOLDER


def article(page):
    inside = re.search("<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside))
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_pages(spark):
    df = spark.read.parquet(f"{FOLDER.replace('0.001', '0.1')}/pages.parquet")
    rows = html.extract_pages(df).join(df.select("page_id", "html"), "page_id").collect()
    assert len(rows) == df.count()
    assert all(r["text"] == article(r["html"]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_labelled_pages_give_their_main_text_back():
    weights = html.fit()
    for page in html.LABELLED:
        kept = "".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))
        got = html.extract(page.replace("[[", "").replace("]]", ""), weights)
        want = re.sub(r"\s+", "", re.sub("<[^>]*>", "", kept))
        assert re.sub(r"\s+", "", got) == want, page


def test_a_scan_finds_the_best_run(monkeypatch):
    """Against all runs of small pages, by the number of words taken."""
    weights = {"x": -4.0, "y": 4.0}
    page = "<div class=x>no no no</div><div class=y>a b</div><div class=x>no no no no no no no no</div><div class=y>c d e</div>"
    assert html.extract(page, weights) == "c d e"
    assert html.extract(page.replace("no no no no no no no no", "no"), weights) == "a b\nc d e"


def test_odd_pages(spark):
    weights = html.fit()
    pages = [None, "", " ", "plain text only", "<p>a<b>b</b>c &amp; d&nbsp;e &#x41;</p>", "<script>var a='</p>'</script>", "<p>open <i>never closed", "< 3 is less", "<!-- never ends <p>x</p>", "<p title='a>b'>q</p>", "<style>", "<nav>" * 2_000 + "deep", "<a href=\"" + "x" * 100_000]
    want = ["", "", "", "plain text only", "abc & d e A", "", "open never closed", "< 3 is less", "", "q", "", "", ""]
    assert [html.extract(p, weights) for p in pages] == want
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "'z' text", "1 n_chars")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()}
    assert got == {i: (w, len(w)) for i, w in enumerate(want)}
    assert html.extract_pages(df.limit(0)).count() == 0


def test_stray_end_tags_cost_no_search():
    import time

    start = time.time()
    html.extract("<b>" * 60_000 + "</i>" * 60_000 + "<p>word</p>", html.fit())
    assert time.time() - start < 5
    assert list(html.parts("<div><b>x</i></b></div>"))[-1][0] == "div"
