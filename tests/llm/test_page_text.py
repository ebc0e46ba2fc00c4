"""Main text of pages whose article is known, from markup of many kinds."""

import random
import re

from pyspark.sql import functions as F

from gondola.llm import page_queries
from gondola.llm import page_text as P

WORDS = "the of and to in is that it was for on with as his they be at one have this from or had by".split()


def say(rng, n=12):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "é"]) for _ in range(n))


def alone(source):
    """Text of one page without any template."""
    left = P.Page(source).own()[2]
    for within in ("article", "main"):
        some = [b["text"] for b in left if b["within"] == within]
        if some:
            return "\n".join(some)
    return "\n".join(b["text"] for b in left)


def test_markup():
    cases = {
        "": "",
        "just text &amp; more": "just text & more",
        "a < b and 3<4 <3": "a < b and 3<4 <3",
        "<p>one<p>two<br>three</P><div>four": "one\ntwo three\nfour",
        "<P CLASS=x>&lt;b&gt; &eacute;&#233;&#xe9; &nbsp; x &copy 1 &unknown;": "<b> ééé x © 1 &unknown;",
        "<p>a <b>b <i>c</b> d</i> e</p>": "a b c d e",
        "x<script>var t='</p><p>no';</script>y<style>p{}</style> z": "xy z",
        "<!-- <p>no</p> -->yes<!-- open": "yes",
        "<p>kept</p><p clas": "kept",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd",
        "<table><tr><td>1<td>2<tr><th>3</table>4": "1\n2\n3\n4",
        "<p title='a > b' data-x=\"<p>\">t</p>": "t",
        "<p>word<span>joined</span></p>": "wordjoined",
        "<nav>menu<ul><li>x</ul></nav><p>t</p><footer>f</footer>": "t",
        "<nav>menu<article><p>t</article>": "t",
        "<body class='has-sidebar'><div class='content with-sidebar'><p>t</div><div class=sidebar>no</div>": "t",
        "<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>x</p><aside>no</aside><footer>no</footer></article>": "T\nx",
        "<main><h1>T</h1><div class='article-header'>kept</div><section id=comments><article class=comment>no</article></section></main>": "T\nkept",
        "<div class='cookie-notice'>no</div><div class='siteHeader'>no</div><div role=main><p>yes</div><div id='ad-1'>no</div><form>no<input></form>": "yes",
        "<div class='ad'>no <article><p>yes</p></article>": "yes",
        "<article>one</article><aside><article>no</article></aside><article>two</article>": "one\ntwo",
        "<div hidden>no</div><p style='display: none'>no<p>yes<textarea><p>no</textarea>": "yes",
        "<select><option>a<option>b</select><button>no</button>yes<svg><text>no</text></svg>": "yes",
        "<dl><dt>a<dd>b<dt>c<dd>d</dl></div></p><p>e": "a\nb\nc\nd\ne",
        "<p>a <button>no</button> b <span class=ad>no <i>no</i></span>c <svg><text>no": "a b c",
        "<pre>  a\n\n b </pre>": "a b",
    }
    for source, text in cases.items():
        assert alone(source) == text, source
    assert alone("<div>" * 30_000 + "deep") == "deep"
    assert len(alone("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def site(rng, hosts=3, pages=40):
    """(url, html, text): menus, notices and boxes without telling names, shared by the pages of a host."""
    out, quote = [], say(rng, 25)
    for h in range(hosts):
        top = f"<div><span>{say(rng, 3)}</span> <a href=/>{say(rng, 2)}</a></div>"
        note = f"<section><p>{say(rng, 9)}</p><ul><li>{say(rng, 2)}<li>{say(rng, 2)}</ul></section>"
        box = f"<div class=x1><p>{say(rng, 6)}</p></div>"
        copied = [say(rng, 30), say(rng, 20)]
        for i in range(pages):
            # A third quote one passage; a quarter are copies of one article, with a list in it.
            blocks = copied if i % 4 == 0 else [say(rng, 30), say(rng, 12)]
            blocks = [*blocks, quote] if i % 3 == 0 else blocks
            points = [f"{copied[0][:9]} {k}" for k in range(2)] if i % 4 == 0 else [say(rng, 4)]
            marked = f"<h1>{blocks[0][:20]}</h1><p>{'</p><p>'.join(blocks)}</p><ul><li>{'<li>'.join(points)}</ul>"
            text = "\n".join([blocks[0][:20].strip(), *blocks, *points])
            own = f"<article>{marked}{box}</article>" if h % 2 == 0 else f"<div id=c>{marked}</div>{box}"
            ad = f"<div class='ad top'>{say(rng, 5)}</div>"
            out.append((f"http://host{h}.example.com/{i}?x=1", f"<html><body>{top}{ad}{own}{note}<div>{say(rng, 1)[:0]}</div></body></html>", text))
    return out


def test_templates_go_and_quotes_stay(spark):
    rng = random.Random(2)
    rows = [(i, *r, 1, 1) for i, r in enumerate(site(rng))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string, row int, blocks int").repartition(7)
    made = P.main_text(df, keep=["page_id", "want", "row", "blocks"]).select("page.*", "text", "n_template").collect()
    assert len(made) == len(rows)
    for r in made:
        assert r.text == r.want and r.n_template >= 1, r
    few = P.main_text(df.where("page_id < 2"), keep=["page_id", "want"]).collect()
    assert all(r.n_template == 0 and r.page.want.splitlines()[0] in r.text for r in few)


def test_hard_rows(spark, tmp_path):
    rows = [
        (1, "http://a.example.com/", None), (2, None, "<article><p>x &amp; y"), (2, None, "<article><p>x &amp; y"), (None, "nothing", ""),
        (3, "HTTPS://User:pw@A.Example.com:80/q", "<p>" + "long " * 300_000), (4, "", " \n\t "), (None, None, None),
    ]
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame(rows, schema).withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in page_queries.op11_page_text(spark, str(tmp_path)).collect()), key=str)
    long = "long " * 299_999 + "long"
    want = [(r[0], r[1], t, len(t)) for r, t in zip(rows, ["", "x & y", "x & y", "", long, "", ""], strict=True)]
    assert got == sorted(want, key=str)
    assert P.main_text(df.limit(0), keep=["page_id"]).count() == 0
    hosts = [r[0] for r in df.select(P.host(F.col("url"))).collect()]
    assert sorted(hosts) == ["", "", "", "", "", "a.example.com", "a.example.com"]


def test_articles_of_the_given_pages(spark):
    """The given pages mark their article, so a plain search for it gives the expected text."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in page_queries.op11_page_text(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))
