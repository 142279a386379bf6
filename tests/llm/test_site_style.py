import html as entities
import random

import pytest

from drainwatch.llm.site_style import StyleTree, branch_importance, extract_text, main_text


def page(article, menu="Home", foot="Foot"):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a>{menu}</a></nav><div class='ad'>Buy</div><article>{article}</article><footer>{foot}</footer></body></html>"


CASES = [
    ("<h1>A &amp; B</h1><p>one\n two&nbsp;three<p>four <b>five</b>.", "A & B\none two three\nfour five."),
    ("<p><b>open<br>line<p>next</p>", "open line\nnext"),
    ("<p>x</p><!-- <p>gone</p> --><p>y &lt;b&gt; &#233; &eacute; &#x1F600;</p>", "x\ny <b> é é 😀"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>bare", "a\nb\n1\n2\nbare"),
    ("<p>t</p><aside>side</aside><form>f<p>g</p></form><div class='newsletter-signup'>n</div><section id='comments'><article>c</article></section>", "t"),
    ("<header><h1>Head</h1></header><div class='cookie_notice'>c</div><div role='navigation'>m</div><div hidden>h</div><p class='leadtext'>kept</p>", "Head\nkept"),
    ("<style>p{}</style><noscript>n</noscript><iframe><p>i</p></iframe><p>a<a href='x>y'>link</a> b</p>", "alink b"),
]


@pytest.mark.parametrize(("article", "want"), CASES)
def test_text_of_the_article(article, want):
    assert main_text(page(article), []) == want
    assert main_text(page(article)[: -len("</body></html>")], None) == want


def test_pages_without_an_article_and_broken_ones():
    assert main_text("<body><nav>m</nav><main><p>a</p></main><p>b</p></body>", []) == "a"
    assert main_text("<p>a</p>text<footer>f</footer>", []) == "a\ntext"
    assert main_text("<p>a</b></div> b<p", []) == "a b"
    assert main_text("a < b <!-- open", []) == "a < b"
    assert main_text(None, []) == main_text("", []) == main_text("<script>x", []) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep, []) == "x"


def test_boilerplate_of_a_host_goes_and_articles_stay(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["lorem", "dolor", "sit", "amet", "elit"]) + str(rng.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body = f"<p>{words(20)} &amp; more</p>"
        # No tag or class says that the box is not the article; only its repetition does.
        rows.append((i, f"http://Site.example/{i}", f"<html><body><div class='box'><p>Same words everywhere</p></div><div class='main'>{body}</div></body></html>"))
        want[i] = entities.unescape(body[3:-4])
    copy = "<html><body><article><p>One page, crawled often</p></article></body></html>"
    rows += [(100 + i, "http://copies.example/x", copy) for i in range(30)]
    rows += [(200, None, copy), (201, "not a url", page("<p>z</p>")), (202, "http://site.example/none", None), (None, "http://site.example/n", "")]
    pages = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, n_chars string")
    got = extract_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == want[i] for i in want)
    assert all(by[100 + i].text == "One page, crawled often" for i in range(30)) and by[200].text == "One page, crawled often"
    assert (by[201].text, by[202].text, by[None].text, by[None].n_chars) == ("z", "", "", 0)
    assert extract_text(pages.limit(0)).collect() == []


def test_importance_is_low_for_what_repeats(spark):
    from pyspark.sql import functions as F

    rows = [(f"<body><div class='a'><p>same</p></div><div class='b'><p>own {i}</p></div></body>",) for i in range(10)]
    pages = spark.createDataFrame(rows, "html string").withColumn("_host", F.lit("h"))
    got = {r.path: (r.pages, r.importance) for r in branch_importance(pages, StyleTree()).collect()}
    assert got["/body/div.a"][0] == 10 and got["/body/div.a"][1] < 0.01 and got["/body/div.b/p"][1] > 0.89


def test_the_cut_spares_articles_and_copies_count_by_their_text(spark):
    rows, want = [], {}
    for i in range(20):
        # Headings and table heads recur in the articles of a host.
        rows.append((i, f"http://papers.example/{i}", f"<body><article><h2>Introduction</h2><p>own {i}</p><table><tr><th>Price</th><td>{i}</td></tr></table></article></body>"))
        want[i] = f"Introduction\nown {i}\nPrice\n{i}"
        rows.append((100 + i, f"http://shop.example/{i}", f"<body><div class='box'>Same</div><main><h2>Results</h2><p>own {i}</p></main></body>"))
        want[100 + i] = f"Results\nown {i}"
    for i in range(100):
        # One article on most of the pages, each time in another html: in the script, the menu and an attribute.
        text = "often crawled" if i < 90 else f"own {i}"
        rows.append((200 + i, f"http://copies.example/{i}", f"<body><script>{i}</script><nav>menu {i}</nav><article data-id='{i}'><p>{text}</p></article></body>"))
        rows.append((300 + i, f"http://plain.example/{i}", f"<body><script>{i}</script><nav>menu {i}</nav><div class='text' data-id='{i}'><p>{text}</p></div></body>"))
        want[200 + i] = want[300 + i] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == want


def test_articles_stay_whatever_stands_around_them():
    words = "<p>One long paragraph of the article itself.</p><p>And another one.</p>"
    text = "One long paragraph of the article itself.\nAnd another one."
    whole = [
        f'<form id="aspnetForm"><div class="menu">Home</div><article>{words}</article></form>',
        f'<div class="page no-sidebar"><article>{words}</article><div class="sidebar">x</div></div>',
        f'<div class="content-with-sidebar"><article>{words}</article></div>',
        f'<article><section id="social-sciences">{words}</section></article>',
        f'<article><section class="chapter header-image">{words}</section></article>',
        f'<div id="footer"><main>{words}</main></div>',
        f'<main>{words}<aside>x</aside><div class="site-header">y</div><div class="share-buttons">z</div></main>',
    ]
    for html in whole:
        assert main_text(f"<html><body>{html}</body></html>", None) == text, html
    named = '<article><h2 id="cookies">Cookies</h2><p>How they work.</p><h2 id="notice-of-appeal">Notice</h2><div class="related-work">Others did.</div><p class="ad-hoc">Some ad hoc text.</p></article>'
    assert main_text(named, None) == "Cookies\nHow they work.\nNotice\nOthers did.\nSome ad hoc text."
    teaser = f"<main>{words}<article><h3>Next</h3></article></main>"
    assert main_text(teaser, None) == text + "\nNext"
    # Noise by its element stays noise, and so do comments and forms with no article.
    assert main_text(f'<aside><article>teaser</article></aside><article>{words}</article><form>Your name</form><div class="comments"><article class="comment">me too</article></div>', None) == text
    assert main_text("<body><form>Your name <input></form><p>Body text.</p></body>", None) == "Body text."


def test_branches_that_repeat_go_from_pages_without_an_article(spark):
    pages = [(k, f"http://h/{k}", f'<body><div class="lead">Read our terms before you go on</div><div class="text"><p>Story number {k} of {k * 7} words.</p></div></body>') for k in range(20)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story number {k} of {k * 7} words." for k in range(20)}


def test_importance_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    from drainwatch.llm.site_style import page_features

    rng = random.Random(4)
    part = lambda: f"<p>{rng.choice('ab')}</p>" + rng.choice(["", "<ul><li>x</li></ul>", "<ul><li>x</li><li>y</li></ul>"])
    htmls = [f"<body><div class='{rng.choice('uv')}'>{part()}</div>{part()}<span>{k}</span></body>" for k in range(30)]
    seen = {}
    for h in htmls:
        text, features = page_features(h)
        seen.setdefault(text, features)
    shapes, texts = {}, {}
    for features in seen.values():
        for path, content, feature in features:
            (texts if content else shapes).setdefault(path, Counter())[feature] += 1
    entropy = lambda c, m: sum(-n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0
    pages = {p: sum(c.values()) for p, c in shapes.items()}
    weight = {p: sum(1 - (math.log(n) / math.log(pages[p]) if pages[p] > 1 else 0) for n in c.values() for _ in range(n)) for p, c in texts.items()}
    want = {}
    for path in shapes:
        below = [p for p in texts if p == path or p.startswith(path + "/")]
        if below:
            content = sum(weight[p] for p in below) / sum(sum(texts[p].values()) for p in below)
            share = StyleTree().gamma ** len(shapes[path])
            want[path] = (1 - share) * entropy(shapes[path], pages[path]) + share * content
    df = spark.createDataFrame([("h", h) for h in htmls], "_host string, html string")
    got = {r.path: r.importance for r in branch_importance(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
