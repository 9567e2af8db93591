import pytest

from plebis.llm import html

ARTICLE = "<h1>Title</h1><p>First   line\nof <b>text</b> &amp; more.</p><p>Short.</p><p>" + "word " * 30 + "</p>"
EXPECTED = "Title\n\nFirst line of text & more.\n\nShort.\n\n" + " ".join(["word"] * 30)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_marked_article():
    noise = "<nav><ul><li><a href='/x'>Menu entry</a></li></ul></nav><!-- c --><div class=\"ad\">Buy this now</div>"
    assert html.extract(page(f"{noise}<article>{ARTICLE}</article><footer>&copy; site</footer>")) == EXPECTED


def test_unmarked_page():
    before = "<div id=top-menu><a href=a>One</a> <a href=b>Two</a></div><div class='site-header'>Name</div>"
    after = "<div class=comments><p>" + "I agree " * 40 + "</p></div><form><p>" + "sign up " * 20 + "</p></form><div class='sidebar'><p>" + "side " * 30 + "</p></div>"
    assert html.extract(page(f"{before}<div class=post>{ARTICLE}</div>{after}")) == EXPECTED


def test_inside_an_article():
    inner = ARTICLE + "<aside><p>" + "related " * 20 + "</p></aside><section class='comments'><p>" + "nice " * 30 + "</p></section><script>x</script>"
    assert html.extract(page(f"<article>{inner}</article>")) == EXPECTED


def test_windows_decide_inside_a_mark():
    links = "<ul><li><a href=a>A related story of some length</a></li><li><a href=b>Another one</a></li><li><a href=c>A third</a></li></ul>"
    menu = "<div><a href=x>Home</a> | <a href=y>News</a> | <a href=z>Sport</a></div>"
    far = "<div><span>Sign in</span></div>" + links  # light, and cut off from the text by links alone
    assert html.extract(page(f"<main>{far}{menu}<div>{ARTICLE}{links}<p>The end.</p></div>{menu}</main>")) == EXPECTED + "\n\nThe end."
    assert html.extract(page(f"<article><h1><a href=t>Title</a></h1>{ARTICLE.partition('</h1>')[2]}{links}</article>")) == EXPECTED
    assert html.extract(page(f"<main></main><div>{ARTICLE}</div>")) == EXPECTED


@pytest.mark.parametrize("label", ["has-sidebar", "no-sidebar", "site has-header-image", "no-comments", "football", "footnotes", "shareholder-report", "header"])
@pytest.mark.parametrize("body", [f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"])
def test_wrappers_are_no_side_matter(label, body):
    note = "<div class='widget sidebar-box'><p>" + "side " * 15 + "</p></div><footer>Foot</footer>"
    assert html.extract(page(f"<div class='{label}'>{body}{note}</div>")) == EXPECTED


def test_labels_stay_outside_beside_a_text():
    long = "<div class='related-posts'><article class=card><p>" + "other " * 200 + "</p></article><article class=card><p>Next</p></article></div><div id=comments><p>" + "I agree " * 200 + "</p></div>"
    assert html.extract(page(f"<div class=post>{ARTICLE}</div>{long}")) == EXPECTED
    assert html.extract(page(f"<form id=all><div class=post>{ARTICLE}</div></form>")) == EXPECTED


def test_unclosed_head_and_several_stretches():
    for start in ("<body>", "<div>"):
        text = page(f"{start}{ARTICLE}").replace("</head><body>", "").replace("<title>T", "<meta charset=utf-8><title>T")
        assert html.extract(text) == EXPECTED
    gap = "<div>" + "<p><a href=x>Only a link</a></p>" * 4 + "</div>"
    assert html.extract(page(f"<div>{ARTICLE}</div>{gap}<div>{ARTICLE}</div>{gap}")) == EXPECTED + "\n\n" + EXPECTED


def test_cut_off_and_odd_pages():
    assert html.extract("<article><p>One<p>Two<br>three <b>open") == "One\n\nTwo three open"
    assert html.extract(None) == html.extract("") == html.extract("<script>only") == html.extract("<nav>Menu</nav>") == ""
    assert html.extract("plain text alone &lt;b&gt;") == "plain text alone <b>"


def test_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>"), 3), (2, None, None, 4), (2, None, None, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect())
    assert got == [(1, EXPECTED, len(EXPECTED)), (2, "", 0), (2, "", 0)]
    assert html.main_text(df.limit(0)).count() == 0


def brute(page):
    """Windows over line weights, place by place."""
    found = html.lines(page or "")
    if any(line[1] and line[2] for line in found):
        found = [line for line in found if line[2]]
    w = [line[1] for line in found]
    n, level = len(w), min(html.SURGE, max(w, default=0))
    window = lambda i: sum(w[i : i + html.WINDOW])
    goes_on = lambda i: w[i] > 0 or (window(i) >= level and window(i) > 0)
    inside, kept = False, set()
    start = None
    for i in range(n + 1):
        if inside and (i == n or not goes_on(i)):
            weight = {}
            for k in range(start, i):
                weight.setdefault(found[k][3], []).append(w[k])
            own = max(weight, key=lambda h: sum(weight[h]))
            first, last = start, i
            above, below = found[start][3], found[i - 1][3]
            while first > 0 and found[first - 1][3] in (own, above):
                first -= 1
            while last < n and found[last][3] in (own, below):
                last += 1
            kept |= {k for k in range(first, last) if w[k] or found[k][4] or (found[k][5] and found[k][3] == own)}
            inside = False
        elif not inside and i < n and w[i] and window(i) >= level:
            inside, start = True, i
    return "\n\n".join(found[k][0] for k in sorted(kept))


def test_windows_against_brute_force(spark, data):
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect()]
    unmarked = [p.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for p in pages if p]
    for page in [*pages, *unmarked]:
        assert html.extract(page) == brute(page)


def test_deep_nesting_takes_linear_time():
    import time

    began = time.process_time()
    assert html.extract("<div>x" * 16_000 + "<p>" + "word " * 40) .endswith("word")
    assert time.process_time() - began < 2


def test_paragraphs_of_an_article_stay():
    inner = ARTICLE + "<p><a href=x>A paragraph that is one link</a></p><p>***</p><p>The end.</p>"
    expected = EXPECTED + "\n\nA paragraph that is one link\n\n***\n\nThe end."
    assert html.extract(page(f"<article>{inner}</article>")) == expected
    assert html.extract(page(f"<div class=post>{inner}</div><ul><li><a href=y>Elsewhere</a></li></ul>")) == expected


def test_topics_of_an_article_are_no_side_matter():
    about = "<p>" + "engines that search " * 10 + "</p>"
    text = " ".join(["engines that search"] * 10)
    for tag, label in (("section", "class=search"), ("div", "id=legal"), ("section", "class='social sharing'")):
        assert html.extract(page(f"<article>{ARTICLE}<{tag} {label}>{about}</{tag}></article>")) == EXPECTED + "\n\n" + text
        assert html.extract(page(f"<article>{ARTICLE}<{tag} {label}><a href=x>Find</a></{tag}></article>")) == EXPECTED
    for kept_out in ("<form class=search>", "<section class=comments>", "<div class='social comments'>"):
        assert html.extract(page(f"<article>{ARTICLE}{kept_out}{about}</article>")) == EXPECTED


@pytest.mark.parametrize("part", ["<p class=tags>word " + "word " * 20 + "</p>", "<div class=tags>x" , "<p class=search>" + "word " * 20 + "</p>"])
def test_many_labels_take_linear_time(part):
    import time

    for around in ("<article>{}</article>", "<div>{}</div>"):
        began = time.process_time()
        html.extract(page(around.format(ARTICLE + part * 8_000)))
        assert time.process_time() - began < 3
