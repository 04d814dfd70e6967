import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import rows  # noqa: E402

from seaflow.llm import html_extraction as H  # noqa: E402


def one(html):
    page = H.Page(html)
    return page.text_below(page.best_place())


def test_cases_of_one_page():
    cases = {
        None: "",
        "": "",
        "just text": "just text",
        "<p>a<p>b": "a\nb",
        "<article><h1>T &amp; U</h1><p>x\n  y<br>z</p></article><p>out</p>": "T & U\nx y z",
        "<main><p>one</p><aside><p>side</p></aside><p>two</p></main>": "one\ntwo",
        "<div class='post'><p>in</p><div class='comment-list comments'><p>nice!</p></div></div><p>other</p>": "in",
        "<header>h</header><nav>n</nav><p>body</p><footer>f</footer>": "body",
        "<article><header><h1>Title</h1></header><p>b</p><footer>f</footer></article>": "Title\nb",
        "<article><p>a</p><script>var t='</p>';</script><style>p{}</style><p>b</p></article>": "a\nb",
        "<article><p>a<!-- <p>no</p> --></p><form><input><p>no</p></form><p>1 &lt; 2 &#233;&nbsp;x</p>": "a\n1 < 2 é x",
        "<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>": "one\ntwo\nc\nd",
        "<article><p>cut off <b>here": "cut off here",
        "<article><div id=cookie-notice>we use</div><div role='navigation'>m</div><p>t</p></article>": "t",
        "<article><p>a <span class=ad>buy</span> b</p></article>": "a b",
        "<div hidden><p>no</p></div><p>yes</p>": "yes",
        '<p title="a > b">quoted</p>': "quoted",
        "<script>only</script>": "",
        "a < b and c > d": "a < b and c > d",
    }
    for html, text in cases.items():
        assert one(html) == text, html


def test_long_and_deep_pages():
    assert one("<article>" + "<p>word</p>" * 20_000).count("\n") == 19_999
    assert one("<div>" * 5_000 + "<p>deep</p>") == "deep"
    assert one("<b>" * 20_000 + "x") == "x"


def site(n, host="h.example", slot="story-body"):
    def page(k):
        return (
            f"<html><body><div class='top'>Site {k}</div><div class='{slot}'><p>Main text number {k} of page.</p>"
            f"<p>Shared passage.</p></div><div class='box'><p>box {k} with rather a lot of other text in it</p></div>"
        )

    return [(k, f"https://{host}/p/{k}", page(k)) for k in range(n)]


SCHEMA = "page_id long, url string, html string"


def test_template_of_a_host(spark):
    pages = site(6) + [(50, "https://h.example/other", "<p>no slot here</p>"), (51, None, None), (52, "x", ""), (3, "https://h.example/p/3", site(6)[3][2])]
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "page_id as host", "url as token", "html as place")
    places = {r["host"]: r["slots"] for r in rows(H.templates(df))}
    assert places == {"h.example": ["/html/body/div.body.story"]}
    found = rows(H.extract(df))
    assert len(found) == len(pages)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[2] == "Main text number 2 of page.\nShared passage."
    assert [texts[i] for i in (50, 51, 52)] == ["no slot here", "", ""]


def test_classes_decide_and_names_only_within_them(spark):
    def page(k):
        extra = "<p class='promoted-by-editor'>An editor chose this.</p>" if k == 1 else ""
        extra += "<h2 id='related-work'>Related work</h2>" if k == 2 else ""
        extra += "<div class='social-sciences'>On societies.</div><div class='ad'>Buy!</div>" if k == 3 else ""
        return (
            f"<html><body><div class='line'>Home News About</div><main><div class='topics'><ul><li>One<li>Two</ul></div>"
            f"<h1>Title {k}</h1><p>Text {k}.</p>{extra}<p>Shared words.</p>"
            f"<div class='comment-list'><p>comment {k}</p></div></main><div class='late'>Late news {k}</div></body>"
        )

    def split(k):
        return (
            f"<body><div class='bar'>Menu of all</div><div class='post-intro'>Intro {k}</div><div class='x'>x {k}</div>"
            f"<div class='post-body'><p>Body {k}</p></div>"
        )

    def plain(k):
        return f"<body><div class='bar'>Menu of all</div><div class='one'>First {k}</div><div class='two'>Second {k}</div>"

    pages = [(k, f"https://a.example/{k}", page(k)) for k in range(6)]
    pages += [(10 + k, f"https://b.example/{k}", split(k)) for k in range(4)]
    pages += [(20 + k, f"https://c.example/{k}", plain(k)) for k in range(4)]
    pages += [(30 + k, f"https://d.example/{k}", page(k)) for k in range(2)]  # too few for a template
    pages += [(40 + k, f"https://e.example/{k}", f"<i>{k}</i><article><p>Alike.</p></article>") for k in range(4)]
    pages += [(50 + k, f"https://f.example/{k}", f"<i>{k}</i><article><div><p>All alike.</p></div></article>") for k in range(4)]
    found = {r["page_id"]: r["text"] for r in rows(H.extract(spark.createDataFrame(pages, SCHEMA)))}
    body = "Title {0}\nText {0}.{1}\nShared words."
    assert found[0] == body.format(0, "")
    assert found[1] == body.format(1, "\nAn editor chose this.")
    assert found[2] == body.format(2, "\nRelated work")
    assert found[3] == body.format(3, "\nOn societies.")
    assert found[12] == "Intro 2\nBody 2"
    assert found[22] == "First 2\nSecond 2"
    assert found[31] == "One\nTwo\nTitle 1\nText 1.\nShared words."
    assert [found[41], found[51]] == ["Alike.", "All alike."]


def test_templates_against_brute_force(spark):
    """The template of random sites, from sets of pages counted here."""
    import random

    rng = random.Random(8)
    parts = ["<div class='a'>same</div>", "<div class='b'>{}</div>", "<main><p>{}</p></main>", "<div class='post'>{}</div>", "<div class='menu-x'>{}</div>"]
    pages = [
        (100 * h + k, f"https://{h}.example/{k}", "<body>" + "".join(p.format(k) for p in parts if rng.random() < 0.75 + 0.05 * (h % 5)))
        for h in range(12)
        for k in range(rng.randint(1, 12))
    ]
    found = {r["host"]: r for r in rows(H.templates(spark.createDataFrame(pages, SCHEMA)))}
    for h in range(12):
        site = sorted({html for i, _, html in pages if i // 100 == h})
        read = [H.Page(html) for html in site]
        least = max(3, 0.8 * len(site))
        seen = {}
        for page in read:
            for token in page.tokens:
                seen[token] = seen.get(token, 0) + 1
        valid = {t for t, n in seen.items() if n >= least}
        if not valid:
            assert f"{h}.example" not in found
            continue
        ranks = {t: read[0].ranks.get(t, p.ranks.get(t)) for p in read for t in valid if t in p.ranks}
        named = [t for t, r in ranks.items() if r is not None and r < 3]
        best = min((ranks[t] for t in named), default=None)
        got = found[f"{h}.example"]
        assert got["slots"] == (sorted(t for t in named if ranks[t] == best) or [""])
        assert got["fixed"] == (["/body/div.a"] if seen.get("/body/div.a", 0) >= least else [])
        assert got["phrased"] == (["/body/div.menu.x"] if seen.get("/body/div.menu.x", 0) >= least else [])


def test_classes_share_occurrence_vectors(spark):
    pages = site(4) + [(9, "https://h.example/9", "<html><body><div class='top'>x</div><p>y</p>")]
    found = rows(H.classes(spark.createDataFrame(pages, SCHEMA)))
    by_token = {t["token"]: (r["vector"], r["n_pages"]) for r in found for t in r["tokens"]}
    assert by_token["/html"] == by_token["/html/body"] == by_token["/html/body/div.top"]
    assert by_token["/html"][1] == 5
    assert by_token["/html/body/div.body.story"] == by_token["/html/body/div.box"] != by_token["/html"]


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0
