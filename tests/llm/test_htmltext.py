from pitgrid.llm import htmltext

ARTICLE = "<p>Plain text of some length, with &amp; and <b>bold</b>face.</p><p>Second<br>line   here\n now</p>"
PAGES = [
    ("http://a.example/1", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class='ad'>buy now</div><article><h1>Head</h1>{ARTICLE}</article><footer>&copy; f</footer></body></html>"),
    ("http://a.example/2", f"<body><script>var x='<p>no</p>';</script><div class=main-text>{ARTICLE}<div id=comments><p>me too, I like this very much indeed</p></div></div><aside>side</aside><form><input><label>name</label></form>"),
    ("http://b.example/", None), ("http://b.example/", ""), (None, "<p>just a paragraph"), ("nonsense", "<nav>only a menu</nav>"),
    ("http://c.example/", "a < b and <unclosed"), ("http://c.example/x", "<div>" * 3000 + "deep" + "</div>" * 3000), ("http://c.example/y", "<p>" + "word " * 50_000),
]
WANT = ["Head Plain text of some length, with & and boldface. Second line here now", "Plain text of some length, with & and boldface. Second line here now",
        "", "", "just a paragraph", "", "a < b and <unclosed", "deep", ("word " * 50_000).strip()]


def rows(spark):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(PAGES)] * 2, "page_id long, url string, html string, host string, winners string")


def test_texts(spark):
    got = htmltext.main_text(rows(spark)).collect()
    assert len(got) == 2 * len(PAGES)
    for r in got:
        assert (r.text, r.n_chars, r.url) == (WANT[r.page_id], len(WANT[r.page_id]), PAGES[r.page_id][0])


def test_host_vote_wins(spark):
    usual = "<body><div class='post n12'><p>the article of this host</p></div><div class='feed'><p>short</p></div>"
    odd = "<body><div class='post n7'><p>brief</p></div><div class='feed'><p>a teaser that is much longer than the article</p></div>"
    pages = spark.createDataFrame([(i, "https://h.example/", usual) for i in range(5)] + [(9, "https://H.example:80/q", odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert got[9] == "brief" and got[0] == "the article of this host"
    assert htmltext.extract(odd, None).startswith("a teaser")


UNLUCKY = [
    "<body><nav>menu</nav><article class='post social-post'>{}</article></body>", "<body><div class='share'>{}</div></body>", "<body><div class='elementor widget'>{}</div><footer>f</footer></body>",
    "<body class='search'>{}</body>", "<body class='has-sidebar nav-open'><div>{}</div></body>", "<body><div class='content has-sidebar'><div class='sidebar'>side links</div><div>{}</div></div></body>",
    "<form id='aspnetForm'><div class='header'>top</div><div>{}</div></form>", "<main id='search'>{}<div class='comments'>" + "<p>long comments of readers, longer than the article</p>" * 9 + "</div></main>",
    "<div class='promo'>buy</div><div class='related-widget'><div class='social'>like</div>{}</div>",
]


def test_unlucky_names_lose_no_article():
    whole = htmltext.extract(f"<article>{ARTICLE}</article>", None)
    assert whole == WANT[1]
    for page in UNLUCKY:
        assert htmltext.extract(page.format(ARTICLE), None) == whole, page


def test_siblings_stay():
    one, two = "<p>first article, of some length</p>", "<p>second article, longer than the first one</p>"
    for a, b in (("article", "article"), ("div class=n1", "div class=n2")):
        page = f"<body><nav>x</nav><{a}>{one}</{a.split()[0]}><{b}>{two}</{b.split()[0]}><footer>f</footer></body>"
        want = "first article, of some length second article, longer than the first one"
        assert htmltext.extract(page, None) == want
        assert htmltext.extract(page, [htmltext.Page(page).paths[-2]] if a == "article" else None) == want


def test_ties_go_to_the_first():
    page = "<body><div class=a><p>same length</p></div><section><div class=b><p>same size!!</p></div></section></body>"
    assert htmltext.extract(page, None) in ("same length same size!!", "same length")
    assert htmltext.extract(page, ["body>x", "html>none"]) == htmltext.extract(page, None)


def test_against_marked_pages(spark):
    """Every given page against a reading that knows which words stand in what part of a page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip, self.words = [], [], []

        def handle_starttag(self, tag, attrs):
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            bad = tag in htmltext.DROPPED or tag in ("script", "style", "form") or (tag not in htmltext.KEPT and htmltext.NOISE.search(named))
            if tag not in htmltext.VOID:
                self.skip.append((tag, bool(bad)))

        def handle_endtag(self, tag):
            while self.skip and any(t == tag for t, _ in self.skip):
                t, _ = self.skip.pop()
                if t == tag:
                    break

        def handle_data(self, data):
            if not any(b for _, b in self.skip):
                self.words += data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    for p in pages.collect():
        reader = Reader()
        reader.feed(p.html or "")
        got, left = texts[p.page_id].text.split(), iter(reader.words)
        assert all(w in left for w in got), p.page_id  # in page order, and nothing from the dropped parts
        assert len(got) >= 0.6 * len(reader.words), p.page_id


def test_empty(spark):
    assert htmltext.main_text(rows(spark).limit(0)).count() == 0
