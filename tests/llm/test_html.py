import random
import re

from keysieve.llm import html

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head>"


def text_of(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS blocks", "'z' AS text")
    return {r.page_id: r.text for r in html.extract(frame).collect()}


def test_article_without_the_rest(spark):
    page = (
        HEAD + "<body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<div class=\"ad\">Buy</div><article><header><h1>A &amp; B</h1></header><p><b>First\n  par&eacute;.<br><p>Second <i>one</i>"
        "<span class='ad'>x</span> here.</p><!-- no --><ul><li>p<li>q</ul><div class='share'>Share</div><form>f<input></form>"
        "<section id='comments'><p>I disagree</p></section></article><aside>side</aside><footer>&copy; foot</footer></body></html>"
    )
    cut = HEAD + "<body><nav>n</nav><article><h1>Title</h1><p>one &am"
    tag = HEAD + "<body><article><p>one</p><p>two</p><di"
    deep = "<body><article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"
    pages = [(1, "http://a.org/1", page), (2, "http://a.org/2", cut), (3, "HTTP://A.org:80/3", tag), (4, None, None), (5, "", ""),
             (6, "x", deep), (6, "x", deep), (7, "http://b.org", "<p>a</p><p>b<table><tr><td>c<td>d</table>"),
             (8, "http://c.org", "<article>" + "<p>w</p>" * 20000)]
    got = text_of(spark, pages)
    assert got[1] == "A & B\nFirst paré.\nSecond one here.\np\nq"
    assert got[2] == "Title\none &am" and got[3] == "one\ntwo" and got[4] == got[5] == "" and got[6] == "deep"
    assert got[7] == "a\nb\nc\nd" and got[8] == "\n".join(["w"] * 20000)
    assert text_of(spark, []) == {}


def test_head_without_an_end(spark):
    """A head that is not closed ends where the body or anything that cannot stand in it begins."""
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><script>var a;</script><noscript><img src=x></noscript><style>p{}</style>"
    article = "<article><p>one</p><p>two</p></article>"
    pages = [(1, "http://a.org/", f"{head}<body>{article}</body></html>"), (2, "http://b.org/", f"{head}{article}"),
             (3, "http://c.org/", f"{head}\n bare <b>text</b>"), (4, "http://d.org/", f"{head}<noscript><link href=x><body>{article}"),
             (5, "http://e.org/", f"{head}<p>x</p></head><body><p>y</p>"), (6, "http://f.org/", f"{head}<b>bold</b> start")]
    assert text_of(spark, pages) == {1: "one\ntwo", 2: "one\ntwo", 3: "bare text", 4: "one\ntwo", 5: "x\ny", 6: "bold start"}


def test_formulas_are_text(spark):
    """What is shown of a formula is; its source in another language is not shown."""
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><mspace width='1'/></mrow></math>"
    tex = "<math><semantics><mi>z</mi><annotation encoding='application/x-tex'>z</annotation></semantics></math>"
    got = text_of(spark, [(1, "http://a.org/", f"<body><article><p>Let {formula} hold, and {tex}.</p></article>")])
    assert got == {1: "Let x=1y hold, and z."}


def test_names_of_text_are_no_marks(spark):
    """Ids are slugs of headings; inside an article only a container whose whole name says so is apart."""
    kept = ("<h2 id='related-work'>1</h2><h2 id='legal-status'>2</h2><h2 id='search' class='search-title'>3</h2><p id='comment-on-results'>4</p>"
            "<p class='read-more-text'>5</p><section id='form-of-government'><p>6</p></section><h3 id='comments'>7</h3>"
            "<div class='legal-status'>8</div><ul><li id='menu'>9</li></ul><div class='more-results-of-search'>10</div>")  # fmt: skip
    gone = ("<div class='related-posts'>a</div><div class='social-share'>b</div><div id='comments'><p>c</p></div><div role='navigation'>d</div>"
            "<ul class='share-buttons'><li>e</li></ul><div class='ad-slot'>f</div><div hidden>g</div><section class='comments-area'>h</section>")  # fmt: skip
    open_ = "<h2 id='related-work'>1</h2><p id='legal-status'>2</p><p class='cookie-notice'>a</p><div id='main-menu'>b</div><div class='sidebar'>c</div>"
    got = text_of(spark, [(1, "http://a.org/", f"<body><article>{kept}{gone}</article></body>"), (2, "http://b.org/", f"<body>{open_}</body>")])
    assert got == {1: "\n".join(map(str, range(1, 11))), 2: "1\n2"}


def test_paragraphs_are_not_cut(spark):
    """Elements that are not blocks stand within a line, unknown ones included, whether their text is shown or not."""
    line = ("<p>one <script>x</script>two <acronym>NATO</acronym> three <svg><text>s</text></svg>four <picture><source><img></picture>five "
            "<x-tip>six</x-tip> sev<button>b</button>en <video>v</video><input>eight <nobr>ni</nobr>ne</p>")  # fmt: skip
    got = text_of(spark, [(1, "http://a.org/", f"<body><article>{line}<x-card><p>a</p>b</x-card></article></body>")])
    assert got == {1: "one two NATO three four five six seven eight nine\na\nb"}


def test_induction_decides_where_marks_are_missing(spark, sf_dir):
    """Pages without any mark: what their host repeats goes only if pages of the host are seen together."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").limit(40).collect()
    pages, alone = [], []
    for n, r in enumerate(rows):
        plain = re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|form)\b[^>]*>", r"<\1div>", r.html or "")
        plain = re.sub(r'(?<=div) (?:class|id|role)="[^"]*"', "", plain)
        plain = plain.replace("<body>", "<body><div><p>The same welcome</p></div>").replace("</body>", "<div><p>The same end</p></div></body>")
        pages.append((n, "http://host.org/", plain))
        alone.append((n, f"http://host{n}.org/", plain))
    together, apart = text_of(spark, pages), text_of(spark, alone)
    assert sum("The same" in t for t in apart.values()) == len(rows)
    assert sum("The same" in t for t in together.values()) <= 0.1 * len(rows)


def test_invalid_utf8(spark):
    frame = spark.sql("SELECT 1L AS page_id, 'u' AS url, cast(unhex(concat(hex('<article>a'), 'FF', hex('b'))) AS string) AS html")
    assert [r.text for r in html.extract(frame).collect()] == ["a�b"]


def test_induced_template(spark):
    """Without any telling tag or class, what all pages of a host repeat in the same place is template."""
    pages = []
    for n in range(8):
        extra = "<div><p>Another box</p></div>" if n % 3 == 0 else ""
        pages.append((n, f"http://host.org/{n}", f"<body><div><p>Welcome here</p></div>{extra}<div><p>Story {n}.</p><p>More of {n}.</p></div>"
                                                 "<div><a href='x'>All stories of this site</a></div><p>Bye now</p></body>"))  # fmt: skip
    pages += [(100 + n, "http://copies.org/", "<body><p>Same page</p></body>") for n in range(9)]
    got = text_of(spark, pages)
    for n in range(8):
        assert "Welcome here" not in got[n] and "Bye now" not in got[n] and "All stories" not in got[n]
        assert f"Story {n}.\nMore of {n}." in got[n]
    assert all(got[100 + n] == "Same page" for n in range(9))


def test_several_constants_in_one_node(spark):
    """Repeated siblings are one node; each text that all pages have in it is template, in an article from 12 pages on."""
    same = "<p>Welcome</p><p>Subscribe now</p>"
    pages = [(n, f"http://plain.org/{n}", f"<body><div>{same}<p>Story {n}</p></div></body>") for n in range(8)]
    pages += [(100 + n, f"http://marked.org/{n}", f"<body><article>{same}<p>Story {n}</p></article></body>") for n in range(12)]
    pages += [(200 + n, f"http://few.org/{n}", f"<body><article>{same}<p>Story {n}</p></article></body>") for n in range(11)]
    got = text_of(spark, pages)
    assert all(got[n] == f"Story {n}" and got[100 + n] == f"Story {n}" for n in range(8))
    assert all(got[200 + n] == f"Welcome\nSubscribe now\nStory {n}" for n in range(11))


def test_templates_of_one_host(spark):
    """A host's sections, and templates of other structure, have a template each, whatever their share of its pages."""

    def section(n, name):
        return f"<body class='{name}'><div><p>Welcome to {name}</p></div><div><p>Story {n}.</p></div><div><p>Bye, {name}</p></div></body>"

    def table(n):
        return f"<body class='news'><table><tr><td>Rates of today</td></tr></table><dl><dt>Term</dt><dd>Value {n}</dd></dl></body>"

    pages = [(n, f"http://host.org/{n}", section(n, "news" if n < 10 else "sport")) for n in range(16)]
    pages += [(100 + n, f"http://host.org/t{n}", table(n)) for n in range(4)]
    extra = "<ul><li>Read this too</li></ul>"
    pages += [(200 + n, f"http://box.org/{n}", f"<body><div><p>Story {n}</p></div>{extra if n < 5 else ''}</body>") for n in range(20)]
    got = text_of(spark, pages)
    assert all(got[n] == f"Story {n}." for n in range(16))
    assert all(got[100 + n] == f"Value {n}" for n in range(4))
    assert all(got[200 + n] == f"Story {n}" for n in range(20))


def test_rounds_end(spark):
    """Skeletons of one host that share nothing, or only their upper levels, are all placed."""
    body = ["".join(f"<{tag} class='{'abcdefgh'[n]}{'xyz'[k]}'>" for k, tag in enumerate(("div", "section", "table"))) for n in range(8)]
    pages = [(n, "http://odd.org/", f"<body>{body[n]}{n}") for n in range(8)]
    pages += [(10 + n, "http://odd.org/", "<body><div><div><div>" + "<b><dl>" * n + f"text {n}") for n in range(6)] + [(90, "http://odd.org/", "")]
    got = text_of(spark, pages)
    assert all(got[n] == str(n) for n in range(8)) and all(got[10 + n] == f"text {n}" for n in range(6)) and got[90] == ""


def brute_match(a, b):
    if a.label != b.label:
        return 0

    def children(x, y):
        if not x or not y:
            return 0
        return max(children(x[:-1], y), children(x, y[:-1]), children(x[:-1], y[:-1]) + brute_match(x[-1], y[-1]))

    return 1 + children(a.children, b.children)


def test_simple_tree_matching():
    rng = random.Random(0)

    def tree(depth):
        label = rng.choice("abc")
        parts = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return f"{label}({','.join(parts)})" if parts else label

    for _ in range(200):
        a, b = html.read_skeleton(f"r({tree(2)},{tree(2)})"), html.read_skeleton(f"r({tree(2)},{tree(2)})")
        pairs = html.align(a, b)
        assert len(pairs) == html.match(a, b, {}) == brute_match(a, b) and len(set(pairs.values())) == len(pairs)
        assert pairs[0] == 0
