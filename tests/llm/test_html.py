from tessera.llm import html as ht

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";x(0);</script></head>
<body class="menu sidebar"><header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy <b>now</b></div><div class="page-wrap sidebar-left"><article><header><h1>Title &amp; more</h1></header>
<p><b>First&nbsp;&eacute; &#8211;  para<br>graph<br><p>Second <a href="x>y">link</a>.</p><aside>Side</aside><div class="cookie-notice">Cookies</div>
<form><p>Mail</p></form><table><tr><td>a</td><td>b</td></tr></table><script>if (a < b) c("</div>")</script><p>Last 1 < 2 &amp;amp; x</p>
<section id="comments"><article class="comment"><p>Reader says</p></article></section></article></div><footer>&copy; us</footer></body></html>"""


def article(page):
    return [t for main, _, t in ht.blocks_of(page) if main]


def test_article():
    assert article(ARTICLE) == ["Title & more", "First é – para graph", "Second link.", "a b", "Last 1 < 2 &amp; x"]


def test_odd_markup():
    assert article("") == article("no tags") == article("<nav><article><p>menu") == []
    assert article("<article><p>open <b>never closed") == ["open never closed"]
    assert article("<main><h1>A</h1>text</main>") == ["A", "text"]
    assert article('<div class="banner"><main><p>kept</p></main></div><div class="comments"><article>no</article></div>') == ["kept"]
    assert article("<article><p>a</p></article><p>between</p><article><p>b</p></article>") == ["a", "b"]
    assert article("<article><p title='a \"quote>' class=x>t</p><p hidden>h</p><p style='display: none'>d</p></article>") == ["t"]
    assert article("<article>" + "<div>" * 20_000 + "deep") == ["deep"]
    assert article("<article><p>x<script>never ends") == ["x"]
    assert article("<article><p>x <script>a</script>y</article>") == ["x y"]
    assert article("<article><![CDATA[a<b]]> <p broken='") == ["a<b"]


def test_suffix_runs():
    blocks = ["Home", "About us", "One two three four", "Copyright by them all"]
    rep = set(ht.keys(ht.stream(blocks[:2] + ["x"]), 3)) & set(ht.keys(ht.stream(blocks), 3))
    assert ht.unique_runs(blocks, [False] * 4, rep, 3) == blocks[2:]
    assert ht.unique_runs(blocks, [False, False, True, False], set(), 3) == [*blocks[:2], blocks[3]]
    assert ht.unique_runs([], [], {1}, 3) == []


def test_pages(spark):
    bare = lambda i: f"<p>Welcome to the site of sites today</p><div>Home</div><div>News</div><div>About</div><p>Story {i} is about word{i} and other{i} things</p><p>Copyright by the site of sites always</p>"
    rows = [(i, f"https://www.h.org/{i}", bare(i)) for i in range(5)]
    rows += [(5, "https://www.h.org/5", bare(4)), (6, "https://other.org/6", bare(6)), (7, None, None), (8, "http://[", ""), (9, "https://www.h.org/9", ARTICLE), (10, "https://www.h.org/10", ARTICLE), (10, "https://www.h.org/10", ARTICLE)]
    rows += [(None, "https://www.h.org/11", "<article><p>" + "long " * 100_000 + "</p></article>"), (12, "https://www.h.org/12", "   ")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in ht.main_text(pages).collect()}
    for i in (0, 1, 2, 3, 4, 5):
        assert got[i].text == f"Story {min(i, 4)} is about word{min(i, 4)} and other{min(i, 4)} things"
    assert got[6].text.startswith("Welcome") and got[6].text.endswith("always")
    assert got[7].text == got[8].text == got[12].text == "" and got[7].url is None and got[8].n_chars == 0
    assert got[9].text == got[10].text == "\n".join(article(ARTICLE)) and got[9].n_chars == len(got[9].text)
    assert got[None].n_chars == 499_999
    assert ht.main_text(pages).count() == len(rows) and ht.main_text(pages.limit(0)).count() == 0


def test_what_repeats_on_a_host(spark):
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    rows = []
    phrase = "the rest of the day was quiet"  # an ordinary phrase of three pages of many
    for i in range(80):
        rows.append((i, "https://big.org/", f"<div>Big site menu with home and news</div><p>{own(i, 12)} {phrase if i < 3 else own(i + 500, 3)} {own(i + 900, 12)}</p>"))
    body = own(2000, 40)
    for i in range(100, 104):  # one body under different menus
        rows.append((i, "https://press.org/", f"<div>Menu {own(i, 8)}</div><p>{body}</p>"))
    notice = "this small site is kept by two friends in their free time"
    for i in range(200, 202):  # a host of two pages
        rows.append((i, "https://small.org/", f"<p>{own(i, 30)}</p><p>{notice}</p>"))
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(80):
        assert got[i] == f"{own(i, 12)} {phrase if i < 3 else own(i + 500, 3)} {own(i + 900, 12)}"
    assert all(body in got[i] for i in range(100, 104))
    assert all(got[i] == own(i, 30) for i in range(200, 202))


def test_the_array_alone_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    menus = [say(9), say(14)]
    pages = []
    for i in range(14):
        blocks = [menus[i % 2], say(40), menus[0] if i % 3 else say(5), say(30)]
        pages.append((i, "http://h.example.org/" + str(i), "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
    pages.append((20, "http://other.example.org/", f"<p>{menus[0]}</p>"))
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), markup=False).collect()}

    def repeated(block, n):
        """Is every token of the block in a run of six that stands on three pages of the host?"""
        tokens = block.split() + ["\n"]
        streams = [" ".join(t for b in ht.blocks_of(p[2]) for t in (*b[2].split(), "|")) for p in pages[:14]]
        runs = [" ".join(tokens[k : k + 6]).replace("\n", "|") for k in range(len(tokens) - 5)]
        return bool(runs) and all(sum(f" {r} " in f" {s} " for s in streams) >= n for r in runs)

    for i, _, page in pages[:14]:
        want = [b for _, _, b in ht.blocks_of(page) if not repeated(b, 3)]
        assert got[i] == "\n".join(want)
    assert got[20] == menus[0]


def test_class_names_that_only_hold_a_listed_word(spark):
    body = "A paragraph of the article that says something in a sentence or two."
    kept = ["related-work", "promo-story", "notice-of-meeting", "social-history", "menu-engineering", "comment-culture", "ad-hoc"]
    for name in kept:
        assert article(f'<article><p>First.</p><div class="{name}"><p>{body}</p></div></article>') == ["First.", body]
        assert article(f'<article class="{name}"><p>{body}</p></article>') == [body]
    for name in ("ad", "ad-slot", "cookie-notice", "related-box", "wide sidebar", "comments"):
        assert article(f'<article><p>First.</p><div class="{name}"><p>{body}</p></div></article>') == ["First."]
    links = "".join(f'<a href="/{i}">{body}</a>' for i in range(3))
    assert article(f'<article><p>First.</p><div class="related-articles"><p>{links}</p></div></article>') == ["First."]
    assert article(f'<article><p>{links}</p></article>') == [" ".join([body] * 3).replace(". A", ".A")]
    assert article(f'<article><div class="related-work"><div class="ad">{body}</div><p>{body}</p></div></article>') == [body]
    rows = [(i, f"https://h{i}.org/", f'<div class="promo-story"><p>{body} Number {i} is other than all else here.</p></div>') for i in range(2)]
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Number {i} is other than all else here." in got[i] for i in range(2))


def by_tree(page):
    """The marked article by Python's own parser, for well-formed pages: block texts outside of what is never main text."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.held = [], [], []

        def flush(self):
            if text := " ".join("".join(self.held).split()):
                self.out.append(text)
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag in ht.BLOCKS:
                self.flush()
            elif tag in ht.SPACED:
                self.handle_data(" ")
            if tag not in ht.VOID:
                words = set((dict(attrs).get("class") or "").split())
                self.open.append((tag, tag in ht.NEVER | ht.OUTSIDE or bool(words & ht.WORDS_OUT)))

        def handle_endtag(self, tag):
            if tag in ht.BLOCKS:
                self.flush()
            while self.open and self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if any(t in ("article", "main") for t, _ in self.open) and not any(gone for _, gone in self.open):
                self.held.append(data)

    walk = Walk()
    walk.feed(page)
    walk.flush()
    return walk.out


def test_given_and_made_pages_against_a_tree_walk(spark):
    import os
    import random

    rnd = random.Random(17)

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["some words ", "more &amp; text ", "caf&eacute; ", " ", "x &#8211; y ", "a &lt; b "])
        tag = rnd.choice(["div", "p", "section", "b", "a", "span", "ul", "li", "aside", "nav", "form", "h2", "blockquote", "script", "table"])
        name = rnd.choice(["", "", "", ' class="ad"', ' class="lead"', ' class="comments"'])
        inner = "var x;" if tag == "script" else "".join(made(depth - 1) for _ in range(rnd.randint(1, 4)))
        return f"<{tag}{name}>{inner.replace('<p', '<div').replace('</p>', '</div>') if tag == 'p' else inner}</{tag}>"

    pages = [f"<html><body><nav>m</nav><div>{made(2)}</div><article>{''.join(made(4) for _ in range(4))}</article><footer>f</footer></body></html>" for _ in range(300)]
    if os.path.isdir("/root/testdata/sf0.001"):
        pages += [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        assert article(page) == by_tree(page)


def test_the_array_decides_about_blocks_of_marked_articles(spark):
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    page = lambda *blocks: "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    notice, quote, lead = "Read our letter for more stories like this one", "A quoted passage that other pages of this host quote too", "The weekly report of the county and its towns"
    rows, want = [], {}

    def add(host, kept, *blocks):
        want[len(rows)] = "\n".join(kept)
        rows.append((len(rows), f"https://{host}/", page(*blocks)))

    for i in range(30):  # a notice that no markup tells, a passage that some quote, short headings and a title that all have
        kept = [lead, "The introduction", own(i, 20), *([quote] if i < 12 else []), own(i + 100, 20)]
        add("big.org", kept, *kept[:3], *([notice] if i % 5 else []), *kept[3:])
    for i in range(30):  # near copies of one article, and of what else the host has
        kept = [own(500, 30), own(501, 30), own(502, 30), f"edited {i}"] if i < 24 else [own(600 + i, 30), own(700 + i, 30)]
        add("copies.org", kept, *kept)
    for i in range(45):  # looser copies, whose least hashes differ, are more than half of a host
        kept = [own(2000, 8), *(own(2001 + j, 8) if i % 7 != j else own(3000 + 10 * i + j, 8) for j in range(7))] if i < 30 else [own(4000 + i, 30), own(4100 + i, 30)]
        add("loose.org", kept, *kept)
    for i in range(9):  # a host of too few articles
        add("small.org", [own(900 + i, 20), notice], own(900 + i, 20), notice)
    for i in range(12):  # on most of one host is on some of another
        kept = [own(1000 + i, 20), own(1100 + i, 20), *([notice] if i < 5 else [])]
        add("some.org", kept, *kept)
    for h in range(60):  # whatever the least hashes of a notice
        for i in range(30):
            kept = [own(5000 + 40 * h + i, 60), own(9000 + 40 * h + i, 60)]
            add(f"h{h}.org", kept, *kept, f"Read letter number {h} of this host for more stories like it")
    got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    lost = sum(r.text != want[r.page_id] and "Read letter number" in r.text for r in got)
    assert lost <= 60  # of 60 hosts two at most, those of notices with two very small hashes
    got = [r for r in got if "Read letter number" not in r.text]
    assert {r.page_id: r.text for r in got} == {r.page_id: want[r.page_id] for r in got} and len(got) == len(rows) - lost and all(r.n_chars == len(r.text) for r in got)


def test_sketches():
    text = " ".join(f"word{i}" for i in range(200))
    assert ht.sketch("") == ht.sketch(" ") == [0, 0, 0] and ht.sketch("one") == ht.sketch(" one ") != ht.sketch("two")
    assert ht.sketch("one two") != ht.sketch(text) == ht.sketch(text.replace(" ", "\n"))
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    agree, likely = 0, 0.0
    for i in range(100):
        other = text.replace(f"word{i + 50} ", "").replace(f"word{i + 20} ", f"other{i} ").replace(f"word{i} ", "x y ")
        agree += sum(a == b for a, b in zip(ht.sketch(text), ht.sketch(other)))
        likely += 3 * len(runs(text) & runs(other)) / len(runs(text) | runs(other))
    assert abs(agree - likely) < 40
