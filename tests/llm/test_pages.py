import numpy as np
import pytest

from playlytics.llm import extraction, urls
from playlytics.llm.queries import op4_extraction, op5_url_filter

PAGES = "page_id bigint, url string, html string"


def text_of(html):
    return extraction.contained(extraction.parse(html))


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<article><h1>A  b</h1><p>c\n d<br>e</p></article>", "A b\nc d e"),
        ("<nav><p>menu</p></nav><article><p>a &amp; b &lt;c&gt; &#233;&copy</p></article><footer>f</footer>", "a & b <c> é©"),
        ("<article><p>a<p>b<b>c<p>d</article><p>after", "a\nbc\nd"),
        ("<article>a<!-- <p>no</p> -->b<script>var t='</p>';</script> c<style>p{}</style></article>", "ab c"),
        ("<article><header>h</header><p>t</p><aside>s</aside><div class='post comments'>c</div><form>f<p>g</form></article>", "t"),
        ("<article><p>x</p><div id=\"cookie-notice\"><p>y</p></div><p class=lead>z</p></article>", "x\nz"),
        ("<main><p>m</p></main><p>o</p>", "m"),
        ("<main>m<article>a</article></main>", "a"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
        ("<ARTICLE><P TITLE='a > b'>q</P></ARTICLE>", "q"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article></article>", ""),
        ("</div></p><article><p>a</span>b</p></article>", "ab"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<!-- <script src=x> --><article><p>a</p></article>", "a"),
        ("<script>x = '<!--';</script><article><p>a</p></article><!-- b -->", "a"),
        ("<script>x = '<article>';</script><main>m</main>", "m"),
        ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"),
        ("<div id='post-with-comments'><article><p>a</p></article></div>", "a"),
        ("<div class='sidebar'><article>t</article></div><article><p>a</p></article>", "a"),
        ("<aside><article>t</article></aside><main><p>m</p></main>", "m"),
        ("<form><div class='page-header'>h</div><article><p>a</p><div class='article-comments'>c</div></article>x</form>", "a"),
        ("<div class='cookie'>c<main><p>m</p><div class=ad-slot>b</div></main></div>", "m"),
        ("<main><div class=related><article>t</article></div><p>the text</p></main>", "the text"),
        ("<main><article><h1>long</h1><p>" + "w " * 50 + "</p></article><article><p>teaser</p></article></main>", "long\n" + ("w " * 50).strip()),
        ("<article><div class='entry-header'><h1>t</h1></div><div class='siteNotice'>n</div><p data-role='header'>p</p></article>", "t\np"),
        ("<article><p>a</p><article class='comment'><p>c</p></article><div class='comments'><article>d</article></div></article>", "a"),
        ("<nav><article>n</article></nav><p>o</p>", "o"),
    ],
)
def test_main_text_is_not_lost(html, text):
    assert text_of(html) == text


def test_container_is_seen_in_the_markup_only(spark):
    menu = " ".join(f"item{i}" for i in range(12))
    html = lambda i: f"<script>'<article>'</script><!-- <main> --><div>{menu}</div><p>own{i}</p>"
    rows = [(i, "http://a.example/", html(i)) for i in range(5)] + [(9, None, f"<p>{menu}</p>"), (10, None, f"<p>{menu} x</p>")]
    got = extraction.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r["text"] for r in got) == sorted(["", "x", *[f"own{i}" for i in range(5)]])


def test_suffix_ranks_against_slices():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 200)
    for depth in (1, 2, 5, 8, 13):
        rank = extraction.suffix_ranks(tokens, depth)
        parts = [tuple(tokens[i : i + depth]) for i in range(len(tokens))]
        order = {p: k for k, p in enumerate(sorted(set(parts)))}
        assert [order[p] for p in parts] == rank.tolist()


def test_repeats_against_brute_force():
    rng = np.random.default_rng(2)
    shared = [f"s{i}" for i in range(12)]
    pages = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 40))]
        pages.append((k // 2 if k < 4 else k, words[:5] + shared[k % 5 :] + words[5:]))
    run = 4
    seen = {}
    for name, words in pages:
        for i in range(len(words) - run + 1):
            seen.setdefault(tuple(words[i : i + run]), set()).add(name)
    for (_, words), covered in zip(pages, extraction.repeated_words(pages, run), strict=True):
        want = np.zeros(len(words), bool)
        for i in range(len(words) - run + 1):
            if len(seen[tuple(words[i : i + run])]) > 1:
                want[i : i + run] = True
        assert covered.tolist() == want.tolist()


def test_pages_without_container_lose_what_their_host_repeats(spark):
    menu = " ".join(f"item{i}" for i in range(12))
    own = lambda i: " ".join(f"p{i}w{k}" for k in range(6))
    html = lambda i: f"<div>{menu}</div><p>{own(i)}</p><div>legal text that all pages of the host carry below {i}</div>"
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(5)] + [(9, "http://b.example/", html(9)), (9, "http://b.example/", html(9))]
    rows += [(10, None, None), (None, "x", "<p>a</p>"), (11, "http://a.example/", "<article><p>" + menu + "</p></article>")]
    got = extraction.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert texts[(3, "http://a.example/3")].split("\n") == [own(3), "3"]
    assert menu in texts[(9, "http://b.example/")] and texts[(11, "http://a.example/")] == menu
    assert texts[(10, None)] == "" and texts[(None, "x")] == "a"


def test_groups_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(extraction, "GROUP", 10)
    menu = " ".join(f"item{i}" for i in range(12))
    rows = [(i, "http://a.example/", f"<div>{menu}</div><p>own{i}</p>") for i in range(100)]
    got = extraction.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r["text"] for r in got) == sorted(f"own{i}" for i in range(100))


def test_extraction_query(spark, folder):
    from html.parser import HTMLParser

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.text, self.inside = [], "", 0

        def flush(self):
            if self.text.split():
                self.blocks.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("article", "h1", "p"):
                self.flush()
            elif tag == "br":
                self.text += " "

        def handle_endtag(self, tag):
            if tag in ("article", "h1", "p"):
                self.flush()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.text += data

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op4_extraction(spark, folder).collect()
    assert {r["page_id"] for r in got} == set(pages)
    for r in got:
        parser = Articles()
        parser.feed(pages[r["page_id"]])
        parser.close()
        assert r["text"] == "\n".join(parser.blocks) and r["n_chars"] == len(r["text"])
    assert extraction.extract_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""),
        ("a.org/x", "", ""),
        ("http://A.ÉX.Org/En/X?q#f", "a.Éx.org", "/En/X"),
        ("https://h", "h", ""),
        ("h://x?y/z", "x", ""),
        ("h://x#y/z", "x", ""),
        ("h:///p", "", "/p"),
        ("u://a://b/c", "a:", "//b/c"),
    ],
)
def test_url_parts(url, host, path):
    assert urls.split_url(url) == (host, path)


def test_verdicts(spark):
    cases = {
        "http://x.net/": ("net/", "block"),
        "http://net/a": ("net/", "block"),
        "http://xnet/": (None, "allow"),
        "http://x.net": (None, "allow"),
        "http://a.example.net/en/1": ("example.net/en/", "allow"),
        "http://badexample.net/en/1": ("net/", "block"),
        "http://example.com/de/": ("example.com/de/", "block"),
        "http://example.com/deu": (None, "allow"),
        "http://a.org/fr/casino": ("org/fr/", "allow"),
        "http://a.org/Casino": (None, "block"),
        "http://casinos.org/": (None, "allow"),
        "http://free.org/free": (None, "allow"),
        "http://free-bets.org/": (None, "block"),
        "http://a.org/?q=win&x=bonus": (None, "block"),
        "": (None, "allow"),
        None: (None, "allow"),
    }
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id bigint, url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(frame).collect()}
    assert got == cases


def test_vocabulary_against_brute_force():
    words = {"ab": 1.0, "b": 0.5, "bab": 0.25, "a-b": 2.0}
    finder = urls.Vocabulary(words, 1.0)
    for url in ("ab", "bab", "a-b-ab", "AB/b", "xab", "éabé b", "", "b.b.b"):
        low = url.translate(urls._LOWER)
        inside = lambda c: c.isascii() and c.isalnum()
        want = sorted(
            w
            for w in words
            if any(
                low.startswith(w, i) and not (i and inside(low[i - 1])) and not (i + len(w) < len(low) and inside(low[i + len(w)]))
                for i in range(len(low))
            )
        )
        assert finder.weigh(url)[1] == want
    assert urls.Vocabulary({}, 1.0).weigh("x") == (0, [])


def test_url_query_keeps_every_row(spark, folder):
    assert op5_url_filter(spark, folder).count() == spark.read.parquet(f"{folder}/pages.parquet").count()
    clash = spark.createDataFrame([(1, "x", "y")], "page_id bigint, url string, Host string")
    with pytest.raises(ValueError):
        urls.judge_urls(clash)


def test_runs_shared_by_few_pages_of_a_large_host(spark, monkeypatch):
    note = " ".join(f"note{i}" for i in range(9))
    some = " ".join(f"some{i}" for i in range(9))
    shared = lambda i: f"<div>{note}</div>" * (i in (3, 60)) + f"<div>{some}</div>" * (i % 20 == 0)
    own = lambda i: " ".join(f"p{i}w{k}" for k in range(9))
    rows = [(i, f"http://a.example/{i}", f"{shared(i)}<p>{own(i)}</p>") for i in range(100)]
    rows += [(200, "http://b.example/", f"<p>{note}</p>"), *rows[:1]]
    frame = spark.createDataFrame(rows, PAGES)
    whole = sorted(extraction.extract_text(frame).collect())
    monkeypatch.setattr(extraction, "GROUP", 10)
    grouped = sorted(extraction.extract_text(frame).collect())
    assert grouped == whole
    assert sorted(r["text"] for r in grouped) == sorted([own(0), note, *map(own, range(100))])


def test_terms_of_four_languages_and_encoded_urls(spark):
    cases = {
        "http://a.example/%63asino": "block",
        "http://a.example/CAS%49NO": "block",
        "http://a.example/sportwetten/": "block",
        "http://a.example/tragaperras": "block",
        "http://a.example/gratuit-rencontres": "block",
        "http://a.example/billig": "allow",
        "http://a.example/buy-online-deals": "block",
        "http://a.example/buy-online": "allow",
        "http://a.example/100%25free": "allow",
        "http://a.example/%zz%": "allow",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    assert {r["url"]: r["verdict"] for r in urls.judge_urls(frame).collect()} == cases
    assert len(urls.TERMS) > 250 and all(t == t.lower() and t.isascii() for t in urls.TERMS)


NOTICE = "read all news of the day in our weekly letter and tell your friends"


def noticed(n, with_notice, host="http://a.example/", first=0):
    own = lambda i, k: " ".join(f"p{i}w{k}x{j}" for j in range(15))
    notice = lambda i: f"<p>{NOTICE}</p>" * with_notice(i)
    return [(first + i, f"{host}{i}", f"<article><p>{own(i, 0)}</p>{notice(i)}<p>{own(i, 1)}</p><p>{own(i, 2)}</p></article>") for i in range(n)]


@pytest.mark.parametrize("group", [1000, 5])
def test_hosts_decide_inside_containers(spark, monkeypatch, group):
    monkeypatch.setattr(extraction, "GROUP", group)
    # on half of the texts of one host, on fewer of another, on too few texts of a third
    rows = noticed(20, lambda i: i % 2 == 0) + noticed(20, lambda i: i < 9, "http://b.example/", 100) + noticed(7, lambda i: True, "http://c.example/", 200)
    # eight versions of a text, and copies of another: neither is a notice
    long = " ".join(f"long{j}" for j in range(60))
    rows += [(300 + i, f"http://d.example/{i}", f"<article><p>{long}</p><p>version {i}</p></article>") for i in range(8)]
    rows += [(400 + i, f"http://e.example/{i}", f"<article><p>{long}</p></article>") for i in range(30)]
    rows += [(500, "http://a.example/x", f"<div>{NOTICE}</div>"), (501, "http://a.example/y", "<article></article>")]
    plain = {r[0]: text_of(r[2]) for r in rows}
    got = {r["page_id"]: r["text"] for r in extraction.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text in got.items():
        assert text == (plain[i].replace(f"{NOTICE}\n", "") if i < 100 else NOTICE if i == 500 else plain[i])
    assert NOTICE in plain[0] and NOTICE not in got[0] and NOTICE in got[100]


def test_frequent_runs_against_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 30))) for _ in range(n)]
        held = {}
        for k, text in enumerate(texts):
            words = text.split()
            for i in range(len(words) - 3):
                held.setdefault(tuple(words[i : i + 4]), set()).add(k)
        want = {extraction._digest(r) for r, pages in held.items() if 2 * len(pages) >= n}
        got = extraction.frequent_runs(texts, 4)
        assert len(got) == len(set(got)) and set(got) == want
