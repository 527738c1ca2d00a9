"""Main text of pages."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankfold.llm import html as H

from .conftest import story


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><header>Site</header><p>a<p>b &amp c&lt;</main><footer>f</footer>", "Site\n\na\n\nb & c<"),
        ("<article><h1>T</h1><p>x <b>y</b>z<br>w\n v</p><div class='comments'><p>no</p></div><form>q<input></form><p>end</article>", "T\n\nx yz w v\n\nend"),
        ("<nav>menu</nav><div class=ad>buy</div><article><p>one</p><script>var x='</p>';</script><p>two</p></article><aside>s</aside>", "one\n\ntwo"),
        ("<body><div id='cookie-notice'>c</div><div>yes <span class=ad>no</span>more</div></body>", "yes more"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p title='a>b'>t</p><!-- <p>hidden</p> --></article>", "t"),
        ("<article><p>&#233;&nbsp;&#x41;</p></article>", "é A"),
        ("", ""),
        (None, ""),
        ("plain text", "plain text"),
        ("<<<>>> <p", "<<<>>> <p"),
        # Words in class and id don't decide what is in an article.
        ('<article><p>We <span class="share">share</span> bread</p><div class="legal-analysis"><p>The court ruled.</p></div><section id="search-methods"><p>We searched.</p></section></article>', "We share bread\n\nThe court ruled.\n\nWe searched."),
        ("<body class='has-sidebar'><div class='layout-with-sidebar'><nav>m</nav><main class='search-results'><p>r</p></main></div></body>", "r"),
        ("<article class='post comments-open'><p class='ad'>x<p>real text</article>", "real text"),
        ("<article><p>a</p><article class='comment'>c</article><div class='ad-slot'>r</div></article>", "a"),
        ("<article><p class=ad>x<div>real</div></article>", "real"),
        ("<div>open <span class=ad>x</div><div>b</div>", "open\n\nb"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\n\nb\n\n1\n\n2"),
        ("<div role=navigation>x</div><div role=main>y</div><div>z</div>", "y"),
        # Elements that close themselves or aren't closed, custom elements, formulas, quotes inside unquoted values.
        ('<article><p>Before</p><svg class="i"/><p>After one</p><p>After two</p></article>', "Before\n\nAfter one\n\nAfter two"),
        ("<article><p>a</p><svg viewBox='0 0 1 1'><text>icon</text></svg><p>b</p><svg><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>Since <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "Since x=1 holds"),
        ("<article><math/><p>a<math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math></p></article>", "ay"),
        ("<article><button-group><p>Custom text</p></button-group><script-like>b</script-like><button>no</button></article>", "Custom text\n\nb"),
        ("<article><p data-x=don't>It's fine here</p><p title=\"a>b\" alt='c>d'>and 'here'</p></article>", "It's fine here\n\nand 'here'"),
        ("<article><p class=\"x>y</p><p>it's</p></article>", "y\n\nit's"),
        ('<article><header class="banner"><h1>The title</h1></header><ul class="menu"><li>Soup of the day</li></ul><div class="notice">Mind this.</div></article><div class="menu">m</div>', "The title\n\nSoup of the day\n\nMind this."),
        ("<script>if (a < b) '</p>'</script ><p>t</p><SCRIPT>open", "t"),
    ],
)
def test_structure(page, text):
    assert H.decided(H.blocks(page), [])[0] == text


def test_neighbours_match_brute_force():
    for seed in range(100):
        r = random.Random(seed)
        pages = {(r.randint(0, 1), b"".join(bytes([0, r.choice([1, 1, 1, 2])]) for _ in range(H.DEPTH))): r.choice([(1, 1), (2, 2), (3, 3), (1, 1), (1, 3)]) for _ in range(30)}
        rows = sorted((o, s, a, b, 1) for (o, s), (a, b) in pages.items())
        want = {}
        for o, s, a, b, _ in rows:
            others = [H.common(s, t) for p, t, c, d, _ in rows if p == o and t != s and not a == b == c == d]
            best = H.DEPTH if a != b else max(others, default=0)
            if best >= H.RUN:
                want[o, s] = best
        assert {(o, s): n for o, s, n, _ in H.neighbours(rows)} == want


def covered(streams, k, size, skip=0):
    """Places of stream k that lie in runs of `size` tokens that another stream has too, but for the first of each run."""
    others = {tuple(t[a : a + size]) for j, t in enumerate(streams) if j != k for a in range(len(t) - size + 1)}
    return {p for a in range(len(streams[k]) - size + 1) if tuple(streams[k][a : a + size]) in others for p in range(a + skip, a + size)}


def test_runs_match_brute_force(spark, monkeypatch):
    """The sparse array finds every run of RUN + WINDOW - 1 tokens, but for WINDOW - 1 at its start, and none of fewer than RUN."""
    r = random.Random(5)
    shared = [story(900 + k, r.randint(5, 25)) for k in range(6)]
    texts = [" ".join(r.choice([story(r.randint(0, 10**6), 7), *shared]) for _ in range(8)) for _ in range(12)]
    rows = [(k, "http://h/", f"<div>{t}</div>") for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    streams = [H.Stream(H.blocks(h)).codes.tolist() for _, _, h in rows]
    seen = H.written
    caught = {}

    def keep(df, name):
        caught[name] = seen(df, name)
        return caught[name]

    monkeypatch.setattr(H, "written", keep)
    monkeypatch.setattr(H, "discard", lambda *frames: None)
    H.extracted(pages).count()
    of = {r.j: r.q for r in caught["pages-suffixes"].select("j", "q").distinct().collect()}
    ids = {spark.range(1).select(F.xxhash64(F.lit(k).cast("long"))).first()[0]: k for k in range(12)}
    got = {ids[of[r.j]]: {p for x in r.runs for p in range(x["at"], min(x["at"] + x["length"], len(streams[ids[of[r.j]]])))} for r in caught["pages-runs"].collect()}
    for k in range(12):
        assert covered(streams, k, H.RUN + H.WINDOW - 1, H.WINDOW - 1) <= got.get(k, set()) <= covered(streams, k, H.RUN)


def test_menus_of_short_blocks_and_footers(spark):
    """Pages without any mark: the array alone decides."""
    menu = "".join(f"<li>{x}</li>" for x in ("Home", "About us", "Contact", "Imprint"))
    foot = "<div>(c) 2024 Example Inc, all rights reserved</div>"
    rows = [(k, f"https://H.example/{k}", f"<ul>{menu}</ul><div>{story(k, 30)}</div><div>{story(50 + k, 9)}</div>{foot}") for k in range(4)]
    rows += [(9, "https://h.example/again", rows[0][2]), (10, "https://other.example/", f"<div>{story(0, 30)}</div>"), (11, None, None), (12, "https://h.example/x", "")]
    rows += [(13, "https://solo.example/", f"{foot}<p>{story(7, 9)}</p>"), (13, "https://solo.example/", f"{foot}<p>{story(7, 9)}</p>"), (None, None, f"{foot}"), (None, None, f"{foot}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("o", F.lit(1)).withColumn("j", F.lit(1))
    got = Counter((r.page_id, r.text) for r in H.extracted(pages).collect())
    notice = "(c) 2024 Example Inc, all rights reserved"
    want = Counter({(k, f"{story(k, 30)}\n\n{story(50 + k, 9)}"): 1 for k in range(1, 4)})
    # An article on two pages stays beside a menu on five.
    want += Counter({(0, f"{story(0, 30)}\n\n{story(50, 9)}"): 1, (9, f"{story(0, 30)}\n\n{story(50, 9)}"): 1}) if H.FEW * 2 <= 5 else Counter()
    rest = Counter({k: n for k, n in got.items() if k[0] not in (0, 9)})
    assert rest == want + Counter({(10, story(0, 30)): 1, (11, ""): 1, (12, ""): 1, (13, f"{notice}\n\n{story(7, 9)}"): 2, (None, notice): 2})
    assert H.extracted(pages.limit(0)).count() == 0


def test_an_article_carried_twice_stays(spark):
    menu = "<div>Home Products Prices Support Careers Contact Imprint Privacy</div>"
    text = "".join(f"<p>{story(k, 12)}</p>" for k in range(70, 75))
    rows = [(k, "http://h/", f"{menu}<p>{story(k, 25)}</p>") for k in range(10)] + [(k, "http://h/", menu + text) for k in (10, 11)]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: story(k, 25) for k in range(10)} | {k: "\n\n".join(story(j, 12) for j in range(70, 75)) for k in (10, 11)}


def test_doubtful_blocks_of_articles(spark):
    widget = "<div class='share'>Tell all of your friends about this fine page today</div>"
    rows = [(k, "http://h/", f"<article><p>{story(k, 25)}</p>{widget}</article>") for k in range(3)] + [(9, "http://other/", f"<article><p>{story(9, 5)}</p>{widget}</article>")]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: story(k, 25) for k in range(3)} | {9: f"{story(9, 5)}\n\nTell all of your friends about this fine page today"}


def test_very_long_page(spark):
    body = "".join(f"<p>{story(k, 200)}</p>" for k in range(60))
    rows = [(1, "u", f"<div>{body}</div>"), (2, "u", "<p>" + "x" * 300_000 + "</p>"), (3, "u", "<div>" * 5000 + "deep")]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n\n".join(story(k, 200) for k in range(60)), 2: "x" * 300_000, 3: "deep"}


def stripped(html):
    """A page without the marks that tell its article from its boilerplate."""
    return re.sub(r'<div class="ad">', "<div>", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html))


def test_sample_pages(spark, sf):
    """Every block of the article and nothing else; and what the array does without any marks."""
    pages = spark.read.parquet(f"{sf}/../sf0.1/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", t)).strip()
    import html

    def article(h):
        inner = re.search(r"<article>(.*)</article>", h, re.S)[1]
        return [b for b in (plain(html.unescape(re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", inner)) if b]

    got = H.extracted(pages).collect()
    assert len(got) == len(rows)
    assert all(r.text == "\n\n".join(article(rows[r.page_id].html)) and r.n_chars == len(r.text) for r in got)
    assert sum(r.by_array > 0 for r in got) > 0.5 * len(got)  # it covers boilerplate there; structure alone would drop the same, as every page marks its article
    bare = spark.createDataFrame([(k, r.url, stripped(r.html)) for k, r in rows.items()], "page_id long, url string, html string")
    kept = found = want = 0
    for r in H.extracted(bare).collect():
        a, b = Counter(article(rows[r.page_id].html)), Counter(filter(None, r.text.split("\n\n")))
        kept, found, want = kept + (a & b).total(), found + b.total(), want + a.total()
    assert kept >= 0.9 * want and kept >= 0.7 * found
