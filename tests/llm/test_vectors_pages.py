"""Top-k search and page text."""

import math
import random
import re
import time

import numpy as np
import pytest

from causeway.llm import html_text, topk


def brute(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append(v)
    usable = {i: [[math.floor(1024 * x) for x in v] for v in sorted(vs)] for i, vs in usable.items()}
    near = lambda a, b: max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = set()
    for q in usable:
        if q % every == 0:
            own = usable[q][0]
            scored = sorted(((-near(own, v), i) for i, vs in usable.items() if i != q for v in vs if len(v) == len(own)))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block,asked", [(8192, 1024), (37, 3)])
def test_top_k_against_brute_force(spark, block, asked):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # many ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (500, []), (600, [1.0, 2.0]), (601, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "vec_id long, embedding array<float>, label string, part int").repartition(5)
    found = topk.top_k(df, df.filter("vec_id % 10 = 0"), 10, block_rows=block, query_rows=asked)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect() if r.query_id != 500}
    assert got == {x for x in brute(rows, 10, 10) if x[0] != 500}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_with_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, -1024 * 1024)]


def test_refinement_goes_on_while_bins_are_full(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in 0.001 * rng.normal(size=4) + 1]) for i in range(600)] + [(900, [-500.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 10, enough=0).collect()}
    assert got == brute(rows, 10, 100)


def test_huge_components_and_two_vectors_of_one_query(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100, [4e6, 1.0, 0.0, 0.0]), (101, [3e12, 3e12, 0.5, 0.0]), (110, [-3e12, 2e9, 0.0, 1.0]), (111, [1e300, 0.0, 0.0, 0.0]), (120, [-1e305, 1.0, 1.0, 1.0])]
    rows += [(130, [2.0, 0.0, 0.0, 0.0]), (130, [-1.0, 5.0, 0.0, 0.0]), (131, [0.0] * 4), (131, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(df, df.filter("vec_id % 10 = 0"), 10, block_rows=13).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == brute(rows, 10, 10)


def test_queries_go_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "MERGED", 2)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(400)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.filter("vec_id % 5 = 0"), 10, block_rows=50, query_rows=7, chunk_queries=20, enough=0).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == brute(rows, 10, 5) and len(found) == 800


@pytest.mark.parametrize("reach", [700, 65_000])
def test_bins_do_not_count_twice(reach):
    rng = np.random.default_rng(reach)
    scores = rng.integers(-reach, reach + 1, 5000)
    low, above, span = np.array([-reach]), np.array([0]), 2 * reach + 1
    while span > 1:
        width = -(-span // topk.BINS)
        bins = topk.bins_of(scores, low, width, span)
        from_top = np.cumsum(np.bincount(bins[bins >= 0], minlength=topk.BINS)[::-1])[::-1] + above
        at = (from_top >= 10).sum() - 1
        above, low, span = from_top[at] - (bins == at).sum(), low + at * width, width
    assert low[0] == np.sort(scores)[-10]


PAGES = {
    "plain": ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  text\n here.<p>Second <b>bold</b>ness.</article><footer>c</footer></body></html>", "Title & more First text here. Second boldness."),
    "short": ("<article><p>Ok.</p></article>", "Ok."),
    "furniture within": ("<article><p>One</p><aside>side</aside><div class='ad-box'>buy</div><p>Two</p><form><p>name</p></form><section id=comments><p>nice!</p></section></article>", "One Two"),
    "class and role": ("<body><div class='site-header'>Brand</div><div role=navigation>Menu</div><main><p>Body text of the page, long enough to count.</p></main><div class='cookieBanner'>We use cookies</div></body>", "Body text of the page, long enough to count."),
    "scripts": ("<article><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;tag&gt; &#233;&nbsp;x</p></article>", "yes <tag> é x"),
    "unclosed": ("<nav><ul><li><a href=a>a<li><a href=b>b<article><h1>T</h1><p>x<p>y", "T x y"),
    "empty": ("", ""),
    "null": (None, ""),
    "only furniture": ("<nav>a</nav><footer>b</footer>", ""),
    "no article": ("<body><div><a href=1>one</a></div><div><a href=2>two</a></div><div><p>" + "A long paragraph of text. " * 10 + "</p><p>" + "And a second one of it. " * 8 + "</p><p>End.</p></div><div><a href=3>three</a></div></body>", ("A long paragraph of text. " * 10 + "And a second one of it. " * 8 + "End.").strip()),
    "odd signs": ("<article><p>1 < 2 and 3 > 2</p><p title='a>b'>kept</p></article>", "1 < 2 and 3 > 2 kept"),
    "closes itself": ('<article><p>First.</p><svg width="3"/><p>Second.</p><iframe/><p>Third.</p></article>', "First. Second. Third."),
    "never closed": ("<article><p>First.</p><object data=x><p>Second.</p><select name=s><option>One<option>Two<p>Third.</p><canvas></article>", "First. Second. Third."),
    "hidden elements": ("<article><p>First.</p><svg><text>no</text></svg><select><option>no</select><p>Second.</p></article>", "First. Second."),
    "names of text": ('<article><div class="entry-header"><h1 class="header-title">T</h1></div><p class="notice-board">One.</p><div class="notice">no</div></article>', "T One."),
    "link in a paragraph": ("<div><p>" + "Long text before it. " * 6 + '</p><p><a href="x">Read this one too</a> please</p><p>' + "Long text after it. " * 6 + "</p></div>", "Long text before it. " * 6 + "Read this one too please " + ("Long text after it. " * 6).strip()),
    "hidden": ("<article><p>seen</p><p hidden>not</p><div style='display: none'>not</div><p>too</p></article>", "seen too"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def plain_between(weight, core, linked, span, surge):
    weight = [max(w, 1) if c else w for w, c in zip(weight, core)]
    n = len(weight)
    heavy = [sum(weight[i : i + span]) for i in range(n)]
    regions, i = [], 0
    while i < n:
        if not heavy[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and heavy[j + 1]:
            j += 1
        end = min(n, j + span)
        if max(heavy[i : j + 1]) >= surge or any(core[i:end]):
            regions.append((i, end))
        i = j + 1
    first, last = (regions[0][0], regions[-1][1]) if regions else (0, n)
    return [any(weight) and first <= i < last and (weight[i] > 0 or linked[i]) for i in range(n)]


def test_surge_and_dive_points_against_plain_loops():
    rng = np.random.default_rng(11)
    changed = 0
    for _ in range(400):
        n = int(rng.integers(0, 40))
        weight = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 90, n))
        core, linked = (rng.random(n) < 0.03) & (rng.random() < 0.5), (weight == 0) & (rng.random(n) < 0.2)
        got = html_text.between(weight, core, linked, 3, 60)
        assert got.tolist() == plain_between(weight.tolist(), core.tolist(), linked.tolist(), 3, 60)
        changed += bool(((weight > 0) & ~got).any())
    assert changed > 50


def test_distribution_decides_where_nothing_is_named():
    body = "A long paragraph of the body. " * 6
    menu = "".join(f"<div><a href={i}>Entry {i}</a></div>" for i in range(4))
    page = f"<body><div>Brand and claim</div>{menu}<div><p>{body}</p><p>Short end.</p></div>{menu}<div>Imprint</div></body>"
    assert html_text.main_text(page) == f"{body}Short end."
    assert html_text.main_text(page, surge=0) == f"Brand and claim {body}Short end. Imprint"


def test_article_does_not_hide_the_rest_of_the_page():
    body = ["A long paragraph of the body. " * 10, "A second long paragraph of it. " * 12]
    page = "<body><nav><a href=1>one</a></nav>" + "".join(f"<div><p>{x}</p></div>" for x in body) + "<article><p>A teaser.</p></article><footer>c</footer></body>"
    assert html_text.main_text(page) == " ".join(" ".join([*body, "A teaser."]).split())
    page = f"<body><div><p>{body[0]}</p></div><nav><p>a</p><p>b</p><p>c</p></nav><main><p>Ok.</p></main></body>"
    assert html_text.main_text(page) == f"{body[0]}Ok."


@pytest.mark.parametrize("lead,closing", [("Short lead. " * 25, "Short end. " * 20), ("A lead of one line that is not long but stands by itself here.", "And an end of one line that is not long but stands by itself.")])
def test_advert_block_does_not_cut_the_article(lead, closing):
    advert = "<div class=advert><p>buy</p><p>this</p><p>now</p><p>please</p></div>"
    related = "<ul>" + "".join(f"<li><a href={i}>More of it {i}</a></li>" for i in range(5)) + "</ul>"
    body = "The long middle part of the text. " * 70
    page = f"<body><div>Brand</div>{related}<div><p>{lead}</p></div>{advert}<div><p>{body}</p></div>{advert}<div><p>Amid.</p></div>{related}<div><p>{closing}</p></div>{related}<div>Imprint</div></body>"
    assert html_text.main_text(page) == " ".join(f"{lead} {body} Amid. {closing}".split())
    assert html_text.main_text(f"<div><p>Ok.</p></div>{advert}<div><p>Yes, it is so.</p></div>") == "Ok. Yes, it is so."


def test_pages_pass_with_their_columns(spark):
    rows = [(i, f"u{i}", p, "t") for i, (p, _) in enumerate(PAGES.values())] + [(0, "u0", PAGES["plain"][0], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = html_text.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text"] and out.count() == len(rows)
    want = [w for _, w in PAGES.values()]
    assert all(r.text == want[r.page_id] for r in out.collect())
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_very_long_page():
    words = [f"w{random.Random(i).randint(0, 9999)}" for i in range(200_000)]
    page = "<nav>x</nav><article>" + "".join(f"<p>{' '.join(words[i : i + 50])}</p>" for i in range(0, len(words), 50)) + "</article>"
    assert html_text.main_text(page) == " ".join(words)


@pytest.mark.parametrize(
    "piece", ["a <b and ", "<b ", "<svg ", "<script ", "<svg>x", '<a "', "<a \"'>", "<!-- ", "<div>", "<div></p>", "<span x=1>a<br>", "</svg", "<math><svg>", "<object <b ", "<article><li>", "<select x><option>y"]
)
def test_malformed_pages_take_time_in_proportion(piece):
    page = piece * (1_500_000 // len(piece))
    for whole in (page, page + ">"):
        began = time.process_time()
        html_text.main_text(whole)
        assert time.process_time() - began < 20


def test_elements_without_text_by_their_pairs():
    old = re.compile(r"<(%s)\b[^>]*(?<!/)>(?:(?!<\1\b).)*?</\1\s*>" % "|".join(sorted(html_text._SETS["unseen"])), re.S | re.I)
    raw = re.compile(r"<(%s)\b[^>]*>.*?(?:</\1\s*>|\Z)" % "|".join(sorted(html_text._SETS["raw"])), re.S | re.I)
    rng = random.Random(4)
    bits = ["<svg>", "</svg>", "<SVG a=1>", "</svg >", "<math>", "</math>", "x", "<p>", " > ", "<script>", "</script>", "<style ", "</style\n>", "<textarea>", "</textarea", "<svgx>", "é"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert html_text.without_unseen(page) == old.sub(" ", page), page
        assert html_text.without_raw(page) == raw.sub(" ", page), page
    assert html_text.without_unseen("a<svg x><svg/><p></svg>b<svg/>c</svg>") == "a b<svg/>c</svg>"
