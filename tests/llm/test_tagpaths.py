import random
import time

import pytest

from tsalign.llm import tagpaths
from tsalign.llm.tagpaths import extract, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First, a\n sentence.</p><p>Second <b>bo</b>ld&nbsp;one; then.<br>Third.</article>"
TEXT = "Title & more First, a sentence. Second bold one; then. Third."
AROUND = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/x'>Home</a></li></ul></nav>"
    "<!-- note --><div class='ad'>Buy this, now! It is good, cheap, and near you; order today, or never.</div>{}<aside>Side, text.</aside>"
    "<form><label>Name</label><input></form><div id='comments'><p>I disagree, at length: no, no, and no. This goes on, and on, and on.</p></div>"
    "<div class='cookie-notice'>We use cookies.</div><footer>&copy; all</footer></body></html>"
)


def test_article():
    assert main_text(AROUND.replace("{}", ARTICLE)) == TEXT


@pytest.mark.parametrize("wrap", ["<main>{}</main>", "<div class='content'>{}</div>", "<div><section>{}</section></div>"])
def test_other_containers(wrap):
    inner = ARTICLE.replace("article>", "div>")
    assert main_text(AROUND.replace("{}", wrap.replace("{}", inner))) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"),
        ("<nav>menu</nav>", ""), ("<script>x</script>", ""), ("<script>never closed", ""), ("<p>a < b & c &lt; d</p>", "a < b & c < d"),
        ("<article><p>x</article></div></p>", "x"), ("<article>a<!-- b", "a"), ("<article><p title='>'>q</p></article>", "q"),
        ("<article><div class='has-sidebar'>in</div></article>", "in"), ("<article><div class='sidebar'>out</div>in</article>", "in"),
        ("<article>x</article><article class='comment'>y</article>", "x"), ("<article><header><h1>H</h1></header><p>t</p></article>", "H t"),
        ("<body><div hidden-x style='display:none'>no</div><p>yes, it is.</p></body>", "yes, it is."), ("<article>&#x41;&#66;&notanentity;</article>", "AB¬anentity;"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


INNER = "<h1>T</h1><p>First, a sentence. It goes on.</p><p>Second one; then more.</p>"
MAIN = "T First, a sentence. It goes on. Second one; then more."


@pytest.mark.parametrize(
    "wrap",
    [
        '<article class="post comments-open">{}</article>', '<article class="post tag-social">{}</article>', '<div class="layout sidebar-right"><article>{}</article></div>',
        '<div class="elementor-widget">{}</div>', '<div id="page-search-x" class="content">{}</div>', '<div class="widget"><article>{}</article></div>', "<form id=f><div>{}</div></form>",
        "<div class=widget><div class=ad><main>{}</main></div></div>", '<article><div class="elementor-widget">{}</div></article>', "<form><article>{}</article></form>",
    ],
)
def test_marked_wrappers_keep_the_article(wrap):
    around = '<html><body><header>Site</header><nav><a href=x>x</a></nav><div class="ad">Buy this, now! Good, cheap.</div>{}<div id="comments"><article class="comment">No, I disagree, and no.</article></div><footer>f</footer></body></html>'
    assert main_text(around.replace("{}", wrap.replace("{}", INNER))) == MAIN


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{INNER}<ul><li><a href=1>One more</a></li><li><a href=2>Another one</a></li></ul></article>", MAIN),
        (f"<article>{INNER}<ul><li>short</li><li>list, <a href=1>with link</a></li></ul></article>", f"{MAIN} short list, with link"),
        (f"<body><div class=a>{INNER}<ul><li>item</li></ul><table><tr><td>cell</table></div><section><div><a href=1>One</a></div><div>side</div></section></body>", f"{MAIN} item cell"),
        ("<article><h1><a href=1>Title</a></h1><p>Some text, here.</p></article>", "Title Some text, here."),
        ("<article><h1>Title</h1><p><a href=1>All of it</a></p></article>", "Title All of it"),
        ("<div id=comments><article class=comment>x, y.</article></div>", ""),
        (f"<div class=related><article>Other, and more of it; a lot of it. And so on, and on.</article></div><article>{INNER}</article>", MAIN),
    ],
)
def test_ratios_choose(page, text):
    assert main_text(page) == text


def test_nothing_is_chosen_without_the_ratios(monkeypatch):
    inner, text = (x.replace("goes on", "goes" + ", on and on" * 20) for x in (INNER, MAIN))
    page = f"<body><div class=a>{inner}</div><section><div>side, a bit</div><div>more aside</div></section></body>"
    listed = f"<article>{inner}<ul><li><a href=1>One more</a></li></ul></article>"
    assert main_text(page) == main_text(listed) == text
    monkeypatch.setattr(tagpaths, "_content_paths", lambda paths, *_: (set(paths), set()))
    assert main_text(page) == f"{text} side, a bit more aside" and main_text(listed) == f"{text} One more"


def plain_paths(paths, lengths, marks, links):
    """The ratios, path by path and block by block."""
    of = {p: [i for i, q in enumerate(paths) if q == p] for p in paths}
    share = {p: sum(links[i] for i in at) / max(sum(lengths[i] for i in at), 1) for p, at in of.items()}
    texts = [sum(lengths[i] - links[i] for i in of[p]) / len(of[p]) for p in paths]
    points = [1 + sum(marks[i] for i in of[p]) / len(of[p]) for p in paths]
    smooth = lambda x, i: 0.25 * x[max(i - 1, 0)] + 0.5 * x[i] + 0.25 * x[min(i + 1, len(x) - 1)]
    fused = [smooth(texts, i) * smooth(points, i) * (1 - share[p]) for i, p in enumerate(paths)]
    mean = sum(fused) / len(fused)
    spread = (sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5
    score = {p: sum(fused[i] for i in at) / len(at) for p, at in of.items()}
    bound = min(tagpaths.SPREAD * spread, max(score.values()))
    return {p for p in of if score[p] >= bound * (1 - 1e-12)}, {p for p in of if share[p] >= tagpaths.LINKS}


def test_content_paths_against_plain_ratios():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 40)
        lengths = [rng.choice([1, 5, 40, 300]) for _ in range(n)]
        args = [rng.randint(0, 6) for _ in range(n)], lengths, [rng.randint(0, 9) for _ in range(n)], [rng.choice([0, 0, x]) for x in lengths]
        assert tagpaths._content_paths(*args) == plain_paths(*args)


@pytest.mark.parametrize(
    "page", ["<div class=x>" * 16000, "<div>" * 16000 + "</span>" * 16000, "<p><b>x</b>" * 16000, "<table><tr><td>" * 8000, "<span><table>" + "<div>" * 16000 + "</span>" * 16000]
)
def test_work_is_linear(page):
    begin = time.process_time()
    assert main_text(page + "deep").endswith("deep")
    assert time.process_time() - begin < 4


def test_long_and_deep_pages():
    page = "<article>" + "<p>Some words, and more.</p>" * 20_000 + "</article>"
    assert main_text(page) == " ".join(["Some words, and more."] * 20_000)
    assert main_text("<div>" * 5000 + "deep") == "deep"


def test_table(spark):
    rows = [(1, "u", ARTICLE, 5, "t"), (1, "u", ARTICLE, 5, "t"), (None, None, None, 5, "t")]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string"))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]))
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
