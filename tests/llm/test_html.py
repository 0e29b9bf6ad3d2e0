import random
import time

from dialectry.llm import html_extraction as H
from dialectry.llm.html_extraction import MARK, extract, main_text


def test_best_region_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        kinds = [(r.choice(["word", "word:link", "/p", "div", "new"]), r.randint(1, 6)) for _ in range(r.randint(0, 25))]
        weights = {"word": r.choice([1.0, 0.5]), "word:link": -0.7, "/p": -0.1, "div": -2.0}
        value = [n * weights.get(k, -0.05) for k, n in kinds]
        sums = {(a, b): sum(value[a:b]) for a in range(len(kinds)) for b in range(a + 1, len(kinds) + 1)}
        a, b = H.best_region(kinds, weights)
        top = max(sums.values(), default=0.0)
        assert (a, b) == (0, 0) if top <= 0 else abs(sums[a, b] - top) < 1e-9


def agreement(pages, **how):
    """Mean F1 of the extracted blocks, and the share of pages that agree in full."""
    whole, f1 = 0, 0.0
    for page in pages:
        before, content, after = page.split(MARK)
        want, got = (main_text("<main>" + content + "</main>", {"word": 1.0, "word:link": 1.0}), main_text(before + content + after, **how))
        x, y = set(got.split("\n\n")), set(want.split("\n\n"))
        whole, f1 = whole + (got == want), f1 + 2 * len(x & y) / max(1, len(x) + len(y))
    return f1 / len(pages), whole / len(pages)


def test_learned_weights_earn_their_place_on_held_out_pages():
    pages = H.labelled_pages(200, seed=99)
    plain = dict.fromkeys(H.learned_weights(), -0.5) | {"word": 1.0, "word:link": 1.0, "word:maybe": 1.0, "word:off": -1.0}
    learned, untaught = agreement(pages), agreement(pages, weights=plain)
    assert learned[0] > 0.95 and learned[0] > untaught[0] + 0.03 and learned[1] > untaught[1] + 0.2


def test_the_rest_of_the_element():
    links = "".join(f"<li><a href='{i}'>part {i}</a></li>" for i in range(9))
    page = f"<body><nav><a>x</a></nav><article><h1>Title</h1><ul>{links}</ul><p>{'words of the text ' * 9}</p></article><footer>f</footer></body>"
    assert main_text(page).startswith("Title\n\npart 0\n\npart 1") and main_text(page).endswith("text")
    assert not main_text(page, whole_element=False).startswith("Title")


def test_nothing_else_is_dropped():
    text = "some words that go on for a while "
    page = f"<body><p>{text}<math>x</math> end</p><div class='tags'>kept words</div><p>{text * 3}</p><svg><text>drawn</text></svg><div class='byline'>by her</div><p>{text}</p></body>"
    assert main_text(page) == f"{text}x end\n\nkept words\n\n{(text * 3).strip()}\n\ndrawn\n\nby her\n\n{text.strip()}"
    inside = f"<article><header><h1>Title</h1></header><div class='entry-header'>sub</div><p>{text * 2}</p><footer>written today</footer></article><footer>all rights</footer>"
    assert main_text(inside) == f"Title\n\nsub\n\n{(text * 2).strip()}\n\nwritten today"
    two = f"<article><p>{text}</p></article><nav><a>a b c d e f g h</a></nav><article><p>{text * 9}</p><p>end.</p></article>"
    assert main_text(two) == f"{(text * 9).strip()}\n\nend."
    loose = f"<div class='menu'><a>one</a></div><div><p>{text * 3}</p><p>{text}</p></div><div id='comments'><p>{text * 20}</p></div>"
    assert main_text(loose) == f"{(text * 3).strip()}\n\n{text.strip()}"


PARAGRAPHS = ["The first paragraph of the article tells what happened and goes on for a good while, " * 3, "The second one tells what people said about it, and why it matters to all of them, " * 3]
ARTICLE = "<h1>What happened</h1>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
WANTED = "\n\n".join(["What happened", *(x.strip() for x in PARAGRAPHS)])
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(8)) + "</ul>"


def page_of(start, end, article=ARTICLE):
    return f"<html><head><title>t</title></head><body><header><nav>{MENU}</nav></header>{start}{article}{end}<footer><p>all rights reserved by us</p>{MENU}</footer></body></html>"


def test_misleading_names_do_not_lose_the_article():
    cases = ["<form id='f' action='/'>|</form>", "<form><div class='content'>|</div></form>", "<form><article>|</article></form>", "<div class='content-sidebar-wrap'><main>|</main></div>", "<div class='page no-sidebar'>|</div>", "<div class='layout has-menu'><article>|</article></div>", "<div role='dialog'><div class='has-ads'><main>|</main></div></div>", "<div hidden>|</div>", "<aside><article>|</article></aside>"]
    for case in cases:
        assert main_text(page_of(*case.split("|"))) == WANTED, case
    for start in ("<nav>" + MENU, "<nav class='menu'><a>x</a> <a>y</a>"):
        for inner in (ARTICLE, f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>"):
            assert main_text(f"<body>{start}{inner}<footer><p>rights</p></footer></body>") == WANTED
    for word in sorted(H.HINTS | H.EDGES):
        for inner in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div>{ARTICLE}</div>"):
            assert main_text(page_of(f"<div class='page {word}-x'>", "</div>", inner)) == WANTED, word


def test_what_names_say_holds_where_the_article_is_elsewhere():
    long = "<p>" + "so many words that nobody asked for but that were written here " * 30 + "</p>"
    for extra in (f"<div id='comments'>{long}</div>", f"<div class='comments'><article>{long}</article><article>{long}</article></div>", f"<footer>{long}</footer>" if len(long) < 900 else "", f"<aside><article><p>a teaser of a few words</p></article></aside>", "<form><label>name</label><p>write to us about this</p></form>"):
        for inner in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
            assert main_text(page_of("", extra, inner)) == WANTED, extra
    assert main_text(f"<body><div>{ARTICLE}</div><aside><p>{'more of this ' * 60}</p></aside></body>") == WANTED


def test_open_and_unmatched_tags_take_linear_time():
    began = time.perf_counter()
    main_text("<div>" * 40_000 + "</section>" * 40_000 + "<p>x y z" * 20_000)
    assert time.perf_counter() - began < 10


def test_html_extraction(spark):
    rows = [
        (1, "<article><h1>Hi</h1><div class='comments'>tweet it</div><p>x &amp; y&nbsp;z<br>q &lt;b&gt;</p><form>sign up</form><p>end.</p><section id=comments><p>long comment here and on</p></section></article>"),
        (2, None), (3, ""), (4, "plain words only"), (5, "<p>open <b>never closed"), (6, "<!-- a <p>x</p>"), (7, "<script>var a = '<p>words</p>'"), (8, "<p>" + "w " * 50_000 + "</p>"), (1, "<p>again</p>"),
    ]
    df = spark.createDataFrame([(i, "u", h, "c") for i, h in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract(df).collect()]
    text = [t for _, t, _ in got]
    assert text[:7] == ["Hi\n\nx & y z q <b>\n\nend.", "", "", "plain words only", "open never closed", "", ""]
    assert text[7] == " ".join(["w"] * 50_000) and text[8] == "again" and all(n == len(t) for _, t, n in got)
    assert extract(df.where("page_id < 0")).count() == 0
