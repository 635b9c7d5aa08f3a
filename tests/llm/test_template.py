import random
import re

import pytest

from loomspan.llm import template

from .common import prose

PAGES = "page_id bigint, url string, html string"


def page(rng, i, wrap=True):
    title, paragraphs = prose(rng, 8), [prose(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
    body = "".join(f"<p>{p.replace('.', ' &amp;', 1)}</p>" if k % 3 else f"<p><b>{p.replace('.', ' &amp;', 1)}\n  <i>x</i><br>" for k, p in enumerate(paragraphs))
    text = [title] + [(p.replace(".", " &", 1) + ("" if k % 3 else " x")) for k, p in enumerate(paragraphs)]
    article = f"<article><h1>{title}</h1>{body}</article>" if wrap else f"<div class='content'><h1>{title}</h1>{body}</div>"
    html = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';x({i})</script></head><body><header><a href='/'>Home</a></header>"
        f"<nav><ul>{''.join(f'<li><a href=/{k}>{prose(rng, 1)}</a></li>' for k in range(rng.randrange(2, 6)))}</ul></nav><!-- ad {i} --><div class=\"ad\">{prose(rng, 6)}</div>"
        f"<div id='cookie-notice'>We use cookies {i}</div>{article}<aside><p>{prose(rng, 5)}</p></aside><form><p>Sign up {i}</p><input name=q></form>"
        f"<section class=\"comments\"><p>{prose(rng, 9)}</p></section><p>All rights reserved by the host.</p><footer>&copy; host &middot; {prose(rng, 3)}</footer></body></html>"
    )
    return html, "\n".join(re.sub(r"\s+", " ", t).strip() for t in text)


@pytest.mark.parametrize("wrap", [True, False])
def test_main_text_of_generated_pages(spark, wrap):
    rng = random.Random(4)
    made = [page(rng, i, wrap) for i in range(150)]
    rows = [(i, f"https://h{i % 2 and 1}.example.com:80/{i}", h) for i, (h, _) in enumerate(made)]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", template.F.lit("clash")).withColumn("host", template.F.lit(1)).withColumn("group", template.F.lit(1))
    out = {r.page_id: r for r in template.main_texts(df).collect()}
    for i, (_, text) in enumerate(made):
        assert out[i].text == text and out[i].n_chars == len(text)


ARTICLE = "<h1>One title</h1><p>The same article on all the pages of this host.</p><p>It has two paragraphs.</p>"
ARTICLE_TEXT = "One title\nThe same article on all the pages of this host.\nIt has two paragraphs."


@pytest.mark.parametrize(
    "before,body",
    [
        ("<script>track({i})</script>", "<article>{a}</article>"), ("<!-- ad {i} --><div class='ad'>buy {i}</div>", "<article>{a}</article>"), ("<nav>menu {i}</nav>", "<div role='main'>{a}</div>"),
        ("<script>track({i})</script>", "<div class='x1'>{a}</div>"), ("<!-- ad {i} --><div class='ad'>buy {i}</div>", "{a}"), ("<nav>menu {i}</nav>", "<div class='x1'>{a}</div>"),
    ],
)
def test_an_article_that_all_pages_share_is_kept(before, body):
    pages = [f"<html><body>{before.format(i=i)}{body.format(a=ARTICLE)}</body></html>" for i in range(64)]
    assert template.extract(pages) == [ARTICLE_TEXT] * 64


def test_larger_part_of_a_page_is_kept_beside_a_changing_menu():
    pages = [f"<html><body><div class='x0'>menu {i}</div><div class='x1'>{ARTICLE}</div></body></html>" for i in range(8)]
    assert template.extract(pages) == [f"menu {i}\n{ARTICLE_TEXT}" for i in range(8)]


def test_constant_text_goes_outside_the_article_only():
    standing = "<h1>Weekly letter</h1><p>Dear readers, this is our letter.</p><hr>"
    pages = [f"<html><body><p>All rights reserved by the host.</p><article>{standing}<p>News {i}</p></article></body></html>" for i in range(8)]
    assert template.extract(pages) == [f"Weekly letter\nDear readers, this is our letter.\nNews {i}" for i in range(8)]
    # Copies of one page don't make up the number of pages.
    pages = [f"<html><body><!-- {i} --><p>Shared words.</p><div class='x1'><h1>T{i % 2}</h1><p>Content of the page {i % 2}</p></div></body></html>" for i in range(8)]
    copies = template.extract(pages)
    assert [c.split("\n")[-2:] for c in copies] == [[f"T{i % 2}", f"Content of the page {i % 2}"] for i in range(8)]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div class='content has-sidebar'><article><p>a</article></div>", "a"), ("<div id='page' class='with-header'><article><p>a</article></div>", "a"),
        ("<div class='content with_footer noSidebar'><p>a</div>", "a"), ("<form action=/><header>h</header><div class=x><h1>t</h1><p>a</div><input></form>", "t\na"),
        ("<form><article><p>a</article></form>", "a"), ("<div class='ad'>buy<article><p>a</article><p>b</body>", "a"), ("<nav><a>home</a><main><p>a</main></nav>", "a"),
        ("<article>" + "".join(f"<p class='{c}'>{c}</p>" for c in "legal byline tags share alert search disclaimer".split()) + "</article>", "legal\nbyline\ntags\nshare\nalert\nsearch\ndisclaimer"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"), ("<article><header><h1>t</h1></header><p>a</article>", "t\na"),
        ("<article><p>first</p></article><div class='ad'>buy<article><p>next</article>", "first\nnext"), ("<div class='sidebar'><article><p>only one</article></div>", "only one"),
        ("<article><p>the main text</p><nav>n</nav></article><aside><article>teaser</article></aside><section id='comments'><article>nice</article></section>", "the main text"),
        ("<div class='SiteHeader'>h</div><div id=main-nav>n</div><div role=search>s</div><form>f</form><p>a", "a"), ("<body class='search'><p>a", "a"),
    ],
)
def test_beside_is_by_whole_names_and_not_around_the_article(html, text):
    assert template.extract([html]) == [text]


@pytest.mark.parametrize("n", [2, 3, 64])
@pytest.mark.parametrize("wrap", ["article", "div"])
def test_a_notice_goes_from_two_pages_on_and_if_some_pages_lack_it(n, wrap):
    notice = "<div class='x1'>We close at six.</div>"
    pages = [f"<html><body>{notice}<{wrap}><h1>Page {i}</h1><p>Content number {i} of the host</p></{wrap}></body></html>" for i in range(n)]
    texts = [f"Page {i}\nContent number {i} of the host" for i in range(n)]
    assert template.extract(pages) == texts
    assert template.extract(pages[:1]) == ["We close at six.\n" + texts[0]]
    if n > 3:
        assert template.extract([*pages[:-1], "<html><body><p>404: there is no such page</p></body></html>"]) == [*texts[:-1], "404: there is no such page"]
        assert template.extract([*pages[:-1], pages[-1].replace(notice, "")]) == texts


def test_equivalence_classes_are_nested_and_ordered():
    pages = [template.parse(f"<html><body><ul>{'<li>x</li>' * n}</ul><div><h1>t</h1></div></body></html>") for n in (1, 2, 3)]
    classes = template.deduce(pages)
    assert any(">html>body>ul" in c and ">html>body>div>h1" in c for c in classes)
    assert any({">html>body>ul>li", "/>html>body>ul>li"} <= c for c in classes)


def brute_classes(pages, support):
    """Classes by the definition, token by token, without slots: instances of a later class must not be cut by a token of an earlier one."""
    keys = sorted({k for page in pages for k, *_ in page if k})
    vector = {k: tuple(sum(x == k for x, *_ in page) for page in pages) for k in keys}
    out = []
    for v in sorted({v for v in vector.values() if sum(map(bool, v)) >= max(2, support * len(pages))}):
        members = {k for k in keys if vector[k] == v}
        runs = [tuple(x for x, *_ in page if x in members) for page in pages]
        n = len(members)
        instances = {run[i : i + n] for run in runs for i in range(0, len(run), n)}
        if n > 1 and len(instances) == 1 and len(set(next(iter(instances)))) == n:
            out.append(frozenset(members))
    return out


def test_classes_equal_brute_force_on_nested_pages():
    """Generated pages without crossing markup: all ordered classes are valid, and names tell instances apart."""
    rng = random.Random(12)
    lost = seen = 0
    for _ in range(30):
        tags = rng.sample(["ul", "div", "section", "table", "dl", "pre", "blockquote"], 4)
        def made(depth):
            return "".join(f"<{t}{depth}>" + (made(depth + 1) if depth < 2 and rng.random() < 0.7 else "x") * 1 + f"</{t}{depth}>" for t in tags[: rng.randrange(1, 4)])
        pages = [template.parse(f"<html><body>{made(0)}</body></html>") for _ in range(rng.randrange(2, 6))]
        classes, named = template.nested(pages)
        want = brute_classes(pages, template.SUPPORT)
        assert all(any(set(c) <= w for w in want) for c in classes)  # split by the slots they lie in
        lost += len({k for w in want for k in w} - {k for c in classes for k in c})
        seen += sum(map(len, want))
        for names in named:
            assert len(set(names.values())) == len(names)
    assert lost <= 0.1 * seen, (lost, seen)  # a tag whose end lies in another slot than its beginning


def test_crossing_and_unordered_tokens_are_no_class():
    a = [("x", "", False, True, False), ("y", "", False, True, False), ("p", "", False, True, False), ("q", "", False, True, False)]
    b = [a[1], a[0], a[2], a[3]]
    assert template.deduce([a, b]) == []  # one vector, two orders
    one = [[(k, "", False, True, False) for k in ks] for ks in ("apbq", "apbq", "ab")]
    assert [set(c) for c in template.deduce(one)] == [{"a", "b"}]  # p and q cross a and b


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p class='a' b's>Text one</p><p>it's here</p><p>end</p>", "Text one\nit's here\nend"), ("<p title='what is hidden or class=ad here'>a</p>", "a"), ("<p title=\"x > y\">a</p>", "a"),
        ("<div class='post social-science'><p>a</div>", "a"), ("<div class='article-tags-and-body'>a</div>", "a"), ("<div id='search-results'>a</div>", "a"), ("<p class=\"open>a</p><p>b</p>", "a\nb"),
        ("<div id=x class = 'ad'>a</div><p>b", "b"), ("<p hidden>a</p><p data-hidden=1>b", "b"), ("<p class='x' class='ad'>a", "a"),
    ],
)
def test_attributes_are_read_by_the_rules(html, text):
    assert template.extract([html]) == [text]


@pytest.mark.parametrize("n", [3, 4, 5])
def test_near_copies_keep_their_article(n):
    pages = [f"<html><body><!-- {i} --><article><h1>T</h1><p>The same words.</p></article></body></html>" for i in range(n)]
    assert template.extract(pages) == ["T\nThe same words."] * n


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<", ""), ("plain text", "plain text"), ("<p>cut off <b>here", "cut off here"), ("<p>a<p>b</p></div><p>c", "a\nb\nc"), ("<p>a</p><foo", "a"),
        ("<p>1 &lt; 2 &amp;amp; &#233;&nbsp;x</p>", "1 < 2 &amp; é x"), ("<script>if (a<b) {}</script><p>x</p>", "x"), ("<p>a</p><!-- <p>b</p>", "a"), ("<div hidden>a</div><p>b", "b"),
        ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>" + "x " * 20000 + "</p>", ("x " * 20000).strip()),
    ],
)
def test_odd_pages_alone(html, text):
    assert template.extract([html or ""]) == [text]


def test_every_row_has_a_result(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "<p>a</p>"), (None, "http://x.example/", "<p>b</p>"), (3, "HTTP://U@X.example:1/", "<p>c</p>")]
    out = template.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, "b"), (1, ""), (1, ""), (2, "a"), (3, "c")]
    assert template.main_texts(spark.createDataFrame([], PAGES)).count() == 0
