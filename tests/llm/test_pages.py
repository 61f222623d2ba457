"""Main text of pages: a page generator whose article text is known, and a second parser beside the query."""

import html as entities
import random
from html.parser import HTMLParser

import pytest

from millrace.llm import html, queries

FOLDER = "/root/testdata/sf0.001"
SKIPPED = {"script", "style", "title", "aside", "nav", "footer", "form", "header", "menu", "noscript", "template", "textarea", "svg", "button", "select"}
INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "u", "small"}
VOID = {"br", "img", "hr", "input", "link", "meta", "wbr"}


class ArticleReader(HTMLParser):
    """The words of the only ``article`` element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attributes):
        if tag not in INLINE:
            self.out.append(" ")
        if tag not in VOID:
            marks = set(" ".join(v or "" for k, v in attributes if k in ("class", "id")).replace("-", " ").split())
            self.open.append((tag, tag in SKIPPED or bool(marks & {"ad", "ads", "comment", "comments", "sidebar", "cookie", "share", "related", "newsletter"})))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.out.append(" ")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if any(tag == "article" for tag, _ in self.open) and not any(skip for _, skip in self.open):
            self.out.append(data)


def test_query_gives_what_a_second_parser_reads(spark):
    pages = queries.table(spark, FOLDER, "pages").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.html_text(spark, FOLDER).collect()}
    assert len(got) == len(pages)
    compared = 0
    for page in pages:
        if page.html and page.html.lower().count("<article") == 1:
            reader = ArticleReader()
            reader.feed(page.html)
            reader.close()
            text = " ".join("".join(reader.out).split())
            assert got[page.page_id] == (text, len(text)), page.page_id
            compared += 1
    assert compared > len(pages) // 2


def words(r, n):
    return " ".join("".join(r.choice("abdegilmnorstuéñü") for _ in range(r.randint(2, 9))) for _ in range(n))


def sentence(r):
    text = words(r, r.randint(6, 20)).capitalize() + r.choice(".!?")
    return text if r.random() > 0.2 else text[:-1] + " & <x> ©" + text[-1]


def furniture(r):
    links = "".join(f"<li><a href='/{i}'>{words(r, 2)}</a></li>" for i in range(r.randint(3, 8)))
    return r.choice([
        f"<nav><ul>{links}</ul></nav>", f"<div class=\"ad\">{words(r, 6)}</div>", f"<aside><h3>{words(r, 2)}</h3><ul>{links}</ul></aside>",
        f"<form action='/s'><label>{words(r, 2)}</label><input name=q><button>{words(r, 1)}</button></form>",
        f"<script>var t = '<p>{words(r, 9)}</p>';</script>", f"<style>.x{{margin:0}}</style><!-- <p>{words(r, 5)}</p> -->",
        f"<div id='cookie-notice'><p>{sentence(r)}</p><button>OK</button></div>", f"<section class='newsletter'><p>{sentence(r)}</p></section>",
    ])


def body(r, inner):
    """Blocks of an article, with furniture between some of them, and the text that they hold."""
    out, text = [], []
    for _ in range(r.randint(3, 12)):
        kind, some = r.choice(["p", "p", "p", "open p", "h2", "ul", "blockquote", "br"]), [sentence(r) for _ in range(r.randint(1, 4))]
        said = [entities.escape(s).replace("©", r.choice(["&copy;", "&#169;", "&#xA9;", "©"])) for s in some]
        if kind == "ul":
            out.append("<ul>" + "".join(f"<li>{s}</li>" for s in said) + "</ul>")
        elif kind == "br":
            out.append("<p>" + "<br/>".join(said) + "</p>")
        elif kind == "open p":
            out.append("<p>" + " \n\t".join(said))
        else:
            out.append(f"<{kind}><b>{said[0]}</b>  " + " \n".join(said[1:]) + f"</{kind}>")
        text += some
        if inner and r.random() < 0.3:
            out.append(furniture(r))
    return "\n".join(out), " ".join(" ".join(text).split())


def page(r, holder):
    content, text = body(r, inner=True)
    start, end = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": ("<div class='content'>", "</div>"), "bare": ("", "")}[holder]
    comments = "".join(f"<div class='comment'><p>{sentence(r)}</p></div>" for _ in range(r.randint(0, 6)))
    return (
        f"<!DOCTYPE html><html><head><title>{words(r, 4)}</title></head><body><header><h1>{words(r, 2)}</h1></header>"
        + "".join(furniture(r) for _ in range(r.randint(1, 4))) + start + content + end + f"<section id='comments'>{comments}</section>"
        + "".join(furniture(r) for _ in range(r.randint(1, 3))) + f"<footer>&copy; {words(r, 5)}</footer></body></html>", text,
    )


@pytest.mark.parametrize("holder", ["article", "main", "div", "bare"])
def test_known_article_text(spark, holder):
    """Weights come from other pages with marked articles; a third of the judged pages repeat."""
    r = random.Random(5)
    labelled = [page(r, "article")[0] for _ in range(30)]
    made = [page(r, holder) for _ in range(40)]
    rows = [(i, f"https://h/{i}", h) for i, (h, _) in enumerate(made)] + [(100 + i, None, made[i][0]) for i in range(13)]
    got = {x.page_id: x.text for x in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()}
    assert got == {i: made[i % 100][1] for i, _, _ in rows}


def test_best_run_of_ties_and_of_very_long_pages(spark):
    assert html.best_run([1.0, -1.0, 1.0]) == (0, 1)
    assert html.best_run([-1.0, 0.0, -2.0]) == html.best_run([]) == (0, 0)
    r = random.Random(3)
    text = [sentence(r) for _ in range(40_000)]
    long = "<html><body><nav><a>menu</a></nav><article>" + "".join(f"<p>{entities.escape(t)}</p>" for t in text) + "</article><footer>end</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", long), (2, "u", "<p>" + "<b>" * 50_000), (3, "u", "<" * 100_000)], "page_id long, url string, html string")
    got = {x.page_id: (x.text, x.n_chars) for x in html.extract_text(rows, [long]).collect()}
    want = " ".join(" ".join(text).split())
    assert got[1] == (want, len(want)) and got[2] == ("", 0)
