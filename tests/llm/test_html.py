"""Page text: paths decide without names, deep and broken markup, and exact text of generated pages."""

import random
import time

import pytest

from quarry.llm import html_text

LETTERS = "abcdefghilmnoprstu"


def sentence(r, n):
    return " ".join("".join(r.choice(LETTERS) for _ in range(2 + r.randrange(8))) for _ in range(n)).capitalize() + r.choice([".", ".", "?", "!"])


def paragraph(r):
    return " ".join(sentence(r, 4 + r.randrange(12)) + r.choice(["", ""]) for _ in range(2 + r.randrange(5)))


def page(r, named=True, root="article"):
    """A page and its main text, by construction."""
    cls = (lambda c: f' class="{c}"') if named else (lambda c: "")
    wanted, body = [sentence(r, 6)], []
    body.append(f"<h1>{wanted[0]}</h1>")
    for k in range(4 + r.randrange(6)):
        if k and r.random() < 0.3:
            wanted.append(sentence(r, 3))
            body.append(f"<h2{cls('related-work')}>{wanted[-1]}</h2>")
        text = paragraph(r)
        wanted.append(text)
        words = text.split()
        j = r.randrange(len(words))
        dressed = " ".join(f"<em>{w}</em>" if i == j else w for i, w in enumerate(words))
        body.append(f"<p>{dressed.replace('. ', f'.{chr(10)}  ', 1)}" + ("</p>" if r.random() < 0.8 else ""))
        if r.random() < 0.2:
            items = [sentence(r, 2) for _ in range(3)]
            wanted += items
            body.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
    links = "".join(f"<li><a href='/{k}'>{sentence(r, 1)}</a></li>" for k in range(6))
    comments = f"<section{cls('comments')}><p>{sentence(r, 3)}</p></section>" if named else ""
    html = (
        f"<html><head><title>{wanted[0]}</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div{cls('ad')}>{sentence(r, 2) if named else ''}</div>"
        f"<{root}>{''.join(body)}{comments}</{root}><aside>{paragraph(r)}</aside><div{cls('cookie')}><ul>{links}</ul></div><form><p>{sentence(r, 9)}</p></form><footer>&copy; {sentence(r, 5)}</footer></body></html>"
    )
    return html, "\n\n".join(" ".join(w.split()) for w in wanted)


@pytest.mark.parametrize("named", [True, False])
@pytest.mark.parametrize("root", ["article", "main", "div"])
def test_generated_pages(named, root):
    r = random.Random(5)
    for _ in range(60):
        html, wanted = page(r, named, root)
        assert html_text.main_text(html) == wanted


def test_paths_decide():
    """Without names and without the main elements the threshold selects, and what it leaves out is not under a root of its own."""
    r = random.Random(8)
    changed = 0
    for _ in range(60):
        html, wanted = page(r, False, "div")
        loose = html.replace("<footer>", "<div>").replace("</footer>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>")
        everything = "\n\n".join(b.text for b in html_text.Page(loose).blocks)
        got = html_text.main_text(loose)
        changed += got != everything
        assert got == wanted
    assert changed == 60


def test_text_of_furniture_inside_a_line_goes():
    long = "Some words here, and more of them there. And so it goes on, as it does."
    assert html_text.main_text(f"<body><article><p>{long} <button>Share</button><span hidden>no</span>The end.</p><p>{long}</p></article>") == f"{long} The end.\n\n{long}"


def test_blocks_end_what_shows_no_text():
    got = html_text.main_text("<body><article><h1>T</h1><p>Some text here, indeed.</p><svg><path/><p>More text follows, here.</p><select><option>a<p>And, again.</p><object data=x>no<p>Last, but here.</p></article>")
    assert got == "T\n\nSome text here, indeed.\n\nMore text follows, here.\n\nAnd, again.\n\nLast, but here."


def test_paragraph_that_is_a_link():
    long = "Some words here, and more of them there. And so it goes on, as it does."
    assert html_text.main_text(f"<body><article><p>{long}</p><p><a href=x>{long}</a></p><p>{long}</p><p>{long}</p></article>") == "\n\n".join([long] * 4)


@pytest.mark.parametrize("piece", ["<div>", "<span>", "<b><p>", "<svg>", '<p title="', "<!", '<a "', "<li>x<span>", "<div><p>", "<select>", "</div>", "<p class='a b'>x, y."])
def test_time_follows_length(piece):
    began = time.process_time()
    html_text.main_text("<body>" + piece * 100_000 + "hello there, my friend.")
    assert time.process_time() - began < 5


def test_extract_handles_odd_rows(spark):
    rows = [(1, "u", None, "a"), (1, "u", "", "b"), (None, None, "<p>Hello, you.", None), (1, "u", "<p>Hello, you.", "a"), (1, "u", "<p>Hello, you.", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(map(repr, ((r["page_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, ""), (1, ""), (None, "Hello, you."), (1, "Hello, you."), (1, "Hello, you.")]))
    assert html_text.extract(spark.createDataFrame([], pages.schema)).count() == 0
