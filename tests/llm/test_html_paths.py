"""Main text of pages whose structure the fixture tables don't have."""

import pytest

from axisfield.llm import html_paths, warc

TEXT = [f"Sentence {i} of the text, which is long enough to be told from a menu, has marks, and ends here. It goes on, for a while, as texts do." for i in range(6)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in TEXT)
CHROME = '<nav><ul><li><a href="/a">menu</a></li></ul></nav>'


@pytest.mark.parametrize("wrap", [
    '<div class="content-sidebar-wrap">%s</div>', '<div class="has-sidebar">%s</div>', '<div class="elementor-widget elementor-widget-text-editor">%s</div>',
    '<div class="widget">%s</div>', '<div class="content-sidebar-wrap"><article>%s</article></div>', '<div class="sidebar"><article>%s</article></div>',
    '<div style="overflow:hidden">%s</div>', '<article style="overflow:hidden">%s</article>', '<div data-id="menu" data-role="search">%s</div>', '<form id="aspnetForm">%s</form>',
])
def test_wrappers_keep_the_text(wrap):
    page = f'<html><head><title>T</title></head><body style="overflow:hidden">{CHROME}{wrap % PARAGRAPHS}<footer>&copy; x</footer></body></html>'
    assert html_paths.main_text(page) == "\n\n".join(TEXT)


def test_named_and_hidden_elements():
    page = f'<body><div>{PARAGRAPHS}</div><div class="sidebar"><p>Read this, too.</p></div><div hidden="">{TEXT[0]}</div><div aria-hidden="true">{TEXT[0]}</div></body>'
    assert html_paths.main_text(page) == "\n\n".join(TEXT)
    # a head without its end tag
    assert html_paths.main_text(f"<html><head><title>T</title><body><div>{PARAGRAPHS}</div>") == "\n\n".join(TEXT)


def test_articles_are_one_feature():
    teasers = "".join(f'<article><h2><a href="/{i}">Teaser {i}</a></h2><p>A few words of another page, cut.</p></article>' for i in range(3))
    comments = '<article class="comment"><p>A comment, with marks.</p></article>' * 3
    for page in (f"<body>{CHROME}<div>{PARAGRAPHS}</div>{teasers}</body>", f"<body>{CHROME}<div>{PARAGRAPHS}</div>{comments}</body>", f"<body><div>{PARAGRAPHS}</div></body>"):
        assert html_paths.main_text(page) == "\n\n".join(TEXT)
    # several articles with texts are all of the page
    assert html_paths.main_text(f"<body>{CHROME}" + "".join(f"<article><p>{t}</p></article>" for t in TEXT) + "</body>") == "\n\n".join(TEXT)


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", '<div class="a"><div class="b">%s</div></div>'])
def test_short_blocks_of_the_container_stay(around):
    items, cells, heads = [f"list item {i}" for i in range(5)], ["a", "1", "b", "2"], [f"Subheading {i} without marks" for i in range(9)]
    parts = ["<h1>A heading of about forty characters, yes</h1>"]
    want = ["A heading of about forty characters, yes"]
    for i in range(20):
        text = " ".join(TEXT)[: 700 + i]
        if i < 9:
            parts.append(f"<h2>{heads[i]}</h2>")
            want.append(heads[i])
        parts.append(f"<p>{text}</p>")
        want.append(text.strip())
    parts += ["<ul>", *(f"<li>{x}" for x in items), "</ul><table><tr><td>a<td>1<tr><td>b<td>2</table><blockquote><p>A quote.</p></blockquote><pre>x = 1</pre><dl><dt>term<dd>meaning</dl>"]
    want += [*items, *cells, "A quote.", "x = 1", "term", "meaning"]
    parts.append('<ul><li><a href="/x">Another page</a></li></ul><div class="share"><p>Share this</p></div>')
    page = f"<html><body>{CHROME}{around % ''.join(parts)}<div class=\"sidebar\"><p>Read this, too.</p></div><footer>x</footer></body></html>"
    assert html_paths.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("raw", [
    "<script>for(var i=0;i<n;i++){f(i);}</script>", "<SCRIPT>if(i<n){document.write('<p>x</p>')}</Script >", "<script/>a<b</script>", "<style>a<b{}</style>", '<script>var q="it\'s";</script>',
    "<textarea>", "<svg><path d='M0'/>", "<svg/>", "<svg><title>x</title></svg>", "<iframe src=x>", "<noscript>",
])
def test_raw_elements_end_at_their_own_tag(raw):
    for page in (f"<html><head><title>T</title></head><body>{raw}<article>{PARAGRAPHS}</article></body></html>", f"<html><head><title>T</title>{raw}</head><body><article>{PARAGRAPHS}</article></body></html>"):
        assert html_paths.main_text(page) == "\n\n".join(TEXT)
        assert warc.plain_text(page).split("\n") == ["T", *TEXT]


def test_unclosed_raw_elements():
    for start in ("<script>i<n", "<style>a<b", "<title>"):
        page = f"<html><head>{start}</head><body><article>{PARAGRAPHS}</article></body></html>"
        assert html_paths.main_text(page) == "\n\n".join(TEXT)
        assert warc.plain_text(page).split("\n") == TEXT
    assert html_paths.main_text(f"<div>{PARAGRAPHS}</div><script>if (i<n) f(") == "\n\n".join(TEXT)


def test_ratios_decide(monkeypatch):
    """Pages with enough text: with the ratios left out, what lies beside the text comes in."""
    teasers = '<div class="promo">' + "".join(f"<p>Offer {i}</p>" for i in range(3)) + "</div>"
    pages = [f"<body>{teasers}<div>{PARAGRAPHS}</div></body>", f"<body><table><tr><td>a<td>b<td>c</table><div>{PARAGRAPHS}</div></body>"]
    for page in pages:
        assert html_paths.main_text(page) == "\n\n".join(TEXT)
    # an article and a name, too, where blocks are long
    long = [f"{t} {t}" for t in TEXT]
    named = '<body><div class="ad">Buy this. Now.</div><article>' + "".join(f"<p>{t}</p>" for t in long) + "</article></body>"
    assert html_paths.main_text(named) == "\n\n".join(long)
    monkeypatch.setattr(html_paths, "fused", lambda characters, marks: 1.0)
    for page in pages:
        assert html_paths.main_text(page) != "\n\n".join(TEXT)
    assert html_paths.main_text(named) != "\n\n".join(long)


def test_little_text_goes_by_names():
    for text in ("Short.", "A short one, with marks."):
        page = f'<body><div class="ad">Buy this, which is longer. Now.</div><article><p>{text}</p></article></body>'
        assert html_paths.main_text(page) == text
    lines = "<p>Yes so.</p>" * 90
    assert html_paths.main_text(f'<body><div class="ad">Buy this, which is longer.</div><article>{lines}</article></body>') == "\n\n".join(["Yes so."] * 90)


def test_paragraphs_of_links_stay():
    linked = '<p><a href="/x">All of this paragraph is one link.</a></p>'
    assert html_paths.main_text(f"<body>{CHROME}<article>{PARAGRAPHS}{linked}</article></body>") == "\n\n".join([*TEXT, "All of this paragraph is one link."])


@pytest.mark.parametrize("control", ["<button>copy</button>", "<select><option>a<option>b</select>", '<button class="x"><b>copy</b></button>', '<button><a href="/x">copy</a></button>'])
def test_controls_do_not_split_a_paragraph(control):
    page = f"<body><article>{PARAGRAPHS}<p>Some words {control} and more of them.</p></article></body>"
    assert html_paths.main_text(page) == "\n\n".join([*TEXT, "Some words and more of them."])


def test_controls_that_hold_blocks_or_do_not_end():
    page = f"<body><article>{PARAGRAPHS}<p>Some words <button><div>copy</div><p>this</p></button> after it.</p><p>The last words.</p></article></body>"
    got = html_paths.main_text(page).split("\n\n")
    assert got[:6] == TEXT and "copy" not in got and "this" not in got and got[-1] == "The last words."
    assert html_paths.main_text(f"<body><article>{PARAGRAPHS}<p>Some words <button>copy</p><p>The last words.</p></article></body>").split("\n\n") == [*TEXT, "Some words", "The last words."]


@pytest.mark.parametrize("around", ['<div class="comments">%s</div>', '<section id="comments">%s</section>', '<ol class="comment-replies">%s</ol>'])
def test_comments_go_on_pages_of_any_form(around):
    some = around % "".join(f"<div><p>{t} I think so, too; do you?</p></div>" for t in TEXT[:4])
    for page in (f"<body>{CHROME}<div>{PARAGRAPHS}</div>{some}</body>", f"<body>{CHROME}<article>{PARAGRAPHS}</article>{some}</body>", f"<body><article>{PARAGRAPHS}{some}</article></body>"):
        assert html_paths.main_text(page) == "\n\n".join(TEXT)
    # a page that is a discussion for the most part
    assert html_paths.main_text(f'<body>{CHROME}<div class="discussion">{PARAGRAPHS}</div></body>') == "\n\n".join(TEXT)
