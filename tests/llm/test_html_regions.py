"""What HTML extraction keeps of the main text."""

from popatlas.llm import html_extract


def test_what_one_page_alone_has_is_no_template_text():
    pages = [f"<main><p>text {i}</p></main>" for i in range(6)]
    pages[3] = "<main><h2 id=early-life>Early life</h2><p>text 3</p><ul><li>item</li></ul></main>"
    got = html_extract.extract(pages)
    assert got == [f"text {i}" if i != 3 else "Early life text 3 item" for i in range(6)]
    assert html_extract.extract([f"<main><section id=s{'abcdef'[i]}><p>own {i}</p></section></main>" for i in range(6)]) == [
        f"own {i}" for i in range(6)
    ]


def test_articles_keep_what_all_pages_share():
    for start, end in (("<article>", "</article>"), ("<div class=content>", "</div>")):
        pages = [f"{start}<h1>One title</h1><p>Same lead</p><p>body {i}</p>{end}" for i in range(8)]
        for n in (1, 4, 5, 8):
            assert html_extract.extract(pages[:n]) == [f"One title Same lead body {i}" for i in range(n)]


def test_only_whole_names_leave_out():
    body = "<h1>T</h1><p>text</p>"
    for page in (
        f'<body class="has-sidebar"><article>{body}</article></body>',
        f'<body class="no-sidebar hidden"><div>{body}</div></body>',
        f'<article class="post comments-open category-social">{body}</article>',
        f'<article id="search" class="share">{body}</article>',
        f'<main role="search">{body}</main>',
        '<article><h1 class="header">T</h1><section id="search"><p>text</p></section></article>',
        '<article><h2 id="related-work">T</h2><section id="search-algorithms"><p>text</p></section></article>',
        '<article><p class="ad-hoc">T</p><p>te<span class="share-word">xt</span></p></article>',
        f'<form action="x"><nav>menu</nav><article>{body}</article><footer>f</footer></form>',
        f'<form action="x"><header>top</header><div>{body}</div></form>',
        f'<main-x class="main-sidebar">x</main-x><div class="content no-sidebar">{body}</div>',
    ):
        assert html_extract.extract([page]) == ["T text"], page
    for name in ('class="x Ad"', "id=comments", 'role="complementary"', "hidden", 'aria-label="share"'):
        assert html_extract.extract([f"<article>{body}<div {name}>no</div></article>"]) == ["T text"]
    assert html_extract.extract([f"<article>{body}<form><p>no</p></form></article>"]) == ["T text"]


def test_end_tags_below_the_deepest_level_close_nothing_else():
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    page = f"<div><article><p>before</p>{deep}<p>after</p></article></div><p>outside</p>"
    assert html_extract.extract([page]) == ["before deep after"]
