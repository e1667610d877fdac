"""Class words and forms that don't mark boilerplate, and pages of great depth."""

import time

import pytest

from graphloom.llm.html_extraction import BOILERPLATE, main_text

LONG = "many words of the text " * 60
FLAT = " ".join(LONG.split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article class="post has-sidebar"><p>{LONG}</p></article>', FLAT),
        (f'<div class="content no-sidebar"><p>{LONG}</p></div>', FLAT),
        (f'<body><form action="x"><div><h1>T</h1><p>{LONG}</p></div><div class="sidebar">side</div></form></body>', f"T\n{FLAT}"),
        (f'<body><form><article><p>{LONG}</p></article><div class="ad-slot">ad</div></form></body>', FLAT),
        (f'<article><section id="related-work"><p>{LONG}</p></section><p class="social-contract">{LONG}</p></article>', f"{FLAT}\n{FLAT}"),
        (f'<body><div class="promo"><div class="modal"><p>{LONG}</p></div></div><div class="menu">m</div></body>', FLAT),
        (f'<body><div><p>{LONG}</p></div><div class="comments"><p>{LONG * 5}</p></div></body>', FLAT),
        (f'<body><article><p>{LONG}</p></article><div class="promo"><p>{LONG * 5}</p></div></body>', FLAT),
        (f'<body><p>{LONG}</p><form><p>a short form</p></form></body>', FLAT),
        (f'<body><div hidden><p>{LONG * 3}</p></div><p>{LONG}</p></body>', FLAT),
    ],
)
def test_what_holds_the_text_is_no_boilerplate(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["ad", "site-footer", "ad-slot", "cookie-banner", "post-comments", "nav-menu", "share-buttons", "x sidebar y", "related_posts", "comment-list-2", "left-sidebar"])
def test_names_of_boilerplate(name):
    assert BOILERPLATE.search(name)


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "related-work", "social-contract", "admin", "with-sidebar-left", "searching", "research", "shared", "content", "without_footer"])
def test_names_of_something_else(name):
    assert not BOILERPLATE.search(name)


@pytest.mark.parametrize("page", ["<div>x" * 60000, "<section>" * 20000 + "</p></b></article>" * 20000, "<aside>" + "<div>" * 20000 + "</p></section>" * 20000, '<div class="ad">x' * 30000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 10
