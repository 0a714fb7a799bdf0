"""Operator 2 keeps an article whatever its wrapper is called and where an open head was left unclosed."""

import pytest

from lectern.llm.html import blocks


@pytest.mark.parametrize(
    "page",
    [
        '<div class="site no-sidebar"><article>own</article></div>',
        '<div id="with-header"><article>own</article></div>',
        '<div class="content has-menu"><nav>menu</nav><article>own</article></div>',
        '<div class="content menu"><article>own</article></div><p>imprint</p>',
        "<html><head><title>t</title><meta charset=utf-8><body><article>own</article>",
        "<head><title>t</title><article>own</article>",
        '<article>own</article><div class="related"><article>teaser</article></div><div class="sidebar"><article>widget</article></div>',
        '<article>own<div class="cookie-banner">c</div><p class="ad">a</p></article>',
    ],
)
def test_article_is_found(page):
    assert blocks(page) == (["own"], True)


def test_parts_of_an_article_stay():
    page = '<article><h2 id="social-history">History</h2><section id="related-work"><p>Work</p></section></article>'
    assert blocks(page) == (["History", "Work"], True)


def test_open_head_without_article():
    assert blocks("<head><title>t</title><p>own") == (["own"], False)
    assert blocks('<div id="comments"><article>reader</article></div><p>own</p>') == (["own"], False)
