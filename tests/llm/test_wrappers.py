"""Class words on wrappers of the whole text."""

from __future__ import annotations

import pytest

from veilspark.llm import pages

LONG = "The house of the king was on the hill, and it is said that they were there for all of the summer with her."


@pytest.mark.parametrize(
    "wrapper",
    ["div class='has-sidebar'", "div class='no-sidebar'", "div id='search-results'", "article class='post category-social'", "div class='category-legal'", "div class='page with-ads'", "div class='social'"],
)
def test_wrapper_words_keep_the_text(wrapper):
    name = wrapper.split()[0]
    page = f"<body><nav><a href=x>Home</a></nav><{wrapper}><h1>Head</h1><p>{LONG}</p><div class=sidebar><p>{LONG}</p></div><p>{LONG}</p></{name}><div class=footer>(c)</div>"
    assert pages.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


def test_long_comments_stay_out():
    page = f"<article><p>{LONG}</p></article><div class=comments>" + f"<p>{LONG}</p>" * 5 + "</div>"
    assert pages.main_text(page) == LONG
