"""Main text of pages with wrappers and cards that mislead."""

import pytest

from hushframe.llm.html_text import main_text

TEXT = [f"Paragraph {i}, with a clause, and another; it ends here, in part {i}." * 3 for i in range(8)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)


@pytest.mark.parametrize("names", ["class='site has-sidebar'", "class=with-sidebar", "id=no-comments", "class='sticky-nav'"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_a_wrapper_with_a_name_of_furniture_stays(names, inner):
    side = "<div class=sidebar><p>Buy this, now, or never.</p></div>"
    page = f"<body><div {names}>{side}{inner.format(BODY)}</div></body>"
    assert main_text(page) == "\n\n".join(TEXT)


def test_cards_do_not_replace_the_text():
    cards = "".join(f"<article><p>{TEXT[i][:70]} card {i}</p></article>" for i in range(3))
    page = f"<body><div><div id=a>{BODY}</div></div><section>{cards}</section></body>"
    assert all(t in main_text(page) for t in TEXT)
    assert "card" not in main_text(page)


@pytest.mark.parametrize("inner", ["<div>{}</div>", "<div><div>{}</div></div>", "<article>{}</article>", "{}"])
def test_a_form_around_the_page_stays(inner):
    page = f"<body><form id=aspnet><input name=x>{inner.format(BODY)}</form></body>"
    assert main_text(page) == "\n\n".join(TEXT)


def test_a_form_beside_the_text_goes():
    form = "<form><label>Your name, please.</label><p>Write to us, now.</p></form>"
    for page in (f"<body><div>{BODY}</div>{form}</body>", f"<article>{BODY}{form}</article>"):
        assert main_text(page) == "\n\n".join(TEXT)


def test_names_are_judged_by_their_last_word():
    share = "<div class='story-share'><p>Share me</p></div><div class='article-comments'><p>First!</p></div>"
    body = f"<div class='story-body'>{BODY}</div>"
    assert main_text(f"<article>{share}{body}</article>") == "\n\n".join(TEXT)
    alert = "<p class='alert'>The bridge is closed, for now.</p>"
    assert main_text(f"<article>{alert}{BODY}</article>").startswith("The bridge is closed, for now.")
