"""Smoothed ratios and clusters decide which regions of a page are its text."""

import random

import numpy as np
import pytest

from loomwork.llm import html_text
from loomwork.llm.html_text import FAINT, LAMBDA, SIGMA, Line

LONG = "a long sentence of the article with many words and hardly any tag in it goes on and on here"
SHELL = "<body><nav><a href='/a'>home</a><a href='/b'>about</a></nav><div class='ad'>Buy one of these now.</div><article><h1>Head</h1><p>{long}</p>{inner}<p>{long}</p></article><footer>All rights are reserved by us.</footer></body>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<div>One short sentence.</div>", "One short sentence."),
        ("<section><h2>Why</h2><p>So.</p></section>", "Why So."),
        ("<table><tr><td>1</td><td>two</td></tr><tr><td>3</td><td>4.5</td></tr></table>", "1 two 3 4.5"),
        ("<p class='share-price'>The price rose.</p>", "The price rose."),
        ("<div class='share-buttons'>Tweet this</div>", ""),
        ("<aside>See also this</aside><div id='comments'>First! A reader says something long here about the article.</div>", ""),
        ("<div class='site-footer'>x</div><div class='cookie-banner'>We use cookies.</div><form>Sign up</form>", ""),
    ],
)
def test_what_is_inside_an_article(inner, text):
    want = " ".join(filter(None, ["Head", LONG, text, LONG]))
    assert html_text.main_text(SHELL.format(long=LONG, inner=inner)) == want


def plain_choice(lines):
    """The same by matrices: a dense Gaussian among like lines, then means of regions weighed by text."""
    n = len(lines)
    faint = np.array([x.weight == FAINT or 2 * x.linked >= len(x.text) for x in lines])
    ratio = np.array([x.weight * max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    gap = np.abs(np.arange(n)[:, None] - np.arange(n))
    w = np.exp(-(gap**2) / (2 * SIGMA**2)) * (gap <= np.ceil(3 * SIGMA)) * (faint[:, None] == faint)
    level = w @ ratio / w.sum(axis=1)
    own = np.array([x.region for x in lines])
    size = np.array([len(x.text) for x in lines])
    means = {r: float((level * size)[own == r].sum() / size[own == r].sum()) for r in set(own.tolist())}
    chosen = {r for r, m in means.items() if m > 0 and m >= LAMBDA * level.std()}
    return chosen or {max(means, key=means.get)}


def test_regions_equal_a_plain_version():
    r = random.Random(3)
    for _ in range(300):
        lines = [Line("x" * r.randint(1, 400), r.randint(0, 12), r.choice([0, 0, 30]), r.choice([FAINT, 1.0, 1.5]), r.randint(0, 6)) for _ in range(r.randint(1, 40))]
        assert html_text.chosen_regions(lines) == plain_choice(lines)


def test_other_ratios_choose_other_text(monkeypatch):
    page = SHELL.format(long=LONG, inner="")
    whole = html_text.main_text(page)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, alike, sigma=1: [1.0] * len(ratios))
    assert "Buy one" in html_text.main_text(page) and "Buy one" not in whole
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, alike, sigma=1: [1 / (1 + 1000 * x) for x in ratios])
    assert LONG not in html_text.main_text(page)


def test_pages_without_an_article():
    page = "<body><div class=menu>x y z</div><div><div>{0} {0} {0}</div><div>{0} {0}</div></div><div><a href='/'>one</a> <a href='/'>two</a></div></body>".format(LONG)
    assert html_text.main_text(page) == " ".join([LONG] * 5)
    assert html_text.main_text("<nav>only <b>furniture</b> here</nav>") == "only furniture here"
