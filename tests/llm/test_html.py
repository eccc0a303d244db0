"""HTML extraction against a plain reading of its rules, and pages that only ratios can decide."""

import math
import random

import duckdb
import pytest

from conforank.llm import html_text
from conforank.llm.html_text import Line


def brute_regions(lines, parents, sure):
    n = len(lines)
    raw = [math.log(1 + (len(x.text) - x.linked) / x.tags) for x in lines]
    smooth = []
    for i in range(n):
        near = [j for j in range(n) if abs(i - j) <= html_text.REACH]
        weight = [math.exp(-((i - j) ** 2) / (2 * html_text.SIGMA**2)) for j in near]
        smooth.append(sum(w * raw[j] for w, j in zip(weight, near)) / sum(weight))
    cut, least = -math.inf, math.inf
    ranked = sorted(smooth)
    for at in range(1, n):
        low, high = ranked[:at], ranked[at:]
        a, b = sum(low) / len(low), sum(high) / len(high)
        spread = sum((v - a) ** 2 for v in low) + sum((v - b) ** 2 for v in high)
        if spread < least - 1e-12:
            least, cut = spread, high[0] if b - a >= html_text.LEAST_GAP else -math.inf
    chars, linked = [0] * len(parents), [0] * len(parents)
    for x in lines:
        chars[x.region] += len(x.text)
        linked[x.region] += x.linked
    plain = [2 * a < b for a, b in zip(linked, chars)]
    content = {x.region for x, v in zip(lines, smooth) if sure[x.region] or (v >= cut - 1e-12 and plain[x.region])}
    seeds = [(i, parents[x.region]) for i, x in enumerate(lines) if x.region in content and not x.named]
    for i, x in enumerate(lines):
        around = [j for j, p in seeds if p == parents[x.region]]
        if plain[x.region] and around and min(around) < i < max(around):
            content.add(x.region)
    return content


def test_regions_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        regions = rng.randint(1, 6)
        parents = [-1] + [rng.randrange(i) for i in range(1, regions)]
        sure = [False] + [rng.random() < 0.1 for _ in range(regions - 1)]
        lines = []
        for _ in range(rng.randint(1, 25)):
            size = rng.choice([1, 5, 8, 60, 200, 900])
            linked = rng.choice([0, 0, 0, size // 2, size])
            lines.append(Line("x" * size, rng.randint(1, 6), linked, rng.randrange(regions), rng.random() < 0.2))
        assert html_text.content_regions(lines, parents, sure) == brute_regions(lines, parents, sure)
    assert html_text.content_regions([], [-1], [False]) == set()


def sentence(rng, words):
    return " ".join(rng.choice("plain words that say a little about nothing in particular today".split()) for _ in range(words)) + "."


def test_ratios_decide_pages_without_names():
    """Neither element names nor classes tell these menus from the text."""
    rng = random.Random(6)
    for _ in range(60):
        links = [f"<a href=/{i}>{sentence(rng, rng.randint(1, 3))}</a>" for i in range(rng.randint(4, 30))]
        menu = "".join(f"<li>{x}" for x in links)
        title, short = sentence(rng, 3), sentence(rng, 2)
        texts = [sentence(rng, rng.randint(15, 80)) for _ in range(rng.randint(2, 12))]
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}" for x in texts)
        page = f"<div><ul>{menu}</ul></div><div>{body}</div><div><ul>{menu}</ul></div>"
        assert html_text.main_text(page) == "\n\n".join([title, *texts])
        parted = f"<div id=a><div>{menu}</div><div><p>{texts[0]}</div><div><p>{short}</div><div><p>{texts[1]}</div></div>"
        assert html_text.main_text(parted) == "\n\n".join([texts[0], short, texts[1]])


def test_ratios_drop_menus_of_real_pages():
    """Counted before any name rules a line out."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    decided = 0
    for (html,) in pages:
        page = html_text.lines_of(html)
        keep = html_text.content_regions(page.lines, page.parents, page.sure)
        decided += any(x.region not in keep for x in page.lines)
    assert decided >= 0.5 * len(pages)


@pytest.mark.parametrize(
    "inner",
    ["<div class='related-work'><p>{}</p></div>", "<p class=top>{}</p>", "<section class='social-science'><p>{}</p></section>"],
)
def test_names_do_not_cut_articles(inner):
    rng = random.Random(7)
    texts = [sentence(rng, 30) for _ in range(3)]
    page = f"<article><p>{texts[0]}</p>{inner.format(texts[1])}<p>{texts[2]}</p></article>"
    assert html_text.main_text(page) == "\n\n".join(texts)
    links = "".join(f"<a href=x>{sentence(rng, 3)}</a>" for _ in range(9))
    page = f"<article><p>{texts[0]}</p><div class='related'>{links}</div><p>{texts[2]}</p></article>"
    assert html_text.main_text(page) == f"{texts[0]}\n\n{texts[2]}"


def test_scripts_do_not_part_a_paragraph_and_boilerplate_goes():
    page = (
        "<body><header><p>Site name and a slogan that reads like text.</header><article><p>One <script>x()</script>line"
        "<span class=ad>buy this now</span></p><div class='reader-comments'><p>A comment as long as the text itself is.</div>"
        "<form><label>Name of the person</label><input></form></article><footer>All rights of this page are reserved.</footer>"
    )
    assert html_text.main_text(page) == "One line"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(pages).collect() == []
