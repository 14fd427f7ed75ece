import numpy as np
import pytest

from corpus import frame
from panelcast.llm.html_blocks import read_blocks
from panelcast.llm.html_text import Extractor, Features, Labeller, Training, extract, made_page, marked, padded, train

PAGES = "page_id long, url string, html string"


def test_blocks():
    page = """<!DOCTYPE html><title>T</title><style>p{}</style><script>var t="</p><p>no";</script><body><!-- <p>no -->
    <div class="Side-Bar x">a <a href='>'>b&amp;</a> c</div><article><p><b>one<br>two&nbsp; three<p>four < five<ul><li>six<li>seven</ul>tail"""
    blocks = read_blocks(page)
    assert [b.text for b in blocks] == ["a b& c", "one two three", "four < five", "six", "seven", "tail"]
    assert "side" in blocks[0].path[-1][1] and blocks[0].linked == 6
    assert [b.path[-1][0] for b in blocks] == ["div", "p", "p", "li", "li", "article"]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<>", "</p>", "<p", "<script>never ends", "<!-- never ends", "<a href=\"x>y", "<" * 5000, "<p>" * 5000])
def test_broken_pages(page):
    assert all(b.text for b in read_blocks(page))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    pages = [made_page(rng) for _ in range(3)]
    x, mask = padded([Features().of(b)[:6] for b, _ in pages])
    y = np.zeros(mask.shape)
    for i, (_, m) in enumerate(pages):
        y[: len(m[:6]), i] = m[:6]
    model = Labeller(4, rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        p = np.clip(model.probabilities(x, mask), 1e-12, 1 - 1e-12)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for k, g in model.gradients(x, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = model.p[k][at], 1e-3
        model.p[k][at] = old + step
        up = loss()
        model.p[k][at] = old - step
        assert abs((up - loss()) / (2 * step) - g[at]) < 1e-3 * max(1e-2, abs(g[at]))
        model.p[k][at] = old


@pytest.fixture(scope="module")
def labeller(spark):
    return train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_whole_pages(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    made = {r.page_id: r for r in extract(pages, labeller).collect()}
    right = 0
    for r in pages.collect():
        blocks = read_blocks(r.html)
        want = "\n\n".join(b.text for b, m in zip(blocks, marked(blocks), strict=True) if m)
        right += made[r.page_id].text == want
        assert made[r.page_id].url == r.url and made[r.page_id].n_chars == len(made[r.page_id].text)
    assert right >= 0.99 * len(made)


def test_unseen_layouts(labeller):
    rng, features = np.random.default_rng(99), Features()
    right = total = 0
    for _ in range(150):
        blocks, marks = made_page(rng)
        x, mask = padded([features.of(blocks)])
        right += int(((labeller.probabilities(x, mask)[:, 0] > 0.5) == np.array(marks, bool)).sum())
        total += len(marks)
    assert right >= 0.96 * total


def test_other_page(labeller):
    story = "The council met on Tuesday to discuss the new bridge. It will cost more than was planned, members said."
    page = f"""<html><head><title>News</title></head><body><div id="topbar" class="navbar"><a href="/">Home</a> <a href="/b">World</a></div>
    <div class="cookie-notice"><p>We use cookies. Accept?</p></div><form><label>Search</label><input name=q></form>
    <div class="article-body"><h1>New bridge</h1><p>{story}</p><p>{story}</p><div class="ad">Buy now</div><p>{story}</p></div>
    <aside><p>Related stories</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice one.</p></div></section>
    <footer>&copy; 2020</footer></body></html>"""
    assert Extractor(labeller).texts([page, None])[0] == "\n\n".join(["New bridge", story, story, story])
    page = f"""<body><header><p>Site of news</p><ul class=nav><li><a href=x>Home</a></li></ul></header><main><article><h1>New bridge</h1><p>{story}</p>
    <aside class="ad">Buy</aside><ul><li>{story}</li></ul><form><p>Sign up for news</p></form><p>{story}</p></article>
    <section id="comments"><p>A reader: {story}</p></section></main><footer><p>{story}</p></footer></body>"""
    assert Extractor(labeller).texts([page])[0] == "\n\n".join(["New bridge", story, story, story])


def test_edges(spark, labeller):
    long = "<article>" + "<p>The words of a paragraph go on and on, as they do.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><h1>Title of it</h1><p>The words of a paragraph go on, as they do.</p></article>"), (4, "u", long), (4, "u", long)]
    made = extract(frame(spark, rows, PAGES), labeller).collect()
    assert [(r.page_id, r.url, r.n_chars > 0) for r in made] == [(1, "u", False), (2, None, False), (None, "u", True), (4, "u", True), (4, "u", True)]
    assert made[3].text.count("\n\n") >= 19_990
    assert extract(frame(spark, [], PAGES), labeller).collect() == []


def test_training_without_pages(spark):
    model = train(frame(spark, [], PAGES), Training(made=8, epochs=1))
    assert len(Extractor(model).texts(["<p>x</p>"])) == 1
