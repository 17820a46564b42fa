"""A plain version of op4: blocks by the standard library's parser, features and both LSTMs in loops over blocks."""

import math
import os
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from veritext.llm import html_blocks

SF = "/root/testdata/sf0.001"


class _Texts(HTMLParser):
    """Texts between the borders of block elements, without what is hidden."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.hidden = [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks.HIDDEN:
            self.hidden.append(tag)
        elif tag == "br":
            self.held.append(" ")
        if tag in html_blocks.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        if tag in html_blocks.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def plain_texts(page):
    p = _Texts()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def plain_features(page):
    """Per block its path buckets, the share of each word bucket, and its figures."""
    out = []
    for k, b in enumerate(page):
        words = b.text.lower().split()
        buckets = {zlib.crc32(w.encode()) % html_blocks.WORDS for w in words}
        marks = len(re.findall(r"[.,;:!?]", b.text))
        figures = [
            math.log(1 + len(b.text)) / 6, math.log(1 + len(words)) / 4, min(1.0, b.linked / len(b.text)), min(1.0, 10 * marks / len(b.text)),
            k / len(page), len(b.tags) / 10,
        ]
        out.append((b.path or (0,), {w: 1 / (len(buckets) + 20) for w in buckets}, figures))
    return out


def plain_logits(p, page):
    """The log odds of each block, one block and one unit after the other."""
    p = {k: v.astype(np.float64).tolist() for k, v in p.items()}
    xs = []
    for path, words, figures in plain_features(page):
        a = [sum(p["path"][i][j] for i in path) / math.sqrt(len(path)) for j in range(html_blocks.D_PATH)]
        b = [sum(v * p["word"][w][j] for w, v in words.items()) for j in range(html_blocks.D_WORD)]
        xs.append(a + b + figures)
    units = html_blocks.HIDDEN_SIZE
    squash = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        h, c = [0.0] * units, [0.0] * units
        for t in order:
            z = [
                p[way + "b"][j] + sum(v * p[way + "x"][i][j] for i, v in enumerate(xs[t])) + sum(v * p[way + "h"][i][j] for i, v in enumerate(h))
                for j in range(4 * units)
            ]
            c = [squash(z[units + j]) * c[j] + squash(z[j]) * math.tanh(z[3 * units + j]) for j in range(units)]
            h = [squash(z[2 * units + j]) * math.tanh(c[j]) for j in range(units)]
            states[way, t] = h
    return [p["bias"][0] + sum(v * w[0] for v, w in zip(states["f", t] + states["b", t], p["out"])) for t in range(len(xs))]


def test_forward_pass_and_features_equal_plain_python():
    r = np.random.default_rng(12)
    model = html_blocks.Labeller(seed=3)
    pages = [html_blocks.blocks(html_blocks.sample_page(r).replace(html_blocks._MARK, "")) for _ in range(6)]
    pages = [p for p in [*pages, html_blocks.blocks("<p>Only one."), html_blocks.blocks("text, without any tag")] if p]
    for page in pages:
        for (path, words, figures), got in zip(plain_features(page), zip(*html_blocks.describe(page))):
            assert tuple(path) == tuple(got[0]) and {int(w): v for w, v in zip(np.flatnonzero(got[1]), got[1][got[1] > 0])} == pytest.approx(words)
            assert got[2].tolist() == pytest.approx(figures, abs=1e-6)
    z, _ = model.logits([html_blocks.describe(p) for p in pages])  # of several lengths, side by side
    decided = model.main_blocks(pages)
    for k, page in enumerate(pages):
        want = plain_logits(model.p, page)
        assert z[k, : len(page)].tolist() == pytest.approx(want, abs=1e-4)
        assert decided[k] == [v > 0 for v in z[k, : len(page)].tolist()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_extracted_pages_equal_plain_python(spark, monkeypatch):
    """The whole table through the operator, and a plain reading of the same pages with the model that it trained."""
    models = []
    train = html_blocks.train
    monkeypatch.setattr(html_blocks, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_blocks.extract_text(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) and len(models) == 1
    for r in rows:
        page = html_blocks.blocks(r.html or "")
        assert [b.text for b in page] == plain_texts(r.html or ""), r.page_id
        odds = plain_logits(models[0].p, page)
        assert all(abs(v) > 1e-4 for v in odds)
        text = "\n".join(b.text for b, v in zip(page, odds) if v > 0)
        assert got[r.page_id] == (text, len(text)), r.page_id


def test_long_pages_teach_by_a_run_of_blocks(spark, monkeypatch):
    taught = {}
    monkeypatch.setattr(html_blocks, "train", lambda own, runs=(): taught.update(own=own, runs=list(runs)) or html_blocks.Labeller())
    item = "<p>Words of item {}, some of them linked.</p>"
    long = "<nav><a href='/'>Home</a></nav><article>" + "".join(item.format(k) for k in range(700)) + "</article><footer>End</footer>"
    wide = "<nav><a href='/'>Home</a></nav><main><p>" + "many words " * 9_000 + "</p></main>"
    short, bare = "<article><p>Short.</p></article>", "<p>No mark</p>" * 500
    rows = [(1, "u", long), (2, "u", wide), (3, "u", short), (4, "u", bare), (5, "u", "<article ></article>"), (6, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_blocks.extract_text(df, most_chars=60_000, most_blocks=400).count() == 6
    assert sorted(taught["own"]) == ["<article ></article>", short]
    runs = sorted((html_blocks.pickle.loads(r) for r in taught["runs"]), key=lambda r: len(r[0]))
    assert [len(r[0]) for r in runs] == [2, 400]
    page = html_blocks.blocks(long)
    paths, words, figures = html_blocks.describe(page)
    begin = zlib.crc32(long.encode()) % (len(page) - 399)
    got_paths, bits, got_figures, labels = runs[1]
    assert list(map(tuple, got_paths)) == list(map(tuple, paths[begin : begin + 400]))
    assert (np.unpackbits(bits, axis=1, count=html_blocks.WORDS) == (words[begin : begin + 400] > 0)).all()
    assert np.allclose(got_figures, figures[begin : begin + 400]) and (labels == html_blocks.own_labels(page)[begin : begin + 400]).all()


def test_training_reads_runs():
    html = "<article>" + "<p>one two three, four.</p>" * 30 + "</article>"
    page = html_blocks.blocks(html)
    run = html_blocks._run_of_blocks(html, page, 20)
    seen = []
    fit = html_blocks.Labeller.fit
    try:
        html_blocks.Labeller.fit = lambda self, x, y: seen.append((x, y))
        html_blocks.train([], drawn=0, runs=[run])
    finally:
        html_blocks.Labeller.fit = fit
    (x, y), = seen
    assert len(x) == 1 and len(x[0][0]) == 20 and y[0].tolist() == [1.0] * 20 and html_blocks._run_of_blocks("<p>a", html_blocks.blocks("<p>a"), 20) is None
