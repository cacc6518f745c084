import numpy as np
import pytest

from lexigauge.llm import html_text as ht


@pytest.fixture(scope="module")
def labeller():
    return ht.train(300)


def test_gradients():
    net, draw = ht.Labeller(), np.random.default_rng(0)
    x, y = draw.normal(size=(5, 3, ht.INPUTS)), (draw.random((5, 3)) > 0.5) * 1.0
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    _, g = net.gradient(x, mask, y)
    for key, value in g.items():
        at = tuple(s // 2 for s in value.shape)
        net.p[key][at] += 1e-5
        more = net.gradient(x, mask, y)[0]
        net.p[key][at] -= 2e-5
        less = net.gradient(x, mask, y)[0]
        net.p[key][at] += 1e-5
        assert abs((more - less) / 2e-5 - value[at]) < 1e-6, key


def test_blocks():
    page = "<head><title>T</title></head><body><!-- x --><p>a<b>b</b>&amp; c<br>d<p>e <script>var t='</p>'</script><ul><li>f<li>g&nbsp;h</ul><img alt=x>i"
    assert [b.text for b in ht.blocks_of(page)] == ["ab& c d", "e", "f", "g h", "i"]
    assert ht.blocks_of("") == [] and ht.blocks_of("<script>x") == [] and ht.blocks_of("<!-- open") == []
    assert ht.blocks_of('<div class="siteNav a-b">x</div>')[0].path == ["div", ".site", ".nav", ".a", ".b"]


def test_blocks_after_open_heads_and_closed_drawings():
    page = "<html><head lang=en>\n<meta charset=utf-8><title>T</title><style>s</style><script>x</script>\n%s<article><p>a</p><p>b</p></article>"
    closed = [(b.path, b.text) for b in ht.blocks_of(page % "</head><body>")]
    assert [text for _, text in closed] == ["a", "b"]
    assert [(b.path, b.text) for b in ht.blocks_of(page % "<body>")] == closed
    assert [b.text for b in ht.blocks_of(page % "")] == ["a", "b"]
    for svg in ('<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<SVG a=b />", "<svg hidden/>", '<svg a=">"/>', "<svg a=b/>x</svg>", "<svg><path d='m'/>x</svg>"):
        assert [b.text for b in ht.blocks_of(f"<p>a</p>{svg}<p>b</p>")] == ["a", "b"], svg


def test_blocks_with_odd_attributes():
    for page, want in (
        ("<p title=it's>Don't stop here</p><p>b</p>", ["Don't stop here", "b"]),
        ('<p>a <a href="x>link</a> b</p>', ["a link b"]),
        ("<p 'x' = 'a>b'>a</p>", ["a"]),
        ('<p class=">" id=x>a</p><p "y">b</p>', ["a", "b"]),
        ("<p>a</p><select><option>1<option>2<p>b</p>", ["a", "b"]),
        ("<p>a<select name=s><option>1</option><b>x</b></select>c</p>", ["ac"]),
        ("<select-menu>a</select-menu>", ["a"]),
    ):
        assert [b.text for b in ht.blocks_of(page)] == want, page


def test_inputs_hold_every_word():
    words = [f"w{k % 7}" for k in range(1000)]
    row = ht.block_inputs([ht.Block([], " ".join(words), 0.0, None)])[0]
    want = np.zeros(ht.WORD_BUCKETS)
    for w in words:
        want[ht.zlib.crc32(w.encode()) % ht.WORD_BUCKETS] += 1 / 1000
    assert np.allclose(row[ht.PATH_BUCKETS : ht.PATH_BUCKETS + ht.WORD_BUCKETS], want)


def test_labels_against_a_plain_pass(labeller, monkeypatch):
    """Pages side by side and inputs in parts give what one block after the other gives."""
    monkeypatch.setattr(ht, "INPUT_BLOCKS", 3)
    draw, p, h = np.random.default_rng(5), labeller.p, ht.HIDDEN
    pages = [ht.blocks_of(ht.template_page(draw)) for _ in range(8)]
    squash = lambda v: 1 / (1 + np.exp(-v))
    for page, got in zip(pages, labeller.label(pages), strict=True):
        x, sides = ht.block_inputs(page), []
        for d in "fb":
            state = cell = np.zeros(h)
            rows = []
            for v in x if d == "f" else x[::-1]:
                i, f, o, new = np.split(v @ p[f"wx{d}"] + p[f"b{d}"] + state @ p[f"wh{d}"], 4)
                cell = squash(f) * cell + squash(i) * np.tanh(new)
                state = squash(o) * np.tanh(cell)
                rows.append(state)
            sides.append(np.array(rows if d == "f" else rows[::-1]))
        logit = np.concatenate(sides, axis=1) @ p["out"] + p["c"]
        sure = abs(logit) > 1e-3
        assert sure.any() and (got == (logit > 0))[sure].all()


def test_unseen_templates(labeller):
    draw = np.random.default_rng(77)
    pages = [ht.blocks_of(ht.template_page(draw)) for _ in range(150)]
    good = [(label == np.array([b.label == "1" for b in page])).mean() for page, label in zip(pages, labeller.label(pages)) if page]
    assert np.mean(good) > 0.97


def test_pages(spark, labeller):
    body = "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Title</h1><p>One  <i>two</i>.<p>Three &lt;4&gt;.</article><section class=comments><p>First!</p></section><footer>&copy; x</footer>"
    long = "<article>" + "<p>Word after word, here.</p>" * 20000 + "</article>"
    rows = [(1, "u", body), (2, None, None), (3, "v", ""), (1, "u", body), (None, "w", long)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = ht.extract(df, labeller).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id == 1] == ["Title One two. Three <4>."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))
    assert next(r.n_chars for r in got if r.page_id is None) == 20000 * 23 - 1
    assert ht.extract(df.filter("false"), labeller).count() == 0
