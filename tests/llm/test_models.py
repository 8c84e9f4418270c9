"""Operators 4, 5, 6 and 8: held-out accuracy, gradients, spans against the plain patterns, main texts."""

import json
import random
import re
import zlib

import numpy as np
import pytest

from gridbill.llm import pii, quality, sample, toxicity, wrappers


def halves(spark, path, label, folds, held):
    rows = spark.read.parquet(f"{path}/documents.parquet").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("doc_id", label, "text").collect()
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % folds == held]
    return test


@pytest.mark.parametrize(("module", "op", "label", "folds", "held", "least"), [
    (toxicity, "op4_toxicity", "toxic", 4, 2, 0.8), (quality, "op5_quality", "quality", 5, 0, 0.9),
])
def test_held_out_ranking(spark, module, op, label, folds, held, least):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in getattr(module, op)(spark, path).collect()}
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % folds == held) for i, r in got.items())
    test = halves(spark, path, label, folds, held)
    assert sample.auc(np.array([got[r[0]].score for r in test]), np.array([r[1] for r in test])) > least


def planted(n, rng):
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "ou", "re"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 200))]
        y = int(i % 3 == 0)
        if y:
            for _ in range(2 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vileword", "badperson"]))
        rows.append((i, y, " ".join(words)))
    return rows


def test_toxicity_planted():
    rows = planted(400, random.Random(5))
    model = toxicity.train(rows[:300], {0: 200, 1: 100})
    test = rows[300:]
    p = model.scores([t for _, _, t in test]) >= toxicity.THRESHOLD
    y = np.array([y for _, y, _ in test]) == 1
    assert (p == y).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_and_odd_texts(spark, documents, module):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = documents([(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "x"), (4, "w " * 40000)])
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.0}
    assert module.score(documents([]), model).count() == 0
    trained = module.train(planted(60, random.Random(1)), {0: 40, 1: 20})
    scores = trained.scores([None, "", "w " * 40000, "!!!"])
    assert len(scores) == 4 and np.isfinite(scores).all() and scores[0] == scores[1]


def test_sample_is_bounded_and_deterministic(spark, documents):
    rows = [(i, f"t{i}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(50)] + [(None, 1, "z"), (3, None, "z"), (4, 1, "z")], "doc_id long, toxic int, text string")
    got, counts = sample.labelled(documents(rows), labels, "toxic", sample.fold(4) != 2, {1: 5, 0: 100})
    assert [y for _, y, _ in got].count(1) == 5 and counts[1] + counts[0] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(50))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in got)
    assert got == sample.labelled(documents(rows), labels, "toxic", sample.fold(4) != 2, {1: 5, 0: 100})[0]


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, start, bag = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3]), np.array([0, 0, 0, 1, 1, 1, 1])
    y, weight = np.array([1.0, 0.0]), np.array([0.4, 0.6])
    m = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    loss = lambda: -(weight * np.log(np.where(y == 1, m.forward(x, start, bag)["p"], 1 - m.forward(x, start, bag)["p"]))).sum()
    grads = m.gradients(m.forward(x, start, bag), start, bag, y, weight)
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-5
        up = loss()
        m.w[k][at] = old - 1e-5
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6
    assert abs(m.attention("a b c " * 100).sum() - 1) < 1e-9


def test_passages_cover_the_text():
    text = "Ab 12 é | " * 100
    rows = quality.passages(text)
    assert len(rows) == -(-400 // quality.PASSAGE) and np.allclose(rows[:, :7].sum(1), 1)
    assert quality.passages("x x x x")[0][7] == 0.75 and len(quality.passages(None)) == 1


# --- 6: personal data --------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice(["a", "b.", "@", "1", "25", "300", ".", "-", " ", "+", "(", ")", "%", "é", "4111111111111111", "x@y.z"]) for _ in range(rng.randrange(14)))
        plain = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if k == "email" or pii.valid(k, m[0])]
        assert pii.base_spans(t) == plain


def test_long_runs_stay_linear():
    for t in ("a" * 200000, "1" * 200000, "1." * 100000, "+" * 100000, "@" * 100000, "+1 " * 60000):
        pii.base_spans(t)
        pii.regions(t)


@pytest.fixture(scope="module")
def tagger():
    return pii.train([])


def test_memory_of_one_long_region_is_bounded(tagger, monkeypatch):
    import tracemalloc

    text = "mail a (at) b.de 10 . 0 . 0 . 1 " + "12 " * 40000 + "x1 (at) y.org"
    tracemalloc.start()
    found = tagger.added([text], [[]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pii.regions(text)) == 1 and peak < 1000 * len(text)
    short = text[:3000] + text[-300:]
    some = tagger.added([short], [[]])
    monkeypatch.setattr(pii, "AT_ONCE", 7)
    assert tagger.added([short], [[]]) == some and len(found) == 1


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    t = pii.Tagger()
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), np.array([[0, 1, 2, 2, 0, 0, 5], [0] * 7, [3, 4, 0, 7, 8, 8, 0]])
    _, grads = t.gradients(x, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = t.w[k][at]
        t.w[k][at] = old + 1e-5
        up = t.gradients(x, y)[0]
        t.w[k][at] = old - 1e-5
        down = t.gradients(x, y)[0]
        t.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_spans_and_mask(documents, tagger):
    text = "mail a.b@c.de or +1 (202) 555-0143, ip 10.0.0.1, card 4111 1111 1111 1111. " * 3
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "x@y.z"), (4, "no data here"), (5, "1 " * 20000)]
    got = pii.find(documents(rows), tagger).collect()
    assert len(got) == len(rows)
    base = next(r.base for r in got if r.doc_id == 1)
    assert base == pii.written(pii.base_spans(text)) and base.count("email") == 3
    assert all({*r.base.split(",")} <= {*r.spans.split(",")} for r in got)
    masked = {r.doc_id: r for r in pii.mask(documents(rows), tagger).collect()}
    assert masked[1].text.startswith("mail [EMAIL] or [PHONE], ip [IP], card [CARD].") and masked[2].text is None and masked[4].text == "no data here" and masked[1].key == "x"
    assert pii.find(documents([]), tagger).count() == 0


def test_tagger_learns_base_and_rewritten_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(pii.sample_windows(docs, 600))
    texts = [r.text for r in docs.where("crc32(cast(doc_id as string)) % 3 = 0").collect()]
    found, base = (tagger.added(texts, [[] for _ in texts]), [pii.base_spans(t) for t in texts])
    hit = sum(len({*a} & {*b}) for a, b in zip(found, base, strict=True))
    assert hit >= 0.8 * sum(map(len, base)) > 0
    extra = tagger.added(texts, base)
    assert all(pii.valid(k, t[a:b]) for t, spans in zip(texts, extra, strict=True) for k, a, b in spans)


def test_op6_columns(spark, tiny):
    import hashlib

    rows = pii.op6_pii(spark, tiny).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = pii.base_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()


# --- 8: main text ------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>three<br>four<p>five&nbsp;six</p><ul><li>a<li>b</ul><!-- <p>no</p> -->"
    "<aside>side</aside><div class='ad'>buy</div><form><p>mail</p></form><section class='comments'><article><p>reader</p></article></section><p>last</article><footer>&copy; x</footer>"
)
MAIN = "Head & line One twothree four five six a b last"


def test_main_text():
    assert wrappers.extracted(PAGE, None) == MAIN
    pages = [PAGE, PAGE.replace("five", "other"), PAGE.replace("<p>last", "<p>more<p>last"), PAGE.replace("</article>", "")]
    wrapper = wrappers.inferred(pages)
    assert wrappers.extracted(PAGE, wrapper) == MAIN
    assert wrappers.extracted(PAGE.replace("six", "6").replace("<ul><li>a<li>b</ul>", "<table><tr><td>t1<td>t2</table>"), wrapper) == "Head & line One twothree four five 6 t1 t2 last"


def test_constant_texts_are_template_where_there_is_no_article():
    page = "<div class=top><p>Same on all</p></div><div id=c><h2>Title {0}</h2><p>Text {0}</p><p>More {0}</p></div>"
    wrapper = wrappers.inferred([page.format(k) for k in range(5)])
    assert wrappers.extracted(page.format(9), wrapper) == "Title 9 Text 9 More 9"


def test_names_inside_an_article():
    page = (
        "<div class='post-share'>no</div><article><h2 id='related-work'>Related</h2><section id='search-algorithms'><p>Search</p></section><div class='content with-sidebar'>Body</div>"
        "<p class='social-history'>History</p><p>Use <code class='header'>head</code> and <math><mi>x</mi></math></p>"
        "<div class='ad box'>no</div><div role='search'>no</div><aside>no</aside><section class='comments'>no</section></article>"
    )
    main = "Related Search Body History Use head and x"
    assert wrappers.extracted(page, None) == main
    assert wrappers.extracted(page, wrappers.inferred([page, page.replace("Body", "Other"), page.replace("Search", "Find")])) == main


def test_constants_and_layouts_of_a_host(spark):
    page = "<div class=top><p>Same on all</p></div><div id=c><h2>{0}</h2><p>Text {1}</p></div>"
    wrapper = wrappers.inferred([page.format("Head", k) for k in range(5)])
    assert wrappers.extracted(page.format("Own", 9), wrapper) == "Own Text 9"
    assert wrappers.extracted(page.format("Head", 1), wrappers.inferred([page.format("Head", 1)] * 3)) == "Same on all Head Text 1"
    mixed = [page.format(f"H{k}", k) for k in range(4)] + [f"<div><p>out</p></div><article><p>in {k}</p></article>" for k in range(4)]
    wrapper = wrappers.inferred(mixed)
    assert [wrappers.extracted(p, wrapper) for p in (mixed[1], mixed[5])] == ["H1 Text 1", "in 1"]
    # all sampled pages of one host have one headline; a page outside of the sample has another
    rows = [(k, "http://a.org/" + str(k), page.format("Head", k)) for k in range(60)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(plain, wrappers.infer(plain)).collect()}
    assert got == {k: f"Text {k}" for k in range(60)}
    first = wrappers.F.xxhash64("page_id", "url")
    last = plain.orderBy(first.desc()).first().page_id
    other = plain.withColumn("html", wrappers.F.when(wrappers.F.col("page_id") == last, page.format("Own", last)).otherwise(wrappers.F.col("html")))
    got = {r.page_id: r.text for r in wrappers.extract(other, wrappers.infer(other)).collect()}
    assert got == {k: f"{'Own' if k == last else 'Head'} Text {k}" for k in range(60)}


def test_all_pages_of_a_host_make_its_wrapper(spark):
    """A block that one page of 400 has is in the wrapper, and a label that a few pages lack stays template."""
    page = "<article><h1>H{0}</h1>{1}<div class=x>Gift vouchers here</div><p>Text {0}.</p></article>"
    bodies = {k: page.format(k, "<ul><li>item</ul>" if k == 7 else "") for k in range(400)} | {9: "<article><h1>H9</h1><p>Text 9.</p></article>"}
    rows = [(k, f"http://a.org/{k}", b) for k, b in bodies.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrapper = json.loads(wrappers.infer(pages).first().wrapper)
    assert wrappers._nodes(wrapper["article"]) == 10 and wrappers.matched(wrappers.tree(bodies[7]), wrapper["article"], [])
    got = {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer(pages)).collect()}
    assert got == {k: f"H{k} {'item ' if k == 7 else ''}Text {k}." for k in bodies}
    # the order of rows and where they lie make no difference
    assert json.loads(wrappers.infer(pages.orderBy("page_id", ascending=False).repartition(7)).first().wrapper) == wrapper


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div id=c>{}</div>"])
def test_the_wrapper_tells_template_without_names(spark, outer):
    """On all three layouts a label that is the same on all pages of a host goes; alone, a page does not show it."""
    body = "<div class=x1><h2>Own {0}</h2><div class=k7>Gift vouchers here</div><p>Text {0} of the page.</p><div class=x2>Also <b>text {0}</b></div></div>"
    page = outer.format(body)
    main = "Own {0} Text {0} of the page. Also text {0}"
    wrapper = wrappers.inferred([page.format(k) for k in range(4)])
    assert wrappers.extracted(page.format(9), None) == main.format(9).replace(" Text", " Gift vouchers here Text")
    assert wrappers.extracted(page.format(9), wrapper) == main.format(9)
    assert wrappers.extracted(page.format(9).replace("Gift vouchers", "Own words"), wrapper) == main.format(9).replace(" Text", " Own words here Text")
    rows = [(k, f"http://a.org/{k}", page.format(k)) for k in range(40)]
    rows += [(k, f"http://b.org/{k}", page.format(k).replace("Gift", f"Gift {k}" if k == 99 else "Gift")) for k in range(60, 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer(pages)).collect()}
    # on the second host one page, in the sample or not, has another text there: it is no template
    own = lambda k: main.format(k) if k < 40 else main.format(k).replace(" Text", f" Gift {k} vouchers here Text" if k == 99 else " Gift vouchers here Text")
    assert got == {r[0]: own(r[0]) for r in rows}


def test_constant_running_text_of_an_article_stays():
    page = "<article><h1>Head</h1><p>Same words</p><div>The same sentence on all pages.</div><ul><li>item</li></ul><div>Own {0}</div></article>"
    wrapper = wrappers.inferred([page.format(k) for k in range(5)])
    assert wrappers.extracted(page.format(7), wrapper) == "Head Same words The same sentence on all pages. item Own 7"


def test_depth_and_teasers():
    for n in (10, 63, 64, 65, 70, 5000):
        nested = "<div>" * n + "<nav>menu <div>deep</div></nav><p>text</p>" + "</div>" * n + "<p>after</p>"
        assert wrappers.extracted(nested, None) == "text after", n
        assert wrappers.extracted(f"<p>out</p>{'<div>' * n}<article>in <nav>no</nav></article>{'</div>' * n}<p>out</p>", None) == "in", n
    teaser = "<main><h1>t</h1><p>body of the page</p><article class='teaser'>short</article></main>"
    assert wrappers.extracted(teaser, None) == "t body of the page short"
    assert wrappers.extracted("<main><p>crumbs</p><article>the text of the article</article></main>", None) == "the text of the article"


def test_odd_pages():
    for page in (None, "", "plain text", "<", "<p", "<div>" * 5000 + "x", "</p></div>", "<a href='" + "x" * 1000, "&lt;p&gt; &#x41; &bogus; &amp", "<article>" * 3):
        assert isinstance(wrappers.extracted(page, None), str)
    assert wrappers.extracted("&lt;p&gt; &#x41;", None) == "<p> A"


def test_raw_names_and_attributes():
    text = lambda body: wrappers.extracted(f"<article>{body}</article>", None)
    for own in ("<svg-icon name=x></svg-icon>", "<select-box></select-box>", "<style-guide>", "<title-bar>", "<svg/>", '<svg width="3" />'):
        assert text(f"<p>one</p>{own}<p>two</p>") == "one two", own
    assert text("<p data-x=don't>text one</p><p>isn't lost</p><p>end</p>") == "text one isn't lost end"
    assert text("""<p title="a > b" lang='x>y'>kept</p><svg><text>no</text></svg><style>p{}</style><p>end</p>""") == "kept end"
    assert wrappers.extracted("<p " + 'a="b" ' * 3000, None) == ""  # no end: read once, without going back


def test_hosts_and_rows(spark):
    rows = [(i, f"http://H{i % 2}.example.com:80/{i}", PAGE.replace("One", f"One{i}")) for i in range(40)]
    rows += [(1, rows[1][1], rows[1][2]), (None, None, PAGE), (50, "not a url", None), (51, "", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = wrappers.extract(pages, wrappers.infer(pages)).collect()
    assert len(got) == len(rows)
    assert all(r.text == MAIN.replace("One", f"One{r.page_id}") for r in got if r.page_id is not None and r.page_id < 40)
    assert {r.page_id: r.text for r in got if r.page_id in (50, 51)} == {50: "", 51: ""}
    empty = pages.limit(0)
    assert wrappers.extract(empty, wrappers.infer(empty)).count() == 0


def test_all_pages_of_a_table(spark, tiny):
    import html

    got = {r.page_id: r.text for r in wrappers.op8_wrappers(spark, tiny).collect()}
    for p in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        assert got[p.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
