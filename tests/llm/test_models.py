"""Trained classifiers on held-out rows, vectors and pages against brute force, and the pipeline."""

import html
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagetrawl.llm import graph, near_vectors, quality, queries, site_style, toxicity
from pagetrawl.llm.common import table

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("model,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, model, label, least):
    operator = getattr(model, {"quality": "quality", "toxic": "toxicity"}[label])
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    found = operator(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in found]) >= least
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_classifiers_take_odd_rows(spark, operator):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y z", "c"), (3, "w " * 30000, "d"), (3, "w " * 30000, "d"), (4, "z" * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (known, known.limit(0)):
        found = operator(docs, labels).collect()
        assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
        assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1
    assert operator(docs.limit(0), known).count() == 0


def test_gradients():
    words = ["a b c d".split(), ["e"], []]
    net = toxicity.Network(1)
    vocabulary, numbers = toxicity.numbered(words)
    inputs = toxicity.word_inputs(vocabulary)
    where, owner = toxicity.windows([4, 1, 0])
    index = np.append(np.array(numbers), len(vocabulary))[where]
    assert owner.tolist() == [0, 1, 2]
    net.w = {k: v.astype(float) for k, v in net.w.items()}

    def loss():
        _, g = net.gates(inputs)
        return float((net.forward(g, index) * [1.0, -2.0, 0.5]).sum())

    saved = {}
    x, g = net.gates(inputs)
    net.forward(g, index, saved)
    grads = net.backward(inputs, x, g, index, saved, np.array([1.0, -2.0, 0.5]))
    for name in ("wx", "uf", "ub", "wa", "v", "wo", "bo", "bx", "part"):
        spot = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        before = net.w[name][spot]
        net.w[name][spot] = before + 1e-3
        high = loss()
        net.w[name][spot] = before - 1e-3
        low = loss()
        net.w[name][spot] = before
        assert abs((high - low) / 2e-3 - grads[name][spot]) < 0.02 * max(abs(grads[name][spot]), 0.05), name


def test_pairs_of_features_in_linear_time():
    machine = quality.Machine(3)
    machine.w[:] = np.random.default_rng(1).standard_normal(len(machine.w))
    statistics, owner, bucket, share = quality.features(["a b b c", "", "x"])
    got, _ = machine.raw(statistics, owner, bucket, share)
    for k in range(3):
        x = np.zeros(len(machine.w))
        x[: quality.STATISTICS] = statistics[k]
        x[bucket[owner == k] + quality.STATISTICS] = share[owner == k]
        on = np.flatnonzero(x)
        pairs = sum(machine.v[i] @ machine.v[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert got[k] == pytest.approx(x @ machine.w + pairs, rel=1e-3)


# --- vectors


def test_near_vectors(spark):
    draw = np.random.default_rng(8)
    base = draw.standard_normal((400, 40))
    near = base[:150] + 0.3 * draw.standard_normal((150, 40)) * draw.random((150, 1))
    data = np.concatenate([base, near, near[:5], base[:3] * 2]).tolist()
    rows = [(k, v, k % 3 if k < 400 else (k - 400) % 3) for k, v in enumerate(data)]
    odd = [None, [], [0.0] * 40, [float("nan")] * 40, [None] * 40, [float("inf")] * 40, [1.0], [2.0], [1e-300] * 40]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, data[0], None), (2001, data[0], None), (2002, data[1], 1), (2002, data[1], 1)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    n, links = len(rows), np.zeros((len(rows), len(rows)), bool)
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows):
            if i != j and x is not None and x == y and a and b and len(a) == len(b) and None not in a + b and np.isfinite(a + b).all():
                p, q = np.array(a), np.array(b)
                if p.any() and q.any():
                    p, q = p / np.abs(p).max(), q / np.abs(q).max()
                    links[i, j] = p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= 0.93
    component = np.array([r[0] for r in rows])
    for _ in range(n):
        new = np.array([min(component[i], *component[links[i]]) if links[i].any() else component[i] for i in range(n)])
        if (new == component).all():
            break
        component = new
    ids = np.array([r[0] for r in rows])
    expected = sorted((int(v), int(links[i].sum()), int(component[i])) for i, v in enumerate(ids))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(frame).collect()) == expected
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_codes_find_what_brute_force_finds():
    draw = np.random.default_rng(9)
    x = draw.standard_normal((2000, 64))
    y = x + 0.395 * draw.standard_normal(x.shape)  # about the least cosine
    codes = near_vectors.Codes(x)
    shared = (codes.buckets(codes.of(x)) == codes.buckets(codes.of(y))).any(1)
    assert shared.mean() >= 0.999
    bits = [((codes.of(x)[:, r : r + 1] >> np.arange(codes.bits)) & 1).mean(0) for r in range(3)]
    assert all(((b > 0.4) & (b < 0.6)).all() for b in bits)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 300)] + [(500, k) for k in range(501, 600)] + [(9, 9)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert found == {**{k: 1 for k in range(1, 301)}, **{k: 500 for k in range(500, 600)}}


# --- pages


def test_main_text_of_the_pages(spark):
    got = {r["page_id"]: r for r in queries.op7_main_text(spark, SF).collect()}
    for page_id, page in table(spark, SF, "pages").select("page_id", "html").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S).group(1)
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", re.sub(r"</?b>|<br>", " ", body))]
        text = "\n".join(b for b in blocks if b)
        assert got[page_id]["text"] == text and got[page_id]["n_chars"] == len(text)


def test_main_text_of_odd_pages(spark):
    body = "<div class='story'><p>Page {0} tells of {0}&amp;{0}.</p><div class='box'>Read our best offers now</div></div>"
    pages = [(k, f"http://h.example/{k}", f"<body>{body.format(k)}<footer>f</footer></body>") for k in range(20)]
    deep = "<div>" * 3000 + "<p>deep" + "</div>" * 3000
    pages += [
        (100, None, None), (101, "u", ""), (102, "http://one.example/", deep), (103, "http://two.example/", "plain &lt;b&gt; 1 < 2\n x"),
        (104, "http://a.example", "<article><h1>T</h1><aside>no</aside><p>a<br>b <b>c</b><form>f</form><ul><li>one<li>two</ul>"
         "<div id='comments'><p>reader</p></div></article><p>beside</p>"), (105, "http://a.example", "<script>var a='<p>';</script><p>x<style>y</style>"),
    ]
    frame = spark.createDataFrame([(*p, 1, "q") for p in [*pages, pages[-1]]], "page_id long, url string, html string, way int, row string")
    got = {r["page_id"]: r["text"] for r in site_style.main_text(frame).collect()}
    assert all(got[k] == f"Page {k} tells of {k}&{k}." for k in range(20))
    assert (got[100], got[101], got[102], got[103]) == ("", "", "deep", "plain <b> 1 < 2 x")
    assert got[104] == "T\na b c\none\ntwo" and got[105] == "x"
    assert site_style.main_text(frame.limit(0)).count() == 0


def test_main_text_by_entropy_within_and_beside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Page {0} tells {0}.</p><div class='box'>Read our best offers now</div></article><div class='more'>{0} ends</div><div class='all'>same</div></body>"
    pages = [(k, f"http://h.example/{k}", page.format(k)) for k in range(12)]
    pages += [(50 + k, "http://copies.example/", page.format("x")) for k in range(9)] + [(70, "http://one.example/", page.format(70))]
    got = {r["page_id"]: r["text"] for r in site_style.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nPage {k} tells {k}.\n{k} ends" for k in range(12))
    assert all(got[50 + k] == "Title x\nPage x tells x.\nRead our best offers now" for k in range(9))
    assert got[70] == "Title 70\nPage 70 tells 70.\nRead our best offers now"


def test_names_lower_the_weight_of_main_text(spark):
    page = "<body class='single has-sidebar'><div class='page with-sidebar'><form><article class='post comments-open'><h1 class='entry-header'>Title {0}</h1><p>Tells {0}.</p><div class='notice'>{1}</div></article></form><div class='ad'>Buy {0}</div></div></body>"
    pages = [(k, f"http://h.example/{k}", page.format(k, f"Warns of {k}")) for k in range(12)]
    pages += [(20 + k, f"http://i.example/{k}", page.format(k, "same")) for k in range(12)] + [(70, "http://one.example/", page.format(70, "x"))]
    pages += [(80 + k, "http://j.example/", f"<body class='home search'><div class='story share-page'>Story {k}</div><div class='share'>Share it</div></body>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in site_style.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nTells {k}.\nWarns of {k}" for k in range(12))
    assert all(got[20 + k] == f"Title {k}\nTells {k}." for k in range(12))
    assert got[70] == "Title 70\nTells 70."
    assert all(got[80 + k] == f"Story {k}" for k in range(12))


# --- pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").withColumn("extra", queries.F.lit(1))
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "toxicity" else {r["doc_id"]: r for r in docs.collect()}
        out = corpus_pipeline.settle(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            after = {r["doc_id"]: r for r in out.collect()}
            gone = set(before) - set(after)
        if name == "toxicity":
            assert sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(v == 1 for v in labels.values())
            assert sum(labels.get(i) == 0 for i in gone) <= 0.03 * len(labels)
        if name == "near_dedup":
            told = {r["doc_id"]: r["kept"] for r in corpus_pipeline.near_dedup.near_duplicates(docs).collect()}
            assert set(after) == {i for i, k in told.items() if k}
        if name == "decontamination":
            assert gone == {i for i, r in before.items() if any(t in r["text"] for t in items)}
        if name == "pii":
            assert not gone and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert not any("@mail" in r["text"] for r in after.values())
        docs = out
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(after)


def test_pipeline_takes_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


@pytest.mark.parametrize("dim", [2, 3])
def test_short_vectors_lose_no_link(spark, dim):
    """Pairs of cosine 0.93 to 0.95 at 2 and 3 dimensions: every link that brute force finds."""
    draw = np.random.default_rng(dim)
    a = draw.standard_normal((300, dim))
    turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    b = []
    for v in a:
        angle = np.arccos(draw.uniform(0.93, 0.95))
        w = draw.standard_normal(dim)
        w -= (w @ v) / (v @ v) * v
        b.append(np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * w / np.linalg.norm(w))
    data = np.concatenate([a, np.array(b)]) @ turn
    rows = [(k, v.tolist(), 0) for k, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(data), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(frame).collect()}
    assert [got[k] for k in range(len(data))] == links.sum(1).tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_components_by_distributed_rounds(spark, monkeypatch, seed):
    """A block of 8 links sends even small inputs through the rounds of large and small stars."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    rng = np.random.default_rng(seed)
    chain = [(k + 1, k) for k in range(60)]
    rand = [tuple(map(int, rng.integers(100, 220, 2))) for _ in range(120)]
    pairs = chain + rand + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    expected = {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    found = graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    assert {r["id"]: r["component"] for r in found.collect()} == expected
