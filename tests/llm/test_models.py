"""Language, toxicity, HTML, embeddings, WARC and the pipeline: held-out accuracy, brute force, odd rows and empty tables."""

import html
import html.entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import embedding_dedup, html_extract, language, toxicity, warc
from plantpulse.llm.registry import QUERIES
from plantpulse.session import shared_folder, stored

SMALL = "/root/testdata/sf0.001"
DATA = "/root/testdata/sf0.01"


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# -- language ---------------------------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    found = QUERIES["op6_language_id"](spark, DATA).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")
    assert (found.held_out == [fold(i) for i in found.index]).all() and len(found) == len(docs)
    held = found[found.held_out]
    assert (held.lang_pred == docs.lang.reindex(held.index)).mean() >= 0.98
    assert found.score.between(0, 1).all()


def test_language_on_odd_rows(odd, odd_rows, none):
    found = language.identified_documents(odd)
    assert set(found.columns) == {*odd.columns, "lang_pred"}
    rows = {r["_row"]: r for r in found.collect()}
    assert len(rows) == len(odd_rows)
    for r in odd_rows:
        undetermined = not any(map(str.isalpha, r[1] or ""))
        assert (rows[r[-1]]["lang_pred"] == "und") == undetermined
        assert (rows[r[-1]]["score"] == 0) == undetermined
    assert language.identified_documents(none).count() == 0
    unlearned = odd.withColumn("lang", odd["source"])
    assert {r["lang_pred"] for r in language.identified_documents(unlearned).collect()} == {"und"}


def test_language_sample_leaves_out_the_held_out_fold(spark):
    rows = [(i, "one two three", "en" if not fold(i) else "xx") for i in range(200)]
    assert {lang for _, lang in language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {"en"}


def test_language_sample_keeps_small_languages(spark):
    sizes = {"aa": 20_000, **{f"b{k}": 3_000 for k in range(10)}, "small": 40, "tiny": 1}
    names = [lang for lang, n in sizes.items() for _ in range(n)]
    rows = [(i, "a few words", lang) for i, lang in enumerate(names, 1) if not fold(i)]
    left = Counter(lang for _, _, lang in rows)
    found = language.labelled_sample(spark.createDataFrame(rows + [(None, "x", "no id")], "doc_id long, text string, lang string"), rows=390, per_language=50)
    taken = Counter(lang for _, lang in found)
    assert len(found) <= 390 and taken.keys() == left.keys() and taken["small"] >= 0.7 * min(left["small"], 30)
    assert all(15 <= taken[lang] <= 50 for lang, n in sizes.items() if n >= 3_000)
    assert {lang for _, lang in language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=13)} == left.keys()


def test_folded_coefficients_equal_the_kernel():
    presence = language.Presence()
    texts = ["the cat sat on the mat", "el gato come pescado", "the dog and the cat", "una casa y un gato", "le chat est noir", "la maison"]
    sample = [(presence.of(t), lang) for t, lang in zip(texts, ["en", "es", "en", "es", "fr", "fr"])]
    columns = np.arange(len(language.ORDERS) * language.BINS)
    rows = language._kernel_rows([b for b, _ in sample], columns)
    kernel = [[np.mean([len(np.intersect1d(a[a // language.BINS == k], b[b // language.BINS == k])) /
                        np.sqrt(sum(a // language.BINS == k) * sum(b // language.BINS == k)) for k in range(3)]) for b, _ in sample] for a, _ in sample]
    assert np.allclose(rows @ rows.T, kernel, atol=1e-5)
    model = language.fit(sample)
    values = language._kernel_rows([b for b, _ in sample], model.bins) @ model.coefficients
    assert [model.languages[i] for i in values.argmax(axis=1)] == [lang for _, lang in sample]


# -- toxicity ---------------------------------------------------------------------------------------------------------

def test_toxicity_of_held_out_documents(spark):
    found = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id").toxic
    held = found[found.held_out].join(labels, how="inner")
    said = held[held.predicted == 1]
    assert said.toxic.mean() >= 0.95 and len(said) >= 0.75 * held.toxic.sum()
    assert ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_toxicity_on_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, None, k) for i, k in [*((i, i % 2) for i in range(20)), (None, 1), (5, None), (6, 7)]],
                                   "doc_id long, quality int, toxic int")
    found = toxicity.scored_documents(odd, labels)
    rows = found.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert {r["score"] for r in toxicity.scored_documents(odd, labels.limit(0)).collect()} == {0.25}
    assert toxicity.scored_documents(none, labels).count() == 0


def test_toxicity_sample_counts_only_labels_of_documents(spark):
    ids = [i for i in range(2000) if not fold(i)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids[::10]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, 100).count() == 100
    assert toxicity.labelled_sample(docs, labels, 1000).count() == len(ids[::10])


def test_ftrl_learns_rare_words_and_stays_sparse():
    rng = random.Random(1)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]

    def text(bad):
        found = rng.choices(vocabulary, k=60)
        return " ".join(found + rng.sample(["vile", "nasty", "rotten", "foul"], 2) * bad)

    rows = [(toxicity.features(text(k % 8 == 0)), int(k % 8 == 0)) for k in range(1200)]
    model = toxicity.fit(rows[:])
    scorer = toxicity.Scorer(model)
    assert len(model.weights) < 0.05 * len(np.unique(np.concatenate([x for x, _ in rows])))
    assert scorer(text(True).upper()) > 0.5 and scorer(text(False)) < 0.5 and scorer(None) == scorer("") < 0.5


def test_ftrl_equals_a_plain_one():
    """Number by number over dictionaries: the same buckets, weights and scores."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["vile", "calm", "tree", "house", "foul", "river", "stone"], k=rng.randrange(3, 12))) for _ in range(150)]
    rows = [(toxicity.features(t), int("vile" in t or "foul" in t.split()[:2])) for t in texts]
    p = toxicity.FtrlParameters()
    times = Counter(int(b) for x, _ in rows for b in x)
    known = [([int(b) for b in x if times[int(b)] >= toxicity.LEAST_ROWS], y) for x, y in rows]
    z, n = Counter(), Counter()
    rate = (sum(y for _, y in rows) + 0.5) / (len(rows) + 2.0)
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0

    def weight(b):
        return 0.0 if abs(z[b]) <= p.l1 else -(z[b] - np.sign(z[b]) * p.l1) / ((p.beta + n[b] ** 0.5) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(known)):
            x, y = known[i]
            held = {b: weight(b) for b in x}
            g = 1 / (1 + np.exp(-(bias + sum(held.values())))) - y
            for b in x:
                z[b] += g - ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / p.alpha * held[b]
                n[b] += g * g
            bias_n += g * g
            bias -= p.alpha * g / bias_n ** 0.5
    expected = {b: weight(b) for b in sorted(times) if weight(b)}
    model = toxicity.fit(rows[:])
    assert model.buckets.tolist() == list(expected)
    np.testing.assert_allclose(model.weights, list(expected.values()), rtol=1e-5)
    assert model.bias == pytest.approx(bias)
    for text in texts[:20]:
        logit = bias + sum(expected.get(int(b), 0.0) for b in toxicity.features(text))
        assert toxicity.Scorer(model)(text) == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


# -- HTML -------------------------------------------------------------------------------------------------------------

def article_text(html):
    import html as entities

    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    lines = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", part.replace("<br>", " "))).split()) for part in re.split(r"</?(?:p|h1|article)\b[^>]*>", inner))
    return "\n".join(line for line in lines if line)


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_html_of_all_pages(spark):
    found = QUERIES["op5_html_extraction"](spark, DATA).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas().set_index("page_id")
    assert len(found) == len(pages)
    for i, row in found.iterrows():
        assert row.text == article_text(pages.html[i]) and row.n_chars == len(row.text) and row.url == pages.url[i]


def test_any_markup_is_read():
    rng = random.Random(7)
    pieces = ["<", ">", "<!", "<![", "[", "]]>", "]", "<!--", "-->", "<p>", "</p", "<div ", "a=", '"', "'", "&", "&#x", ";", "<?", "?>", "</", "/>", "<![CDATA[", "<![if x]>", "<![endif]>", "foo", " ", "\n",
              "<script>", "</script>", "<title>", "<!doctype", "<svg>", "x"]
    for _ in range(20_000):
        html_extract.Dom("".join(rng.choices(pieces, k=rng.randrange(14))))
    assert "x" in "".join(text for _, text in filter(None, html_extract.Dom("<p><![foo[bar]]>x</p>").segments))


def test_html_in_unseen_markup(spark, trees):
    texts = [article_text(r["html"]).split("\n") for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(60).collect()]
    rng, right = random.Random(77), 0
    for lines in texts:
        page = re.sub(f' {html_extract._LABEL}="."', "", html_extract.rebuilt_page(lines, [line for found in texts for line in found], rng))
        dom = html_extract.Dom(page)
        right += html_extract.block_texts(dom, html_extract.decode(dom.parent, trees.logits(html_extract.node_features(dom)))) == "\n".join(lines)
    assert right >= 0.85 * len(texts)


def test_html_decoding_is_best_and_consistent():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(size=n)
        best = max(sum(o if k >> i & 1 else -o for i, o in enumerate(odds)) for k in range(2**n)
                   if all(not k >> i & 1 or k >> parent[i] & 1 for i in range(1, n)))
        kept = html_extract.decode(parent, odds)
        assert all(not kept[i] or kept[parent[i]] for i in range(1, n))
        assert np.isclose(sum(o if k else -o for o, k in zip(odds, kept)), best)


def test_html_on_odd_pages(spark, trees):
    long = "<article>" + "<p>Words that go on, and on; here.</p>" * 3000
    pages = [(1, None), (2, ""), (3, "plain &amp; words only"), (4, "<article><p>Cut off <b>text, with a sentence.<script>x(1)"), (5, long), (None, "<p>x"), (5, long),
             (6, "<article><h1>A&nbsp;b\n c</h1><p>One &lt;two&gt; three, four.<br>five six.</p></article><footer>&copy; f</footer>"), (7, "<<<>>> <p </p")]
    frame = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html_extract.extracted(frame, trees).collect()
    found = {(r["page_id"], r["html"]): r["text"] for r in rows}
    assert len(rows) == len(pages) and found[1, None] == found[2, ""] == ""
    assert found[3, pages[2][1]] == "plain & words only"
    assert found[5, long].count("\n") == 2999
    assert found[6, pages[7][1]] == "A b c\nOne <two> three, four. five six."
    assert html_extract.extracted(frame.limit(0), html_extract.fit(frame.limit(0))).count() == 0


# -- embeddings -------------------------------------------------------------------------------------------------------

def brute_links(rows):
    sound = {}
    for k, (_, vector, label) in enumerate(rows):
        if vector and label is not None and None not in vector and np.isfinite(vector).all() and np.any(vector):
            sound[k] = np.array(vector, dtype=float) / np.linalg.norm(vector)
    links = {k: [j for j in sound if j != k and rows[j][2] == rows[k][2] and len(sound[j]) == len(sound[k]) and sound[k] @ sound[j] >= 0.93] for k in sound}
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[k], *(root[j] for j in links.get(k, []))]) for k in range(len(rows))]
    return [(r[0], len(links.get(k, [])), rows[root[k]][0]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for dim in (24, 5):
        for _ in range(12):
            center = rng.standard_normal(dim)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((len(rows), (center + 0.05 * rng.standard_normal(dim)).astype("f4").tolist(), int(rng.integers(0, 2))))
    same = rng.standard_normal(24).astype("f4").tolist()
    rows += [(len(rows) + k, same, 1) for k in range(30)]
    for vector, label in ((None, 1), ([], 1), ([0.0] * 24, 1), ([None] + same[1:], 1), ([float("nan")] + same[1:], 1), ([float("inf")] + same[1:], 1), (same, None), ([2 * v for v in same], 1)):
        rows.append((len(rows), vector, label))
    frame = spark.createDataFrame([(*r, 0, "b") for r in rows], "vec_id long, embedding array<float>, label int, dim int, block string")
    found = embedding_dedup.near_duplicates(frame).orderBy("vec_id").collect()
    expected = brute_links(rows)
    assert [r["vec_id"] for r in found] == [e[0] for e in expected]
    clear = {e[0] for e, r in zip(expected, rows) if not r[1] or len(r[1]) == 24}  # in 5 dimensions families meet near the threshold
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in found if r["vec_id"] in clear] == [e for e in expected if e[0] in clear]
    assert all(r["n_links"] <= e[1] for r, e in zip(found, expected))
    assert sum(r["n_links"] for r in found) >= 0.95 * sum(e[1] for e in expected)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_cap_filters_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    caps = embedding_dedup.CapFilters(64)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x), caps.decode(y))]
    assert np.mean(shared) >= 0.97
    every = caps._all(caps._parts(x[:5]))
    for scores, ids in zip(every, caps.decode(x[:5])):
        passing = np.flatnonzero(scores >= caps.threshold)
        assert set(passing) <= set(ids) and len(ids) >= embedding_dedup.LEAST_FILTERS


@pytest.mark.parametrize("shape", [1 / np.arange(1, 65), np.arange(64) < 32, np.arange(64) < 22], ids=["decaying", "half padded", "two thirds padded"])
def test_cap_filters_recall_where_coordinates_differ(shape):
    rng = np.random.default_rng(4)
    caps = embedding_dedup.CapFilters(64)
    x, side = rng.standard_normal((400, 64)) * shape, rng.standard_normal((400, 64)) * shape
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x), caps.decode(y))]) >= 0.97


@pytest.mark.parametrize("dim", [1, 2, 5, 7])
def test_no_link_escapes_in_few_dimensions(dim):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, dim))
    y = x + 0.2 * rng.standard_normal(x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    filters = embedding_dedup.filters_of(dim, 0.93)
    shared = np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(filters.decode(x), filters.decode(y))])
    assert shared[(x * y).sum(axis=1) >= 0.93].all()


# -- WARC -------------------------------------------------------------------------------------------------------------

def test_warc_records_link_and_round_trip(spark):
    pages = [(1, "http://a", "<p>One &amp; two</p><script>x</script><p>three"), (2, None, None), (None, "http://b", ""), (1, "http://a", "<p>One &amp; two</p><script>x</script><p>three")]
    frame = spark.createDataFrame([(*p, "h", "b") for p in pages], "page_id long, url string, html string, headers string, block string")
    found = stored(warc.responses(frame))
    records = stored(found.unionByName(warc.derivatives(found)))
    rows = records.collect()
    assert sorted(r["warc_type"] for r in rows) == ["conversion"] * 4 + ["metadata"] * 4 + ["response"] * 4
    ids = {r["record_id"] for r in rows if r["warc_type"] == "response"}
    digests = {r["record_id"]: r["payload_digest"] for r in rows if r["warc_type"] == "response"}
    for r in rows:
        if r["warc_type"] != "response":
            assert r["refers_to"] in ids and r["headers"]["X-Source-Payload-Digest"] == digests[r["refers_to"]]
            assert any(o["record_id"] == r["headers"]["WARC-Concurrent-To"] and o["refers_to"] == r["refers_to"] for o in rows)
    assert {r["block"] for r in rows if r["warc_type"] == "conversion" and r["page_id"] == 1} == {"One & two\nthree"}
    folder = f"{shared_folder(spark)}/warc"
    warc.write_warc(records, folder)
    back = sorted(r["value"] for r in warc.read_warc(spark, folder).collect())
    assert back == sorted(r["value"] for r in warc.record_text(records).collect())
    for value in back:
        head, block = value.split("\r\n\r\n", 1)
        assert int(re.search(r"Content-Length: (\d+)$", head, re.M)[1]) == len(block.encode())
    assert warc.derivatives(warc.responses(frame.limit(0))).count() == 0


def test_warc_text_decodes_all_references(spark):
    texts = ["a &mdash; b&rsquo;s caf&eacute; &#8217;&#x27;&#X1F600;&#128;&#0;&#xD800;&#x110000;&#99999999999;&#1;&#xFFFE;z", "&copy2 &notit; &notin; &ampamp; &amp;lt; &bogus; &; && &#; &#x; &NotEqualTilde; &AMP &acE;",
             "no reference", "x&", "a&nbsp;b&nbsp&NonBreakingSpace;&#160;&#xA0;", *(f"&{name} &{name}x" for name in list(html.entities.html5)[::40]), *(f"a&#{k};b&#x{k:x}b" for k in [*range(33, 300), 0xFDD0, 0x1FFFF])]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = {r["k"]: r["text"] for r in frame.select("k", warc.unescaped(F.col("text")).alias("text")).collect()}
    assert [found[k] for k in range(len(texts))] == [html.unescape(t).replace("\u00a0", " ") for t in texts]


@pytest.mark.parametrize("page, text", [
    ("<p>a</p><script>var x = 1;", "a"), ("<p>a<style>b {}", "a"), ("a<!-- b <p>c", "a"), ("a<!-->b", "a" + "b"), ("a<script>x</script foo>b", "ab"),
    ("<title>the <script> tag</title><p>b", "the tag\nb"), ("<a title='<script>'>b</a>", "b"), ("<script-x>b</script-x>c", "bc"), ("<p>&mdash;&#8217;", "\u2014\u2019")])
def test_warc_text_of_unclosed_markup(spark, page, text):
    frame = spark.createDataFrame([(page,)], "html string")
    assert re.sub(" +", " ", frame.select(warc.plain_text(warc.without_markup(F.col("html"))).alias("t")).first()["t"]) == text


# -- pipeline ---------------------------------------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.limit(6)
    mixed = stored(docs.union(extra).union(spark.createDataFrame([(90001, None, None, None, None), (90002, " 12 ", "en", "s", 4), (None, "a text without id", None, None, 0)], docs.schema)))
    before, at = mixed.count(), mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, at, SMALL))
        assert kept.columns == docs.columns and kept.exceptAll(at).isEmpty()
        if name == "language_id":
            assert kept.count() == before - 2
        if name == "exact_dedup":
            norm = [re.sub(r"\s", "", r["text"]) for r in kept.collect()]
            assert len(norm) == len(set(norm)) and set(norm) == {re.sub(r"\s", "", r["text"]) for r in at.collect()}
        at = kept
    placed = corpus_pipeline.STAGES[-1][1](spark, at, SMALL)
    assert {r["doc_id"] for r in placed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in at.collect()}


def test_pipeline_on_odd_and_empty_rows(spark, odd, none):
    import corpus_pipeline

    for frame in (odd, none):
        at = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stored(stage(spark, at, SMALL))
            assert at.columns == frame.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, at, SMALL).count() == 0) == (frame is none)


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_keeps_texts_with_letters(spark, odd, odd_rows, none, lang):
    import corpus_pipeline

    docs = stored(odd.withColumn("lang", F.lit(lang).cast("string")))
    kept = corpus_pipeline.with_language(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert {r["_row"] for r in kept.collect()} == {r[-1] for r in odd_rows if any(map(str.isalpha, r[1] or ""))}
    assert corpus_pipeline.with_language(spark, none, SMALL).count() == 0


def test_exact_copies_stage_keeps_columns_named_like_its_own(spark):
    import corpus_pipeline

    rows = [(1, "same text", "d1", 1), (1, "same text", "d1", 1), (2, "same  text", "d2", 2), (3, "other", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, __digest long")
    kept = corpus_pipeline.without_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "same  text", "d2", 2), (3, "other", None, 3)]
    repeated = corpus_pipeline.without_copies(spark, docs.filter("doc_id <> 2"), SMALL)
    assert repeated.columns == docs.columns
    assert sorted(map(tuple, repeated.collect())) == [(1, "same text", "d1", 1), (3, "other", None, 3)]
