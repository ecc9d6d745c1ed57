"""The operators that run Python in tasks, against brute force or held-out accuracy."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skald.llm import consensus, langid, ngrams, packing, pii, quality, queries
from skald.llm.common import Scratch

SF = "/root/testdata/sf0.001"

ODD = [(1, "", "en"), (2, None, "en"), (3, "12 34 ++", None), (None, "word " * 70, "en"), (1, "x" * 300_000, "fr"), (1, "x" * 300_000, "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 0.5) for r in ODD], "doc_id long, text string, lang string, score string, spans double")


def base_spans(text):
    """The base kinds as the contract words them."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(s[::-1])) % 10 == 0

    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in checks for m in re.finditer(p, text) if ok(m.group())]


def test_pii_base_spans(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.detect(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == base_spans(texts[r.doc_id])
    assert pii.digest(pii.detect(odd)).count() == len(ODD)


def test_pii_spans_of_random_strings():
    rng = np.random.default_rng(3)
    signs = np.array(list("a1@.-+ 5()%_Z0,"))
    for _ in range(4000):
        text = "".join(rng.choice(signs, rng.integers(1, 60), p=[0.08, 0.2, 0.08, 0.14, 0.08, 0.06, 0.08, 0.1, 0.02, 0.02, 0.02, 0.02, 0.03, 0.05, 0.02]))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text), text
    for _ in range(1500):
        text = ".".join(str(int(n)) for n in rng.integers(0, 300, rng.integers(3, 12))) + rng.choice(["", "@", "x@y.z", " +49 (0)123 456-78"])
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text), text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "@a." * 300_000, "1." * 250_000, "999." * 250_000, "1 " * 500_000, "+1 " * 300_000, "DE12 " * 200_000])
def test_pii_takes_linear_time(text):
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 2


def test_pii_further_kinds():
    assert [s[:3] for s in pii.spans("konto DE89 3704 0044 0532 0130 00 TODAY PLEASE")] == [("iban", 6, 33)]
    good, bad = "DE89370400440532013000", "DE88370400440532013000"
    assert [s[0] for s in pii.spans(f"iban {good} and {bad}")] == ["iban"]
    assert [s[0] for s in pii.spans("ssn 123-45-6789")] == ["ssn"] and pii.spans("number 123-45-6789") == []
    near, far = pii.spans("card 4111111111111111")[0], pii.spans("4111 1111 1111 1111")[0]
    assert near[3] > far[3] and (far[1], far[2]) == (0, 19)
    assert pii.spans("é 😀 a@b.c")[0][1:3] == (4, 9)


def test_ngrams_in_pieces(monkeypatch):
    text = "Some words, ÄÖÜ 123 and\nmore 𝒳 lines " * 20
    whole = [np.sort(np.concatenate(list(ngrams.hashed(text, (n,), 14)))) for n in (1, 2, 3)]
    monkeypatch.setattr(ngrams, "PIECE", 50)
    assert all((np.sort(np.concatenate(list(ngrams.hashed(text, (n,), 14)))) == w).all() for n, w in zip((1, 2, 3), whole, strict=True))


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {d for d, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    model = langid.learn(langid.learning_rows(docs))
    rows = langid.predict(odd, model).collect()
    assert sorted(r.lang_pred == "und" for r in rows) == [False] * 3 + [True] * 3 and all(0 <= r.score <= 1 for r in rows)
    assert langid.reject(odd, model, 0).count() == 3
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_quality_held_out(spark, odd):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op8_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) >= 0.93
    model = quality.learn(odd, spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, quality int"))
    rows = quality.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.predict(odd, quality.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_quality_features_in_pieces(monkeypatch):
    text = "Some words, ÄÖÜ 123 and\nmore lines " * 20
    every = lambda: np.sort(np.concatenate(list(quality.features(text))))
    whole = every()
    monkeypatch.setattr(quality, "PIECE", 60)
    assert (every() == whole).all()


def test_token_ids_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.tokenizer()
    for text in ("", "Hello  world's\n\n x", "a<|endoftext|>b", "é ß 日本語 😀\t\x00", "x" * 3000, "THE 1234567 ###\r\n  "):
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == lib.encode(text, add_special_tokens=False).ids


def check_packed(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            part = np.array(ids[doc][r.start : r.start + r.length], "<u4")
            assert r.start == at and len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[doc])
            at += r.length
        assert at == len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(ids)
    return len(by_sequence)


def test_packing_round_trip(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encode = packing.tokenizer()
    ids = {r.doc_id: [*encode.encode(r.text or "", allowed_special="all"), 1] for r in docs.collect()}
    n = check_packed(packing.pack(docs, Scratch(spark, "t")).collect(), ids)
    assert n <= 1.04 * sum(map(len, ids.values())) / packing.CAPACITY + 1
    rows = packing.pack(odd, Scratch(spark, "t"), keep_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(encode.encode(t or "")) + 1 for _, t, _ in ODD) and all(len(r.ids) == r.length for r in rows)
    assert packing.pack(odd.limit(0), Scratch(spark, "t")).collect() == []


def test_solver_covers_demand():
    rng = np.random.default_rng(4)
    size = np.unique(rng.integers(1, 80, 60))
    demand = rng.integers(1, 500, len(size))
    plan = packing.solve(size, demand.astype(float), 256)
    assert (sum(c * n for c, n in plan) == demand).all() and all((c * size).sum() <= 256 for c, _ in plan)
    assert sum(n for _, n in plan) <= 1.03 * (size * demand).sum() / 256 + 2
    value = rng.random(len(size))
    best, used = packing.knapsack(value, size, 256)
    assert (used * size).sum() <= 256 and abs((used * value).sum() - best) < 1e-9


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    import html

    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_html_consensus(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_consensus_outvotes_a_page(spark):
    good = "<body><div class='post-1'><p>" + "text of the article " * 9 + "</div><div class='x'><p>short</div>"
    odd_one = "<body><div class='post-2'><p>brief text</div><div class='x'><p>" + "long other matter " * 20 + "</div>"
    rows = [(i, "http://h.example/a", good) for i in range(3)] + [(9, "http://h.example/b", odd_one), (10, None, None), (11, "nonsense", "<p>bare"), (11, "nonsense", "<p>bare")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r.text for r in consensus.extract(df, consensus.votes(df)).collect()}
    assert got[9] == "brief text" and got[10] == "" and got[11] == "bare"
    assert consensus.extract(df.limit(0), consensus.votes(df.limit(0))).collect() == []


def test_page_parts():
    page = consensus.Page(
        "<html><body><div id='cookie-banner'>We use cookies</div><header><h1>Site</h1></header><nav>menu</nav><div class='content post-12'><h1>T &amp; x</h1><p>Hello <b>wor</b>ld &nbsp; a<br>b<p>two "
        "<a href='x'>link</a><form><input>send</form></div><div class='comments'><p>bad</p></div><script>x<p></script><aside>s</aside><!-- c --></body>"
    )
    assert page.text(None) == "T & x Hello world a b two link"
    assert consensus.Page("a < b").text(None) == "a < b" and consensus.Page("<div>" * 3000 + "deep").text(None) == "deep"


def test_sizes_of_schema(spark):
    assert queries.op5_pii_spans(spark, SF).agg(F.sum("n_email")).first()[0] >= 0


def test_malformed_pages():
    text = lambda source: consensus.Page(source).text(None)
    assert text('<p title="x>first para</p><p>second') == "first para second"
    assert text("<p title='a>b'>one</p><p data-x=\"c>d\">two</p>") == "one two"
    assert text("<p don't>one</p><p>two</p>") == "one two"
    assert text("<p>one</p><div class='y") == "one" and text("<p>one</p><!-- never closed <p>two") == "one"
    assert text("<p>one</p><script>var x = '<p>two</p>'") == "one" and text("<p>1 < 2 </ p>and</p>") == "1 < 2 and"
    assert text('<div class="post hidden-gem"><p>' + "the article itself " * 9 + "</div>") == ("the article itself " * 9).strip()
    assert text("<div class='menu'><p>all there is</p></div>") == "all there is"
    assert text("<div class='content'><p>body</p><ul class='related-posts'><li>x</ul><div id='cookieNotice'>y</div></div>") == "body"


@pytest.mark.parametrize("piece", ['<a x="', "<a x='", "<script ", "<!-", "<a b=c ", "</", '<a "', "<p>", "<div>", "&amp", "<style><"])
def test_pages_take_linear_time(piece):
    took = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        consensus.Page(piece * n).text(None)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 2


@pytest.mark.parametrize(
    "head, tail",
    [("<div>", "</x>"), ("<div>", "</span>"), ("<b>", "<p>x</p>"), ("<div>", "<li>a b</li>"), ("<b>", "</i>"), ("<table><tr><td>", "<td>x"), ("<div>word two ", "</div>"), ("<section>", "<div>some words here</div>"), ("<i>", "<td>")],
)
def test_open_elements_take_linear_time(head, tail):
    took = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        page = consensus.Page(head * n + tail * n)
        page.text(None)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 6


class Walked(consensus.Page):
    """The same rules by walks over all that is open."""

    def _last(self, tag):
        assert self._outer[1:] == [i for i in range(1, len(self._open)) if self._tags[self._open[i]] not in consensus.INLINE]
        return next((i for i in range(len(self._open) - 1, 0, -1) if self._tags[self._open[i]] == tag), 0)

    def _close(self, tag):
        if tag not in consensus.INLINE:
            self._break()
        for i in range(len(self._open) - 1, 0, -1):
            name = self._tags[self._open[i]]
            if name == tag:
                self._drop(i)
                return
            if tag in consensus.INLINE and name not in consensus.INLINE:
                return

    def _sides(self, fit):
        def side(at):
            top = at
            while top not in fit:
                top = self.parent[top]
            found = 0
            while at > 0:
                tag = self._tags[at]
                if tag in consensus.PART or consensus.HEADING.fullmatch(tag):
                    return 0
                if tag == "div" and at > top:
                    found = at
                at = self.parent[at]
            return found

        return [side(i) for i in range(len(self.parent))]


def test_pages_against_walks():
    rng = np.random.default_rng(6)
    bits = [*(f"<{t}>" for t in "div p b i li ul td tr table section h2 a span dt dl".split()), *(f"</{t}>" for t in "div p b i li ul td tr table section h2 a span x".split()), "some words here ", "more ", "a long run of words that makes good text ", "<div class='menu'>", "<br>"]
    for _ in range(600):
        source = "".join(bits[int(rng.integers(len(bits)))] for _ in range(int(rng.integers(1, 80))))
        a, b = consensus.Page(source), Walked(source)
        assert (a.parent, a.label, a.blocks, a.best(), a.text(None)) == (b.parent, b.label, b.blocks, b.best(), b.text(None))


def test_deep_paths(spark):
    """Beyond any depth, pages of a host agree on the path that most vote for."""
    deep = "<section>" * 200
    page = lambda name, other: f"<body>{deep}<div class='{name}'><p>{'text of the article ' * 9}</p></div><div class='x'><p>{'other matter ' * other}</p></div></body>"
    rows = [(i, "http://h.example/a", page(f"post-{i}", 0)) for i in range(3)] + [(9, "http://h.example/b", page("post-9", 50))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = consensus.votes(df)
    assert votes.first().path.count(">") == 201
    assert {r.text for r in consensus.extract(df, votes).collect()} == {("text of the article " * 9).strip()}


def test_vote_by_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    count = {}
    for r in pages.collect():
        page = consensus.Page(r.html)
        at, score = page.best()
        if at:
            host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", r.url or "")
            own = count.setdefault(host[1].lower() if host else "", {}).setdefault(page.path(at), [0, 0])
            own[0] += 1
            own[1] += int(score)
    want = {h: max((n, chars, p) for p, (n, chars) in paths.items())[2] for h, paths in count.items()}
    assert {r.host: r.path for r in consensus.votes(pages).collect()} == want


def test_nested_articles_are_whole(spark):
    body = "words of a very long article " * 400
    pages = {
        1: (f"<body><nav>menu</nav><article><h1>Title</h1><p>The lead</p><div class='body'><p>{body}</p></div></article><footer>f</footer></body>", f"Title The lead {body}"),
        2: (f"<body><article><section><p>Brief</p></section><section><p>{body}</p></section></article></body>", f"Brief {body}"),
        3: (f"<body><table><tr><td>{body}</td><td>Small</td></tr></table></body>", f"{body} Small"),
        4: (f"<body><h1>Title</h1><div class='body'><p>{body}</p></div><div class='ad'>buy this now</div></body>", f"Title {body}"),
        5: (f"<body><div class='top'>A short lead</div><div class='body'><p>{body}</p></div><p><a href='x'>read more</a></p></body>", f"A short lead {body} read more"),
        6: (f"<body><div class='x'><a href='y'>all of it linked</a></div><div class='body'><div>{body}</div></div></body>", body),
    }
    rows = [(i, f"http://h{i}.example/", source) for i, (source, _) in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in consensus.extract(df, consensus.votes(df)).collect():
        assert r.text == " ".join(pages[r.page_id][1].split()), r.page_id


def test_quality_learns_from_whole_texts_and_bounded_rows(spark, monkeypatch):
    long = " ".join(f"{a}{b}{c}{a}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append([(b.copy(), w.copy(), y) for b, w, y in rows]))
    docs = spark.createDataFrame([(1, long), (1, long), (2, long), (3, ""), *((4, f"text {i}") for i in range(20))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(1, 0)], "doc_id long, quality int")
    quality.learn(docs, labels)
    rows = seen.pop()
    assert len(rows) == 23 and sum(len(b) > 3000 for b, *_ in rows) == 2
    buckets, counts = np.unique(np.concatenate(list(quality.features(long))), return_counts=True)
    for b, w, _ in rows:
        assert abs(w.sum() - 1) < 1e-4 or not len(b)
        assert len(b) < 3000 or ((b == buckets).all() and np.allclose(w, counts / counts.sum()))
    monkeypatch.setattr(quality, "SAMPLE", 5)
    quality.learn(docs, labels)
    assert len(seen.pop()) == 5
