"""Row-local operators: secrets, HTML, SentencePiece, toxicity, decontamination."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from corpus_cases import EDGES, SF, needs_tables, prose
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html_extract, queries, secrets, sentencepiece_fst, toxicity


# --- secrets
def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "ſecret", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "a", "0", " ", "token=token:", "é", "\n", "x" * 7]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        base = secrets.base_spans(text)
        assert hashlib.sha256(secrets.joined(base).encode()).hexdigest() == secrets.brute_force(text), text


def test_assign_scans_on_after_a_short_value():
    assert secrets.base_spans("token:token:abcdefgh") == []  # the value of the first is five long, and the scan goes on behind it
    assert secrets.joined(secrets.base_spans('PassWord" : \'hunter22')) == "assign:0:21"


def test_markov_models_on_held_out_samples():
    model = secrets.SecretModel(secrets.labelled_samples(seed=1))
    held = secrets.labelled_samples(500, seed=99)
    precision, recall = secrets.precision_and_recall(model, held)
    assert precision == 1.0 and recall > 0.97
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"):  # no digit is needed
        rng = random.Random(4)
        assert sum(model.is_secret("".join(rng.choice(letters) for _ in range(32))) for _ in range(200)) > 195
    text = "see Zx9fQ2LmP7vKt4RwB8nYc3HsJ6dGq1 and internationalisation_of_modules"
    assert [k for _, _, k in secrets.model_spans(text, model, secrets.base_spans(text))] == ["markov"]


def test_model_spans_equal_plain_search():
    model, rng = secrets.SecretModel(secrets.labelled_samples()), random.Random(12)
    bits = ["password = ", "Zx9fQ2LmP7vKt4RwB8nYc3HsJ6dGq1", " ", "deadbeef" * 4, "internationalisation_of_modules", "AKIA" + "Q7" * 10, ".", "é"]
    added = 0
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        base = secrets.base_spans(text)
        want, at = [], 0
        while at < len(text):  # character by character
            end = at
            while end < len(text) and text[end] in secrets.ALPHABET:
                end += 1
            if end - at >= 20 and model.ratio(text[at:end]) > secrets.MARGIN and not any(s < end and at < e for s, e, _ in base):
                want.append((at, end, "markov"))
            at = max(end, at + 1)
        assert secrets.model_spans(text, model, base) == want
        added += len(want)
    assert added > 50


def test_secret_scan_edges(documents):
    rows = secrets.scan_secrets(documents(EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r.spans == [] for r in rows)
    assert secrets.scan_secrets(documents([])).count() == 0
    got = secrets.scan_secrets(documents([(1, "é🤪 token = abcdef123")])).first()
    assert (got.spans[0].start, got.spans[0].end, got.n_assign) == (3, 20, 1)  # code points


# --- HTML
def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        kept = [x for x, k in zip(a, html_extract.shared_lines(a, b, rng.choice([1, 20, 1 << 28]))) if k]
        rest = iter(b)
        assert len(kept) == lcs_length(a, b) and all(x in rest for x in kept)


def test_blocks_and_zones():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>menu</a></nav><div id='cookie-notice'>We use</div>"
            "<article><header><h1>Title &amp; more</h1></header><p>One <b>two<br>three</b>\n four<p>five<script>var x='</p>';</script>"
            "<aside>side</aside><form>f<input></form><div class='ad'>ad</div><section class='comments'><p>reader</p></section></article><footer>&copy;</footer>")
    lines, zones = html_extract.lines_of(page)
    assert html_extract.main_text(lines, zones, bytes(len(lines))) == ["Title & more", "One two three four", "five"]


def text_of(page):
    lines, zones = html_extract.lines_of(page)
    return html_extract.main_text(lines, zones, bytes(len(lines)))


@pytest.mark.parametrize("page, want", [
    ('<article><p>one <span class="ad">BUY NOW</span> two', ["one two"]),
    ("<article><p>one <button>Share</button> two</p>", ["one two"]),
    ('<article><p>one <a class="share" href="/x">Share</a><i> two</i></p><p>three</p>', ["one two", "three"]),
    ('<article><p>one <span class="ad">x<p>two</p></article>', ["one", "two"]),
    ('<article><section id="discussion"><p>it holds</section><section id="related-work"><p>so does this</section>', ["it holds", "so does this"]),
    ('<article><p class="notice">mind the gap</p><div class="comment-list"><p>first!</p></div>', ["mind the gap"]),
    ("<article><p><math><mi>E</mi><mo>=</mo><mi>mc2</mi></math> holds", ["E=mc2 holds"]),
    ("<html><head><title>t</title><meta name=a><body><p>text", ["text"]),
    ("<html><head><style>p{}<body><p>text<p>more</html>", ["text", "more"]),
    ("<p>a<script>if (x < 3) y()<p>b</p>", ["a", "b"]),
    ("<article><ul><li>one<li>two <b>three</ul>four</article>", ["one", "two three", "four"]),
    ("", []), ("no markup &lt;at&gt; all", ["no markup <at> all"]), ("<p>" * 3000 + "deep", ["deep"]), ("<div>" * 3000 + "deep", ["deep"])])
def test_texts_of_pages(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("text", [
    "-" * 20, "_" * 25, "=" * 30, "a" * 25, "x" * 22, "=-" * 11, "-yp" * 12, "Kraftfahrzeughaftpflichtversicherung", "Llanfairpwllgwyngyllgogerychwyrndrobwll",
    "wyswietlanie/uzytkownikow", "Donaudampfschifffahrtsgesellschaft", "electroencefalografista", "antidisestablishmentarianism",
    "/usr/local/share/doc/python3/README", "https-www-example-com-about-us", "550e8400-e29b-41d4-a716-446655440000", "20240131120000000001"])
def test_ordinary_strings_are_no_secrets(text):
    assert not secrets.SecretModel(secrets.labelled_samples()).is_secret(text)


@pytest.mark.parametrize("alphabet, least", [(secrets.ALPHABET[:62], 0.97), (secrets.ALPHABET[:64], 0.97), ("0123456789abcdef", 0.93), ("0123456789ABCDEF", 0.93),
                                             ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.95)])
def test_random_strings_of_twenty_characters_are_secrets(alphabet, least):
    model, rng = secrets.SecretModel(secrets.labelled_samples()), random.Random(3)
    assert sum(model.is_secret("".join(rng.choice(alphabet) for _ in range(20))) for _ in range(300)) >= 300 * least


def test_repeated_units():
    assert [secrets.repeated_unit(t) for t in ("aaa", "aa", "abcabcab", "abcabcabca", "", "abcd" * 3, "x" * 70 + "y")] == ["a", None, None, "abc", None, "abcd", None]


INSIDE = '<article><p>before</p>{}<p>after</p></article>'


@pytest.mark.parametrize("part", [
    '<section id="tasting-menu"><p>it</p></section>', '<section id="comments-on-history"><p>it</p></section>', '<section class="widgets-overview"><p>it</p></section>',
    '<p id="newsletter-history">it</p>', '<div class="text-overlay"><p>it</p></div>', "<p><label>it</label></p>", '<h2 id="discussion">it</h2>'])
def test_content_of_an_article_stays(part):
    assert text_of(INSIDE.format(part)) == ["before", "it", "after"]


@pytest.mark.parametrize("part", [
    '<div class="ad-box">it</div>', '<div id="ad">it</div>', '<div class="related-posts">it</div>', '<div class="notice">it</div>', '<div class="site-notice">it</div>',
    '<div class="replies"><p>it</p></div>', '<div id="discussion">it</div>', '<div class="login">it</div>', '<div class="footer">it</div>',
    '<header class="site-header">it</header>', '<span class="ad-label">it</span>', '<article class="comment"><p>it</p></article>', '<div id="ad-slot-3">it</div>',
    '<div class="comment__body comment-text">it</div>', "<form><label>it</label></form>"])
def test_chrome_inside_an_article_goes(part):
    assert text_of(INSIDE.format(part)) == ["before", "after"]
    assert text_of(INSIDE.format(part).replace("article>", "main>", 1).replace("</article></article>", "</article></main>")) == ["before", "after"]


def test_teasers_are_not_the_text():
    teaser = "<section><article><h3>Teaser</h3></article></section>"
    assert text_of(f'<body><div class="content"><p>the real story</p></div>{teaser}</body>') == ["the real story"]
    assert text_of(f"<body><p>short</p>{teaser}</body>") == ["Teaser"]
    lines, zones = html_extract.lines_of(f"<body><p>a site's long slogan</p>{teaser}</body>")
    assert html_extract.main_text(lines, zones, bytes([html_extract.NEAREST, 0])) == ["Teaser"]  # the neighbour has the slogan, too
    assert text_of("<body><article><p>story</p></article><article class='comment'><p>first!</p></article></body>") == ["story"]


def test_lines_are_told_apart_by_what_takes_them_out(spark):
    page = "<nav>home</nav><article><p>{0}</article><div class='ad'>{1}</div><footer>(c)</footer>"
    rows = [(k, f"http://a.x/{k}", page.format(prose(k, 6), prose(k + 50, 4))) for k in range(5)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.n_lines, r.n_differenced, r.n_zoned, r.n_template) for r in got} == {(4, 2, 1, 0)} and all(r.text == prose(r.page_id, 6) for r in got)


def test_long_pages():
    words = " ".join(f"w{k}" for k in range(50_000))
    assert text_of(f"<article><p>{words}</p></article>") == [words]
    assert len(text_of("<article>" + "<p>x &amp; y" * 20_000)) == 20_000


def test_extraction_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k in range(90):
        body = [prose(rng.randrange(60), 5) for _ in range(rng.randint(2, 8))]
        around = ["<h2>Share this</h2>", "<div>Site name</div>"][: rng.randint(0, 2) if k % 5 == 0 else 2]
        inner = "".join(around) + "".join(f"<p>{x}" for x in body) + "<p>More on this site"
        page = rng.choice(["<html><body><nav>menu</nav><article>{}</article><footer>(c)</footer>", "<body><p>Top</p>{}<p>Bottom", "<main>{}<button>Go</button></main>"]).format(inner)
        rows.append((k, f"http://h{k % 3}.x/{rng.choice('ab')}/{rng.randrange(30)}", page))
    rows += [(100 + k, u, p) for k, (_, u, p) in enumerate(rng.sample(rows, 10))] + [(200, None, None), (201, "http://h1.x/a/1", "")]
    got = {r.page_id: (r.text, r.n_template) for r in html_extract.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = html_extract.brute_force(rows)
    ties = {k for k, v in want.items() if got[k][0] != v}  # neighbours of one path: their order is free
    keys = [html_extract.url_key(u) for _, u, _ in rows]
    assert ties <= {r[0] for r, key in zip(rows, keys) if keys.count(key) > 1 or any(keys.count(o) > 1 for o in keys if o[0] == key[0])}
    assert sum(n > 0 for _, n in got.values()) >= 10
    unique = {key: r for r, key in zip(rows, keys)}.values()
    got = {r.page_id: r.text for r in html_extract.extract_main_text(
        spark.createDataFrame(list(unique), "page_id long, url string, html string").repartition(5)).collect()}
    assert got == html_extract.brute_force(list(unique))


def test_template_inside_articles_goes_and_repeated_prose_stays(spark):
    page = "<article><h2>Share this</h2><p>{0} first<p>{0} and<p>the same prose<p>{0} last<p>More on this site</article>"
    rows = [(k, f"http://a.x/{k:02d}", page.format(prose(k, 6))) for k in range(12)]
    rows += [(40 + k, f"http://c.x/{k:02d}", page.format(prose(k, 6)) if k in (4, 5, 6) else f"<article><p>{prose(k, 9)}") for k in range(12)]  # not on half of the host
    rows += [(20 + k, f"http://b.x/{k}", "<article><p>a story<p>in two parts</article>") for k in range(3)]  # copies
    got = {r.page_id: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5].text == f"{prose(5, 6)} first\n\n{prose(5, 6)} and\n\nthe same prose\n\n{prose(5, 6)} last" and got[5].n_template == 2
    assert got[0].n_template == 0  # one neighbour proves no template
    assert got[45].text.startswith("Share this") and got[45].n_template == 0
    assert all(got[20 + k].text == "a story\n\nin two parts" for k in range(3))


def test_differencing_removes_the_template(spark):
    page = "<div>Site name</div><p>{0} first</p><p>{0} second</p><div>All rights reserved</div>"
    rows = [(k, f"http://h{k % 2}.example/a/{k}.html?x=1", page.format(prose(k, 6))) for k in range(40)] + [(99, None, None), (98, "http://alone.example/", page.format("solo"))]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n long")
    got = {r.page_id: r for r in html_extract.extract_main_text(df.repartition(7)).collect()}
    assert len(got) == 42 and got[3].text == f"{prose(3, 6)} first\n\n{prose(3, 6)} second" and got[3].n_shared == 2
    assert got[99].text == "" and got[98].text.startswith("Site name") and got[98].n_chars == len(got[98].text)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    twice = html_extract.extract_main_text(df.filter("page_id = 3").union(df.filter("page_id = 3")))
    assert twice.count() == 2


# --- SentencePiece
MODEL = os.path.join(queries.TOKENIZERS, queries.PIECES)
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="tokenizer files are not here")
ODD = ["", " ", "  two  spaces ", "日本語 🤪 text\n\n\tx", "aaaaaaaaaaaaaaaaa", "naïve — “q” (x).y", "1234567890", "don't. Stop", "x" * 3000, "▁"]


@needs_model
def test_encoding_equals_the_library():
    spm = pytest.importorskip("sentencepiece")
    model = queries.tokenizer_bytes()
    fst, lib = sentencepiece_fst.Transducer(model, cache=50), spm.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abc ,.'\n1é(") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [prose(k, 50) for k in range(20)]
    for t in texts:
        ids = fst.encode(t)
        assert ids.tolist() == lib.encode(t), t
        if "▁" not in t:
            assert fst.decode(ids) == t


def compiled_map(rules: dict[str, str]) -> bytes:
    """A character map in the published layout: a block of 256 units for each state of the trie."""
    states, texts = {b"": 0}, b""
    for key in (k.encode() for k in rules):
        for n in range(1, len(key) + 1):
            states.setdefault(key[:n], len(states))
    units = [0] * (256 * (len(states) + 1))
    place = {key: 256 * (states[key[:-1]] + 1) ^ key[-1] if key else 0 for key in states}
    for key, k in states.items():
        units[place[key]] = (place[key] ^ 256 * (k + 1)) << 10 | (key[-1] if key else 0)
    for key, new in rules.items():
        units[place[key.encode()]] |= 1 << 8
        units[256 * (states[key.encode()] + 1)] = 1 << 31 | len(texts)
        texts += new.encode() + b"\0"
    return np.array([4 * len(units), *units], "<u4").tobytes() + texts


RULES = {"A": "a", "B": "b", "AB": "ba", "é": "a b", "\t": " ", "ABz": "", "z": "Z"}


@pytest.mark.parametrize("kind", [1, 2])
def test_character_maps_are_read_as_by_the_library(kind):
    spm = pytest.importorskip("sentencepiece")
    assert sentencepiece_fst.character_map(compiled_map(RULES)) == RULES
    model = toy(kind, compiled_map(RULES), squeeze=1)
    fst, lib = sentencepiece_fst.Transducer(model), spm.SentencePieceProcessor(model_proto=model)
    rng = random.Random(8)
    for _ in range(400):
        t = "".join(rng.choice("ABabzé \t-") for _ in range(rng.randint(0, 14)))
        assert fst.encode(t).tolist() == lib.encode(t), t


def toy(kind: int, rules: bytes = b"", squeeze: int = 0, raised: float = 0.0) -> bytes:
    """A model file with a few pieces."""
    def number(x):
        out = b""
        while True:
            x, low = x >> 7, x & 127
            out += bytes([low | (128 if x else 0)])
            if not x:
                return out

    def field(n, data):
        return number(n << 3 | 2) + number(len(data)) + data

    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s + raised, 1) for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.1), ("ab", -2.7), ("ba", -3.3), ("aba", -4.4), ("▁a", -3.5))]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + number(3 << 3) + number(t)) for p, s, t in pieces)
    return body + field(2, number(3 << 3) + number(kind) + number(35 << 3) + number(1)) + field(3, (field(2, rules) if rules else b"") + number(3 << 3) + number(1) + number(4 << 3) + number(squeeze) + number(5 << 3) + number(1))


@pytest.mark.parametrize("raised", [0.0, 4.0])
def test_unigram_shortest_path_equals_brute_force(raised):
    fst = sentencepiece_fst.Transducer(toy(1, raised=raised))
    rng = random.Random(4)

    def all_paths(s):
        if not s:
            return [(0.0, [])]
        out = []
        for n in range(1, len(s) + 1):
            arc = fst.arcs.get(s[:n])
            if arc is not None or n == 1:
                cost = -fst.scores[arc] if arc is not None else -fst.worst
                out += [(cost + c, [s[:n], *p]) for c, p in all_paths(s[n:])]
        return out

    for _ in range(200):
        s = "".join(rng.choice("ab▁z") for _ in range(rng.randint(1, 9)))
        path = fst.shortest_path(s)
        assert "".join(map(fst.label, path)) == s
        cost = sum(-fst.scores[a] if a >= 0 else -fst.worst for a in path)
        assert cost == pytest.approx(min(c for c, _ in all_paths(s)))


def test_links_need_no_merging_of_the_pair(monkeypatch):
    """Random vocabularies, equal ranks among them: a link is where merging the pair leaves both, told from the parts of each label alone."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    wanted = []
    for k in range(25):
        fst = sentencepiece_fst.Transducer(toy(2))
        fst.pieces = sorted(set(rng.sample(words, 25)))
        fst.scores = [-float(rng.randint(0, 10 if k % 2 else 1000)) for _ in fst.pieces]
        fst.arcs = {p: i for i, p in enumerate(fst.pieces)}
        pairs = [(a, b) for a in fst.arcs.values() for b in fst.arcs.values()]
        wanted.append((fst, {(a, b): fst.merged(fst.label(a) + fst.label(b)) == [fst.label(a), fst.label(b)] for a, b in pairs}))
    assert {x for _, links in wanted for x in links.values()} == {False, True}
    monkeypatch.setattr(sentencepiece_fst.Transducer, "merged", None)
    for fst, links in wanted:
        assert {pair: fst.linked(*pair) for pair in links} == links


def test_encoding_merges_each_piece_once(monkeypatch):
    """Long unlike chunks: merging is followed for the pieces met, not for every pair of them."""
    count = []
    merge = sentencepiece_fst.Transducer.next_merge
    monkeypatch.setattr(sentencepiece_fst.Transducer, "next_merge", lambda self, parts: count.append(1) or merge(self, parts))
    fst = sentencepiece_fst.Transducer(toy(2))
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("abz") for _ in range(60))
        ids = fst.encode(text).tolist()
        assert fst.decode(np.array(ids, "<i4")) == text
    assert len(count) <= sum(map(len, fst.arcs))


def test_a_worker_compiles_a_model_once():
    model = toy(2)
    assert sentencepiece_fst.compiled(model) is sentencepiece_fst.compiled(bytes(bytearray(model)))


@needs_model
def test_encode_documents_edges(documents):
    rows = sentencepiece_fst.encode_documents(documents(EDGES), queries.tokenizer_bytes())
    got = rows.collect()
    assert len(got) == len(EDGES) and all(r.round_trip for r in got) and {r.doc_id: r.n_tokens for r in got}[1] == 0
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode_documents(rows, queries.tokenizer_bytes()).collect()}
    assert back[5] == EDGES[5][1]
    assert sentencepiece_fst.encode_documents(documents([]), queries.tokenizer_bytes()).count() == 0


# --- toxicity
def labelled(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.3
        words = prose(k, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vileness", "grimly", "rotten"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(rng.random() < 0.8), int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, documents):
    docs, labels = labelled(600)
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1, 1), (5, None, None), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(docs), known)
    assert model.thresholds[0] <= model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(docs), model).collect()}
    assert all(got[k].rejected == bool(t) for k, _, t in labels if k >= 400)
    assert all(0 <= r.p_toxic <= r.expected_severity <= 2 for r in got.values())
    kept = toxicity.score_toxicity(documents(EDGES), model, keep=("doc_id", "text", "class"))
    assert kept.count() == len(EDGES) and kept.filter("rejected").count() == 0 and kept.filter("text is null").count() == 1


@needs_tables
def test_toxicity_scores_equal_the_definition(spark):
    """The scorer takes another way to the margin than the features that the fit sees."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    usual, rich = toxicity.train(docs, labels), toxicity.train(docs, labels, min_gain=4.0)  # few labels here
    assert len(rich.weights) > 10 and rich.thresholds[0] < rich.thresholds[1]
    for model, scored in ((usual, queries.op9_toxicity(spark, SF)), (rich, toxicity.score_toxicity(docs, rich))):
        rows = scored.collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = toxicity.brute_force(texts[r.doc_id], model)
            assert (r.expected_severity, r.p_toxic) == (pytest.approx(want[0]), pytest.approx(want[1])) and r.rejected == (r.p_toxic >= 0.5)


def test_every_threshold_has_features(spark, documents):
    """A word of poor texts and a word of toxic ones both get weights."""
    rng = random.Random(3)
    grades = [rng.choice([0, 0, 1, 2]) for _ in range(400)]
    docs = [(k, f"{prose(k, 20)} {['', 'clickbait', 'rotten'][g]}") for k, g in enumerate(grades)]
    labels = spark.createDataFrame([(k, int(g != 1), int(g == 2)) for k, g in enumerate(grades)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(docs), labels)
    assert {"1clickbait", "1rotten"} <= set(model.weights)
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(docs), model).collect()}
    assert all(got[k].rejected == (g == 2) and abs(got[k].expected_severity - g) < 0.6 for k, g in enumerate(grades))


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents([(1, "a")]), none)
    row = toxicity.score_toxicity(documents([(1, "a")]), model).first()
    assert (row.expected_severity, row.rejected) == (0.0, False)


def test_ordinal_gradient_finds_the_maximum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 3))
    score = x @ np.array([2.0, -1.0, 0.0])
    grades = (score + rng.logistic(size=500) > 0.5).astype(int) + (score + rng.logistic(size=500) > 3).astype(int)
    rows = [np.flatnonzero(r).tolist() for r in x]

    def loss(w, theta):
        th = np.concatenate([[-np.inf], theta, [np.inf]])
        p = toxicity.sigmoid(th[grades + 1] - x @ w) - toxicity.sigmoid(th[grades] - x @ w)
        return -np.log(p).sum() + 0.5 * 0.1 * (w @ w)

    w, theta = toxicity.fit(rows, grades, 3, l2=0.1)
    best = loss(w, theta)
    for _ in range(50):
        assert best <= loss(w + rng.normal(size=3) * 0.05, theta + np.sort(rng.normal(size=2)) * 0.05) + 1e-3


# --- decontamination
def test_decontamination_equals_brute_force(spark, documents):
    rng = random.Random(5)
    items = [(k, f"What is the {prose(k, 8 + k)} of it? The answer is {prose(k + 50, 4)}.") for k in range(30)] + [(90, ""), (91, None), (92, "..."), (93, "seven quiet mills ran"), (94, prose(77, 300))]
    docs = [(k, " ".join([prose(k, rng.randint(0, 120)), rng.choice(items[:30])[1] if k % 3 == 0 else "", prose(k + 9, 30)])) for k in range(60)]
    docs.append((77, items[4][1][: len(items[4][1]) // 2]))
    docs += [(78, f"{prose(3, 90)} Seven quiet mills ran {prose(8, 200)}"), (79, f"{prose(5, 900)} {items[-1][1]} {prose(6, 30)} {items[2][1]}")]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    want = decontaminate.brute_force(docs, items)
    for chars in (4_000_000, 500):  # one shard, several shards
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(documents(docs), bench, shard_chars=chars).collect()}
        assert got == want
    assert len(want) >= 20 and {(78, 93), (79, 94), (79, 2)} <= want
    assert decontaminate.find_contamination(documents(EDGES), bench).count() == 0
    assert decontaminate.find_contamination(documents(docs), bench.limit(0)).count() == 0


def test_wand_equals_exhaustive_search():
    from collections import Counter
    items = [(k, prose(k, 5 + k % 20)) for k in range(50)]
    toks = [decontaminate.terms(t) for _, t in items]
    df = Counter(t for x in toks for t in set(x))
    index = decontaminate.BlockMaxIndex(items, df, len(items), 12.0)
    rng = random.Random(6)
    for _ in range(200):
        ids = [index.term_ids.get(rng.choice(prose(rng.randrange(60), 30).split()), 0) for _ in range(rng.randint(0, 15))]
        threshold = rng.choice([0.05, 0.3, 0.6])
        exact = {k: sum(x for t in set(ids) if t for kk, x in zip(*index.postings[t]) if kk == k) for k in range(50)}
        assert [k for k, _ in index.search(ids, threshold)] == [k for k, v in sorted(exact.items()) if v + 1e-12 >= threshold]


def test_portions_of_long_documents_change_nothing(monkeypatch):
    """All windows that exact search finds something in are passages, however few numbers are held at a time."""
    from collections import Counter
    items = [(k, prose(k, 12 + k % 9)) for k in range(40)]
    df = Counter(t for _, x in items for t in set(decontaminate.terms(x)))
    index = decontaminate.BlockMaxIndex(items, df, len(items), 15.0)
    rng, half = random.Random(8), 10
    ids = np.array([index.term_ids.get(w, 0) for k in range(300) for w in (prose(k, 12) if rng.random() < 0.3 else "x y z u v").split()], np.int64)
    got = []
    for portion in (1, 300, 1_000_000):
        monkeypatch.setattr(decontaminate, "PORTION", portion)
        got.append(list(index.passages(ids, 0.6)))
    assert index.longest == 2 * half and got[0] == got[1] == got[2] and 0 < len(got[0]) < len(ids) // half
    found = {(s, min(s + 3 * half, len(ids))) for s in range(0, len(ids) - 2 * half, half) if index.search(ids[s:s + 3 * half].tolist(), 0.6)}
    assert found <= set(got[0])


@needs_tables
def test_registered_queries_return_the_contract(spark):
    got = queries.op1_secrets(spark, SF)
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.base_sha256 == secrets.brute_force(docs[r.doc_id] or "") for r in got.collect())
    text = queries.op2_html_text(spark, SF)
    assert text.columns[:4] == ["page_id", "url", "text", "n_chars"] and text.filter("n_chars <> length(text)").count() == 0
    assert not re.search("<", "".join(r.text for r in text.filter("page_id < 20").collect()))
    assert queries.op9_toxicity(spark, SF).agg(F.count("*").alias("n")).first().n == len(docs)


def test_differencing_keeps_the_text_of_copies_and_repeated_prose(spark):
    """Pages without an article: a copy next door must not empty a page, nor a shared line in the middle go."""
    def page(*body):
        return "<html><body>" + "".join(f"<p>{x}</p>" for x in ("Site name", *body, "All pages")) + "</body></html>"

    rows = [(1, "http://a.x/p/1", page("first story", "it repeats", "its end")), (2, "http://a.x/p/2", page("second story", "it repeats", "other end")),
            (3, "http://b.x/q/1", page("copied story", "of two lines")), (4, "http://b.x/q/1?print=1", page("copied story", "of two lines"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract_main_text(df).collect()}
    assert got[1] == ["first story", "it repeats", "its end"] and got[2] == ["second story", "it repeats", "other end"]
    assert got[3] == got[4] == ["Site name", "copied story", "of two lines", "All pages"]


def test_toxicity_rows_are_bounded_and_ordered(spark, documents, monkeypatch):
    """Documents that repeat labelled ids: no more rows than asked for reach the fit, the same at any partitioning."""
    seen, plain = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, grades, *a, **k: seen.append((rows, grades.tolist())) or plain(rows, grades, *a, **k))
    texts = [(k % 20, ("awful nasty words " if k % 20 < 10 else "kind gentle words ") + prose(k % 7, 12)) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k < 10)) for k in range(20)], "doc_id long, quality int, toxic int")
    models = [toxicity.train(documents(texts).repartition(n), labels, max_rows=60) for n in (1, 5)]
    assert len(seen) == 2 and len(seen[0][1]) == 60 and seen[0] == seen[1] and models[0].weights == models[1].weights
