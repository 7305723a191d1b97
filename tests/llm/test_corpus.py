"""Corpus operators against brute force, and on nulls, empty tables, repeated rows, long texts and clashing columns."""

import collections
import hashlib
import html
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tableops.llm import exact_dedup, html_extract, lm_score, mixing, packing, pii, quality, queries, simhash, toxicity, url_filter

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(1, "Some words here", "a"), (2, None, None), (3, "", "a"), (4, " \n\t ", "b"), (5, "some WORDS here", "b"), (5, "some WORDS here", "b"), (None, "no id", "c"), (6, "long word " * 20000, "a"), (7, "é ö ß " * 3 + " x", None)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those the operators make."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("fp", "size", "component_id", "keep_id", "score", "piece", "length", "kept", "n_words", "target", "prob", "lang", "__hash", "__key", "__row_hash", "__copies", "__copy", "__rows", "__row", "__text", "doc", "id", "copies", "rows", "node", "left_id", "right_hash", "spans")})


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: tokenizer.encode(v or "", add_special_tokens=False).ids + [0] for k, v in texts.items()}
    got = packing.pack_documents(docs, TOKENS).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, ids in want.items():
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == packing.CAPACITY for r in pieces[1:])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    least = -(-sum(map(len, want.values())) // packing.CAPACITY)
    assert len(by_sequence) <= least + 2
    with_ids = packing.tokenize_pieces(docs, TOKENS, with_ids=True)
    whole = packing.assemble_sequences(with_ids, packing.place_pieces(with_ids.drop("ids")))
    assert sum(len(r.ids) for r in whole.collect()) == sum(map(len, want.values()))


def test_packing_plan_uses_every_piece_once():
    counts = np.zeros(101, dtype=np.int64)
    rng = np.random.default_rng(1)
    np.add.at(counts, rng.integers(1, 101, 5000), 1)
    used = np.zeros_like(counts)
    n = 0
    for parts, times in packing.plan_sequences(counts):
        assert sum(parts) <= 100
        n += times
        for x in parts:
            used[x] += times
    assert (used == counts).all()
    assert n <= sum(packing._best_fit(counts).values())


def test_packing_plan_beats_best_fit_decreasing():
    """Short lengths of equal number: the program finds what best-fit decreasing misses; never is its plan the worse one."""
    counts = np.zeros(2049, dtype=np.int64)
    counts[100:256] = 1000
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    n, plain = (sum(x) for x in ([t for _, t in packing.plan_sequences(counts)], packing._best_fit(counts).values()))
    assert bound <= n <= 1.005 * bound and n < plain
    rng = np.random.default_rng(5)
    for _ in range(3):
        counts = np.bincount(rng.integers(1, 200, 500), minlength=201)
        assert sum(t for _, t in packing.plan_sequences(counts)) <= sum(packing._best_fit(counts).values())


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> 's", "<|endoftext", "\u00a0\u2003x \n\n y\r\n", "x" * 50_000, "naïve 123²  \u0301"])
def test_tokens_are_those_of_the_file(text):
    from tokenizers import Tokenizer

    assert packing.token_ids(TOKENS)(text) == Tokenizer.from_file(TOKENS).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, " " * 3_000_000 + "a", "b" + "\n" * 3_000_000 + "a c", "x" * 3_000_000])
def test_very_long_white_space_is_packed(spark, text):
    """Ids are those of the file, and no row, however long, fails the query."""
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(TOKENS).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(TOKENS)(text) == want
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit(text[:1]), len(text) - 1)).otherwise("a few words"))
    got = packing.tokenize_pieces(docs, TOKENS).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    alone = Tokenizer.from_file(TOKENS).encode(text[:1] * (len(text) - 1), add_special_tokens=False).ids
    assert {r.doc_id: r.n for r in got}[1] == len(alone) + 1


def test_a_file_of_another_kind_is_run_as_it_is():
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.token_ids(other)("Some  Words, 123") == Tokenizer.from_file(other).encode("Some  Words, 123", add_special_tokens=False).ids
    packing.token_ids.cache_clear()


def test_packing_edges(spark, edge):
    got = packing.pack_documents(edge, TOKENS).collect()
    assert sum(r.doc_id == 5 for r in got) == 2 and [r.length for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(edge.limit(0), TOKENS).count() == 0


def test_url_rules(spark):
    urls = ["https://Example.com/en/x", "http://www.example.com/en/", "http://www.example.com/de", "http://a.b.net/es/1?x", "http://net/fr/", "http://x.net/es", "http://badexample.com/en/", "no scheme", None, "http://example.com", "http://com/", "http://x.org:80/a", "http://EXAMPLE.COM/en/a#b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(url_filter._FOLD), m[2]) if m else ("", "")
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    want = {k: brute(u) for k, u in enumerate(urls)}
    got = url_filter.filter_urls(df, queries.RULES)
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == want
    joined = url_filter._by_join(url_filter.with_host_and_path(df).select("page_id", "host", "path"), queries.RULES, "page_id", "allow")
    assert {r.page_id: tuple(r)[1:] for r in joined.collect()} == want
    assert url_filter.filter_urls(df.limit(0), queries.RULES).count() == 0


def test_url_open_segments():
    trie = url_filter.UrlTrie([url_filter.Rule("block", "a.com", "/pre"), url_filter.Rule("allow", "a.com", "/pre/x/"), url_filter.Rule("allow", "com", "")])
    assert trie.match("a.com", "/prefix")[0] == "block" and trie.match("a.com", "/pre/x/1")[0] == "allow"
    assert trie.match("b.com", "")[0] == "allow" and trie.match("org", "/") is None


def test_html_is_the_article(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        article = re.sub(r"</?(?:p|h\d|br|ul|li|div)\b[^>]*>", " ", article)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", article)).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<body><div class='menu'><a href=x>Home</a></div><main><h1>T &amp; t</h1><p>a&nbsp;b</p><aside>no</aside><p>c</p></main><div id=comments><p>great post</p></div>", "T & t a b c"),
        ("<header>Site</header><article><p>one</p><script>if (a < b) '</p>'</script><form>mail<input></form><p>two</p></article><footer>f</footer>", "one two"),
        ("<article><div class=ad>buy<div>now</div></div><p>x<br>y</p></article>", "x y"),
        ("<p>" + "word " * 300 + "</p>", ("word " * 300).strip()),
        ("plain text < 5 and > 3", "plain text < 5 and > 3"),
        ('<p title="a<b">Hello', "Hello"),
        ("<p title='a>b' class=c\">x</p>y", "x y"),
        ('<article><div class="entry-header"><h1>The title</h1></div><p>b</p></article>', "The title b"),
        ('<article><div class="share-price"><p>12 up</p></div><section class="notice-board"><p>n</p></section></article>', "12 up n"),
        ("<article><p>See <a href=x>the whole long report here</a></p></article>", "See the whole long report here"),
        ("<div class='site-footer'>f</div><div id='main-nav'>n</div><p>text</p>", "text"),
        ("x<!-- never closed", "x"),
    ],
)
def test_html_cases(page, text):
    assert html_extract.extract_text(page or "") == text


@pytest.mark.parametrize("page", ["<p " + 'a="b" ' * 10_000, "<a " * 50_000, '<p title="' * 20_000, "<!--" * 50_000, "</" * 100_000, "<script " * 20_000, "<p a='" + "b" * 100_000 + "<" * 50_000])
def test_html_is_read_in_linear_time(page):
    began = time.perf_counter()
    html_extract.extract_text(page)
    assert time.perf_counter() - began < 3


def test_html_without_article_keeps_the_dense_block():
    body = "".join(f"<p>{'long sentence of the text ' * 10}</p>" for _ in range(4))
    page = f"<div><a href=a>Home</a> <a href=b>About</a></div><div class=sidebar>x</div>{body}<div class=footer>tiny</div>"
    assert html_extract.extract_text(page) == " ".join(["long sentence of the text " * 10] * 4).replace("  ", " ").strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (("<p>" + "w " * 750 + "</p>") * 3 + "<div class=ad>buy</div><p>" + "z " * 100 + "</p>", "w " * 2250 + ("z " * 100).strip()),
        ("<div class='page with-sidebar'><p>menu</p><article><div>one<div>two</div></div></article><div>side</div></div><p>after</p>", "one two"),
        ("<div class=sidebar><div>x</div><main><p>a</p><div class=ad>no<div>no</div></div><p>b</p></main>y</div>", "a b"),
        ("<article><h2><a href=x>A linked heading</a></h2><p>text</p><ul><li><a href=y>Reference</a></li></ul></article>", "A linked heading text Reference"),
        ("<p>the post</p><div class=comments><article>great</article></div>", "the post"),
        ("<article>own</article><div class=sidebar><article>other</article></div>", "own"),
        ("<p>the post</p><nav><article>card</article></nav><div class=sidebar style='display:none'><main>gone</main></div>", "the post"),
    ],
)
def test_html_drops_no_text(page, text):
    assert html_extract.extract_text(page) == text


def _plain_page(page):
    """The page with its article, menu and footer elements as div."""
    return re.sub(r"<(/?)(?:article|nav|footer|header|aside)\b", r"<\1div", page)


def test_html_blocks_decide_where_no_element_tells(data, monkeypatch):
    """Surge and dive points bound the article on pages of div alone; one block over the whole page takes more."""
    pages = [r.html for r in pq.read_table(f"{data.replace('0.001', '0.01')}/pages.parquet").to_pandas().itertuples()]
    want = [html_extract.extract_text(p) for p in pages]
    got = [html_extract.extract_text(_plain_page(p)) for p in pages]
    assert sum(a == b for a, b in zip(want, got, strict=True)) >= 0.96 * len(pages)
    monkeypatch.setattr(html_extract, "text_blocks", lambda n: [(0, len(n), int(n.sum()))])
    one = [html_extract.extract_text(_plain_page(p)) for p in pages]
    assert sum(a == b for a, b in zip(want, one, strict=True)) < 0.1 * len(pages)


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "reader-comments", "article-sidebar", "ad-slot", "adSlot", "related-posts", "cookie-notice", "cookie-banner", "notice", "notices", "userComments", "share", "newsletter-signup"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_html_drops_compound_boilerplate(name, around):
    page = f"<{around}><p>{'text ' * 30}</p><div class='x {name}'><p>{'gone ' * 40}</p></div><p>end of it</p></{around}>"
    assert html_extract.extract_text(page) == ("text " * 30 + "end of it" if around != "div" else ("text " * 30).strip())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div class='content with-sidebar'><p>body</p></div></article>", "body"),
        ("<article><header class='entry-header'><h1>T</h1></header><div id=notice-board>n</div></article>", "T n"),
        ("<div><h1>Title</h1></div><div>" + "long text " * 30 + "</div><div>Short.</div><div>" + "more text " * 30 + "</div><div>tail</div>", "Title " + "long text " * 30 + "Short. " + ("more text " * 30).strip()),
        ("<div>" + "words " * 100 + "</div><div>\u00a9 2020 " + "someone " * 20 + "</div>", ("words " * 100).strip()),
        ("<p>" + "words " * 100 + "</p><p>\u00a9 2020 someone</p>", "words " * 100 + "\u00a9 2020 someone"),
        ("<article><a href=x>Teaser</a></article><div>" + "words " * 200 + "</div>", ("words " * 200).strip()),
    ],
)
def test_html_regions(page, text):
    assert html_extract.extract_text(page) == text


def test_mixing_meets_targets(spark, docs, edge):
    got = mixing.mix_documents(docs).collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s))
    size = collections.Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size
        size[r.source] += r.size
    target, left, open_ = {}, 1.5 * sum(size.values()), dict(zip(names, itertools.cycle((3, 1, 2))))
    while open_:
        level = left / sum(open_.values())
        held = [s for s, w in open_.items() if level * w >= 2 * size[s]]
        for s in held or list(open_):
            target[s] = 2.0 * size[s] if held else level * open_[s]
            left -= target[s]
            del open_[s]
    for s in names:
        rows = [r for r in got if r.source == s]
        assert abs(rows[0].target - target[s]) < 1e-6 * max(1, target[s])
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r.size for r in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(docs.repartition(7)).collect()))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix_documents(edge).count() == len(EDGE) and mixing.take_mix(edge).columns == edge.columns
    assert mixing.mix_documents(edge.limit(0)).count() == 0 and mixing.take_mix(edge.limit(0)).count() == 0


def test_mixing_in_blocks(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("grp"), (F.col("id") % 97 + 1).alias("size"), F.lit(0.37).alias("prob"))
    got = mixing.balanced_sample(rows, "doc_id", "grp", "prob", "size", 3000, block_rows=100)
    out = got.agg(F.sum("prob").alias("n"), F.sum(F.col("prob") * F.col("size")).alias("words"), F.count("*").alias("rows")).first()
    words = sum(k % 97 + 1 for k in range(3000)) * 0.37
    assert out.rows == 3000 and abs(out.n - 1110) <= 5 and abs(out.words - words) <= 100
    assert {r.prob for r in got.select("prob").distinct().collect()} == {0.0, 1.0}


def test_exact_dedup(spark, docs, edge):
    fold = lambda t: (t or "").encode().lower()
    for df in (docs, edge):
        groups = collections.defaultdict(list)
        for r in df.collect():
            groups[fold(r.text)].append(r.doc_id)
        want = sorted((repr(k), repr(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t).hexdigest()) for t, ids in groups.items() for k in ids)
        got = exact_dedup.exact_groups(df).collect()
        assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, bytes(r.sha256).hex()) for r in got) == want
        left = exact_dedup.drop_exact_duplicates(df)
        assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.drop_exact_duplicates(edge.limit(0)).count() == 0


def test_lm_prefers_text_to_shuffled_text(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"a{x} b{x} c{x} d{x}" for x in rng.integers(0, 6, 60))
    rows = [(k, text()) for k in range(400)] + [(1000 + k, " ".join(rng.permutation(text().split()))) for k in range(40)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_documents(df, rounds=2, epochs=6).collect()}
    held = [got[k].log_prob_per_token for k in range(400)]
    mixed = [got[1000 + k].log_prob_per_token for k in range(40)]
    assert np.mean(held) > np.mean(mixed) + 0.05
    assert got[2000].log_prob == 0 and got[2001].log_prob_per_token is None and got[5].n_tokens == 240


def test_lm_edges(spark, edge):
    assert lm_score.score_documents(edge).count() == len(EDGE)
    assert lm_score.score_documents(edge.limit(0)).count() == 0


def test_lm_rare_words_have_their_own_share(spark, monkeypatch):
    """Outside the vocabulary a word met five times is five times as likely as one met once."""
    monkeypatch.setattr(lm_score, "VOCABULARY", 2)
    rows = [(k, "common other " * 9) for k in range(3)] + [(10 + k, "five") for k in range(5)] + [(20, "one")]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[10].log_prob - got[20].log_prob - np.log(5)) < 1e-5 and got[10].log_prob_per_token == got[10].log_prob


def test_lm_trains_on_every_document(edge, docs):
    for df in (edge, docs):
        rounds = sum(lm_score.in_round("doc_id", r, lm_score.ROUNDS).cast("int") for r in range(lm_score.ROUNDS))
        assert {r[0] for r in df.select(rounds).collect()} == {1}


def test_lm_scores_are_brute_force(spark, docs, monkeypatch):
    """The network's own softmax of every token, word by word in double precision, and the shares of rare words from plain counts."""
    monkeypatch.setattr(lm_score, "VOCABULARY", 300)
    monkeypatch.setattr(lm_score, "HEAD_COUNTS", 350)
    some = docs.where("doc_id < 60")
    encoded, vocabulary, counts = lm_score.encode_documents(some)
    net = lm_score.train_network(encoded, vocabulary)
    got = {r.doc_id: r.log_prob for r in lm_score.score_with(encoded, counts, net).collect()}
    texts = {r.doc_id: lm_score.tokens_of((r.text or "").encode()) for r in some.collect()}
    seen = collections.Counter(w for t in texts.values() for w in t)
    ranked = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:300]]
    place, rare = {w: k for k, w in enumerate(ranked)}, sum(n for w, n in seen.items() if w not in set(ranked))
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    embed, w1, wc, ww = (getattr(net, n).astype(float) for n in ("embed", "w1", "wc", "ww"))
    for k, words in texts.items():
        ids = [0, 0, *(place[w] + 1 if w in place else 301 + xxhash.xxh32_intdigest(w) % 64 for w in words), 0, 0]
        total = 0.0
        for i, w in enumerate(words):
            h = np.tanh(np.concatenate([embed[ids[i + j]] for j in (0, 1, 3, 4)]) @ w1 + net.b1)
            c = place[w] // 128 if w in place else 3
            total += soft(h @ wc + net.bc)[c]
            total += soft(h @ ww[c] + net.bw[c])[place[w] % 128] if w in place else np.log(seen[w] / rare)
        assert abs(total - got[k]) < 1e-3 * max(1, abs(total))


def test_lm_words_are_those_of_every_slice(docs):
    texts = [r.text for r in docs.limit(40).collect()] + ["  A\tb\x0bC\x1cd ", None, "", " \n", "\u00c9\u0085x\u3000Y", "z"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for at, n in ((0, 46), (3, 20), (37, 9), (42, 2)):
            words, owner = lm_score.words_of(column.slice(at, n))
            want = [(w, k) for k, t in enumerate(texts[at : at + n]) for w in lm_score.tokens_of((t or "").encode())]
            assert list(zip(words.to_pylist(), owner.tolist(), strict=True)) == want


def _lm_sample(seed=1, tokens=3000):
    """A vocabulary of 700 words in 6 classes, contexts, and tokens of which few are of the later classes and some rare."""
    rng = np.random.default_rng(seed)
    vocabulary = lm_score.Vocabulary([(b"%d" % k, 2000 // (k + 1) + 1) for k in range(700)], 900)
    return vocabulary, rng.integers(0, vocabulary.n_ids, (tokens, 4)).astype(np.uint16), np.minimum(rng.zipf(1.3, tokens), 750).astype(np.uint16), rng


@pytest.mark.parametrize("size", [1, 150])
def test_lm_step_is_the_gradient(size):
    """One step against plain softmax gradients in double precision; with weights of 150 exponentials leave the range of floats."""
    vocabulary, context, token, rng = _lm_sample()
    net = lm_score.WindowNetwork(vocabulary)
    net.words[:, : lm_score.HIDDEN] = rng.standard_normal((len(net.words), lm_score.HIDDEN)) * size / 8
    net.classes[:, : lm_score.HIDDEN] *= size
    old = {n: np.array(getattr(net, n), float) for n in ("embed", "w1", "b1", "wc", "bc", "ww", "bw")}
    assert np.isfinite(net.log_probs(context, token)).all()
    net.train(context, token, 0.5)
    soft = lambda z: np.exp(z - z.max(axis=-1, keepdims=True)) / np.exp(z - z.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)
    x = old["embed"][context].reshape(len(token), -1)
    h = np.tanh(x @ old["w1"] + old["b1"])
    of, place = np.where(token <= 700, (token.astype(int) - 1) // 128, 6), (token.astype(int) - 1) % 128
    d = (soft(h @ old["wc"] + old["bc"]) - np.eye(7)[of]) / len(token)
    want = old | {"wc": old["wc"] - 0.5 * h.T @ d, "bc": old["bc"] - 0.5 * d.sum(axis=0), "ww": old["ww"].copy(), "bw": old["bw"].copy()}
    dh = d @ old["wc"].T
    for c in set(of.tolist()) - {6}:
        at = np.flatnonzero(of == c)
        d = (soft(h[at] @ old["ww"][c] + old["bw"][c]) - np.eye(128)[place[at]]) / len(token)
        dh[at] += d @ old["ww"][c].T
        longer = 0.5 * min(lm_score.LIFT, len(token) / len(at))
        want["ww"][c] -= longer * h[at].T @ d
        want["bw"][c] -= longer * d.sum(axis=0)
    dh *= 1 - h * h
    want |= {"w1": old["w1"] - 0.5 * x.T @ dh, "b1": old["b1"] - 0.5 * dh.sum(axis=0), "embed": old["embed"].copy()}
    np.add.at(want["embed"], context.ravel(), -0.5 * lm_score.EMBED_LIFT * (dh @ old["w1"].T).reshape(-1, lm_score.WIDTH))
    for n, value in want.items():
        assert np.abs(getattr(net, n) - value).max() < 1e-4 * max(1, np.abs(value[np.abs(value) < 1e6]).max()), n


def test_lm_minibatches_meet_few_classes(monkeypatch):
    """Every token once, in runs by class, so that a minibatch multiplies fewer and larger matrices; frequent classes are dealt evenly."""
    monkeypatch.setattr(lm_score, "MINIBATCH", 1000)
    vocabulary, _, _, rng = _lm_sample()
    token = np.concatenate([rng.integers(1, 129, 16_000), rng.integers(129, 765, 4000)]).astype(np.uint16)
    net = lm_score.WindowNetwork(vocabulary)
    order = net.dealt(token, np.random.default_rng(2))
    assert sorted(order.tolist()) == list(range(len(token))) and not len(net.dealt(token[:0], rng))
    found = [token[order[k : k + 1000]] for k in range(0, len(token), 1000)]
    assert np.mean([len(set(((t - 1) // 128).tolist())) for t in found]) < 5  # of 6; all 6 in a plain random order
    assert all(600 <= np.count_nonzero(t <= 128) <= 1000 for t in found)


def _brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


ODD = ["a@b.c@d.e", "x@y", "@a.b", "a@b.c.d-e.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (415) 555-0100.", "+1 2", "++12345678901", "a.b+c@x-y.zz a@b.c", "1.2.3", "9" * 50, "é@b.com ü1.2.3.4é", "4111111111111111 4111111111111111", "a@b.co@c.de x@y.z@", "+49 30 (1234) 5678-90 12"]


def test_pii_base_is_the_patterns(docs):
    for text in [*ODD, *(r.text for r in docs.collect() if r.text)]:
        assert list(map(tuple, pii.base_spans(text))) == _brute_spans(text), text[:80]


def test_pii_bootstraps_unseen_identifiers(spark, edge):
    """An identifier of another shape is found in a context of seeds, if two patterns agree on it; a lone word is not enough."""
    rows = [(k, f"Please call me at +1 415 555 01{k:02d} today.") for k in range(10)] + [(50, "Please call me at 555-0199 today."), (51, "He ran at 555-0177 and left")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x.kind for x in got[3].base] == ["phone"] and not got[51].spans
    assert [(rows[10][1][x.s : x.e], x.kind) for x in got[50].spans] == [("555-0199", "phone")] and not got[50].base
    assert pii.find_pii(edge).count() == len(EDGE) and pii.find_pii(edge.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["x" * 1_000_000, "\u5b57" * 1_000_000, "9\n" * 300_000, "a@" * 300_000, "a" * 500_000 + "\u00e9" + "b" * 500_000 + "@c.de", "+1((" * 200_000, "1.2." * 200_000])
def test_pii_reads_long_texts_in_linear_time(text):
    began = time.perf_counter()
    pii.occurrences(text)
    assert time.perf_counter() - began < 20


def test_pii_shared_contexts(spark):
    rows = [(k, f"card no. 4111 1111 1111 1111 and id-{k} ok") for k in range(5)]
    rows += [(10 + k, f"server 10.0.0.{k} down") for k in range(8)] + [(30, "server 10.0.0.300 down")]
    got = {r.doc_id: [(x.s, x.e, x.kind) for x in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[30] == [(7, 17, "ip")]


def test_pii_bootstraps_to_the_end(spark):
    """Each context is accepted through what the one before adds; the last is reached in the third round."""
    contexts = {"server": [*range(1, 13), *range(301, 307)], "host": [*range(301, 307), *range(401, 405)], "node": [*range(401, 405), 501, 502], "other": [601]}
    rows = [(k, f"{word} 10.0.0.{x} down") for k, (word, x) in enumerate((w, x) for w, xs in contexts.items() for x in xs)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if not r.spans] == [rows[-1][0]]
    with pytest.raises(RuntimeError):
        pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2)


PLANTED = {
    "email": ("please write to {} for the details", lambda k: f"ann.{k}@mail{k % 3}.example.com", lambda k: f"bob{k}@intranet"),
    "ip": ("the host {} went down again", lambda k: f"10.1.{k}.7", lambda k: f"10.1.7.{300 + k}"),
    "card": ("card number {} expires next year", lambda k: _with_check_digit(f"41{k:013d}"), lambda k: f"4111-1111-{1000 + k}"),
    "phone": ("call us at {} before noon", lambda k: f"+1 415 555 {1000 + k}", lambda k: f"555-{2000 + k}"),
}


def _with_check_digit(digits):
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def test_pii_finds_unseen_shapes_planted_in_documents(spark, data):
    """In a copy of documents: identifiers of shapes that no base pattern takes, in contexts that base ones share, and the same in others."""
    rng = np.random.default_rng(7)
    texts = [r.text or "" for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").collect()]
    plain = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = set()
    for kind, (sentence, seen, unseen) in PLANTED.items():
        for k in range(24):
            doc, token = int(rng.integers(len(texts))), seen(k) if k < 14 else unseen(k)
            words = f"item {token} sold" if k >= 20 else sentence.format(token)
            texts[doc] = f"{words}. {texts[doc]}" if k % 2 else f"{texts[doc]} {words}."
            if 14 <= k < 20:
                want.add((doc, kind, token))
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {(r.doc_id, x.kind, texts[r.doc_id][x.s : x.e]) for r in got for x in set(r.spans) - set(r.base)}
    before = sum(len(set(r.spans) - set(r.base)) for r in plain)
    print(len(added & want), len(want), len(added), before)
    assert len(added & want) >= 0.9 * len(want)
    assert len(added & want) >= 0.95 * (len(added) - before)


def test_pii_numbers_that_base_patterns_merge(spark):
    """A phone number before other digits, and a card that stands elsewhere by itself, are found whole; a like number without a context is not."""
    rows = [(k, f"w{'abcdefgh'[k]} +1 ({200 + k}) 555-{1000 + k} v{'abcdefgh'[k]}") for k in range(8)]
    rows += [(10, "x +1 (843) 555-7672 170.106.47.218 y"), (11, "one 4111111111111111 two"), (12, "z 4111111111111111 4111111111111111 q"), (13, "at 843-7672 or so")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = lambda k: [(dict(rows)[k][x.s : x.e], x.kind) for x in got[k].spans]
    assert found(10) == [("+1 (843) 555-7672", "phone"), ("170.106.47.218", "ip")] and [x.kind for x in got[10].base] == ["ip"]
    assert found(12) == [("4111111111111111", "card")] * 2 and not got[12].base
    assert not found(13) and all(len(found(k)) == 1 for k in range(8))


def test_toxicity_learns_held_out_documents(spark, edge):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(300)]
    make = lambda bad: " ".join(["zorgon" if bad and rng.random() < 0.1 else "zorgous" if bad and rng.random() < 0.05 else rng.choice(words) for _ in range(60)])
    rows = [(k, make(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df.drop("toxic"), df.where("doc_id < 300").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df.drop("toxic"), model).collect()}
    right = sum((got[k].score >= 0.5) == bool(t) for k, _, t in rows[300:])
    assert right >= 97
    k, text, _ = rows[300]
    assert {text[s.s : s.e] for s in got[k].spans} <= {"zorgon", "zorgous"} and got[k].spans
    assert toxicity.keep_clean(df.drop("toxic"), model).columns == ["doc_id", "text"]
    assert toxicity.score_toxicity(edge, model, keep=("doc_id", "score")).columns == ["doc_id", "score", "spans"]
    scored = toxicity.score_toxicity(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score < 0.5 for r in scored)
    none = toxicity.train_toxicity(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(edge, none).collect()} == {0.0}
    assert toxicity.keep_clean(edge, none).count() == len(EDGE) and toxicity.keep_clean(edge.limit(0), model).count() == 0


def test_chain_marginals_match_plain_forward_backward():
    chain = {"emit": np.array([2.0, -1.0]), "bias": -1.5, "move": np.array([[1.2, 0.6], [0.5, 1.9]])}
    model = toxicity.ToxicityModel(["=x", "=y"], chain)
    words = ["a", "x", "b", "c", "y", "x", "a", "a"]
    e = np.array([[1.0, np.exp(-1.5 + {"x": 2.0, "y": -1.0}.get(w, 0.0))] for w in words])
    total = np.zeros((len(words), 2))
    for path in itertools.product((0, 1), repeat=len(words)):
        p = np.prod([e[k, s] for k, s in enumerate(path)]) * np.prod([chain["move"][a, b] for a, b in itertools.pairwise(path)])
        for k, s in enumerate(path):
            total[k, s] += p
    want = total[:, 1] / total.sum(axis=1)
    assert all(abs(p - want[k]) < 1e-9 for k, p in model.marginals(words))


def test_toxicity_scores_match_plain_forward_backward():
    """Long runs between informative tokens, and letters whose lower case is longer: scores and offsets are those of the whole chain."""
    chain = {"emit": np.array([3.0, -0.5]), "bias": -2.0, "move": np.array([[1.3, 0.4], [0.7, 1.6]])}
    model = toxicity.ToxicityModel(["=bad", "=meh"], chain)
    for words in (["x"] * 700 + ["bad"] + ["x"] * 1500 + ["meh", "bad"], ["bad", "\u0130x"] * 3 + ["x"] * 5, ["x"] * 9):
        e = np.array([[1.0, np.exp(-2.0 + {"bad": 3.0, "meh": -0.5}.get(w, 0.0))] for w in words])
        alpha, beta = np.ones((len(words), 2)), np.ones((len(words), 2))
        for k in range(len(words)):
            alpha[k] = (alpha[k - 1] @ chain["move"] if k else np.full(2, 0.5)) * e[k]
            alpha[k] /= alpha[k].sum()
        for k in range(len(words) - 2, -1, -1):
            beta[k] = chain["move"] @ (e[k + 1] * beta[k + 1])
            beta[k] /= beta[k].sum()
        p = (alpha * beta)[:, 1] / (alpha * beta).sum(axis=1)
        want = sum(p[k] for k, w in enumerate(words) if w in ("bad", "meh"))
        weight, found = model.weight(" ".join(words))
        assert abs(weight - want) < 1e-9 and [k for k, _ in found] == [k for k, w in enumerate(words) if w in ("bad", "meh")]
    assert toxicity.words_of("\u0130 bad") == ["i\u0307", "bad"]


def _fingerprint(raw, words=3):
    w = raw.lower().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, linked):
    low = {k: k for k in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_simhash_is_brute_force(spark, docs, edge):
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    fps = {k: _fingerprint(v) for k, v in raw.items()}
    near = [(a, b) for a, b in itertools.combinations(raw, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = _components(raw, near)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (fps[k], want[k]) for k in raw}
    assert simhash.near_duplicates(edge).count() == len(EDGE) and simhash.near_duplicates(edge.limit(0)).count() == 0


def test_vantage_point_tree_finds_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    chain = base[:1] ^ np.array([sum(1 << b for b in range(n)) for n in range(40)], dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, chain]))
    tree = simhash.build_tree(fps, 4)
    pairs = {(a, b) for k in range(len(fps)) for a, b in ((k, k + 1 + int(j)) for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 2))}
    met = set()
    for _, members, guests in simhash.route(tree, fps, 2):
        both = np.concatenate([members, guests])
        inside = set(both.tolist())
        own = set(members.tolist())
        met |= {p for p in pairs if p[0] in inside and p[1] in inside and (p[0] in own or p[1] in own)}
    assert met == pairs
    monkeypatch.setattr(simhash, "BLOCK", 64)
    parent = simhash.link_shard(fps, np.arange(len(fps)), np.arange(0), 2)
    want = _components(range(len(fps)), pairs)
    assert {k: int(parent[k]) for k in range(len(fps))} == want


def test_near_duplicate_stage_is_brute_force(spark, docs, edge):
    raw = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in raw.items() if w}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = _components(raw, near)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {k for k in raw if want[k] == k}
    left = simhash.drop_near_duplicates(edge)
    assert left.columns == edge.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 4, None, 6, 7}
    assert simhash.drop_near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [(2048, 4 << 20), (16, 4 << 20), (2048, 3000)])
def test_near_duplicates_of_a_hub_are_all_found(spark, monkeypatch, limits):
    """Variants that are near the hub, but hardly near each other: a failed link beside the true one must not hide it.

    The same where shards are larger than a block may be, by rows or by shingles.
    """
    monkeypatch.setattr(simhash, "SHARD_ROWS", limits[0])
    monkeypatch.setattr(simhash, "SHARD_HASHES", limits[1])
    rng = np.random.default_rng(3)
    hub = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    texts = [hub]
    for _ in range(120):
        own = list(hub)
        for at in rng.choice(15, 3, replace=False) * 10 + 4:
            own[at] = f"x{rng.integers(0, 1 << 30)}"
        texts.append(own)
    sets = [set(simhash.shingle_hashes(" ".join(t).encode(), 5)) for t in texts]
    assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_groups(df).collect()} == {0} and simhash.similar_groups(df).count() == len(texts)


def test_near_duplicates_of_short_texts_are_all_found(spark):
    """Eight words, and the same with a ninth: similarity 0.8 exactly, but fingerprints often more than 60 bits apart."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 8)) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, f"{t} end{k}") for k, t in enumerate(texts)] + [(2000 + k, f"  {t}") for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 1000 for k, _ in rows}


def test_near_duplicates_make_no_quadratic_rows(spark, monkeypatch):
    """Texts that share a passage, similar at 0.65 to 0.8: near by fingerprint, none linked, and few rows made of them."""
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(160)]
    rows = [(k, " ".join(passage + [f"x{x}" for x in rng.integers(0, 1 << 40, 20)])) for k in range(300)]
    found = []
    keep = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: found.append((name, keep(df, name))) or found[-1][1])
    assert simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    pairs = simhash.MIN_HASHES * (simhash.MIN_HASHES - 1) // 2
    assert max(df.count() for name, df in found if name != "dealt" and not name.startswith("links")) <= 2 * pairs * len(rows)


def test_linked_sets_are_brute_force():
    rng = np.random.default_rng(8)
    sets = [np.array(sorted(rng.choice(14, rng.integers(1, 12), replace=False))) for _ in range(300)]
    near = [(a, b) for a, b in itertools.combinations(range(300), 2) if 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})]
    links = simhash.linked_sets(sets)
    assert _components(range(300), links) == _components(range(300), near) and len(links) == 300 - len(set(_components(range(300), near).values()))


def test_quality_base_is_brute_force(spark, docs, edge):
    for df in (docs, edge):
        want = collections.Counter()
        for r in df.collect():
            text = r.text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
            hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
            seen, dup = set(), 0
            for line in text.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
            want[(r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)] += 1
        got = quality.judge_quality(df).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge_quality(edge.limit(0)).count() == 0


def test_quality_votes_find_planted_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where(rng.random(4000) < p, good, ~good) * 2 - 1) for p in (0.95, 0.9, 0.8, 0.7, 0.9)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.fit(patterns, counts)
    assert abs(prior - 0.7) < 0.05
    assert ((quality.posterior(votes, prior, table) >= 0.5) == good).mean() > 0.93


def test_quality_agrees_with_labels(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.judge_quality(docs).drop("quality").join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_pipeline(spark, data, edge, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, data)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
        assert stage(spark, edge, data).columns == edge.columns, name
        assert stage(spark, edge.limit(0), data).count() == 0, name
