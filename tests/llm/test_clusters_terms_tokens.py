"""Centroids, divergences and byte-level BPE against brute force, and on nulls, empty tables, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableops.llm import bpe, centroids, divergence

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Byte-level BPE


@pytest.fixture(scope="module")
def by_library():
    return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


TEXT = st.lists(st.sampled_from(["a", "l", "ll", "'", "'s", "n't", " ", "  ", "\n", "\t", "1", "22", "!", "é", "日本", "the ", " people", " ", "\U0001f600", "\x00", "x" * 9]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.text(max_size=12))
def test_ids_are_those_of_the_library(by_library, spelt, other):
    encoder = bpe.encoder(RANKS, PATTERN)
    for text in (spelt, other, spelt + other):
        assert encoder.encode(text) == by_library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), TEXT), max_size=4), TEXT)
def test_edits_and_appends_are_exact(text, edits, more):
    encoder = bpe.encoder(RANKS, PATTERN)
    edited = encoder.open(text)
    for place, size, new in edits:
        start = int(place * len(edited.text))
        end = min(len(edited.text), start + size)
        text = text[:start] + new + text[end:]
        edited.replace(start, end, new)
    edited.append(more)
    assert edited.text == text + more and edited.ids() == encoder.encode(text + more)
    assert edited.tables == encoder.open(edited.text).tables


def test_edits_compute_only_what_is_near():
    edited = bpe.encoder(RANKS, PATTERN).open("word " * 20_000 + "x" * 1_000)
    for place, new in ((len(edited.text), "y"), (50_000, "Q"), (0, "a ")):
        edited.computed = 0
        edited.replace(place, place, new)
        assert edited.computed < 20
    assert edited.ids() == bpe.encoder(RANKS, PATTERN).encode(edited.text)


def test_a_vocabulary_of_few_merges():
    """Against the merges themselves, on every string of three letters; a token that no merge reaches ends no prefix."""
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"bcb", b"cab", b"aab", b"ccc"])}
    table = bpe.PrefixTable(ranks)
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
        want = [ranks[p] for p in table.merge(data)]
        last = table.extend(table.extend([], data[: rng.randint(0, len(data))]), data)
        got, k = [], len(data)
        while k:
            got.append(last[k - 1])
            k -= len(table.bytes_of[last[k - 1]])
        assert got[::-1] == want


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 300_000 + "a", "x" * 200_000, " \n" * 100_000])
def test_very_long_pieces(text):
    data = bpe.encoder(RANKS, PATTERN).ids_bytes(text)
    assert bpe.decode_ids(data, RANKS) == text.encode()


def test_documents_are_encoded_and_decoded(spark, data, by_library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t "), (-3, " \n\t "), (None, "no id"), (-4, "long word " * 20_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    got = bpe.decode_documents(bpe.encode_documents(docs, RANKS, PATTERN), RANKS).collect()
    want = sorted((str(r.doc_id), by_library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0), RANKS, PATTERN), RANKS).count() == 0


# Centroids


def brute_clusters(vectors, k, rounds, salt="2:"):
    """[(id, cluster, distance)], centroids: whole numbers of Python throughout."""
    order = sorted((x for x in vectors if x[0] is not None), key=lambda x: (hashlib.sha256(f"{salt}{x[0]}".encode()).hexdigest(), x[1]))
    order += sorted((x for x in vectors if x[0] is None), key=lambda x: x[1])
    cs = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in vectors:
            of[near(v)[1]].append(v)
        cs = [[sum(x) // len(x) for x in zip(*of[j], strict=True)] if of[j] else c for j, c in enumerate(cs)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in vectors), cs


def make_vectors(n, d, seed, spread=3.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (6, d))
    return [(i, [float(np.float32(x)) for x in middle[i % 6] + rng.normal(0, 1, d)]) for i in range(n)]


def test_clusters_are_those_of_brute_force(spark):
    found = [(None, [0.5] * 4), (900, [0.5] * 4), (900, [0.5] * 4), (901, [0.5] * 4), (902, [1e30, -1e30, 0.0, 1.0]), *make_vectors(300, 4, 1)]
    left_out = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan")] * 4), (6, [1.0, float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(found + left_out, "vec_id long, embedding array<double>").repartition(5).withColumns({"cluster": F.lit("clash"), "key": F.lit(1), "vector": F.lit(2), "sums": F.lit(3), "size": F.lit(4)})
    whole = [(i, [max(-(2**27), min(2**27, math.floor(256 * x))) for x in v]) for i, v in found]
    for k, rounds in ((7, 5), (1, 2), (12, 0)):
        got = centroids.cluster_vectors(df, k, rounds, size=4)
        want, cs = brute_clusters(whole, k, rounds)
        assert sorted((repr(r.key), r.cluster, r.distance) for r in got.rows.collect()) == want
        assert got.centroids == cs and sum(got.sizes) == len(found)
    by_cluster = collections.Counter()
    for _, j, d in want:
        by_cluster[j] += d
    for r in centroids.with_inertia(got).collect():
        assert (r.cluster_inertia, r.inertia) == (by_cluster[r.cluster], sum(by_cluster.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(make_vectors(3, 4, 2), "vec_id long, embedding array<double>")
    got = centroids.cluster_vectors(df, 40, 5, size=4)
    assert len(got.centroids) == 3 and {r.distance for r in got.rows.collect()} == {0}
    none = centroids.with_inertia(centroids.cluster_vectors(df.limit(0), 40, 5, size=4))
    assert none.count() == 0 and "centroid_sha256" in none.columns


def test_bounds_spare_evaluations_and_lose_nothing():
    """Displacements that come back to where they began loosen a bound by nothing, which summed drifts would."""
    rng = np.random.default_rng(3)
    x = np.array([v for _, v in make_vectors(2000, 16, 4, 6.0)])
    x = np.floor(256 * x).astype(np.int64)
    history = [x[:20].copy()]
    cluster, low, since = np.zeros(len(x), np.int64), np.zeros((len(x), 20), np.float32), np.zeros((len(x), 20), np.uint8)
    spared = []
    for _ in range(7):
        best, found, evaluated = centroids.assign(x, history, cluster, low, since)
        every = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (found == every.min(1)).all()
        # Bounds hold for the centroids as they were when each was last evaluated.
        there = np.stack(history)[since, np.arange(20)[None, :]]
        assert (low <= np.sqrt(((x[:, None, :] - there) ** 2).sum(2))).all()
        spared.append(evaluated)
        cluster = best
        history.append(history[-1] + rng.integers(-40, 41, history[-1].shape) if len(history) % 3 else history[0].copy())
    assert spared[0] == x.shape[0] * 20 and max(spared[1:]) < 0.7 * spared[0]


# Divergence of sources


def brute_audit(docs, least_docs, top):
    shown = lambda x: "" if x is None else x
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", shown(text))]
        counts[shown(lang), shown(source)].update(terms)
        df[shown(lang)].update(set(terms))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        sources = [s for l, s in counts if l == lang]
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p = {s: share(of[s]) for s in sources}
        q = share({t: sum(of[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in sources if h != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return sorted(out, key=repr)


def test_divergences_are_those_of_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "gamma", "É", "é", "naïve", "x", "日本語", "delta"]
    docs = [(" ".join(rng.choices(words, weights=range(1, 10), k=rng.randint(0, 12))) + "1_z!", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(200)]
    docs += [(None, "en", "none"), ("", None, None), ("only here", "xx", "a"), ("only here", "xx", "b"), ("Alpha " * 30_000, "en", "a"), *[("same text", "en", "c")] * 3]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(7).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "total", "value", "item", "rank", "shard")})
    for least, top, shard_rows in ((10, 10, 10**6), (2, 3, 10), (1, 10, 3)):
        got = divergence.audit_sources(df, least, top, shard_rows=shard_rows)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert rows(got) == brute_audit(docs, least, top)
    assert divergence.audit_sources(df.limit(0)).count() == 0


def test_products_in_blocks_give_the_same(spark, monkeypatch):
    docs = [(f"w{chr(97 + i % 7)} w{chr(97 + i % 5)} w{chr(97 + i % 3)}x", "en", f"s{i % 11}") for i in range(150)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    counts = divergence.count_terms(df).where("term <> ''")
    kept, groups = counts.toPandas(), counts.groupBy("source").agg(F.sum("n").alias("total")).orderBy("source").toPandas()
    import pyarrow as pa

    table = pa.Table.from_pandas(kept, preserve_index=False)
    of_lang = pa.Table.from_pandas(groups.assign(terms=kept["term"].nunique(), lang_total=int(kept["n"].sum())), preserve_index=False)
    want = divergence._shard(table, of_lang, 10)
    for products in (1, 7, 50):
        monkeypatch.setattr(divergence, "PRODUCTS", products)
        assert divergence._shard(table, of_lang, 10) == want


def test_shares_are_exact_for_large_counts():
    for n, total, terms in ((0, 0, 1), (10**13, 3 * 10**13, 10**6), (7, 10**12, 3), (9 * 10**12 + 1, 9 * 10**12 + 1, 1)):
        assert divergence.shares(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
