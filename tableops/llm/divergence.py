"""Source divergence audit: how far the sources of a language are apart in their use of words, by Gustavson row accumulation.

Terms are counted by (language, source, term), and those in enough documents of their language are kept. The counts are dealt
to shards by language and hash of the term, so that a shard has all sources' counts of its terms: a term-major index. In
it each source's row is multiplied out as Gustavson does it for sparse matrices: its terms are scattered through the
index into one dense accumulator over all sources of the language. What the accumulator begins with is the row against
each peer's share of a term that it doesn't have, the zero baseline, counted by distinct share; where the index says that a
peer does have the term, the baseline is taken back. No pair of postings ever becomes a row: a shard gives one
row for each source and peer, which Spark adds up. Terms over-represented in a source are ranked in the same pass,
since the shard also knows the language's count.

Defined results: null text, language and source count as ''; each row is a document, equal ones too; a source without
any kept term, or a language without one, has all its pairs (of value 0 where there are no terms at all); without rows there is no
result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.common import frugal, materialize, text_bytes, texts_of

#: A share is 1 + floor(PARTS * (count + 2) / (all counts + 2 * terms)).
PARTS, SPLIT = 1_000_000_000, 100_000
#: Rows of counts in a shard, on average, and products of a row held at a time.
SHARD_ROWS, PRODUCTS = 131_072, 1 << 20
#: Entries that a task counts before it hands them on.
ENTRIES = 400_000

_ENDS = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: Bytes that end a term become spaces and A-Z lower case; bytes from 0x80 on, of other characters, belong to terms.
_FOLD = bytes.maketrans(_ENDS + bytes(range(0x41, 0x5B)), b" " * len(_ENDS) + bytes(range(0x61, 0x7B)))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it), once each; a group's own row has the term ''."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (l, s), (n, d) in counts.items():
                terms = [b"", *n]
                column = pa.array(terms, pa.binary()).cast(pa.string())
                same = lambda v: pa.array([v] * len(terms), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(l), same(s), column, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], names=names)
            counts.clear()

        held = 0
        for batch in batches:
            for data, l, s in zip(text_bytes(batch.column(0)), texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True):
                n, d = counts.setdefault((l, s), (Counter(), Counter()))
                held -= len(n)
                terms = terms_of(data)
                n.update(terms)
                d.update(set(terms))
                held += len(n)
                if held > ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    columns = [F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate((text, lang, source))]
    found = docs.select(*columns).mapInArrow(frugal(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """Shares of counts n in whole parts, exactly: in two steps, whose products fit 64 bits for counts under 9 * 10**13."""
    below = np.asarray(total, np.int64) + 2 * terms
    whole, rest = np.divmod((np.asarray(n, np.int64) + 2) * SPLIT, below)
    return 1 + whole * (PARTS // SPLIT) + rest * (PARTS // SPLIT) // below


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)), which 64 bits hold."""
    return (p - q) ** 2 // (p + q)


def _shard(counts: pa.Table, groups: pa.Table, top: int) -> list[tuple]:
    """(source, part, item, value, common) of a shard of one language.

    value of a pair is what the source's own terms add to it, or to the peer's pair with it (part 'pair' both);
    common is the number of terms that both have, told on one of the two rows.
    """
    source_names = groups["source"].to_pylist()
    place = {s: k for k, s in enumerate(source_names)}
    total, terms, lang_total = groups["total"].to_numpy(), groups["terms"][0].as_py(), groups["lang_total"][0].as_py()
    base = shares(np.zeros(len(total), np.int64), total, terms)
    term_names, term = np.unique(np.array(counts["term"].to_pylist(), dtype=object), return_inverse=True)
    row = np.fromiter(map(place.__getitem__, counts["source"].to_pylist()), np.int64, counts.num_rows)
    n = counts["n"].to_numpy()
    p = shares(n, total[row], terms)
    in_all = np.zeros(len(term_names), np.int64)
    np.add.at(in_all, term, n)
    q = shares(in_all, lang_total, terms)
    # The term-major index: postings of term t are order[starts[t] : starts[t + 1]].
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(term_names) + 1))
    peers_of, shares_of = row[order], p[order]
    out: list[tuple] = []
    for g in np.unique(row):
        own = np.flatnonzero(row == g)
        # What every peer adds if it has none of the terms; then the index corrects those it has.
        values, times = np.unique(p[own], return_counts=True)
        lacking = np.zeros(len(base), np.int64)
        for at in range(0, len(values), max(1, PRODUCTS // len(base))):
            part = slice(at, at + max(1, PRODUCTS // len(base)))
            lacking += (gap(values[part, None], base[None, :]) * times[part, None]).sum(0)
        shared, common = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
        lengths = starts[term[own] + 1] - starts[term[own]]
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(PRODUCTS, lengths.sum() + PRODUCTS, PRODUCTS), side="left") + 1
        for mine in np.split(np.arange(len(own)), np.unique(cuts[cuts < len(own)])):
            size = lengths[mine]
            at = np.repeat(starts[term[own[mine]]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            peer, theirs, ours = peers_of[at], shares_of[at], np.repeat(p[own[mine]], size)
            np.add.at(shared, peer, gap(ours, theirs))
            np.add.at(lacking, peer, -gap(ours, base[peer]))
            np.add.at(common, peer, 1)
        for h in range(len(base)):
            if h != g:
                out.append((source_names[g], "pair", source_names[h], int(shared[h] + lacking[h]), int(common[h])))
                out.append((source_names[h], "pair", source_names[g], int(lacking[h]), 0))
        more = own[p[own] > q[term[own]]]
        value = gap(p[more], q[term[more]])
        # The first `top` by value, then by UTF-8: code points order strings as their bytes do.
        best = more[np.lexsort((term[more], -value))[:top]]
        out += [(source_names[g], "term", term_names[term[k]], int(gap(p[k], q[term[k]])), 0) for k in best]
    return out


def audit_sources(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value and rank: each source's peers by divergence (part 'pair'), and its `top` own terms (part 'term')."""
    counted = materialize(count_terms(docs, text, lang, source), "terms")
    of_term = Window.partitionBy("lang", "term")
    kept = materialize(counted.where("term <> ''").withColumn("docs", F.sum("docs").over(of_term)).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counted.where("term = ''").select("lang", "source").join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = materialize(groups.select("lang", "source", zero("total"), zero("own"), zero("lang_total"), zero("terms")), "groups")
    shards = max(1, -(-kept.count() // shard_rows))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    every = groups.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(counts: pa.Table, of_lang: pa.Table) -> pa.Table:
        rows = _shard(counts, of_lang, top) if counts.num_rows else []
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table([pa.array([of_lang["lang"][0].as_py()] * len(rows), pa.string()), *made], names=["lang", "source", "part", "item", "value", "common"])

    added = dealt.groupBy("lang", "shard").cogroup(every.groupBy("lang", "shard")).applyInArrow(run, "lang string, source string, part string, item string, value long, common long")
    added = materialize(added, "accumulated")
    sums = added.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("common").alias("common"))
    # Every pair of sources of a language is a row of the result; terms that neither has are added here.
    a = groups.select("lang", "source", F.col("own").alias("a_own"), F.col("total").alias("a_total"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("b_own"), F.col("total").alias("b_total"))
    pairs = a.join(b, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    share = lambda total: F.expr(f"1 + CAST({2 * PARTS} AS BIGINT) div ({total} + 2 * terms)")
    neither = F.col("terms") - F.col("a_own") - F.col("b_own") + F.coalesce("common", F.lit(0))
    pairs = pairs.withColumns({"a_base": F.when(F.col("terms") > 0, share("a_total")), "b_base": F.when(F.col("terms") > 0, share("b_total"))})
    pairs = pairs.withColumn("gap", F.expr("(a_base - b_base) * (a_base - b_base) div (a_base + b_base)"))
    value = F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + F.col("gap") * neither).otherwise(F.lit(0)).cast("long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank)
    own = added.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.unionByName(own)
