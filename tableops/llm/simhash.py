"""SimHash near-dedup with vantage-point trees over 64-bit fingerprints.

A tree over vantage points deals the distinct fingerprints to shards by Hamming distance. A fingerprint is a
member of one shard, and a guest of every shard that its ball of the search radius reaches by the triangle
inequality, so each pair within the radius meets in the shard of one of the two. Inside a shard the same
splitting goes on until blocks are small enough to compare directly. A shard returns a spanning forest of
its links, never all pairs; components over shards come from star contraction in Spark.

Defined results: null text counts as empty; no words give fingerprint zero, linked like any other; repeated
rows share their component; rows with a null doc_id take part, and never name a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import ROW_HASH, attach, ddl, discard, frugal, matching, materialize, signed, small_batches, text_bytes, with_row_hash

SEED = 42
#: Members of a shard aimed at, fingerprints compared directly, and rows the splitting thresholds are taken from.
#: The tree is exact whatever its thresholds are: the sample only balances the shards.
SHARD_MEMBERS, BLOCK, INDEX_SAMPLE = 16384, 1024, 65536

#: For each byte value its eight bits, one in each byte of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of the word shingles of a lower-cased text, repeats included; fewer words: the whole sequence."""
    w = text.lower().split()
    if len(w) <= words:
        shingles = [b" ".join(w)] if w else []
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in shingles]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bit i is set where over half of the run have it."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # Sums of at most 255 hashes fit the bytes of a word.
    chunks = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    inner = np.arange(chunks.sum()) - np.repeat(first, chunks)
    cuts = np.repeat(starts, chunks) + inner * 255
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(full), 64), dtype=bool)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        bits[:, 8 * k : 8 * k + 8] = 2 * counts > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """key, row hash and fp (a signed long with the 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for t in text_bytes(batch.column(2)):
                h = np.array(shingle_hashes(t, words), dtype=np.uint64)
                sizes.append(len(h))
                hashes.append(h)
            fp = majority_bits(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(sizes, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(fp))], names=[key, ROW_HASH, "fp"])

    kept = with_row_hash(docs.select(key, text), text).select(key, ROW_HASH, text)
    return kept.mapInArrow(run, ddl(kept.select(key, ROW_HASH), "fp long"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(sample: np.ndarray, rng: np.random.Generator, radius: int = 2) -> tuple[np.ndarray, int] | None:
    """Vantage point and threshold that cut the sample near its middle with the fewest rows at the cut; None if nothing cuts."""
    best = None
    for vp in sample[rng.integers(0, len(sample), 8)]:
        d = distance(sample, vp)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            inside = (d <= m).mean()
            if 0.1 <= inside <= 0.9:
                cost = (np.abs(d - m) <= radius).mean() + abs(inside - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, vp, m)
    return best and (best[1], best[2])


def build_tree(sample: np.ndarray, depth: int, seed: int = 7) -> tuple:
    """Nested (vantage point, threshold, inside, outside); leaves are shard numbers."""
    rng, leaves = np.random.default_rng(seed), iter(range(1 << 30))

    def grow(part: np.ndarray, left: int):
        cut = _split(part, rng) if left and len(part) >= 32 else None
        if cut is None:
            return next(leaves)
        d = distance(part, cut[0])
        return (cut[0], cut[1], grow(part[d <= cut[1]], left - 1), grow(part[d > cut[1]], left - 1))

    return grow(sample, depth)


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, members, guests) as index arrays into fps."""

    def down(node, members: np.ndarray, guests: np.ndarray):
        if not len(members) and not len(guests):
            return
        if isinstance(node, int):
            yield node, members, guests
            return
        vp, mu, inside, outside = node
        dm, dg = distance(fps[members], vp), distance(fps[guests], vp)
        # A pair across the cut is found inside, where its outer half is a guest.
        yield from down(inside, members[dm <= mu], np.concatenate([guests[dg <= mu + radius], members[(dm > mu) & (dm <= mu + radius)]]))
        yield from down(outside, members[dm > mu], guests[dg > mu - radius])

    yield from down(tree, np.arange(len(fps)), np.zeros(0, dtype=np.int64))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of the pairs (a, b); parent is flat before and after."""
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        if not len(a):
            return
        # Each class is hung below the least that it meets.
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def link_shard(fps: np.ndarray, members: np.ndarray, guests: np.ndarray, radius: int, seed: int = 7) -> np.ndarray:
    """parent[i] for fps: the classes of all links between members, and of members and guests."""
    parent, rng = np.arange(len(fps)), np.random.default_rng(seed)

    def direct(m: np.ndarray, g: np.ndarray) -> None:
        both = np.concatenate([m, g])
        for i in range(0, len(m), 256):
            for j in range(i, len(both), 8192):
                x, y = np.nonzero(np.bitwise_count(fps[m[i : i + 256], None] ^ fps[both[None, j : j + 8192]]) <= radius)
                x, y = m[i + x], both[j + y]
                apart = x != y
                _union(parent, x[apart], y[apart])

    todo = [(members, guests)]
    while todo:
        m, g = todo.pop()
        cut = _split(fps[m[rng.integers(0, len(m), 2048)]], rng, radius) if len(m) > BLOCK else None
        if cut is None:
            direct(m, g)
            continue
        vp, mu = cut
        dm, dg = distance(fps[m], vp), distance(fps[g], vp)
        todo.append((m[dm <= mu], np.concatenate([g[dg <= mu + radius], m[(dm > mu) & (dm <= mu + radius)]])))
        todo.append((m[dm > mu], g[dg > mu - radius]))
    return parent


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of column fp that differ in at most radius bits."""
    n = distinct.count()
    share = min(1.0, INDEX_SAMPLE / max(n, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(np.sort(picked), max(0, int(np.ceil(np.log2(max(1, n / SHARD_MEMBERS))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, members, guests in route(tree, fps, radius):
                who = np.concatenate([members, guests])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), shard, np.int32)), pa.array(signed(fps[who])), pa.array(np.arange(len(who)) < len(members))], names=["shard", "fp", "member"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        member = table.column("member").to_numpy()
        order = np.lexsort((fps, ~member))
        fps, n_members = fps[order], int(member.sum())
        parent = link_shard(fps, np.arange(n_members), np.arange(n_members, len(fps)), radius)
        low = np.flatnonzero(parent != np.arange(len(fps)))
        return pa.table({"a": signed(fps[parent[low]]), "b": signed(fps[low])})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, member boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (its component's smallest node) for every node of links (a, b), by alternating star contraction."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, materialize(small, "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """key, row hash, fp and component_id (the smallest key of its group) of every row of docs."""
    rows = materialize(fingerprints(docs, key, text, words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
    comps = connected_components(fingerprint_links(distinct, radius))
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp")
    named = named.join(named.groupBy("comp").agg(F.min("first_id").alias("group_id")), "comp").select("fp", "group_id")
    same = distinct.where("n > 1").select("fp", F.col("first_id").alias("same_id"))
    groups = named.join(same, "fp", "full").select("fp", F.coalesce("group_id", "same_id").alias("component_id"))
    return attach(rows, groups, ["fp"], [key, ROW_HASH]).select(key, ROW_HASH, "fp", F.coalesce("component_id", key).alias("component_id"))


#: Near duplicates by similarity: words of a shingle, words of a fingerprint, min-hashes, search radius in bits.
SHINGLE_WORDS, FINGERPRINT_WORDS, MIN_HASHES, RADIUS, SIMILARITY = 5, 4, 8, 64, 0.8
#: Rows, and hashes in their shingle sets, that are compared in one task; larger shards are dealt as pairs of blocks.
SHARD_ROWS, SHARD_HASHES = 2048, 2 << 20
#: Sets of at most so many shingles are compared whatever their fingerprints: few shingles make those differ in many bits.
SMALL_SET = 40
#: Odd multipliers that make further hashes of a shingle from its first.
_MULTIPLIERS = np.array([2 * int.from_bytes(xxhash.xxh64_digest(bytes([k]), 1)) % (1 << 64) | 1 for k in range(16)], dtype=np.uint64)
_FP = [f"f{k}" for k in range(FINGERPRINT_WORDS)]


def _remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each shingle hash."""
    x = hashes * _MULTIPLIERS[k]
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIERS[15 - k]
    return x ^ (x >> np.uint64(29))


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """key, row hash, node, size, fingerprint (f0, f1, ...), min-hashes of every row with words.

    A node is a shingle set, named by its hash: rows of equal sets are one node. small is the set where it has at
    most SMALL_SET shingles, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(t, words) for t in text_bytes(batch.column(2))]
            sizes = np.array([len(h) for h in found], dtype=np.int64)
            full = np.flatnonzero(sizes)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
            mins = [np.minimum.reduceat(_remixed(flat, 4 + k), starts) if len(full) else np.zeros(0, np.uint64) for k in range(MIN_HASHES)]
            rows = batch.take(pa.array(full))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array([xxhash.xxh64_intdigest(found[k].tobytes()) - (1 << 63) for k in full], pa.int64()),
                    pa.array(sizes[full]),
                    *(pa.array(signed(majority_bits(_remixed(flat, k), sizes[full]))) for k in range(FINGERPRINT_WORDS)),
                    pa.array(list(signed(np.stack(mins, axis=1))) if len(full) else [], pa.list_(pa.int64())),
                    pa.array([signed(found[k]) if sizes[k] <= SMALL_SET else None for k in full], pa.list_(pa.int64())),
                ],
                names=[key, ROW_HASH, "node", "size", *_FP, "mins", "small"],
            )

    kept = with_row_hash(docs.select(key, text), text).select(key, ROW_HASH, text)
    return kept.mapInArrow(frugal(run), ddl(kept.select(key, ROW_HASH), "node long", "size long", *(f"{f} long" for f in _FP), "mins array<long>", "small array<long>"))


def _rarest(nodes: DataFrame, similarity: float) -> DataFrame:
    """node and shard, for each of the rarest shingles of a small set of which any similar set shares one.

    Of n shingles these are the n - ceil(similarity n) + 1 that the fewest small sets have, without those of this set alone.
    """
    each = nodes.where("small is not null").select("node", F.explode("small").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ranked = attach(each, often, ["shingle"], ["node"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle"))).alias("ranked"))
    least = F.ceil(F.size("ranked") * similarity - 1e-9)
    prefix = F.filter(F.slice("ranked", 1, (F.size("ranked") - least + 1).cast("int")), lambda x: x["n"] > 1)
    return ranked.select("node", F.explode(F.transform(prefix, lambda x: F.xxhash64(F.lit(-1), x["shingle"]))).alias("shard"))


def deal_nodes(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, size and shard, once for each shard that a node is in.

    Two sets of similarity s share a given min-hash with probability s; a shard is made by a pair of min-hashes, so that a
    passage in very many texts does not make one shard of all. Small sets are in the shards of their rarest shingles too.
    """
    pairs = [(i, j) for i in range(MIN_HASHES) for j in range(i)]
    shards = F.array(*(F.xxhash64(F.lit(i), F.lit(j), F.col("mins")[i], F.col("mins")[j]) for i, j in pairs))
    by_sketch = nodes.select("node", "size", F.explode(shards).alias("shard"))
    return by_sketch.unionByName(_rarest(nodes, similarity).join(nodes.select("node", "size"), "node"))


def _near(a: str, b: str):
    """Whether the fingerprints of two sides (columns with these endings) are near, or both sets are small."""
    bits = sum((F.bit_count(F.col(f + a).bitwiseXOR(F.col(f + b))) for f in _FP), F.lit(0))
    return (bits <= RADIUS) | ((F.col("size" + a) <= SMALL_SET) & (F.col("size" + b) <= SMALL_SET))


def vantage_links(dealt: DataFrame, shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes to the vantage points of their shards where those are near: at most one a node and shard."""
    sides = lambda end: nodes.select(F.col("node").alias("node" + end), F.col("size").alias("size" + end), *(F.col(f).alias(f + end) for f in _FP))
    pairs = dealt.select("node", "shard").join(shards.select("shard", "vantage"), "shard").where("node <> vantage").select("node", "vantage").distinct()
    both = pairs.join(sides("_a").withColumnRenamed("node_a", "node"), "node").join(sides("_b").withColumnRenamed("node_b", "vantage"), "vantage")
    return both.where(_near("_a", "_b")).select(F.col("node").alias("a"), F.col("vantage").alias("b"))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by some columns, as tables of whole groups with the groups' first rows; one group is held at most."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([table[c].to_numpy() for c in by], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield table.slice(0, last).combine_chunks(), np.concatenate([[0], cuts])
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


_BLOCK_KEY = ["shard", "own", "other"]


def contested_blocks(dealt: DataFrame, shards: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the shards of three nodes or more in which two components meet, as blocks to be searched.

    A shard within SHARD_ROWS and SHARD_HASHES is one block. Of a larger one the rows outside its main component are
    dealt to parts, and so are those of the main component; each part of the former meets each part of either.
    """
    rows = dealt.join(shards.where("n > 2").select("shard"), "shard").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = rows.groupBy("shard", "comp").agg(F.count("*").alias("rows"), F.sum("size").alias("hashes"))
    whole = by_comp.groupBy("shard").agg(F.count("*").alias("comps"), F.max_by("comp", "rows").alias("main"), F.sum("rows").alias("all_rows"), F.sum("hashes").alias("all_hashes"), F.max("rows").alias("main_rows"), F.max_by("hashes", "rows").alias("main_hashes")).where("comps > 1")
    parts = lambda n, h: F.ceil(F.greatest(n / F.lit(SHARD_ROWS), h / F.lit(SHARD_HASHES), F.lit(1e-9))).cast("int")
    large = (F.col("all_rows") > SHARD_ROWS) | (F.col("all_hashes") > SHARD_HASHES)
    # Blocks of main parts are numbered from 1 on, those of parts outside from -1 down; block (0, 0) is a whole shard.
    plan = whole.select("shard", "main", large.alias("large"), parts(F.col("main_rows"), F.col("main_hashes")).alias("mains"), parts(F.col("all_rows") - F.col("main_rows"), F.col("all_hashes") - F.col("main_hashes")).alias("outs"))
    met = rows.join(plan, "shard")
    spread = F.xxhash64("node", "shard")
    out = -1 - F.pmod(spread, F.col("outs")).cast("int")
    block = lambda own, other: F.struct(own.alias("own"), other.alias("other"))
    outside = F.concat(
        F.transform(F.sequence(F.lit(1), F.col("mains")), lambda m: block(m, out)),
        F.transform(F.sequence(-F.col("outs"), F.lit(-1)), lambda o: block(F.greatest(o, out), F.least(o, out))),
    )
    inside = F.transform(F.sequence(-F.col("outs"), F.lit(-1)), lambda o: block(1 + F.pmod(spread, F.col("mains")).cast("int"), o))
    blocks = F.when(~F.col("large"), F.array(block(F.lit(0), F.lit(0)))).when(F.col("comp") == F.col("main"), inside).otherwise(outside)
    return met.select("shard", "node", "size", "comp", F.inline(blocks)).join(nodes.select("node", *_FP), "node")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)


def cross_links(blocks: DataFrame) -> DataFrame:
    """Near pairs (a, b) of different components in each block; of a block with more than two a row, its nodes (b null)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(batches, _BLOCK_KEY):
            comp, node, small = (table["comp"].to_numpy(), table["node"].to_numpy(), table["size"].to_numpy() <= SMALL_SET)
            fps = np.stack([table[f].to_numpy().view(np.uint64) for f in _FP], axis=1)
            where, first, second = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                kinds, of, sizes = np.unique(comp[lo:hi], return_inverse=True, return_counts=True)
                if len(kinds) == 1:
                    continue
                # Every pair that crosses has an end outside the largest component.
                is_outside, most = of != sizes.argmax(), 2 * (hi - lo)
                outside = np.flatnonzero(is_outside)
                xs, ys, n, met = [], [], 0, np.zeros(hi - lo, dtype=bool)
                for part in np.array_split(outside, -(-len(outside) // 256)):
                    far = np.zeros((len(part), hi - lo), dtype=np.uint16)
                    for k in range(FINGERPRINT_WORDS):
                        np.add(far, np.bitwise_count(fps[lo + part, k][:, None] ^ fps[lo:hi, k][None, :]), out=far)
                    near = far <= RADIUS
                    if small[lo:hi].any():
                        near |= small[lo + part][:, None] & small[lo:hi][None, :]
                    near &= of[part][:, None] != of[None, :]
                    met[part] |= near.any(axis=1)
                    met |= near.any(axis=0)
                    # A pair of two rows outside is met from both.
                    near &= (part[:, None] > np.arange(hi - lo)[None, :]) | ~is_outside[None, :]
                    n += np.count_nonzero(near)
                    if n <= most:
                        x, y = np.nonzero(near)
                        xs.append(part[x])
                        ys.append(y)
                if n <= most:
                    x, y = np.concatenate(xs), np.concatenate(ys)
                    where.append(np.full(n, lo))
                    first.append(node[lo + x])
                    second.append(pa.array(node[lo + y]))
                else:
                    crowd = lo + np.flatnonzero(met)
                    where.append(np.full(len(crowd), lo))
                    first.append(node[crowd])
                    second.append(pa.nulls(len(crowd), pa.int64()))
            if where:
                at = pa.array(np.concatenate(where))
                yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(at) for c in _BLOCK_KEY), pa.array(np.concatenate(first)), pa.concat_arrays(second)], names=[*_BLOCK_KEY, "a", "b"])

    return _ordered(blocks).mapInArrow(frugal(search), "shard long, own int, other int, a long, b long")


def linked_sets(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of at least `similarity`, breadth first.

    Each set looks only for those that no other has reached, so a cluster of near copies costs about one look each.
    """
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = number.astype(np.int32)
    # A set can only be linked through elements that another one has, and must have so many of them.
    shared = often[number] > 1
    enough = np.bincount(of[shared], minlength=len(sets)) >= similarity * sizes - 1e-9
    of, number = of[shared & enough[of]], number[shared & enough[of]]
    holders = of[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number, minlength=len(often)))
    held = np.split(number, np.cumsum(np.bincount(of, minlength=len(sets)))[:-1])
    open_, links = np.ones(len(sets), dtype=bool), []
    for root in range(len(sets)):
        todo = [root] if open_[root] else []
        open_[root] = False
        while todo and open_.any():
            x = todo.pop()
            if not len(held[x]):
                continue
            common = np.bincount(np.concatenate([holders[a:b] for a, b in zip(ends[held[x] - 1] * (held[x] > 0), ends[held[x]], strict=True)]), minlength=len(sets))
            near = np.flatnonzero(open_ & (common >= similarity * (sizes + sizes[x] - common) - 1e-9)).tolist()
            open_[near] = False
            links += [(x, y) for y in near]
            todo += near
    return links


def block_links(crowded: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) among the nodes of each block: a spanning forest, so fewer than its nodes."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(batches, _BLOCK_KEY):
            node, lists = table["node"].to_numpy(), table["shingles"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = [(node[lo + x], node[lo + y]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x, y in linked_sets([flat[at[k] : at[k + 1]] for k in range(lo, hi)], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return _ordered(crowded.join(sets, "node")).mapInArrow(frugal(search), "a long, b long")


def merged_blocks(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Crowded blocks that share nodes as one, where that is within the limits of a block: copies crowd many shards together.

    Each node of such a group (of four times the rows at most) then travels once; blocks of larger groups stay as they are.
    """
    block = F.xxhash64(F.lit("block"), *_BLOCK_KEY)
    groups = connected_components(crowded.select(block.alias("a"), F.col("node").alias("b"))).withColumnRenamed("comp", "group")
    once = materialize(crowded.select("node").distinct().join(groups, "node").join(nodes.select("node", "size"), "node"), "crowds")
    fits = once.groupBy("group").agg(F.count("*").alias("rows"), F.sum("size").alias("hashes")).where((F.col("rows") <= 4 * SHARD_ROWS) & (F.col("hashes") <= SHARD_HASHES)).select("group")
    merged = once.join(fits, "group", "left_semi").select(F.col("group").alias("shard"), F.lit(0).alias("own"), F.lit(0).alias("other"), "node")
    large = once.join(fits, "group", "left_anti").select("node")
    return merged.unionByName(crowded.join(large, "node", "left_semi").select(*_BLOCK_KEY, "node"))


def shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, key: str, text: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """node and the set of word shingles of every wanted node, read from one row of each; other texts are not hashed again."""
    one = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(key, ROW_HASH)).alias("row")).select("node", F.col(f"row.{key}").alias(key), f"row.{ROW_HASH}")
    linked = matching(docs.select(key, text), one.select(key, ROW_HASH).distinct(), key, text, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(t, words) for t in text_bytes(batch.column(0))]
            nodes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([signed(s) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    # Rows repeated whole give a node twice.
    return linked.select(text).mapInArrow(frugal(run), "node long, shingles array<long>").dropDuplicates(["node"])


def verified_links(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) whose sets have a Jaccard similarity of at least `similarity`."""
    both = links.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row hash and component_id of the rows that are in a group of near duplicates with another row.

    Each shard has a vantage point, its least node; near nodes are linked to it, which joins most copies. A shard in which
    components are left apart is searched for near pairs across them: few pairs are verified as they are, and of many
    the sets are compared in their block, of which only a spanning forest leaves. So rows made grow with the input.
    """
    with small_batches(docs.sparkSession):
        return _similar_groups(docs, key, text)


def _similar_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = materialize(sketches(docs, key, text), "sketches")
    nodes = materialize(rows.drop(key, ROW_HASH).dropDuplicates(["node"]), "nodes")
    dealt = materialize(deal_nodes(nodes), "dealt")
    shards = materialize(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("node").alias("vantage")).where("n > 1"), "shards")
    tried = materialize(vantage_links(dealt, shards, nodes), "vantage-links")
    ends = lambda links: links.select(F.col("a").alias("node")).unionByName(links.where("b is not null").select(F.col("b").alias("node"))).distinct()
    sets = materialize(shingle_sets(docs, rows, ends(tried), key, text), "shingle-sets")
    good = materialize(verified_links(tried, sets), "verified")
    comps = connected_components(good)
    found = materialize(cross_links(contested_blocks(dealt, shards, nodes, comps)), "cross-links")
    if not found.isEmpty():
        fresh = ends(found).join(sets, "node", "left_anti")
        sets = sets.unionByName(materialize(shingle_sets(docs, rows, fresh, key, text), "shingle-sets"))
        pairs = found.where("b is not null").select("a", "b").distinct()
        crowded = merged_blocks(found.where("b is null").withColumnRenamed("a", "node").drop("b"), nodes)
        comps = connected_components(good.unionByName(materialize(verified_links(pairs, sets).unionByName(block_links(crowded, sets)), "verified")))
    named = rows.select(key, ROW_HASH, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = named.groupBy("comp").agg(F.min(key).alias("component_id"), F.count("*").alias("n")).where("n > 1")
    return named.join(groups, "comp").select(key, ROW_HASH, "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document, that of the smallest key, of each group linked by five-word shingles at SIMILARITY; all columns kept.

    Rows without words are in no group. Rows of that key in the group all stay: exact dedup is another operator.
    """
    groups = similar_groups(docs, key, text)
    lost = materialize(groups.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(key, ROW_HASH).distinct(), "near-copies")
    return matching(docs, lost, key, text, "left_anti")
