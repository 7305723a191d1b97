"""Language-model scoring by masked pseudo-likelihood.

Every token is hidden in turn and predicted from both sides: the embeddings of the WINDOW words before and
after it go through one hidden layer to a distribution over word classes, and from the same layer to a
distribution over the words of the class. A document's score is the sum of the log-probabilities of its
tokens. Classes are runs of frequency rank. Words outside the vocabulary are one class, in which each has its share of
the class's corpus count; as context they share RARE_BUCKETS embeddings.

Word counts come from all documents. Texts are encoded once; the counts of the HEAD_COUNTS most frequent words go to every
task, those of others are joined to each document's counts of them. The network is trained in numpy on all
documents, each in one of the rounds, in which every partition trains from the same weights and Spark averages what they
end with, weighted by tokens.

Defined results: null text counts as empty; no tokens score 0 in total and null a token; repeated rows are scored
each for itself; without any words in the corpus nothing is trained and all totals are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import ddl, materialize

WINDOW, VOCABULARY, RARE_BUCKETS, CLASS_WORDS, WIDTH, HIDDEN = 2, 16_384, 64, 128, 16, 32
#: Words whose counts are sent to every task (some 100 bytes each); the others' are joined.
HEAD_COUNTS = 1 << 16
#: Rounds of averaging, step size, tokens of a minibatch; how much longer the steps of a class's weights may be, and those of embeddings are.
ROUNDS, STEP, MINIBATCH, LIFT, EMBED_LIFT = 4, 1.5, 4096, 32.0, 80.0
#: Tokens of a class that go into a minibatch together, where it would have fewer.
TOGETHER = 64
EDGE = 0  # the id beside the first and last word of a text
#: Distinct words that a task counts before it hands them on; tokens scored at a time; tokens whose exponentials are worked on at a time.
COUNTED_WORDS, _CHUNK, _BLOCK = 300_000, 32_768, 1024


def tokens_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens_of the texts of a column, in order, and the row of each; null counts as empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words, owner = parts.flatten().cast(pa.large_binary()), pc.list_parent_indices(parts).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty one
    return words.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and n over all documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = words_of(batch.column(0).slice(at, 256))[0].value_counts()
                seen.append(pa.table({"word": found.field(0).cast(pa.binary()), "n": found.field(1)}))
                rows += len(found)
                if rows > COUNTED_WORDS:
                    whole = pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
                    seen, rows = [whole], whole.num_rows
                    if rows > COUNTED_WORDS // 2:
                        yield from whole.to_batches()
                        seen, rows = [], 0
        if seen:
            yield from pa.concat_tables(seen).to_batches()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of the most frequent words, their classes, and shares: 1 is the most frequent word; rare words share ids by hash."""

    def __init__(self, words: list[tuple[bytes, int]], rare_tokens: int):
        """words: the most frequent, in order, with counts, VOCABULARY at most; rare_tokens: tokens of all others."""
        self.first_rare = 1 + len(words)
        self.n_ids = self.first_rare + RARE_BUCKETS
        self.rare_class = -(-len(words) // CLASS_WORDS)
        self.rare_tokens = rare_tokens
        counts = np.zeros(self.rare_class * CLASS_WORDS)
        counts[: len(words)] = [n for _, n in words]
        by_class = counts.reshape(-1, CLASS_WORDS)
        mass = np.append(by_class.sum(axis=1), rare_tokens)
        self.class_prior = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
        # Places that no word has get no probability.
        self.word_prior = np.where(by_class > 0, np.log(np.maximum(by_class, 1) / np.maximum(by_class.sum(axis=1, keepdims=True), 1)), -1e9).astype(np.float32)

    def rare_ids(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.first_rare + xxhash.xxh32_intdigest(w) % RARE_BUCKETS for w in words], dtype=np.uint16)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _sums(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows. Most ids stand a few times: those are added up place by place, the others by runs."""
    few = 4
    order = np.argsort(ids, kind="stable")
    first = _starts(ids.take(order))
    n = np.diff(first, append=len(ids))
    by = np.argsort((few + 1 - np.minimum(n, few + 1)).astype(np.uint8), kind="stable")  # the frequent first
    first, n = first.take(by), n.take(by)
    total = rows.take(order.take(first), axis=0)
    many = np.count_nonzero(n > few)
    for k in range(1, few):
        more = np.count_nonzero(n > k)
        total[many:more] += rows.take(order.take(first[many:more] + k), axis=0)
    if many:
        runs = np.cumsum(n[:many]) - n[:many]
        at = np.repeat(first[:many] - runs, n[:many])
        at += np.arange(len(at))
        total[:many] = np.add.reduceat(rows.take(order.take(at), axis=0), runs, axis=0)
    return ids.take(order.take(first)), total


class WindowNetwork:
    """Weights: embeddings, context to hidden, hidden to classes, hidden to words of each class; the first biases are corpus shares.

    classes and words hold a row for each class or word: its weights, its bias and a one. A hidden layer ends in a one and a zero, so
    that its product with such rows has the bias in it, and that of exponentials with them has their sum as its last column.
    """

    NAMES = ("embed", "w1", "b1", "classes", "words")

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        rows = lambda weights, bias: np.column_stack([weights, bias, np.ones(len(bias))]).astype(np.float32)
        n = vocabulary.rare_class
        self.vocabulary = vocabulary
        self.embed = (rng.standard_normal((vocabulary.n_ids, WIDTH)) * 0.1).astype(np.float32)
        self.w1, self.b1 = scale(2 * WINDOW * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.classes = rows((scale(HIDDEN, n + 1) * np.float32(0.1)).T, vocabulary.class_prior)
        self.words = rows(np.zeros((n * CLASS_WORDS, HIDDEN)), vocabulary.word_prior.ravel())
        self._kept = np.empty(0, np.float32)

    wc = property(lambda self: self.classes[:, :HIDDEN].T, doc="HIDDEN x classes")
    bc = property(lambda self: self.classes[:, HIDDEN])
    ww = property(lambda self: self.words[:, :HIDDEN].reshape(-1, CLASS_WORDS, HIDDEN).transpose(0, 2, 1), doc="classes x HIDDEN x CLASS_WORDS")
    bw = property(lambda self: self.words[:, HIDDEN].reshape(-1, CLASS_WORDS))

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed.take(context.ravel(), axis=0).reshape(len(context), -1)
        h = np.zeros((len(x), HIDDEN + 2), np.float32)
        z = x @ self.w1
        z += self.b1
        np.tanh(z, out=h[:, :HIDDEN])
        h[:, HIDDEN] = 1
        return x, h

    def _by_class(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, int, int]]]:
        """The order of tokens by id; contexts, classes and ranks (of those in the vocabulary) in it; where classes begin, and the words of each with its slice."""
        order = np.argsort(token, kind="stable")
        token = token.take(order)
        rank = token[: np.searchsorted(token, self.vocabulary.first_rare)].astype(np.int64) - 1
        of = np.full(len(token), self.vocabulary.rare_class)
        of[: len(rank)] = rank // CLASS_WORDS
        cuts = _starts(of)
        ends = [*cuts[1:].tolist(), len(of)]
        pieces = [(self.words[c * CLASS_WORDS : (c + 1) * CLASS_WORDS], a, b) for c, a, b in zip(of[cuts].tolist(), cuts.tolist(), ends, strict=False) if c != self.vocabulary.rare_class]
        return order, context.take(order, axis=0), of, rank, cuts, pieces

    @staticmethod
    def _log_sums(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log of the sum of exp(h @ rows.T) in each row; shifted by the row's maximum only where a sum would leave the range of floats."""
        z = h @ rows.T
        np.exp(z, out=z)
        sums = z @ np.ones(len(rows), np.float32)
        if sums.min() > 1e-20 and sums.max() < 1e20:
            return np.log(sums)
        z = h @ rows.T
        top = z.max(axis=1)
        return top + np.log(np.exp(z - top[:, None]).sum(axis=1))

    def log_probs(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probability of each token in its context; of a rare word that of one with a count of one."""
        order, context, of, rank, _, pieces = self._by_class(context, token)
        _, h = self._hidden(context)
        n = len(rank)
        found = np.einsum("ij,ij->i", h, self.classes.take(of, axis=0))
        found[:n] += np.einsum("ij,ij->i", h[:n], self.words.take(rank, axis=0))
        with np.errstate(over="ignore", invalid="ignore"):
            for rows, a, b in [(self.classes, 0, len(of)), *pieces]:
                for k in range(a, b, _BLOCK):
                    end = min(k + _BLOCK, b)
                    found[k:end] -= self._log_sums(h[k:end], rows)
        found[n:] -= np.log(max(self.vocabulary.rare_tokens, 1))
        out = np.empty_like(found)
        out[order] = found
        return out

    def _space(self, rows: int) -> np.ndarray:
        """Room for one class's exponentials of so many tokens; the same memory each time."""
        if self._kept.size < rows * CLASS_WORDS:
            self._kept = np.empty(rows * CLASS_WORDS, np.float32)
        return self._kept[: rows * CLASS_WORDS].reshape(rows, CLASS_WORDS)

    def train(self, context: np.ndarray, token: np.ndarray, step: float, shifted: bool = False) -> None:
        """One step along the gradient of the mean log-probability of the tokens; shifted: row maxima are taken off before exponentials.

        With e the exponentials and s their sum, a gradient is that of e / s less that of the token itself. Products with e are divided
        by s afterwards, which spares passes over e; those with the tokens themselves are sums over equal ones.
        """
        if not len(token):
            return
        _, context, of, rank, cuts, pieces = self._by_class(context, token)
        x, h = self._hidden(context)
        m, n, share = len(of), len(rank), np.float32(1 / len(of))
        g, gw, space = np.empty_like(h), np.empty_like(h[:n]), self._space(n)
        matmul, exp = np.matmul, np.exp
        d = np.zeros_like(self.classes)
        own = np.empty((min(m, _BLOCK), len(self.classes)), np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(0, m, _BLOCK):
                part, out = h[a : a + _BLOCK], g[a : a + _BLOCK]
                e = matmul(part, self.classes.T, out=own[: len(part)])
                if shifted:
                    e -= e.max(axis=1, keepdims=True)
                exp(e, out=e)
                matmul(e, self.classes, out=out)
                d += e.T @ (part * (share / out[:, -1:]))
            for rows, a, b in pieces:
                e = matmul(h[a:b], rows.T, out=space[a:b])
                if shifted:
                    e -= e.max(axis=1, keepdims=True)
                exp(e, out=e)
                matmul(e, rows, out=gw[a:b])
        if not shifted and not all(s.min(initial=1) > 1e-20 and s.max(initial=1) < 1e20 for s in (g[:, -1], gw[:, -1])):
            return self.train(context, token.take(np.argsort(token, kind="stable")), step, True)  # no weight has changed yet
        d[of[cuts], :-1] -= share * np.add.reduceat(h, cuts, axis=0)[:, :-1]
        dh = g * (share / g[:, -1:])
        dh -= self.classes.take(of, axis=0) * share
        scale = share / gw[:, -1:]
        dh[:n] += gw * scale
        dh[:n] -= self.words.take(rank, axis=0) * share
        # A class meets few of a batch's tokens: its own weights take longer steps.
        length = np.diff(cuts, append=m)
        longer = h[:n] * np.repeat(np.float32(step) * np.minimum(LIFT, m / length).astype(np.float32), length)[:n, None]
        met, ahead = _sums(longer, rank.astype(np.uint16))
        longer *= scale
        change = np.empty((CLASS_WORDS, HIDDEN + 2), np.float32)
        for rows, a, b in pieces:
            rows -= matmul(space[a:b].T, longer[a:b], out=change)
        self.words[met] += share * ahead
        self.classes -= np.float32(step) * d
        dh = dh[:, :HIDDEN] * (1 - np.square(h[:, :HIDDEN]))
        dx = (dh @ self.w1.T).reshape(-1, WIDTH)
        self.w1 -= step * (x.T @ dh)
        self.b1 -= step * dh.sum(axis=0)
        met, change = _sums(dx, context.ravel())
        self.embed[met] -= np.float32(EMBED_LIFT * step) * change

    def dealt(self, token: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A random order of all tokens, in which those of an infrequent class stand in runs of TOGETHER, so that a minibatch meets fewer classes."""
        order = rng.permutation(len(token))
        of = np.where(token < self.vocabulary.first_rare, (token - 1) // CLASS_WORDS, self.vocabulary.rare_class).astype(np.uint16)
        order = order.take(np.argsort(of.take(order), kind="stable"))
        first = _starts(of.take(order))
        n = np.diff(first, append=len(order))
        together = np.where(n * MINIBATCH < TOGETHER * len(order), TOGETHER, 1)
        begins = (np.arange(len(order)) - np.repeat(first, n)) % np.repeat(together, n) == 0
        place = rng.integers(0, 1 << 16, np.count_nonzero(begins), dtype=np.uint16)
        return order.take(np.argsort(place.take(np.cumsum(begins) - 1), kind="stable"))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids, token ids and text numbers of all tokens; edges part the texts."""
    edge = np.full(WINDOW, EDGE, np.uint16)
    flat = np.concatenate([edge, *(part for t in texts for part in (t, edge))])
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(lengths + WINDOW)[:-1]]) + WINDOW
    at = np.concatenate([np.arange(f, f + n) for f, n in zip(first, lengths, strict=True)]).astype(np.int64)
    context = np.stack([flat[at + k] for k in range(-WINDOW, WINDOW + 1) if k], axis=1)
    return context, flat[at], np.repeat(np.arange(len(texts)), lengths)


def _decoded(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in ids.to_pylist()]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Vocabulary, DataFrame]:
    """Rows (key, row, n_tokens, ids, lift, rare), the vocabulary, and the counts of all words.

    lift is the sum of log counts of a row's words outside the vocabulary but among the HEAD_COUNTS most frequent; rare has
    the other words and how often each stands there.
    """
    counts = materialize(count_words(docs, text), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD_COUNTS).toArrow()  # columns, not Row objects: the driver is small
    words, times = top["word"].to_pylist(), top["n"].to_pylist()
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    vocabulary = Vocabulary(list(zip(words, times, strict=True))[:VOCABULARY], tokens - sum(times[:VOCABULARY]))
    logs = np.log(np.maximum(times, 1.0))
    logs[:VOCABULARY] = 0
    head_ids = np.concatenate([np.arange(1, vocabulary.first_rare, dtype=np.uint16), vocabulary.rare_ids(words[VOCABULARY:])])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pa.array(words, pa.large_binary()), head_ids, logs))
    kept = docs.select(key, F.monotonically_increasing_id().alias("row"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, head, head_ids, logs = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, owner = words_of(part.column(2))
                place = pc.index_in(tokens, value_set=head).fill_null(-1).to_numpy()
                known, seldom = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                ids = np.empty(len(place), np.uint16)
                ids[known] = head_ids.take(place[known])
                lifts = np.bincount(owner[known], logs.take(place[known]), part.num_rows)
                others = tokens.take(pa.array(seldom)).dictionary_encode()
                number = others.indices.to_numpy().astype(np.int64)
                ids[seldom] = vocabulary.rare_ids(others.dictionary.to_pylist()).take(number)
                kinds = max(len(others.dictionary), 1)
                pairs, often = np.unique(owner[seldom] * kinds + number, return_counts=True)
                cuts = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * kinds), pa.int32())
                rare = pa.StructArray.from_arrays([others.dictionary.take(pa.array(pairs % kinds)).cast(pa.binary()), pa.array(often, pa.int32())], names=["word", "times"])
                n = np.bincount(owner, minlength=part.num_rows)
                ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                coded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), coded, pa.array(lifts, pa.float64()), pa.ListArray.from_arrays(cuts, rare)], names=[key, "row", "n_tokens", "ids", "lift", "rare"])

    schema = ddl(kept.select(key, "row"), "n_tokens long", "ids binary", "lift double", "rare array<struct<word:binary,times:int>>")
    return materialize(kept.mapInArrow(run, schema), "encoded"), vocabulary, counts


def in_round(key: str, r: int, rounds: int):
    """Whether a row is trained on in round r: each row in one of them, by the hash of its id."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(rounds)) == r


def train_network(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", rounds: int = ROUNDS, epochs: int = 1) -> WindowNetwork:
    """The network after `epochs` over all documents, `rounds` of local training and averaging each; the driver gets one set of weights a round."""
    spark = encoded.sparkSession
    network = WindowNetwork(vocabulary)
    blocks = 64

    for r in range(rounds * epochs):
        shared = spark.sparkContext.broadcast((vocabulary, network.flat()))
        step = STEP / (1 + r / epochs)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            words, start = shared.value
            own, n, rng = WindowNetwork(words), 0, np.random.default_rng(5)
            own.load(start)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    context, token, _ = _windows(_decoded(batch.column(0).slice(at, 256)))
                    order = own.dealt(token, rng)
                    for k in range(0, len(order), MINIBATCH):
                        part = order[k : k + MINIBATCH]
                        own.train(context.take(part, axis=0), token.take(part), step * min(1.0, len(part) / MINIBATCH))
                    n += len(token)
            if n:
                parts = np.array_split(own.flat(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([float(n)] * blocks), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "n", "weights"])

        def average(table: pa.Table) -> pa.Table:
            total, n = 0.0, 0.0
            for w, raw in zip(table["n"].to_pylist(), table["weights"].to_pylist(), strict=True):
                total, n = total + w * np.frombuffer(raw, np.float32).astype(float), n + w
            return pa.table({"block": table["block"][:1], "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

        # Each block gathers one slice of weights from each task, never whole networks.
        rows = encoded.where(in_round(key, r % rounds, rounds)).select("ids").mapInArrow(learn, "block int, n double, weights binary").groupBy("block").applyInArrow(average, "block int, weights binary").collect()
        if rows:
            network.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))
    return network


def score_with(encoded: DataFrame, counts: DataFrame, network: WindowNetwork, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, log_prob and log_prob_per_token of every encoded row."""
    shared = encoded.sparkSession.sparkContext.broadcast(network)  # of fixed size: VOCABULARY words
    kept = encoded.select(key, "row", "n_tokens", "lift", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                context, token, owner = _windows(_decoded(part.column(4)))
                total = part.column(3).to_numpy(zero_copy_only=False).copy()
                for k in range(0, len(token), _CHUNK):
                    total += np.bincount(owner[k : k + _CHUNK], net.log_probs(context[k : k + _CHUNK], token[k : k + _CHUNK]), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(total)], names=[key, "row", "n_tokens", "log_prob"])

    scored = kept.mapInArrow(run, ddl(kept.select(key, "row", "n_tokens"), "log_prob double"))
    # A rare word's share is n of the rare class's tokens; the network's pass counted 1 of them.
    lifts = encoded.select("row", F.inline("rare")).join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    whole = scored.join(lifts, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return whole.select(key, "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("log_prob_per_token"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **training) -> DataFrame:
    """key, n_tokens, log_prob (sum over tokens) and log_prob_per_token of every row of docs."""
    encoded, vocabulary, counts = encode_documents(docs, key, text)
    return score_with(encoded, counts, train_network(encoded, vocabulary, key, **training), key)
