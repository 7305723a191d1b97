"""Best-fit packing of tokenised documents by a configuration linear program.

A document is its token ids and an end id; one longer than a sequence is cut into full pieces, of which
the first may be shorter. What is packed are lengths: the histogram (one count for each length, so of fixed
size) goes to the driver. A configuration is a multiset of lengths that fits a sequence. The linear program
over configurations is solved by multiplicative weights: every length has a price, a knapsack dynamic program
finds the configurations of best price, their use is raised, and prices of covered lengths fall. The solution is
rounded down, what is left is priced again in the next pass, and the last pieces are placed best-fit decreasing. This is
tried with all lengths in the program, and with the shortest left to fill gaps, after each number of passes; the plan of
fewest sequences stays. Pieces then take the slots of their length by rank, in parallel.

Defined results: null text counts as empty, and an empty document is one piece with the end id alone; equal
pieces (repeated rows too) are packed each for itself; no documents give no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableops.llm.common import frugal, materialize, texts_of

CAPACITY, END_ID = 2048, 0
#: Rounds of pricing, passes of pricing and rounding, and the least lengths that the program places, one try each: shorter pieces fill gaps.
ROUNDS, PASSES, LEAST = 60, 3, (256, 1, 64)
#: Rows of one length that are ranked together.
RANKED_ROWS = 50_000


#: How a byte-level BPE of this kind parts a text before merging: a fixed value of its format.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _is_byte_level(model: dict) -> bool:
    """Whether a tokenizer file merges plain bytes of the parts that PARTS makes, and nothing else comes before or between."""
    parts, merging = model.get("pre_tokenizer") or {}, model["model"]
    plain = parts.get("type") == "ByteLevel" and not parts.get("add_prefix_space") and parts.get("use_regex", True)
    merged = merging.get("type") == "BPE" and not any(merging.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(plain and merged and not model.get("normalizer"))


def _encoding(model: dict) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE file, run by tiktoken: the same ids at several times the speed.

    Tokens in the file spell bytes as printable characters: those that are printable stand for
    themselves, the rest for 256, 257, ... in order. Ids of such a file are also its merge ranks.
    A special token spelt out in a text is that token, as it is for the file's own tokenizer.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(spelt[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def token_ids(path: str) -> Callable[[str], list[int]]:
    """text -> its ids by the tokenizer file at path.

    Files that PARTS doesn't stand for, and texts whose white space is too long for tiktoken's split, go to the
    tokenizers library itself.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
    by_file = lambda text: whole().encode(text, add_special_tokens=False).ids
    if not _is_byte_level(model):
        return by_file
    encode = partial(_encoding(model).encode, allowed_special="all")

    def ids(text: str) -> list[int]:
        try:
            return encode(text)
        except ValueError:  # its backtracking has run out of stack
            return by_file(text)

    return ids


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids (array of int) of every piece of docs."""
    end = array("I", [END_ID]).tobytes()
    kept = docs.select(key, text)
    fields = f"`{key}` {dict(kept.dtypes)[key]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
                for k, text_ in enumerate(texts_of(part.column(1))):
                    data = array("I", encode(text_)).tobytes() + end
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(k)
                        pieces.append(piece)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(data[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(np.frombuffer(data[4 * a : 4 * b], dtype="<i4"))
                columns = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return kept.mapInArrow(frugal(run), fields)


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price of a configuration of each total length up to capacity, and the length it takes (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = price[c:0:-1] + best[:c]  # of lengths c, c - 1, ...: among equals the longest, which keeps small pieces
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], take[c] = value[k], c - k
        else:
            best[c] = best[c - 1]
    return best, take


def solve_configurations(counts: np.ndarray, rounds: int = ROUNDS, eps: float = 0.1) -> dict[tuple[int, ...], float]:
    """Fractional uses of configurations that cover counts[length], by multiplicative weights."""
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = lengths / capacity
    cover = np.zeros(capacity + 1)
    use: dict[tuple[int, ...], float] = defaultdict(float)
    for t in range(1, rounds + 1):
        best, take = _knapsack(price, capacity)
        enough = (1 - eps) * best[capacity]
        # One pass raises every length to the level t, the longest first: each by the best configuration through it.
        for first in lengths[::-1]:
            if cover[first] >= t * counts[first] or price[first] + best[capacity - first] < enough:
                continue
            parts, c = [int(first)], capacity - int(first)
            while c > 0:
                if take[c]:
                    parts.append(int(take[c]))
                    c -= int(take[c])
                else:
                    c -= 1
            need = Counter(parts)
            short = [(t * counts[x] - cover[x]) / a for x, a in need.items()]
            step = max(short[0] if len(short) == 1 else min(s for s in short if s > 0) if max(short) > 0 else 0, counts[first] * 1e-3)
            use[tuple(sorted(parts, reverse=True))] += step
            for x, a in need.items():
                cover[x] += a * step
        behind = cover[lengths] / counts[lengths] - t
        price[lengths] *= np.exp(-eps * np.clip(behind, -5, 5))
        price[lengths] /= max(1e-12, (price[lengths] * counts[lengths]).sum() / (lengths * counts[lengths]).sum() * capacity)
    lowest = (cover[lengths] / counts[lengths]).min() if len(lengths) else 1
    return {c: u / max(lowest, 1e-9) for c, u in use.items()}


def plan_sequences(counts: np.ndarray, rounds: int = ROUNDS, passes: int = PASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences with just these lengths), using every counted piece once. counts[0] is 0.

    Never more sequences than best-fit decreasing makes, which is among the tries; the search ends at the lower bound.
    """
    capacity = len(counts) - 1
    bound = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    best = _best_fit(counts)
    for least in LEAST:
        left, plan = counts.astype(np.int64).copy(), Counter()
        if left[capacity]:
            plan[(capacity,)] += int(left[capacity])
            left[capacity] = 0
        for _ in range(passes):
            large = np.where(np.arange(capacity + 1) < least, 0, left)
            if sum(best.values()) <= bound or not large.any():
                break
            solution = solve_configurations(large, rounds)
            placed = 0
            # Rounded down, and only what is full: the rest keeps its small pieces for the gaps of its large ones.
            for parts, used in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
                if sum(parts) < capacity:
                    continue
                need = Counter(parts)
                times = min(int(used), *(int(left[x]) // a for x, a in need.items()))
                if times:
                    plan[parts] += times
                    placed += times
                    for x, a in need.items():
                        left[x] -= a * times
            whole = plan + _best_fit(left)
            if sum(whole.values()) < sum(best.values()):
                best = whole
            if not placed:
                break
    return sorted(best.items(), reverse=True)


def _best_fit(counts: np.ndarray) -> Counter:
    """Best-fit decreasing over a histogram: equal sequences are placed together."""
    capacity = len(counts) - 1
    opened: dict[int, Counter] = defaultdict(Counter)  # by room: contents -> how many
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if opened.get(r)), None)
            if room is None:
                # As many of this length to a new sequence as fit.
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    opened[capacity - each * length][(length,) * each] += full
                if rest:
                    opened[capacity - rest * length][(length,) * rest] += 1
                break
            parts, there = opened[room].popitem()
            each = min(room // length, n)
            placed = min(there, n // each)
            if placed < there:
                opened[room][parts] += there - placed
            opened[room - each * length][parts + (length,) * each] += placed
            n -= placed * each
    done: Counter = Counter()
    for held in opened.values():
        for parts, n in held.items():
            done[tuple(sorted(parts, reverse=True))] += n
    return done


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, runs of slots by rank: first rank, sequences in the run, first sequence, offset."""
    rows, base, taken = [], 0, Counter()
    for parts, times in plan:
        offset = 0
        for length in parts:
            rows.append((length, taken[length], base, offset))
            taken[length] += times
            offset += length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset"]).sort_values(["length", "first"])


def place_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. The histogram of lengths is all that reaches the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs = _slots(plan_sequences(counts))
    # Ranks within a length: inside blocks of it, after the blocks before. A frequent length has as many blocks as its rows need.
    blocks = pieces.sparkSession.createDataFrame([(k, int(n // ranked_rows) + 1) for k, n in enumerate(counts.tolist()) if n], "length long, __blocks long")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("__block", F.pmod(F.xxhash64(key, "piece"), F.col("__blocks"))).drop("__blocks")  # a row for each length
    by_block = materialize(dealt.groupBy("length", "__block").agg(F.count("*").alias("n")), "lengths")
    before = by_block.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__block")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "__block").orderBy(key, "piece")) - 1
    ranked = dealt.withColumn("__rank", rank).join(before, ["length", "__block"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).select(*pieces.columns, "__rank")
    lengths, firsts, bases, offsets = (runs[c].to_numpy(np.int64) for c in ("length", "first", "base", "offset"))
    width = int(counts.max()) + 1 if len(runs) else 1
    starts = lengths * width + firsts
    # The runs follow the number of lengths and of configurations of the program, not that of the pieces.
    found = pieces.sparkSession.sparkContext.broadcast((starts, firsts, bases, offsets))
    names = pieces.columns

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, firsts, bases, offsets = found.value
        for batch in batches:
            ranks = batch["__rank"].to_numpy(zero_copy_only=False)
            run = np.searchsorted(starts, batch["length"].to_numpy(zero_copy_only=False) * width + ranks, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(bases[run] + ranks - firsts[run]), pa.array(offsets[run])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(seat, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, key, text, capacity), "pieces")
    return place_pieces(pieces, key, capacity)


def assemble_sequences(pieces_with_ids: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id and ids of every sequence, from pieces with ids and their places (keys not repeated)."""
    joined = pieces_with_ids.select(key, "piece", "ids").join(placed.select(key, "piece", "sequence_id", "offset"), [key, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
