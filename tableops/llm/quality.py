"""Quality rules by weak supervision.

Each rule votes for a text, against it, or abstains. How accurate each is, nobody tells: votes of all documents are
counted by pattern (a table whose size depends on the rules alone), and expectation-maximisation over the counts
estimates, for good and for bad texts, how often each rule gives each vote. The posterior probability that
a text is good replaces the demand that it pass every rule.

Defined results: null text counts as empty; texts without words get all counts zero and fail the base rules;
repeated rows are judged each for itself and count each; with no rows there is nothing to estimate or judge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import materialize, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Common words of the languages served: fixed lists.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it for was on are as with be by this from at or an not have"
        " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch"
        " le la les de des et un une en que pour dans est sur par pas au avec du qui"
        " el los las una por con para del se al lo como más su y e"
    ).split()
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_function", "n_letters", "n_upper")
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LETTERS = _ASCII_UPPER + _ASCII_UPPER.lower()


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the list, the first find included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    w = np.array([seen.setdefault(x, len(seen)) for x in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    pairs = w[:-1] * len(seen) + w[1:]
    if len(seen) > 1 << 20:  # three of them would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(seen) + w[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    text = raw.decode("utf-8", "replace")
    n_letters = sum(map(len, _LETTERS.findall(text))) if not raw.isascii() else len(raw) - len(raw.translate(None, _ASCII_LETTERS))
    n_upper = sum(map(str.isupper, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, _ASCII_UPPER))
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())),
        n_letters,
        n_upper,
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and MEASURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in text_bytes(batch.column(1))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=[key, *MEASURES])

    kept = docs.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {dict(kept.dtypes)[key]}, " + ", ".join(f"{m} long" for m in MEASURES))


#: Rules: (name, measure as SQL, bad at or below, good from, good to, bad at or above). Between them a rule abstains.
RULES = (
    ("words", "n_words", 20, 60, 1e12, 1e13),
    ("word_length", "word_chars / greatest(n_words, 1)", 2.0, 3.0, 9.0, 13.0),
    ("symbols", "n_symbols / greatest(n_words, 1)", -1, -1, 0.03, 0.15),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", -1, -1, 0.05, 0.25),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", -1, -1, 0.10, 0.35),
    ("function_words", "n_function / greatest(n_words, 1)", 0.04, 0.10, 1, 2),
    ("letters", "n_letters / greatest(word_chars, 1)", 0.70, 0.88, 1, 2),
    ("upper", "n_upper / greatest(n_letters, 1)", -1, -1, 0.15, 0.40),
)


def votes(rows: DataFrame) -> DataFrame:
    """rows with v_<rule> for each rule: 1 for, -1 against, 0 abstaining."""
    out = {}
    for name, measured, low, good_from, good_to, high in RULES:
        x = F.expr(measured)
        out[f"v_{name}"] = F.when((x <= low) | (x >= high), -1).when((x >= good_from) & (x <= good_to), 1).otherwise(0)
    return rows.withColumns(out)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good and P(vote | class) as [class, rule, vote + 1], by expectation-maximisation over vote patterns.

    Starts from rules that are right four times in five; small pseudo-counts keep every vote possible.
    """
    n_rules = patterns.shape[1]
    prior = 0.8
    table = np.empty((2, n_rules, 3))
    table[1], table[0] = (0.1, 0.3, 0.6), (0.5, 0.3, 0.2)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        good = posterior(patterns, prior, table)
        for c, share in ((1, good * counts), (0, (1 - good) * counts)):
            seen = np.einsum("p,prv->rv", share, onehot) + 1.0
            table[c] = seen / seen.sum(axis=1, keepdims=True)
        new = float((good * counts).sum() + 1) / float(counts.sum() + 2)
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability that a text with each pattern of votes is good."""
    at = patterns + 1
    rules = np.arange(patterns.shape[1])
    log = [np.log(table[c][rules, at]).sum(axis=1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -700, 700)))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, MEASURES, base_failed, quality (posterior) and kept of every row of docs."""
    voted = materialize(votes(measures(docs, key, text)), "votes")
    names = [f"v_{r[0]}" for r in RULES]
    # At most 3 to the number of rules rows, whatever the input.
    seen = voted.groupBy(*names).count().toPandas()
    patterns, counts = seen[names].to_numpy(np.int64).reshape(-1, len(names)), seen["count"].to_numpy(float)
    prior, table = fit(patterns, counts) if len(seen) else (0.5, np.full((2, len(names), 3), 1 / 3))
    # The posterior's log-odds are a sum over rules, so it is plain column arithmetic.
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k, name in enumerate(names):
        gain = np.log(table[1, k] / table[0, k])
        odds = odds + F.element_at(F.array(*(F.lit(float(g)) for g in gain)), F.col(name).cast("int") + 2)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return voted.select(key, *MEASURES, failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= least)).alias("kept"))
