"""Personal data by bootstrapped contextual extraction.

Base patterns (email, ip, card, phone) give seed entities. The words around a seed, their digits alike, make lexical
patterns over four places (two before, two after) and the start of a line: one place alone, also with a gap to the seed, the
two before, the two after, or one on each side, each with the class of what stands between (with an at sign, of digits and
signs, or with letters). The last word of a seed of several words counts as an instance too, in the words before it. Occurrences of
identifier-like tokens and their patterns form a graph of patterns and instances. Round by round Spark scores patterns by
the known instances among theirs, accepts those of high confidence, and through them adds instances for which
accepted patterns agree that together cover LEAST_PLACES places (nested patterns cover no more than the widest of them);
these count as known in the next round, until a round adds none. Spans of known instances wherever they stand outside
base spans, grown to the left over a number's lead ("+1 (415)") if of kind phone, are added to the base spans.

Defined results: null text counts as empty; no words give no spans; spans are in code points, the end exclusive;
repeated rows are searched each for itself, and count in pattern statistics once for each distinct instance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import materialize, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Rounds after which bootstrapping counts as failed; known instances and confidence that a pattern needs; places that the patterns of an instance cover.
ROUNDS, LEAST_KNOWN, LEAST_CONFIDENCE, LEAST_PLACES = 200, 3, 0.6, 2
#: Characters on each side of an occurrence in which its context words are looked for; a longer word counts by its near end.
CONTEXT = 256

# The tails that follow a kind's anchor; anchors are found first, so that long runs are read once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IDENTIFIER = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&"
_DIGITS = re.compile("[^0-9]")
_NUMBER = re.compile("[0-9]+")
#: What may stand before the last word of a phone number.
_LEAD = re.compile(r"\+[0-9]{1,4}[ .-]?(?:\(?[0-9]{1,5}\)?[ .-]?)?\Z")
#: Tokens shorter than this are no identifiers.
LEAST_LENGTH = 5


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping emails, found from their at signs: a local part reaches as far left as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        end = _DOMAIN.match(text, at)
        if end:
            # The run before the at sign, read backwards in growing steps.
            step, low, left = 64, at, at
            while low > done and left == low:
                low, step = max(done, at - step), step * 4
                left = low + len(text[low:at].rstrip(_LOCAL))
            if left < at:
                yield Span(left, end.end(), "email")
                done = end.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else not p.strip("0") or int(p[-300:]) <= 255 and not p[:-300].strip("0") for p in m[0].split(".")):
            found.append(Span(m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(Span(m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def class_of(token: str) -> str:
    """What kind of token may stand in a pattern: one with an at sign, of digits and signs, or with letters."""
    return "@" if "@" in token else "a" if any(map(str.isalpha, token)) else "9"


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str], bool]:
    """The two words before (nearest first) and after, lower-cased, without their edges and with digits alike; whether a line starts."""
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    before = [w for w in map(_word, left.split()[:-4:-1]) if w]
    after = [w for w in map(_word, right.split(None, 3)[:3]) if w]
    return before[:2], after[:2], not left.rpartition("\n")[2].strip(" \t" + _EDGES)


def _word(word: str) -> str:
    return _NUMBER.sub("9", word.strip(_EDGES).lower())


def patterns_around(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(hash, places as bits) of each pattern that text[start:end] stands in."""
    before, after, first = _context(text, start, end)
    keys = [(1, ("l", before[0]))] if before else []
    if len(before) > 1:
        keys += [(2, ("g", before[1])), (3, ("ll", *before))]
    if after:
        keys.append((4, ("r", after[0])))
    if len(after) > 1:
        keys += [(8, ("h", after[1])), (12, ("rr", *after))]
    if before and after:
        keys.append((5, ("lr", before[0], after[0])))
    if first:
        keys.append((16, ("^",)))
        if after:
            keys.append((20, ("^r", after[0])))
    kind = class_of(text[start:end])
    return [(_hash("\x1f".join((*key, kind))), places) for places, key in keys]


class Occurrence(NamedTuple):
    s: int
    e: int
    grown: int  # where the span starts if it is a phone number
    kind: str | None  # of a base span
    tail: bool  # the last word of a base span, not a span itself
    instance: int
    patterns: list[tuple[int, int]]


def occurrences(text: str) -> list[Occurrence]:
    """Base spans, the last words of those of several words, and other identifier-like tokens."""
    spans = base_spans(text)
    found: list[tuple[int, int, str | None, bool]] = [(*s, False) for s in spans]
    for s in spans:
        last = text[s.start : s.end].rsplit(None, 1)
        if len(last) > 1 and len(last[1]) >= LEAST_LENGTH:
            found.append((s.end - len(last[1]), s.end, s.kind, True))
    taken, k = sorted((s.start, s.end) for s in spans), 0
    for m in _IDENTIFIER.finditer(text):
        token = m[0].strip(_EDGES)
        if len(token) < LEAST_LENGTH or not any(c.isdigit() or c == "@" for c in token):
            continue
        start = m.start() + m[0].index(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if not any(a < start + len(token) and start < b for a, b in taken[max(0, k - 1) : k + 4]):
            found.append((start, start + len(token), None, False))
    out = []
    for start, end, kind, tail in found:
        lead = None if kind else _LEAD.search(text, max(0, start - 16), start)
        grown = lead.start() if lead else start
        out.append(Occurrence(start, end, grown, kind, tail, _hash(text[start:end].lower()), patterns_around(text, start, end)))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def find_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and an array `found` of occurrences, for every row of docs."""
    entry = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("grown", pa.int32()), ("kind", pa.string()), ("tail", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.struct([("pattern", pa.int64()), ("places", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x._asdict() | {"patterns": [{"pattern": h, "places": p} for h, p in x.patterns]} for x in occurrences(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(entry))], names=[key, "found"])

    kept = docs.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {dict(kept.dtypes)[key]}, found array<struct<s:int,e:int,grown:int,kind:string,tail:boolean,instance:long,patterns:array<struct<pattern:long,places:int>>>>")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, least_known: int = LEAST_KNOWN, least_confidence: float = LEAST_CONFIDENCE, least_places: int = LEAST_PLACES) -> DataFrame:
    """instance and kind of every known instance, of base spans or added by patterns, that occurs outside base spans."""
    flat = found.select(F.explode("found").alias("o")).select("o.instance", "o.kind", F.explode_outer("o.patterns").alias("p"))
    edges = materialize(flat.select("instance", "kind", "p.pattern", "p.places").distinct(), "pattern-edges")
    known = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    links = edges.where("pattern is not null").select("pattern", "places", "instance").distinct()
    for _ in range(rounds):
        marked = links.join(known, "instance", "left")
        total = links.groupBy("pattern").agg(F.count("*").alias("n"))
        # Patterns that no known instance has stood in can't be accepted.
        scores = marked.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("f")).join(total, "pattern")
        accepted = scores.withColumn("confidence", F.col("f") / F.col("n")).where((F.col("f") >= least_known) & (F.col("confidence") >= least_confidence))
        best = accepted.groupBy("pattern").agg(F.max_by("kind", F.struct(F.col("confidence") * F.log2("f"), "kind")).alias("kind"), F.max(F.col("confidence") * F.log2("f")).alias("score"))
        fresh = links.join(best, "pattern").join(known.select("instance"), "instance", "left_anti")
        agreed = fresh.groupBy("instance", "kind").agg(F.max("score").alias("score"), F.bit_count(F.bit_or("places")).alias("n")).where(F.col("n") >= least_places)
        votes = materialize(agreed.groupBy("instance").agg(F.max_by("kind", F.struct("n", "score", "kind")).alias("kind")), "votes")
        if votes.isEmpty():
            break
        known = materialize(known.unionByName(votes), "known")
    else:
        raise RuntimeError("bootstrapping did not settle")
    return known.join(edges.where("kind is null").select("instance").distinct(), "instance", "left_semi")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """key, base and spans of every row: arrays of (s, e, kind) by start, then kind; spans holds base and what the method adds."""
    found = materialize(find_occurrences(docs, key, text).withColumn("__row", F.monotonically_increasing_id()), "occurrences")
    added = bootstrap(found, **parameters)
    kind_rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x)
    base = F.transform(F.filter("found", lambda o: o["kind"].isNotNull() & ~o["tail"]), lambda o: F.struct(o["s"].alias("s"), o["e"].alias("e"), o["kind"].alias("kind")))
    open_rows = found.select("__row", F.explode(F.filter("found", lambda o: o["kind"].isNull())).alias("o")).select("__row", "o.s", "o.e", "o.grown", "o.instance")
    # An added instance may stand in very many rows; the added ones are few against those.
    start = F.when(F.col("kind") == "phone", F.col("grown")).otherwise(F.col("s"))
    more = open_rows.join(added, "instance").withColumn("s", start).groupBy("__row").agg(F.collect_list(F.struct("s", "e", "kind")).alias("more"))
    both = found.withColumn("base", base).join(more, "__row", "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,e:int,kind:string>>")))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda o: F.struct(o["s"], kind_rank(o["kind"]).alias("r"), o["e"].alias("e"), o["kind"].alias("kind")))), lambda o: F.struct(o["s"].alias("s"), o["e"].alias("e"), o["kind"].alias("kind")))
    return both.select(key, "base", ordered.alias("spans"))
