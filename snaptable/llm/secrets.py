"""Secret scan: fixed token shapes, and values in a credential context that would be hard to guess.

The second part is a guess-cost estimate: a dynamic program segments a value into
dictionary words, dates, repeats, keyboard walks and brute-force spans at the least
total cost (log10 of the guesses), and reports values whose least cost is high.
The dictionary is a few password words and then the corpus's own words by the number of texts that hold them,
so what reads as text there is cheap. Segments may have any length, and the work is linear in the
value's length, so a very long value is no special case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from math import inf, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import least_count, named, ship, text_of, written

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the length can be part of the pattern
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: What may stand before a credential's value, wider than the assign shape.
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|credentials?|api[_-]?key|access[_-]?key"""
    r"""|private[_-]?key|auth|login)["']?\s*(?:[:=]|=>|->|\bis\b)\s*["'`]?([^\s"'`<>,;]{8,})""",
    re.I | re.A,
)
_PROSE = re.compile(r"\bis\s+$", re.I | re.A)  # after an unquoted "is" a word of letters is prose
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "cred", "key", "auth", "login")

#: Common password words, the commonest first; they come before the corpus's words.
WORDS = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "secret", "hello",
    "shadow", "sunshine", "princess", "football", "baseball", "iloveyou", "trustno", "superman", "batman", "michael",
    "jordan", "hunter", "ranger", "thomas", "robert", "daniel", "charlie", "andrew", "jessica", "ashley",
    "summer", "winter", "spring", "autumn", "monday", "friday", "sunday", "january", "december", "love",
    "user", "root", "test", "guest", "default", "change", "token", "access", "server", "system",
    "internet", "computer", "example", "sample", "dummy", "your", "here", "none", "null", "true",
    "false", "pass", "word", "key", "the", "and", "api", "value", "string", "placeholder",
)

_LEET = str.maketrans("0134578@$!", "oieastbasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SEGMENT = log10(2.0)  # what each further segment costs
_TURN = log10(4.6)  # of a keyboard walk: the other keys next to one
_UNIT = 8  # longer units of a repeat are found where so many of their characters come again
MOST_WORDS = 30_000  # of the corpus in the dictionary, the commonest


_SHIFT = dict(zip('~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?', "".join(_ROWS), strict=True))
_KEY = {c: (r, x) for r, row in enumerate(_ROWS) for x, c in enumerate(row)}
_KEY |= {up: _KEY[low] for up, low in _SHIFT.items()}


def _step(a: str, b: str) -> tuple[int, ...] | None:
    """The direction from a key to one next to it, or along the code points; None if there is no such step."""
    if a in _KEY and b in _KEY:
        (r, x), (s, y) = _KEY[a], _KEY[b]
        if (r, x) != (s, y) and abs(r - s) <= 1 and abs(x - y) <= 1:
            return s - r, y - x
    return (ord(b) - ord(a),) if abs(ord(b) - ord(a)) == 1 else None


_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)[01]\d\1[0-3]\d|[0-3]\d([-/._]?)[0-3]\d\2(?:19|20)\d\d)")


def _char_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if c < "\x80" else 2.0


def periods(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the longest runs in which each character is that one unit before, two units or more.

    All with units up to _UNIT; longer units where _UNIT characters come again for the first time after one."""
    n, out = len(value), []
    for unit in range(1, min(_UNIT, n // 2) + 1):
        start = 0
        for i in range(unit, n + 1):
            if i < n and value[i] == value[i - unit]:
                continue
            if i - start >= 2 * unit:
                out.append((start, i, unit))
            start = i - unit + 1
    last: dict[str, int] = {}
    done: dict[int, int] = {}  # by unit: where its newest run ends
    for i in range(n - _UNIT + 1):
        before = last.get(value[i : i + _UNIT])
        last[value[i : i + _UNIT]] = i
        if before is None or i - before <= _UNIT or i < done.get(i - before, 0):
            continue
        unit, end = i - before, i + _UNIT
        while before and value[before - 1] == value[before - 1 + unit]:
            before -= 1
        while end < n and value[end] == value[end - unit]:
            end += 1
        done[unit] = end
        if end - before >= 2 * unit:
            out.append((before, end, unit))
    return out


def guess_cost(value: str, words: dict[str, int]) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments (kind, start, end).

    ``words`` maps lower-case words to ranks from 1. The empty value costs 0."""
    n = len(value)
    if not n:
        return 0.0, []
    lower = "".join(c.lower() if c < "\x80" else c for c in value)
    plain = lower.translate(_LEET)
    costs = [_char_cost(c) for c in value]
    lengths = sorted({len(w) for w in words})
    ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]  # by end: start, cost, kind
    for i in range(n):
        for length in lengths:
            if i + length > n:
                break
            raw, seen = lower[i : i + length], plain[i : i + length]
            rank = words.get(raw) or words.get(seen)
            if rank:
                capitals = sum(c.isupper() for c in value[i : i + length])
                cost = log10(rank) + (0.3 if raw not in words else 0.0)
                cost += 0.0 if not capitals else 0.3 if capitals in (1, length) else 0.3 * min(capitals, length - capitals) + 0.3
                ending[i + length].append((i, cost, "word"))
        if "0" <= value[i] <= "9":
            if m := _YEAR.match(value, i):
                ending[m.end()].append((i, log10(130), "date"))
            if m := _DATE.match(value, i):
                ending[m.end()].append((i, log10(365 * 130), "date"))
    so_far = [0.0]
    for c in costs:
        so_far.append(so_far[-1] + c)
    for start, end, unit in periods(value):
        # Whole copies from each place of the first one; what is left over stays to other segments.
        for at in range(start, min(start + unit, end - 2 * unit + 1)):
            times = (end - at) // unit
            if unit > 1 or times >= 3:
                ending[at + times * unit].append((at, so_far[at + unit] - so_far[at] + log10(times), "repeat"))
    # Keyboard walks of three keys or more: a start, its turns, and the length of the whole walk they lie in.
    steps = [None, *map(_step, lower, lower[1:])]
    first, turns, size = list(range(n)), [0] * n, [0.0] * n
    for i in range(1, n):
        if steps[i] is not None:
            first[i] = first[i - 1]
            turns[i] = turns[i - 1] + (i - 1 > first[i] and steps[i] != steps[i - 1])
    for i in range(n - 1, -1, -1):
        size[i] = size[i + 1] if i + 1 < n and first[i + 1] == first[i] else log10(i + 1 - first[i])
    walk, entered = inf, 0
    best, back = [0.0] + [inf] * n, [(0, "")] * (n + 1)
    brute, since = inf, 0
    for i in range(1, n + 1):
        opened = best[i - 1] + (_SEGMENT if i > 1 else 0.0)
        if opened < brute:
            brute, since = opened, i - 1
        brute += costs[i - 1]
        best[i], back[i] = brute, (since, "brute")
        key, begun = i - 1, i - 3  # the walk's last key, and the latest key it may begin at
        if begun < first[key]:
            walk = inf
        else:
            opened = best[begun] + (_SEGMENT if begun else 0.0) - turns[begun + 1] * _TURN
            if opened < walk:
                walk, entered = opened, begun
            total = walk + log10(94) + turns[key] * _TURN + size[key]
            if total < best[i]:
                best[i], back[i] = total, (entered, "walk")
        for start, cost, kind in ending[i]:
            total = best[start] + cost + (_SEGMENT if start else 0.0)
            if total < best[i]:
                best[i], back[i] = total, (start, kind)
    parts, i = [], n
    while i:
        start, kind = back[i]
        parts.append((kind, start, i))
        i = start
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed shapes, leftmost and non-overlapping per kind, in the order of KINDS."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def guessed_spans(
    text: str, taken: list[tuple[str, int, int]], words: dict[str, int], least: float
) -> list[tuple[str, int, int, float]]:
    """Values in a credential context, inside no span in ``taken``, that cost 10**least guesses or more.

    A value of letters only counts like any other, but for one after an unquoted "is"."""
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m.group(1).rstrip(".:!?)]}")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) < 8 or any(s <= start and end <= e for _, s, e in taken):
            continue
        if value.isalpha() and _PROSE.search(m.group()[: start - m.start()]):
            continue
        cost, _ = guess_cost(value, words)
        if cost >= least:
            out.append(("guess", start, end, cost))
    return out


def rank_words(words: Sequence[str]) -> dict[str, int]:
    return {w: k for k, w in enumerate(dict.fromkeys(words), 1)}


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The commonest runs of 3 to 24 ASCII letters, in lower case, by the number of rows that hold them; equals by the word.

    As many as have the same number or more in at most ``most``, so equals are taken all or none. Counted over all rows and
    whole texts; only those words reach the driver, and a row for each number."""
    ship(docs.sparkSession)
    letters = re.compile(rb"(?<![a-z])[a-z]{3,24}(?![a-z])")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found]), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(set(letters.findall(text.as_py().encode().lower())))
                if len(found) > 500_000:  # the sums go on in Spark
                    yield out()
                    found.clear()
        if found:
            yield out()

    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(docs.sparkSession, counts, "words")
    cut = least_count(counts, "n", most)
    found = counts.filter(F.col("n") >= cut).collect() if cut is not None else []
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])


def base_cost(text: str, span: tuple[str, int, int], words: dict[str, int]) -> float:
    """log10 of the guesses of a fixed shape's value."""
    kind, start, end = span
    if kind == "assign":
        start = _ASSIGN.match(text, start).start(2)
    return guess_cost(text[start:end], words)[0]


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_log10_guesses: float = 10.0,
    words: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the identifier and ``secrets``, an array of (kind, start, end, log10_guesses).

    Spans count code points, the end exclusive, ordered by start and then by KINDS. The dictionary is ``words`` in order
    of rank, or else WORDS and ``common_words`` of the texts. Fixed shapes stay whatever they cost. A null or
    empty text has no spans; a null identifier stays null; repeated rows and repeated identifiers
    each give their own row; an empty table gives no rows. Columns besides the two named are not read."""
    spark = docs.sparkSession
    ship(spark)
    ranks = rank_words(words if words is not None else [*WORDS, *common_words(docs, text_col)])
    shared = spark.sparkContext.broadcast(ranks)  # MOST_WORDS at most, or what the caller gave

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = {k: i for i, k in enumerate(KINDS)}, shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                spans = [(*s, base_cost(text, s, known)) for s in base] + guessed_spans(text, base, known, least_log10_guesses)
                spans.sort(key=lambda s: (s[1], order[s[0]]))
                rows.append([{"kind": k, "start": a, "end": b, "log10_guesses": c} for k, a, b, c in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], names=["id", "secrets"])

    out = "secrets array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>"
    rows = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, {out}").withColumnRenamed("id", id_col)
