"""Secret scans: fixed patterns, and formats inferred from what they find.

Credentials that the patterns label are turned into one prefix tree for each
kind; states whose outgoing frequencies agree by Hoeffding's bound are merged
(ALERGIA) into a probabilistic automaton.  Every other run of ``LEAST`` or more
credential characters, unless a found span covers it, is scored by how much likelier
the best automaton makes it than a letter-pair model of ordinary long runs.  Dots
inside a run belong to it, dots around it don't.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The shortest credential that a fixed pattern takes.
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{%d,}(?<!\.)" % (LEAST - 1))
WORDS = ("passw", "secret", "token", "api")
#: Distinct labelled credentials of each kind, and ordinary runs, that are learned from: those of least hash over all texts.
SAMPLE = 400
GROUPS = 16
SIGMA = 66
END = ""
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, credential), sorted; code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs that no base span covers; a run may contain one."""
    ends, at = [(s[0], s[2]) for s in base], 0
    for m in RUN.finditer(text):
        run = m[0]
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not any(a <= m.start() and m.end() <= b for a, b in ends[at:]):
            yield m.start(), m.end(), run


class Automaton:
    """A probabilistic automaton by ALERGIA: states with counts of arrivals, ends and outgoing characters."""

    def __init__(self, words: Iterable[str], alpha: float = 0.05):
        self.arrive, self.end, self.count, self.next = [0], [0], [Counter()], [{}]
        for word in words:
            at = 0
            self.arrive[0] += 1
            for c in word:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    for x, new in ((self.arrive, 0), (self.end, 0), (self.count, Counter()), (self.next, {})):
                        x.append(new)
                at = self.next[at][c]
                self.arrive[at] += 1
            self.end[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            n1, n2 = self.arrive[a], self.arrive[b]
            if not n1 or not n2:
                continue
            if self._differ(self.end[a], n1, self.end[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a][c], n1, self.count[b][c], n2):
                    return False
            # A state of the tree has few visits below it; the red side may be a cycle, the blue side is a tree, so this ends.
            stack += [(self.next[a][c], x) for c, x in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            self.arrive[a] += self.arrive[b]
            self.end[a] += self.end[b]
            self.count[a].update(self.count[b])
            for c, x in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], x))
                else:
                    self.next[a][c] = x

    def _merge_all(self) -> None:
        red = [0]
        while True:
            blue = [(r, c, x) for r in red for c, x in sorted(self.next[r].items()) if x not in red]
            if not blue:
                break
            r, c, x = max(blue, key=lambda t: (self.arrive[t[2]], t[1]))
            for to in red:
                if self._compatible(to, x):
                    self.next[r][c] = to
                    self._fold(to, x)
                    break
            else:
                red.append(x)
        keep = {s: i for i, s in enumerate(red)}
        self.states = [(self.arrive[s], self.end[s], dict(self.count[s]), {c: keep[x] for c, x in self.next[s].items()}) for s in red]
        del self.arrive, self.end, self.count, self.next

    def score(self, word: str) -> float:
        """log10 probability; a character never seen in a state has the weight of half a visit, and stays there."""
        at, total = 0, 0.0
        for c in word:
            n, _, count, to = self.states[at]
            total += math.log10((count.get(c, 0) + 0.5 / SIGMA) / (n + 0.5 + 0.5 / SIGMA))
            at = to.get(c, at)
        n, end, _, _ = self.states[at]
        return total + math.log10((end + 0.5 / SIGMA) / (n + 0.5 + 0.5 / SIGMA))


class Pairs:
    """A letter-pair model of ordinary runs, interpolated with a uniform one."""

    def __init__(self, words: Iterable[str]):
        self.count, self.total = defaultdict(Counter), Counter()
        for word in words:
            for a, b in zip(" " + word, word + " ", strict=True):
                self.count[a][b] += 1
                self.total[a] += 1
        self.count = dict(self.count)

    def score(self, word: str) -> float:
        total = 0.0
        for a, b in zip(" " + word, word + " ", strict=True):
            total += math.log10((self.count.get(a, {}).get(b, 0) + 1) / (self.total.get(a, 0) + SIGMA))
        return total


class Formats:
    """Automata by kind against ordinary runs."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if v}
        self.ordinary = Pairs(ordinary)

    def evidence(self, word: str) -> float:
        """log10 likelihood ratio of the best kind."""
        return max((a.score(word) for a in self.kinds.values()), default=-math.inf) - self.ordinary.score(word)


def _texts(batch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def learn_formats(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Learns from all texts (``text``); at most ``sample`` whole strings of each kind reach the driver.

    Of all distinct strings of a kind those of least hash are taken, equal hashes
    by the strings, so that order and repeats of rows don't matter.  Null and empty
    texts hold none; a kind without strings, as in an empty table, has no automaton.
    """

    def gather(batches):
        least = defaultdict(dict)
        for batch in batches:
            for text in _texts(batch):
                base = base_spans(text)
                for _, kind, _, word in base:
                    least[KINDS[kind]][word] = 0
                for _, _, word in other_runs(text, base):
                    least["other"][word] = 0
            for kind, words in least.items():
                if len(words) > 4 * sample:
                    least[kind] = dict.fromkeys(heapq.nsmallest(sample, words, key=lambda w: (xxhash.xxh64_intdigest(w), w)), 0)
        rows = [(kind, xxhash.xxh64_intdigest(w) >> 1, w) for kind, words in least.items() for w in heapq.nsmallest(sample, words, key=lambda w: (xxhash.xxh64_intdigest(w), w))]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "hash", "word"), map(list, zip(*rows, strict=True)), strict=True)))

    rows = docs.select("text").mapInArrow(gather, "kind string, hash long, word string").distinct()
    # Each task has kept at most `sample` strings of a kind; parts of them by another hash first, then a kind's GROUPS * sample.
    order = ["hash", "word"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(GROUPS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "part").orderBy(*order))).filter(F.col("rank") <= sample)
    least = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("rank") <= sample)
    words = defaultdict(list)
    for row in sorted(least.collect()):
        words[row.kind].append(row.word)
    return Formats({k: words[k] for k in KINDS}, words["other"])


def find_secrets(docs: DataFrame, formats: Formats, least: float = 6.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts and digest of base spans, and all spans.

    ``spans`` is ``kind:start:end`` in code points, end exclusive, by start and
    then kind, comma-joined; ``format`` spans are those that the automata add
    (evidence of at least ``least`` powers of ten).  A null or empty text has no
    spans (digest of the empty string), a text of any length is searched whole; spans
    of one place and kind don't repeat; repeated rows give repeated rows; an empty
    table gives none; other columns are not read.
    """

    def scan(batches):
        names = (*KINDS, "format")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                base = base_spans(text)
                added = [(start, 3, end, "") for start, end, word in other_runs(text, base) if formats.evidence(word) >= least]
                say = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in spans)
                n = Counter(k for _, k, _, _ in base)
                out.append((doc_id, n[0], n[1], n[2], hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + added) if added else base)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)
