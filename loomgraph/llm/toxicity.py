"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their 4- and 5-letter beginnings.  A bounded sample of
labelled documents gives the examples and picks the ``TERMS`` terms whose presence
goes best with the label (by rank of chi-square, whatever the sample's size);
document frequencies of those terms are counted over all documents.  Examples are numbered block by block; each term keeps its
postings and, for each block, its greatest weight.  A query visits blocks in
order of their bound and stops when no bound can reach the k-th best cosine, so
its neighbours are exactly those of a full scan.  The neighbours' votes become
scores by isotonic regression on the examples, each voted on by all others.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Labelled rows that are learned from at most (those of least hash), and terms that are kept at most.
SAMPLE, TERMS = 4000, 512
LEAST_DF = 4
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 16, 128, 0.25
WORD = re.compile(r"\w+")
SCORE = "score double, evidence array<long>"
CACHE_WORDS = 250_000


def terms_of(word: str) -> tuple[str, ...]:
    if len(word) < 4:
        return ("=" + word,)
    return ("=" + word, "^" + word[:4], "^" + word[:5]) if len(word) > 4 else ("=" + word, "^" + word)


class Vocabulary(dict):
    """Word to the numbers of its kept terms; bounded."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        return self.setdefault(word, tuple(n for t in terms_of(word) if (n := self.number.get(t)) is not None))

    def counts(self, text: str) -> Counter:
        return Counter([n for w in WORD.findall(text.lower()) for n in self[w]])


class Index:
    """Examples (id, label, term counts) behind block-max postings."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], k: int = NEIGHBOURS, block: int = BLOCK, calibrate: bool = True):
        self.idf, self.k, self.block = idf, k, block
        bare = [label for _, label, counts in examples if not counts]
        self.prior = (sum(x[1] for x in examples) + 0.5) / (len(examples) + 1)
        self.bare = (sum(bare) + self.prior) / (len(bare) + 1)
        # Examples of like strongest term lie together, which makes the bounds tight.
        vectors = [(i, label, *self.vector(counts)) for i, label, counts in examples if counts]
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], np.float64)
        n_blocks = -(-len(vectors) // block)
        self.bound = np.zeros((len(idf), n_blocks))
        lists = {}
        for e, (_, _, terms, weights) in enumerate(vectors):
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                at, ws = lists.setdefault((t, e // block), ([], []))
                at.append(e % block)
                ws.append(w)
                self.bound[t, e // block] = max(self.bound[t, e // block], w)
        self.postings = {key: (np.array(at), np.array(ws)) for key, (at, ws) in lists.items()}
        self.map = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        if calibrate and vectors:
            counts = {i: c for i, _, c in examples}
            votes = np.array([self.votes(self.nearest(counts[i], e)) for e, i in enumerate(self.ids.tolist())])
            self.map = isotonic(votes, self.labels, self.prior)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts))
        weights = (1 + np.log([counts[t] for t in terms.tolist()])) * self.idf[terms]
        return terms, weights / math.sqrt(float(weights @ weights))

    def nearest(self, counts: dict[int, int], skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the ``k`` best, ties by example; never ``skip``."""
        if not counts or not len(self.ids):
            return []
        terms, weights = self.vector(counts)
        bounds = weights @ self.bound[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == self.k and bounds[b] + 1e-9 < -best[-1][0]:
                break
            sums = np.zeros(min(self.block, len(self.ids) - b * self.block))
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                if found := self.postings.get((t, b)):
                    sums[found[0]] += w * found[1]
            sums = np.round(sums, 9)
            if skip // self.block == b:
                sums[skip % self.block] = 0
            best = sorted(best + [(-sums[e], e + b * self.block) for e in np.flatnonzero(sums).tolist()])[: self.k]
        return [(-s, e) for s, e in best]

    def votes(self, near: list[tuple[float, int]]) -> float:
        """Labels weighted by squared cosine, drawn to the prior where there are few."""
        votes = sum(s * s * self.labels[e] for s, e in near) + PRIOR_WEIGHT * self.prior
        return float(votes / (sum(s * s for s, _ in near) + PRIOR_WEIGHT))

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        """The calibrated votes of the neighbours, and their ids."""
        if not counts:
            return self.bare, []
        near = self.nearest(counts)
        return float(np.interp(self.votes(near), *self.map)), [int(self.ids[e]) for _, e in near]


def isotonic(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Votes and shares of label 1, both rising: adjacent groups in the wrong order are pooled, and each is drawn to the prior by one label."""
    pools: list[list[float]] = []  # sum of labels, examples, sum of votes
    order = np.argsort(votes, kind="stable")
    for v, y in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([y, 1, v])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][2] / pools[-2][1] == pools[-1][2] / pools[-1][1]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    shares = [(y + prior) / (n + 1) for y, n, _ in pools]
    return np.array([t / n for _, n, t in pools]), np.maximum.accumulate(shares)


class Model:
    def __init__(self, terms: list[str], index: Index):
        self.terms, self.index = terms, index


def _texts(batch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_terms: int = TERMS) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic 0/1, the rows to learn from).

    Rows of a null id or label are left out, of repeated labels the least counts,
    of an id's texts the least; null and empty texts have no terms.  Of all labelled ids those of
    least hash are the sample, ties by id; of terms of equal chi-square the first by
    name are kept.  Without labels of both sorts there are no terms and one score.
    At most ``sample`` examples, reduced to kept terms, and ``most_terms`` terms
    reach the driver and are sent to tasks.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.min("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    rows = common.written(rows, common.new_folder(docs.sparkSession, "labelled"))

    def presence(batches):
        common.release()
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                for term in {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}:
                    seen.setdefault(term, [0, 0])[toxic] += 1
            if len(seen) > 1_000_000:
                yield said(seen)
                seen = {}
        if seen:
            yield said(seen)

    def said(seen):
        return pa.RecordBatch.from_pydict({"term": list(seen), "clean": [x[0] for x in seen.values()], "toxic": [x[1] for x in seen.values()]})

    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    terms: list[str] = []
    if n0 and n1:
        counts = rows.mapInArrow(presence, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(F.col("c") + F.col("t") >= LEAST_DF)
        df = F.col("c") + F.col("t")
        chi = F.pow(F.col("t") / n1 - F.col("c") / n0, 2) * (n0 + n1) / (df / (n0 + n1) * (1 - df / (n0 + n1) + 1e-9)) * (n0 * n1 / (n0 + n1) ** 2)
        terms = [r.term for r in counts.withColumn("chi", chi).orderBy(F.desc("chi"), "term").limit(most_terms).collect()]
    vocabulary = Vocabulary(terms)

    def frequency(batches):
        common.release()
        seen, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for text in _texts(batch):
                n += 1
                if found := vocabulary.counts(text):
                    seen[list(found)] += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(terms)), "df": np.append(n, seen)})
        common.release()

    df = {r.term: r.df for r in docs.select("text").mapInArrow(frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    total = df.get(-1, 0)
    idf = np.array([math.log((total + 1) / (df[i] + 0.5)) + 0.1 for i in range(len(terms))])

    def reduced(batches):
        for batch in batches:
            found = [vocabulary.counts(text) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    examples = sorted(rows.mapInArrow(reduced, "doc_id long, toxic int, terms array<int>, counts array<int>").collect())
    return Model(terms, Index(idf, [(r.doc_id, r.toxic, dict(zip(r.terms, r.counts, strict=True))) for r in examples]))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1), evidence (ids of the neighbours, nearest first).

    Only ``text`` is looked at, the whole of it; of equally near examples the one of less number counts; null and empty texts, like all texts without a
    kept term, get the share of toxic examples among examples of that sort;
    repeated rows are scored alike; an empty table gives no rows; input columns of
    the added names are replaced.
    """
    docs = docs.drop("score", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE examples of TERMS terms

    def scored(batches):
        common.release()
        index, vocabulary = shared.value.index, Vocabulary(shared.value.terms)
        for batch in batches:
            found = [index.score(vocabulary.counts(text)) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=[*batch.schema.names, "score", "evidence"])
        vocabulary.clear()
        common.release()

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{kinds}, {SCORE}")
