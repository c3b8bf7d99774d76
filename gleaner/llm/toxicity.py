"""Toxicity by weak supervision: voters, a label model over them, a linear classifier.

1. A lexicon of words and word beginnings is mined from a bounded sample of labelled
   documents. Its terms are dealt over ``LEXICON_VOTERS`` voters; patterns (shouting,
   masked letters and so on) vote as well. A voter says "toxic" or abstains.
2. How often voters and pairs of voters fire is counted over all documents. Given the
   share of toxic documents, independent voters have covariances that factor into
   one number per voter, which gives its firing rates on toxic and clean documents
   without any label. Pairs that do not fit are taken as correlated: they are left
   out of the factoring, and such voters share their weight.
3. The label model's posteriors of a bounded sample of documents, labelled or not, train
   a logistic regression on the single terms and patterns, which scores every text.

Only counts, the lexicon (``MAX_TERMS``) and the hits of the bounded sample reach the
driver; texts are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from gleaner.llm.workers import free_name, ready


#: At most about so many labelled documents are mined for the lexicon.
MAX_LABELLED = 40_000
#: At most about so many documents, with their posterior labels, train the classifier.
MAX_TRAINING = 20_000
MAX_TERMS = 2048
MAX_CANDIDATES = 4 * MAX_TERMS
MIN_TOXIC_DOCS = 3
MIN_LIFT = 8.0
LEXICON_VOTERS = 24
PREFIXES = (4, 5)
DEPENDENT = 0.1
_COUNTER_LIMIT = 300_000
_CACHE_LIMIT = 200_000

_CAPITALS = re.compile(r"[A-Z][A-Z][A-Z][A-Z]")
_SHOUTED = re.compile(r"(?:\b[A-Z]{4,}\b\W+){2}")
_MASKED = re.compile(r"[A-Za-z][*@#$]+[A-Za-z]")
_INSULTED = re.compile(r"\b(?:you|your|you're|youre) (?:are|re|look|smell|deserve)\b")
_SENT_OFF = re.compile(r"\b(?:go|get|shut|drop) (?:away|lost|up|dead|to hell)\b")

#: Patterns on a text and its lower-case form; cheap literal tests come first.
PATTERNS = (
    lambda text, low: _CAPITALS.search(text) is not None and _SHOUTED.search(text) is not None,
    lambda text, low: "!!" in text or "?!" in text or "!?" in text or "??" in text,
    lambda text, low: any(c in text for c in "*@#$") and _MASKED.search(text) is not None,
    lambda text, low: "you" in low and _INSULTED.search(low) is not None,
    lambda text, low: any(w in low for w in (" away", " lost", " dead", " up", " to hell"))
    and _SENT_OFF.search(low) is not None,
)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(token: str) -> set[str]:
    """Words of a token and their beginnings, marked by a star."""
    found = set()
    for word in _WORD.findall(token):
        found.add(word)
        found.update(word[:n] + "*" for n in PREFIXES if len(word) > n)
    return found


class TermIndex:
    """The ids of all known terms and patterns that occur in a text."""

    def __init__(self, terms: list[str]) -> None:
        self.ids = {term: i for i, term in enumerate(terms)}
        self.heads = {term.rstrip("*")[: min(PREFIXES)] for term in terms}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _look_up(self, token: str) -> tuple[int, ...]:
        ids, word = self.ids, token.rstrip(".,;:!?")
        if word.isalpha():  # most tokens are one word
            wanted = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
        else:
            wanted = terms_of(token)
        found = tuple(ids[t] for t in wanted if t in ids)
        if len(self.cache) >= _CACHE_LIMIT:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = found
        return found

    def hits(self, text: str) -> list[int]:
        found: set[int] = set()
        cache, heads, low = self.cache, self.heads, text.lower()
        head = min(PREFIXES)
        for token in set(low.split()):
            if token[:head] not in heads and token.isalpha():
                continue
            ids = cache.get(token)
            if ids is None:
                ids = self._look_up(token)
            if ids:
                found.update(ids)
        n = len(self.ids)
        found.update(n + i for i, fires in enumerate(PATTERNS) if fires(text, low))
        return sorted(found)


def _voter(term: int, terms: int) -> int:
    """Terms are dealt in turn; every pattern is a voter of its own."""
    return term % LEXICON_VOTERS if term < terms else LEXICON_VOTERS + term - terms


@dataclass
class LabelModel:
    """Firing rates of each voter on toxic and clean documents, and correlated pairs."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    share: np.ndarray
    correlated: dict[tuple[int, int], float] = field(default_factory=dict)

    @property
    def accuracy(self) -> np.ndarray:
        return self.prior * self.on_toxic + (1 - self.prior) * (1 - self.on_clean)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of 0/1 votes; abstaining says nothing."""
        fired = np.log(self.on_toxic / self.on_clean) * self.share
        logit = np.log(self.prior / (1 - self.prior)) + votes @ fired
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(n: int, fired: np.ndarray, both: np.ndarray, prior: float) -> LabelModel:
    """From counts alone: ``fired[i]`` and ``both[i, j]`` of ``n`` documents."""
    p = fired / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    fits = np.outer(fired > 0, fired > 0) & ~np.eye(len(p), dtype=bool)
    a, residual = 0.5 * spread, np.zeros_like(cov)
    for _ in range(4):
        for _ in range(200):
            top, low = (fits * cov) @ a, fits @ (a * a)
            a = 0.5 * a + 0.5 * np.clip(np.divide(top, low, out=0 * a, where=low > 1e-15), 0, spread)
        residual = (cov - np.outer(a, a)) / np.outer(spread, spread)
        odd = (np.abs(residual) > DEPENDENT) & np.outer(fired > 0, fired > 0)
        # A voter keeps the better half of its partners, or nothing could be factored.
        worst = np.median(np.abs(residual), axis=1)
        odd &= np.abs(residual) > np.maximum(worst[:, None], worst[None, :])
        fits = np.outer(fired > 0, fired > 0) & ~np.eye(len(p), dtype=bool) & ~odd
    off = ~np.eye(len(p), dtype=bool)
    linked = np.where(off & ~fits & np.outer(fired > 0, fired > 0), np.abs(residual), 0)
    ratio = np.sqrt((1 - prior) / prior)
    low, high = 1e-4, 1 - 1e-4
    pairs = {(int(i), int(j)): float(residual[i, j]) for i, j in np.argwhere(linked) if i < j}
    return LabelModel(
        prior,
        np.clip(p + a * ratio, low, high),
        np.clip(p - a / ratio, low, high),
        np.where(fired > 0, 1 / (1 + linked.sum(axis=1)), 0.0),
        pairs,
    )


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, ridge: float = 1e-4):
    """Weights and bias of a logistic regression on binary features, soft targets."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=len(which))
    w, bias = np.zeros(size), 0.0
    seen_w, seen_b = np.full(size, 1e-8), 1e-8
    n = max(len(rows), 1)
    for _ in range(400):
        logit = bias + np.bincount(which, w[feature], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        grad = np.bincount(feature, error[which], minlength=size) / n + ridge * w
        seen_w += grad * grad
        step_b = error.mean() if len(rows) else 0.0
        seen_b += step_b**2
        w -= 0.5 * grad / np.sqrt(seen_w)
        bias -= 0.5 * step_b / np.sqrt(seen_b)
    return w, float(bias)


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    code = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(5)) == 0, F.lit(False))


def _sampled(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of the keys."""
    n = df.count()
    if n <= limit:
        return df
    place = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30))
    return df.where(place < int(limit / n * (1 << 30)))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


_TERM_COUNTS = "term string, toxic_docs bigint, clean_docs bigint"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        terms = list(counts[0] | counts[1])
        toxic, clean = counts[1], counts[0]
        batch = pa.RecordBatch.from_pydict(
            {
                "term": pa.array(terms, pa.string()),
                "toxic_docs": pa.array([toxic[t] for t in terms], pa.int64()),
                "clean_docs": pa.array([clean[t] for t in terms], pa.int64()),
            }
        )
        toxic.clear()
        clean.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = set()
            for token in set(text.lower().split()):
                found |= terms_of(token)
            counts[toxic].update(found)
        if len(counts[0]) + len(counts[1]) > _COUNTER_LIMIT:
            yield out()
    yield out()


def _contexts(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """Which words the terms follow, as (term, hash of the word before)."""
    index = TermIndex(terms)
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for text in batch.column(0).to_pylist():
            before = ""
            for token in text.lower().split():
                ids = index.cache.get(token)
                for i in index._look_up(token) if ids is None else ids:
                    found.add((i, crc32(before.encode())))
                before = token
        ids, words = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(ids, pa.int32()), "context": pa.array(words, pa.int64())}
        )


def _is_widespread(a: int, b: int, contexts: int, share: float, wanted: float) -> bool:
    """Whether the evidence holds with each context counted once.

    The words of a toxic text with many near copies occur in many toxic documents, but
    always after the same word.
    """
    a = min(a, contexts)
    total = a + b
    chance = a * np.log(a / total / share)
    if b:
        chance += b * np.log(b / total / (1 - share))
    return chance >= wanted


def _without_loose_beginnings(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Drop a word beginning if a longer term explains it with fewer clean documents.

    ``counts`` are the toxic and clean documents of each term.
    """
    longer: dict[str, list[str]] = {}
    for term in counts:
        word = term.rstrip("*")
        for n in PREFIXES:
            if n < len(word):
                longer.setdefault(word[:n] + "*", []).append(term)
    return [
        term
        for term, (a, b) in counts.items()
        if not any(
            counts[other][0] >= 0.8 * a and 2 * counts[other][1] < b
            for other in longer.get(term, [])
        )
    ]


def mine_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[list[str], float]:
    """Terms that mark toxic documents, strongest first, and the share of toxic ones."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~is_held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    known = _sampled(known, MAX_LABELLED, "doc_id")
    sums = known.agg(F.sum("toxic"), F.count("*")).first()
    toxic, n = sums[0] or 0, sums[1]
    if not toxic or toxic == n:
        return [], min(max(toxic / max(n, 1), 1e-3), 0.5)
    # Bounded by MAX_LABELLED rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text())
    rows = texts.join(F.broadcast(known), "doc_id").select("text", "toxic")
    ready(docs.sparkSession)
    counted = (
        rows.mapInArrow(_count_terms, _TERM_COUNTS)
        .groupBy("term")
        .agg(F.sum("toxic_docs").alias("a"), F.sum("clean_docs").alias("b"))
        .where(F.col("a") >= MIN_TOXIC_DOCS)
        .checkpoint()
    )
    lift = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (n - toxic + 1))
    # Chernoff's bound on a clean term falling into so many toxic documents by chance,
    # held against the number of terms that had the chance.
    wanted = 1 + np.log(max(counted.count(), 1))
    total, share = F.col("a") + F.col("b"), F.lit(toxic / n)
    chance = F.col("a") * F.log(F.col("a") / total / share) + F.coalesce(
        F.col("b") * F.log(F.col("b") / total / (1 - share)), F.lit(0.0)
    )
    expected = total * share
    strong = (
        counted.where((lift >= MIN_LIFT) & (chance >= wanted))
        .withColumn("z", (F.col("a") - expected) / F.sqrt(expected))
        .orderBy(F.desc("z"), "term")
        .limit(MAX_CANDIDATES)
        .collect()
    )
    candidates = [r.term for r in strong]
    contexts = (
        rows.where("toxic = 1")
        .select("text")
        .mapInArrow(partial(_contexts, terms=candidates), "id int, context bigint")
        .distinct()
        .groupBy("id")
        .count()
        .collect()  # a row per candidate at most
    )
    apart = {candidates[r["id"]]: r["count"] for r in contexts}
    wide = [r for r in strong if _is_widespread(r.a, r.b, apart[r.term], toxic / n, wanted)]
    terms = _without_loose_beginnings({r.term: (r.a, r.b) for r in wide})
    return terms[:MAX_TERMS], min(max(toxic / n, 1e-3), 0.5)


def _vote_counts(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    index, voters = TermIndex(terms), LEXICON_VOTERS + len(PATTERNS)
    both, n = np.zeros((voters, voters), dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            hits = index.hits(text)
            if hits:
                fired = np.unique([_voter(h, len(terms)) for h in hits])
                both[np.ix_(fired, fired)] += 1
    i, j = np.nonzero(both)
    yield pa.RecordBatch.from_pydict(
        {
            "i": pa.array(np.append(i, -1), pa.int32()),
            "j": pa.array(np.append(j, -1), pa.int32()),
            "n": pa.array(np.append(both[i, j], n), pa.int64()),
        }
    )


def _hit_lists(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    index = TermIndex(terms)
    for batch in batches:
        hits = [index.hits(text) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"hits": pa.array(hits, pa.list_(pa.int32()))})


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels of held-out ids, null ids and null labels are not used; several labels of one
    document count as their majority. Without labels of both kinds there is no lexicon
    and every document gets the same low score.
    """
    ready(docs.sparkSession)
    terms, prior = mine_lexicon(docs, labels)
    voters = LEXICON_VOTERS + len(PATTERNS)
    if not terms:
        bias = float(np.log(min(prior, 0.4) / (1 - min(prior, 0.4))))
        return ToxicityModel([], np.zeros(len(PATTERNS)), bias)
    texts = docs.select(_text())
    counts = (
        texts.mapInArrow(partial(_vote_counts, terms=terms), "i int, j int, n bigint")
        .groupBy("i", "j")
        .agg(F.sum("n").alias("n"))
        .collect()  # a row per pair of voters at most
    )
    both, n = np.zeros((voters, voters)), 0
    for i, j, k in counts:
        if i < 0:
            n = k
        else:
            both[i, j] = k
    model = fit_label_model(n, np.diag(both).copy(), both, prior)
    sample = _sampled(docs, MAX_TRAINING, "doc_id", "text").select(_text())
    hits = [
        list(r.hits)
        for r in sample.mapInArrow(partial(_hit_lists, terms=terms), "hits array<int>").collect()
    ]
    votes = np.zeros((len(hits), voters))
    for row, found in enumerate(hits):
        votes[row, [_voter(h, len(terms)) for h in found]] = 1
    weights, bias = fit_linear(hits, model.posterior(votes), len(terms) + len(PATTERNS))
    return ToxicityModel(terms, weights, bias, model)


def _score(
    batches: Iterator[pa.RecordBatch],
    name: str,
    terms: list[str],
    weights: np.ndarray,
    bias: float,
) -> Iterator[pa.RecordBatch]:
    index = TermIndex(terms)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        logits = np.array([bias + weights[index.hits(t)].sum() for t in texts], dtype=float)
        scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        columns = [*batch.columns[:-1], pa.array(scores, pa.float64())]
        names = [*batch.schema.names[:-1], name]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *keep: str, score: str = "score"
) -> DataFrame:
    """The columns ``keep`` and a score (0 to 1) for every row; null text is empty."""
    rows = docs.select(*keep, _text().alias(free_name(docs, "text to score")))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(score, T.DoubleType())])
    scored = partial(
        _score, name=score, terms=model.terms, weights=model.weights, bias=model.bias
    )
    return rows.mapInArrow(scored, schema)
