"""Toxicity by maximum-scoring segments of token log-odds.

Units are words and their first 4 to 7 letters. From labelled documents every unit gets the log-odds of its
rate among the tokens of toxic against those of clean documents, with a Dirichlet prior that is proportional
to the unit's rate overall, less CAUTION standard errors, which follow from the documents that hold it: tokens
of one document are no independent witnesses. A unit counts from LEAST on. One rule holds at every size of
the sample: few documents make large errors. A token scores the largest log-odds of its units, or a small
negative drift. A linear-time scan finds all maximal scoring segments of a text; under the clean model their
scores follow an extreme value law, E = K n exp(-lambda S), whose lambda and K are estimated on the clean
training documents. The significant segments' normalised scores are summed and a logistic curve, fitted on
the training sample, turns the sum and the best segment into the probability of label 1.

Training reads a sample of at most TOXIC_DOCS and CLEAN_DOCS labelled documents, picked by a hash of the id;
the driver gets the units that count, a histogram of token scores and three numbers a sampled document.

Defined results: null, blank and wordless texts have no segment and get the curve's value there; a null id
is not held out (its fold is unknown) and does not train; with no labelled toxic or clean document every
score is 0; repeated labels of one id count once, by their largest; extra columns are ignored; an empty table
gives an empty answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLOTS, Columns, arrow_rows, filtered, fold, slot, written

TOXIC_DOCS, CLEAN_DOCS = 4000, 8000
PREFIXES = (4, 5, 6, 7)
#: Documents of the sample that must hold a unit; the prior's weight in tokens of either class, and what of it
#: never vanishes; the drift of all other tokens.
SUPPORT, PRIOR, FLOOR, DRIFT = 3, 4.0, 0.25, -0.02
#: Tokens of a unit in one document that count, least log-odds, and standard errors that they are lowered by.
CLIP, LEAST, CAUTION = 8, 2.5, 2.0
THRESHOLD = 0.3
#: Bytes that separate tokens: ASCII signs that are neither letter nor digit.
SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[str]:
    return text.lower().encode("utf-8", "replace").translate(SPACED).decode("utf-8").split() if text else []


def units(words: Iterable[str]) -> Counter[str]:
    """Units of tokens with their counts: words, and prefixes marked by a star."""
    out: Counter[str] = Counter()
    for w, n in Counter(words).items():
        out[w] += n
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    score: float


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[Segment]:
    """All maximal scoring segments of (start, end, score) stretches, in linear time (Ruzzo and Tompa)."""
    total, held = 0.0, []  # (left total, right total, start, end)
    for start, end, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        item = [before, total, start, end]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= item[0]:
                j = held[j][4]
            if j < 0 or held[j][1] >= item[1]:
                held.append([*item, j])
                break
            item = [held[j][0], item[1], held[j][2], item[3]]
            del held[j:]
    return [Segment(a, b, r - l) for l, r, a, b, _ in held]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 0.01  # K
    weights: tuple[float, float, float] | None = None
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.heads = {u.rstrip("*")[: PREFIXES[0]] for u in self.odds}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def value(self, word: str) -> float:
        best = self.odds.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.odds.get(word[:n] + "*", 0.0))
        return best

    def valued(self, text: str | None) -> np.ndarray:
        """The value of each token; 0 stands for the drift."""
        words, heads, n = tokens(text), self.heads, PREFIXES[0]
        out = np.zeros(len(words))
        cache = self._cache
        if len(cache) > 300_000:
            cache.clear()
        for i, w in enumerate(words):
            if w[:n] in heads:
                v = cache.get(w)
                if v is None:
                    v = cache[w] = self.value(w)
                out[i] = v
        return out

    def segments(self, text: str | None) -> tuple[int, list[Segment]]:
        """Number of tokens, and the maximal segments by token place."""
        values, runs, last = self.valued(text), [], 0
        for i in np.flatnonzero(values).tolist():
            if i > last:
                runs.append((last, i, (i - last) * DRIFT))
            runs.append((i, i + 1, float(values[i])))
            last = i + 1
        return len(values), maximal_segments(runs)

    def evidence(self, n: int, segments: list[Segment]) -> tuple[float, float]:
        """(sum of the significant segments' normalised scores, best segment's score)."""
        level = math.log(max(1.0, self.scale * n))
        normal = [self.rate * s.score - level for s in segments] or [-level]
        return sum(x for x in normal if x > 0) or max(normal), max((s.score for s in segments), default=0.0)

    def score(self, text: str | None) -> tuple[float, list[Segment]]:
        if self.weights is None:
            return 0.0, []
        n, segments = self.segments(text)
        a, b, c = self.weights
        total, best = self.evidence(n, segments)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a * squash(total) + b * best + c)))), segments


def squash(x: float) -> float:
    """Signed log, so that long documents don't outweigh all others in the fit."""
    return math.copysign(math.log1p(abs(x)), x)


def karlin_rate(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1 for scores of negative mean."""
    if (values * share).sum() >= 0 or values.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    excess = lambda r: float((share * np.exp(np.minimum(r * values, 700))).sum()) - 1
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression on standardised columns by Newton steps that are halved until the loss falls,
    so that separable samples end in finite weights; the last weight is the constant's and is not shrunk."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-12] = 1.0
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step, now, t = np.linalg.solve(h, g), loss(w), 1.0
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return np.r_[slopes, w[-1] - slopes @ mean]


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """(toxic, text) of the bounded sample. use filters labels by doc_id."""
    known = labels.where(use & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda k, most: F.lit(min(SLOTS, SLOTS * most // max(1, sizes.get(k, 1)) + 1))
    few = known.where(slot("id") < F.when(F.col("toxic") == 1, share(1, TOXIC_DOCS)).otherwise(share(0, CLEAN_DOCS)))
    # bounded by the shares above, so it may be sent to every task; twice the bound is never reached
    few = few.limit(2 * (TOXIC_DOCS + CLEAN_DOCS))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text")).join(F.broadcast(few), "id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    sampled = written(labelled_sample(docs, labels, use), "labelled")

    def count(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            held: dict[str, list[int]] = {}
            for toxic, text in zip(b["toxic"], b["text"]):
                k = int(toxic == 1)
                for u, n in units(tokens(text)).items():
                    found = held.setdefault(u, [0, 0, 0, 0])
                    found[k] += 1
                    found[2 + k] += min(n, CLIP)
            yield {"unit": list(held), **{c: [v[i] for v in held.values()] for i, c in enumerate(("d0", "d1", "c0", "c1"))}}

    def size(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            yield {"toxic": b["toxic"], "n": [len(tokens(t)) for t in b["text"]]}

    told = {r["toxic"]: r for r in arrow_rows(sampled, size, "toxic int, n bigint").groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    if len(told) < 2:
        return Model()
    n1, n0 = max(1, told[True]["n"]), max(1, told[False]["n"])
    counted = arrow_rows(sampled, count, "unit string, d0 bigint, d1 bigint, c0 bigint, c1 bigint").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1"))).where(F.col("d0") + F.col("d1") >= SUPPORT)
    share = (F.col("c0") + F.col("c1")) / F.lit(float(n0 + n1))
    toxic, clean = F.col("c1") + PRIOR * share + FLOOR, F.col("c0") + PRIOR * share + FLOOR
    error = F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))
    odds = F.log(toxic / F.lit(n1 + PRIOR)) - F.log(clean / F.lit(n0 + PRIOR)) - F.lit(CAUTION) * error
    model = Model({r["unit"]: r["odds"] for r in counted.withColumn("odds", odds).where(F.col("odds") >= LEAST).select("unit", "odds").collect()})

    def measure(batches: Iterable[Columns]) -> Iterator[Columns]:
        """Per document its tokens and best segment; with the first of a batch, how often each score was hit in clean ones."""
        for b in batches:
            hits: Counter[float] = Counter()
            best, sizes = [], []
            for toxic, text in zip(b["toxic"], b["text"]):
                n, segments = model.segments(text)
                sizes.append(n)
                best.append(max((s.score for s in segments), default=0.0))
                if toxic != 1:
                    v = model.valued(text)
                    hits.update(v[v > 0].tolist())
            more = [list(hits.items())] + [[]] * (len(sizes) - 1)
            yield {"toxic": b["toxic"], "n": sizes, "best": best, "hits": [[{"value": v, "n": n} for v, n in h] for h in more]}

    measured = written(arrow_rows(sampled, measure, "toxic int, n bigint, best double, hits array<struct<value double, n bigint>>"), "measured")
    calm = [(r["n"], r["best"]) for r in measured.where("toxic <> 1").select("n", "best").collect()]
    hist = measured.select(F.explode("hits").alias("h")).groupBy("h.value").agg(F.sum("h.n").alias("n")).collect()
    n_tokens, n_hits = max(1, sum(n for n, _ in calm)), sum(r["n"] for r in hist)
    if hist:
        values = np.array([*(r["value"] for r in hist), DRIFT])
        rates = np.array([*(r["n"] / n_tokens for r in hist), max(0.0, 1 - n_hits / n_tokens)])
        model.rate = min(4.0, max(0.25, karlin_rate(values, rates)))
    # one exceedance is expected per clean document at its best segment
    model.scale = (len(calm) + 1) / (sum(n * math.exp(-model.rate * best) for n, best in calm) + 1)

    def weigh(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = [model.evidence(*model.segments(t)) for t in b["text"]]
            yield {"toxic": b["toxic"], "total": [squash(total) for total, _ in found], "best": [best for _, best in found]}

    rows = arrow_rows(sampled, weigh, "toxic int, total double, best double").collect()
    # the sample holds more toxic documents than the corpus; the curve keeps the sample's rates
    model.weights = tuple(logistic(np.array([(r["total"], r["best"]) for r in rows]), np.array([float(r["toxic"] == 1) for r in rows])).tolist())
    return model


def score_documents(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, and the passages as (start, end, score) of tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = [sent.value.score(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "held_out": b["held_out"],
                "score": [f[0] for f in found],
                "predicted": [int(f[0] >= THRESHOLD) for f in found],
                "passages": [[{"start": s.start, "end": s.end, "score": s.score} for s in f[1]] for f in found],
            }

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), F.col("text"))
    return arrow_rows(rows, run, "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start int, end int, score double>>")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs that are not predicted toxic; every row is judged on its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: [sent.value.score(t)[0] < THRESHOLD for t in texts], "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, fold("doc_id", 4) != 2)
    return score_documents(docs, model, fold("doc_id", 4) == 2).select("doc_id", "held_out", "score", "predicted")
