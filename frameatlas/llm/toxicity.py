"""Abusive, hateful and sexually explicit documents.

A subsequence-kernel SVM with Nyström landmarks scores every sentence of every
document (whole texts, windows of long sentences); a document's score is its worst
sentence's.  Labels are given for documents, some of them wrongly, so training works
on sentences: those of documents labelled 0 are negative; of a document labelled 1 the
sentences that the kernel finds worst, judged by models trained without the document,
are positive.  No word list takes part: the start is the log odds of the kernel's own
hashed subsequences, and every later choice is the machine's, apart from sentences that
the labels alone convict (``_Bags.evident``): those are positive and among the landmarks
even if nothing else resembles them.

Training takes about ``max_labelled`` different labelled texts (whole texts, by hash;
all of them in the given data).  Everything else runs where the documents lie, in one
pass without a shuffle, with a weight table of a MB; a task scores a sentence once,
however many of its documents hold it.

Defined cases: null and empty texts and texts without a letter, digit or star get no
score (null) and are not flagged; without a document labelled 1 and one labelled 0
nothing is flagged and scores are null; repeated documents get equal scores and train
once, by the label that most of them have; a document labelled twice counts by its
highest label.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.llm import strkernel
from frameatlas.runtime import hash_sample, materialize, single_blas_thread, table

LEVEL = 1e-3  # chance at which the labels alone convict a sentence
KEPT = 200_000  # scored sentences that a task remembers


def _cut(batches):
    for b in batches:
        rows = [(d, t, s) for d, t, x in zip(b["doc_id"], b["toxic"], b["text"]) for s in dict.fromkeys(strkernel.sentences(x))]
        yield pd.DataFrame(rows, columns=["doc_id", "toxic", "sentence"])


def training_sentences(docs: DataFrame, labels: DataFrame, max_labelled: int) -> pd.DataFrame:
    """``doc_id, toxic, sentence`` of labelled texts, bounded by whole texts.

    Copies of a text count once, with the label that most of them have (1 where both are as many), so
    the bound holds that many different texts, however often a text is repeated.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text").join(own, "doc_id")
    one = materialize(texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")), "labelled")
    some = hash_sample(one.df, "doc_id", max_labelled, one.rows())
    out = some.select("doc_id", "toxic", "text").mapInPandas(_cut, "doc_id long, toxic int, sentence string").toPandas()
    one.drop()
    return out


def _log_odds(texts: list[str], plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight table of the log odds of hashed subsequences, and their rarity."""
    size = 1 << strkernel.BITS
    p, n = np.full(size, 1e-2), np.full(size, 1e-2)
    feats = strkernel.sparse(texts)
    for (ids, w), a, b in zip(feats, plus, minus):
        if a:
            np.add.at(p, ids, a * w)
        if b:
            np.add.at(n, ids, b * w)
    rarity = strkernel.rarities([ids for ids, _ in feats])
    return (np.log(p / p.sum()) - np.log(n / n.sum())) * rarity, rarity


class _Bags:
    """Labelled documents as bags of distinct sentences; a pair is one sentence of one document.

    Copies (documents of the same sentences) are one bag with the label that most of them
    have: else a machine that isn't shown a document would know it from its copies.
    """

    def __init__(self, rows: pd.DataFrame, folds: int, rng):
        rows = rows.drop_duplicates(["doc_id", "sentence"])
        self.texts, s = np.unique(rows.sentence.to_numpy(object), return_inverse=True)
        docs, b = np.unique(rows.doc_id.to_numpy(), return_inverse=True)
        label = np.zeros(len(docs), int)
        np.maximum.at(label, b, rows.toxic.to_numpy(int))
        order = np.lexsort((s, b))
        seen: dict[bytes, int] = {}
        kind = np.array([seen.setdefault(part.tobytes(), len(seen)) for part in np.split(s[order], np.searchsorted(b[order], np.arange(1, len(docs))))], int)
        self.label = (2 * np.bincount(kind, label) >= np.bincount(kind)).astype(int)
        one = np.isin(b, np.unique(kind, return_index=True)[1])
        self.s, self.b = s[one], kind[b[one]]
        self.on = self.label[self.b] == 1
        self.fold = rng.integers(0, folds, len(seen))[self.b]
        self.n1, self.n0 = self.count(self.on), self.count(~self.on)
        # labels are wrong at times, but a sentence of which a third of the labels say 0 is no candidate
        self.open = 2 * self.n0 <= self.n1
        self.cand = self.on & self.open[self.s]

    def evident(self, start: np.ndarray, level: float = LEVEL) -> np.ndarray:
        """Sentences (a mask) that the labels alone convict: too many of their documents are labelled 1 for chance.

        The bound on that chance is Chernoff's, ``exp(-n KL)``.  A document that a stronger sentence explains speaks
        for no other one.
        """
        p, bar = self.label.mean(), -np.log(level)
        left = {int(i): set() for i in np.flatnonzero(self.open & (self.n1 > 1))}
        for i, b in zip(self.s[self.cand].tolist(), self.b[self.cand].tolist()):
            if i in left:
                left[i].add(b)

        def proof(i: int) -> float:
            n1, n0 = len(left[i]), self.n0[i]
            q = n1 / max(1, n1 + n0)
            return 0.0 if q <= p else n1 * np.log(q / p) + (n0 * np.log((1 - q) / (1 - p)) if n0 else 0.0)

        out, told = np.zeros(len(self.texts), bool), set()
        heap = [(-proof(i), -start[i], i) for i in left]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= bar:
            have, _, i = heapq.heappop(heap)
            left[i] -= told
            now = proof(i)
            if now < -have:
                heapq.heappush(heap, (-now, -start[i], i))
                continue
            out[i] = True
            told |= left[i]
        return out

    def count(self, pairs: np.ndarray) -> np.ndarray:
        return np.bincount(self.s[pairs], minlength=len(self.texts))

    def best(self, score: np.ndarray, n: int, above: float, least: float) -> np.ndarray:
        """Candidate pairs (a mask): per document the ``n`` best and all above a bound, if over ``least``."""
        at = np.flatnonzero(self.cand)
        at = at[np.lexsort((self.s[at], -score[at], self.b[at]))]
        b = self.b[at]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        out = np.zeros(len(self.s), bool)
        out[at[((rank < n) | (score[at] > above)) & (score[at] > least)]] = True
        return out

    def worst(self, score: np.ndarray) -> np.ndarray:
        out = np.full(len(self.label), -np.inf)
        np.maximum.at(out, self.b, score)
        return out


def train(rows: pd.DataFrame, landmarks: int = 300, negatives: int = 4_000, folds: int = 4, c: float = 6.0, rounds: int = 3, share: float = 0.025, seed: int = 3):
    """``(weights, rarity, bias)``, or None without documents of both labels.

    Labelled documents are richer in cases than others; ``share`` is the share of cases
    among all documents that the decision threshold is set for.
    """
    if rows.empty or rows.toxic.nunique() < 2:
        return None
    single_blas_thread()
    rng = np.random.default_rng(seed)
    bags = _Bags(rows, folds, rng)
    texts, n0, s = bags.texts, bags.n0, bags.s
    if not bags.open.any() or not (n0 > 0).any():
        return None
    # start: log odds of subsequences, each half of the sentences judged by the other
    per_bag = np.bincount(bags.b[bags.cand], minlength=len(bags.label))
    plus = np.bincount(s[bags.cand], 1.0 / per_bag[bags.b[bags.cand]], len(texts))
    start = np.zeros(len(texts))
    for half in (0, 1):
        use = np.arange(len(texts)) % 2 != half
        start[~use] = strkernel.score(list(texts[~use]), *_log_odds(list(texts[use]), plus[use], n0[use]), 0.0)
    sure = bags.evident(start)
    # a pool of likely positives and of common, hard and any negatives
    likely = np.unique(s[bags.best(start[s], 3, np.inf, -np.inf) | (bags.cand & sure[s])])
    innocent = np.flatnonzero(~bags.open & (n0 > 0))
    by_count, by_start = innocent[np.lexsort((innocent, -n0[innocent]))], innocent[np.lexsort((innocent, -start[innocent]))]
    pool = list(dict.fromkeys([*likely, *by_count[: negatives // 4], *by_start[: negatives // 4], *rng.permutation(innocent)]))[: len(likely) + negatives]
    few = min(len(likely), landmarks // 2)
    order = np.argsort(-start[likely], kind="stable")
    first = rng.permutation(np.flatnonzero(sure[likely]))[:few]
    rest = rng.permutation(order[: max(few, len(likely) // 2)])
    marks = [*first, *rest[~np.isin(rest, first)][: few - len(first)], *(len(likely) + rng.permutation(len(pool) - len(likely)))[: landmarks - few]]
    machine = strkernel.Machine([texts[i] for i in pool], [int(i) for i in marks])
    # what is thought of every pair by a machine that didn't see its document
    held = start[s]
    for r in range(rounds):
        shown = np.where(sure[s], np.maximum(held, 1 + np.abs(held).max()), held)  # what is evident is a document's witness
        witness = bags.best(shown, 1, np.inf, -np.inf) if r == 0 else bags.best(shown, 1, 0.0, -0.9)  # below, the label is taken for wrong
        # an innocent document's sentence that the other documents contradict doesn't train
        minus_pairs = ~bags.on & ~bags.open[s] & ((held < 0.9) | (r == 0))
        at = np.array(pool)
        inside = np.full(len(texts), -1)
        inside[at] = np.arange(len(at))

        def fit(pairs: np.ndarray, first: np.ndarray | None) -> np.ndarray:
            plus, minus = bags.count(witness & pairs)[at], bags.count(minus_pairs & pairs)[at]
            use = (plus > 0) | (minus > 0)
            up = max(1.0, 0.2 * (minus > 0).sum() / max(1, (plus > 0).sum()))
            load = np.where(plus > 0, up * np.minimum(5, plus), np.minimum(40, minus))
            return machine.fit(np.flatnonzero(use), np.where(plus[use] > 0, 1.0, -1.0), load[use], c, first)

        w = fit(np.ones(len(s), bool), None)
        table = machine.table(w)
        score = strkernel.score(list(texts), table, machine.rarity, float(w[-1]))
        held = score[s]
        for f in range(folds):
            own = np.flatnonzero((bags.fold == f) & (inside[s] >= 0))
            held[own] = machine.values(fit(bags.fold != f, w), inside[s[own]])
        # what the machine takes for a case outside the pool joins it: hard negatives and better witnesses
        out = inside < 0
        hard = np.flatnonzero(out & (n0 > 0) & ~bags.open & (score > -0.6))
        better = np.flatnonzero(out & bags.open & (score > -0.3))
        new = [*hard[np.argsort(-score[hard], kind="stable")][: negatives // 4], *better]
        if r + 1 < rounds and new:
            machine.add([texts[i] for i in new])
            pool.extend(new)
    worst, label = bags.worst(held), bags.label
    cuts = np.linspace(-0.2, 0.6, 33)
    tp = np.array([((worst > t) & (label == 1)).sum() for t in cuts])
    heavy = max(1.0, (label == 1).sum() * (1 - share) / share / max(1, (label == 0).sum()))
    wrong = heavy * np.array([((worst > t) & (label == 0)).sum() for t in cuts])
    f1 = 2 * tp / np.maximum(1, tp + wrong + (label == 1).sum())
    return table, machine.rarity, float(w[-1]) - float(np.mean(cuts[f1 >= f1.max() - 0.004]))


class _Scorer:
    """Scores of raw sentences, remembered within a task."""

    def __init__(self, model):
        self.weights, self.rarity, self.bias = model
        self.known: dict[str, float] = {}

    def documents(self, texts) -> np.ndarray:
        """Worst sentence of every text; nan where nothing can be scored."""
        cut = [strkernel.raw_sentences(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({s for c in cut for s in c if s not in self.known})
        parts = [strkernel.windows(s) for s in strkernel.normal_all(new)]
        sizes = np.array([len(p) for p in parts])
        flat = [w for p in parts for w in p]
        worst = np.full(len(new), np.nan)
        if flat:
            values = strkernel.score(flat, self.weights, self.rarity, self.bias)
            some = sizes > 0
            worst[some] = np.maximum.reduceat(values, (np.cumsum(sizes) - sizes)[some])
        self.known.update(zip(new, worst.tolist()))
        out = np.full(len(cut), np.nan)
        for i, c in enumerate(cut):
            v = [x for x in map(self.known.__getitem__, c) if x == x]
            if v:
                out[i] = max(v)
        return out


def score_documents(docs: DataFrame, model: tuple | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` (null without text) and ``flagged``; one pass, no shuffle."""
    base = docs.select(*keep, F.col("text").alias("_text"))
    if model is None:
        return base.select(*keep, F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_text") + ", score double, flagged boolean"

    def run(batches):
        scorer = _Scorer(shared.value)
        for b in batches:
            worst = scorer.documents(b.column("_text").to_pylist())
            missing = np.isnan(worst)
            flagged = np.where(missing, False, worst > 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(worst, mask=missing), pa.array(flagged)], names=[*keep, "score", "flagged"])

    return base.mapInArrow(run, schema)


def scored(spark, sf_dir: str, max_labelled: int = 20_000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_sentences(docs, table(spark, sf_dir, "doc_labels"), max_labelled))
    return score_documents(docs, model, ["doc_id", "source"])


def p10_found(spark, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("flagged").select("doc_id")


def p10_scores(spark, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "source", F.round("score", 6).alias("score"), "flagged")


def p10_source_rates(spark, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_docs"), 6))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}
