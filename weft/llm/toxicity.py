"""Toxicity by a classifier chain.

Categories are predicted in a fixed order; each later linear model also sees the earlier categories' probabilities, and is trained on
out-of-fold predictions of them, so that it never learns from answers an earlier model has memorised. The categories are ``insult``
and ``contempt`` (labelled toxic and holding one of the category's seed words) and last ``toxic`` itself (the label).

Features are the presence of words and of word beginnings (a stem has many forms). The classifier
is fitted on a bounded sample of labelled rows, chosen by hash, half of them toxic if there are enough: SAMPLE rows give the vocabulary
(the features whose share among toxic documents most surely exceeds that among all), MAX_ROWS of them the models. As the sample's mix of
classes isn't that of the labels, rows weigh the inverse of their class's sampling rate in the fits and in the threshold, which is the one
with the best F1 out of fold.

Nulls: a null text has no words; without labels nothing is toxic (probabilities 0.0). Documents are judged one by one, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, kept_rows, small_batches, words

# Seed words of the finer categories.
SEEDS = {
    "insult": ["idiot", "moron", "loser", "clown", "scum"],
    "contempt": ["pathetic", "worthless", "disgusting", "trash", "stupid"],
}
#: Lengths of the word beginnings that are features; they are written with a star.
STEMS = (4, 6)
#: SAMPLE labelled rows choose the vocabulary, MAX_ROWS of them fit the models.
MAX_WORDS, MIN_DOCS, MIN_Z, SAMPLE, MAX_ROWS, FOLDS = 512, 5, 4.0, 20_000, 8000, 5


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, rate) of at most about ``most`` labelled rows, half of them toxic if there are enough: those with the smallest hash of
    their id; ``rate`` is the share of a row's class that is taken. Of several labels of a document the largest counts. Only the sampled labels
    (some 24 bytes each) are broadcast; no text of other rows is shuffled. Equal rows count once, and of rows that share an id so often that
    the sample would outgrow twice its size those with the smallest hash of the text stay."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    one = one.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    counts = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    span = 1 << 32
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)), F.lit(span))
    cap = lambda k: min(1.0, most / 2 / max(1, counts.get(k, 1)))
    picked = one.withColumn("rate", F.when(F.col("toxic") == 1, cap(1)).otherwise(cap(0))).filter(rank < F.col("rate") * span)
    found = cut(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]), "sampled")
    size = {r.toxic: r["count"] for r in found.groupBy("toxic").count().collect()}
    tied = F.xxhash64("text", F.col("doc_id").cast("string"))
    if max(size.values(), default=0) <= most:  # always, unless an id has very many rows
        return found
    parts = [found.filter(F.col("toxic") == k).orderBy(rank, tied).limit(most) for k in (0, 1)]
    return parts[0].union(parts[1])


def features(w):
    """The distinct words and starred word beginnings of an array of words."""
    def stems(n: int):
        return F.transform(F.filter(w, lambda x: F.length(x) >= n), lambda x: F.concat(F.left(x, F.lit(n)), F.lit("*")))

    return F.array_distinct(F.concat(w, *map(stems, STEMS)))


def vocabulary(rows: DataFrame, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> list[str]:
    """The features most surely more frequent among toxic documents of the sample ``rows``; the best max_words come to the driver."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total.n or 0, total.t or 0
    if not t or t == n:
        return []
    per = rows.select("toxic", F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("d"))
    # signed root of the likelihood ratio of "the word is as frequent in toxic as in all documents"
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    expected = F.col("d") * (t / n)
    z = F.when(F.col("a") > expected, F.sqrt(F.greatest(F.lit(0.0), 2 * (term(F.col("a"), expected) + term(F.col("d") - F.col("a"), F.col("d") - expected))))).otherwise(0.0)
    best = per.filter(F.col("a") >= min_docs).withColumn("z", z).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(max_words)
    return sorted(r.word for r in best.collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12, start: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps from ``start`` (the bias is the last weight and isn't shrunk); one class only gives a constant.
    A row counts ``weight`` times (once by default)."""
    w = np.zeros(x.shape[1] + 1)
    weight = np.ones(len(y)) if weight is None else weight
    rate = ((weight * y).sum() + 0.5) / (weight.sum() + 1.0)
    w[-1] = np.log(rate / (1 - rate))
    if y.min(initial=1) == y.max(initial=0):
        return w
    if start is not None:
        w = start.copy()
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        g, hess = shrink * w, np.diag(shrink)
        for i in range(0, len(x), 1024):  # a part of the rows at a time bounds what is copied
            part = np.hstack([x[i : i + 1024], np.ones((len(x[i : i + 1024]), 1), x.dtype)])
            p, a = prob(part[:, :-1], w), weight[i : i + 1024]
            g += part.T @ (a * (p - y[i : i + 1024]))
            hess += (part * (a * (p * (1 - p) + 1e-9))[:, None].astype(x.dtype)).T @ part
        s = np.linalg.solve(hess, g)
        w -= s
        if np.abs(s).max() < 1e-2:
            break
    return w


def prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    vocab: dict[str, int]
    categories: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, in chain order."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, prob(np.hstack([x, out]), w)[:, None]])
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, vocab: list[str], categories: list[str], folds: int = FOLDS, seed: int = 5, weight: np.ndarray | None = None) -> Chain:
    """y: one column for each category, in chain order; weight: how often each row counts (once by default)."""
    weight = np.ones(len(x)) if weight is None else weight
    chain = Chain({w: i for i, w in enumerate(vocab)}, categories)
    fold = np.random.default_rng(seed).permutation(len(x)) % folds
    oof = np.zeros((len(x), 0), np.float32)
    for k in range(y.shape[1]):
        xk = np.hstack([x, oof])
        chain.weights.append(logistic(xk, y[:, k], weight=weight))
        p = np.zeros(len(x))
        for f in range(folds):
            if (fold == f).any():
                p[fold == f] = prob(xk[fold == f], logistic(xk[fold != f], y[fold != f, k], rounds=4, start=chain.weights[-1], weight=weight[fold != f]))
        oof = np.hstack([oof, p[:, None].astype(np.float32)])
    last, truth = oof[:, -1], y[:, -1]
    cuts = np.linspace(0.3, 0.95, 66)
    f1 = [2 * weight[(last >= c) & (truth > 0)].sum() / max(1e-9, weight[last >= c].sum() + weight[truth > 0].sum()) for c in cuts]
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    chain.threshold = float(cuts[best[len(best) // 2]])
    return chain


def _presence(texts: list[str | None], vocab: dict[str, int]) -> np.ndarray:
    """Which vocabulary words stand in each text; words as in ``common.words``."""
    x = np.zeros((len(texts), len(vocab)), np.float64)
    keys = vocab.keys()
    for i, t in enumerate(texts):
        if t:
            found = {w.decode("utf-8", "replace") for w in set(t.encode("utf-8", "replace").translate(_TABLE).split(b"\0"))}
            for w in keys & found:
                x[i, vocab[w]] = 1
            for n in STEMS:
                for w in keys & {f"{w[:n]}*" for w in found if len(w) >= n}:
                    x[i, vocab[w]] = 1
    return x


#: Bytes of words stay (A-Z as a-z), every other ASCII byte becomes a zero byte.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seeds: dict[str, list[str]] = SEEDS) -> Chain | None:
    rows = labelled(docs, labels).select("doc_id", "toxic", "rate", words(F.col("text")).alias("w"))
    rows = cut(rows.select("doc_id", "toxic", "rate", F.array_join(features(F.array_distinct("w")), " ").alias("text")), "labelled")
    vocab = vocabulary(rows)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not vocab or len(counts) < 2:
        return None
    share = {k: min(1.0, max_rows / 2 / v) for k, v in counts.items()}
    # another seed than in labelled(), whose rows all have small ranks; as a part of the class's share, so that head() cuts all classes alike
    own = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 32)) / (own * (1 << 32))
    has = {c: F.arrays_overlap(F.split("text", " "), F.lit(ws)) for c, ws in seeds.items()}
    # only which of the vocabulary's words a row has comes to the driver
    seen = F.array_intersect(F.split("text", " "), F.lit(vocab))
    own_rows = rows.withColumn("rank", rank).filter("rank < 1")
    if own_rows.count() > 2 * max_rows:  # never, unless an id has very many rows
        own_rows = own_rows.orderBy("rank", F.xxhash64("text")).limit(2 * max_rows)
    picked = own_rows.select("rank", "toxic", (1 / (F.col("rate") * own)).alias("weight"), seen.alias("seen"), *[(v & (F.col("toxic") == 1)).cast("int").alias(c) for c, v in has.items()])
    got = picked.toPandas().sort_values(["rank", "toxic"])
    at = {w: i for i, w in enumerate(vocab)}
    x = np.zeros((len(got), len(vocab)), np.float32)
    for i, s in enumerate(got["seen"]):
        x[i, [at[w] for w in s]] = 1
    weight = got["weight"].to_numpy(float)
    return fit_chain(x, got[[*seeds, "toxic"]].to_numpy(float), vocab, [*seeds, "toxic"], weight=weight / weight.mean())


def _predicted(chain: Chain | None, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of the n categories, rejected) of each text, a part at a time."""
    p = np.zeros((len(texts), n))
    if chain:
        for i in range(0, len(texts), 512):
            p[i : i + 512] = chain.predict(_presence(texts.slice(i, 512).to_pylist(), chain.vocab))
    return p, p[:, -1] >= (chain.threshold if chain else 2)


def judge(docs: DataFrame, chain: Chain | None, keep: list[str], categories: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus one probability for each category and ``rejected``."""
    small_batches(docs.sparkSession)
    cats = chain.categories if chain else categories or [*SEEDS, "toxic"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [f"p_{c}" for c in cats]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, bad = _predicted(chain, b.column(0), len(cats))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(p[:, k]) for k in range(len(cats))], pa.array(bad)], [*keep, *names, "rejected"])

    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}, rejected boolean")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, p_insult, p_contempt, p_toxic, rejected."""
    return judge(docs, fit(docs, labels), ["doc_id"])


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with the columns they had; each row is judged by itself, and each column sent once. Rows with a
    null or empty text stay, as do null doc_ids; repeated rows are judged alike."""
    chain = fit(docs, labels)
    return kept_rows(docs, lambda texts: ~_predicted(chain, texts, len(SEEDS) + 1)[1])
