"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text is lower-cased and all but letters become word ends; the character n-grams of its words (with their ends) are hashed into
``DIM`` buckets. The mean of the buckets' embeddings goes through a linear softmax. Embeddings and softmax are trained together by
minibatch SGD on a bounded sample: ``per_lang`` rows of each label, fewer where that makes over MAX_ROWS rows or MAX_GRAMS counted n-grams,
chosen by hash over all labelled rows. Over MAX_LANGS labels raise an error rather than leave any out.
A quarter of the sample is kept back: on it a temperature is fitted, and a rejection threshold below nearly all right answers.

Prediction reads whole texts, long ones as a stream of parts whose n-grams are exactly those of the whole, and nothing but the text. Because the model is linear behind the mean, embedding times softmax is one
table (DIM x languages, 4 bytes each: under 1 MB for 16 languages) and is sent to the tasks with the function.

Nulls: a null text, or one without a letter, is ``und`` with score 0.0 and is rejected. A null doc_id counts as held out. Without any
labelled row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, kept_rows, small_batches

DIM, EMBED, ORDERS = 1 << 14, 16, (1, 2, 3)
PER_LANG, EPOCHS, BATCH, RATE = 600, 12, 32, 0.5
#: Bounds of what is learnt from: labels, rows, and distinct n-grams of all rows together (8 bytes each on the driver).
MAX_LANGS, MAX_ROWS, MAX_GRAMS = 1024, 16_384, 24_000_000
#: Texts of more characters are counted by themselves, so many characters at a time.
LONG = 200_000
#: Of right answers on the kept-back rows, the share that may fall under the rejection threshold; the threshold never exceeds one half.
REJECT = 0.002
UND = "und"


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id's text is divisible by ``folds``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (made once in each worker)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _grams(codes: np.ndarray, dim: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, place of the middle letter) of all n-grams of one order after another; 0 is a word end and no two stand together."""
    ok = codes > 0
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        inner = np.ones(len(h), bool)
        for i in range(n):
            part = slice(i, len(codes) - n + 1 + i)
            h = (h * np.uint64(0x100000001B3)) ^ (codes[part] + np.uint64(1))
            if n == 1 or 0 < i < n - 1:
                inner &= ok[part]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        yield (h[inner] % np.uint64(dim)).astype(np.int32), np.flatnonzero(inner) + n // 2


def _codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text, 0 for all but letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[codes], codes, 0).astype(np.uint64)


def buckets(texts: list[str], dim: int = DIM, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text of each n-gram) for a few texts at once."""
    low = [t.lower() for t in texts]
    codes = _codes(f" {' '.join(low)} ")
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, low), np.int64, len(low)) + 1)
    owner = np.concatenate([[0], owner])[: len(codes)]
    keep = (codes > 0) | np.concatenate([[True], codes[:-1] > 0])  # one word end between words
    codes, owner = codes[keep], owner[keep]
    got = [(b, owner[at]) for b, at in _grams(codes, dim, orders)]
    return (np.concatenate([b for b, _ in got]), np.concatenate([w for _, w in got])) if got else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def counted(text: str, dim: int = DIM, orders: tuple[int, ...] = ORDERS, step: int = LONG) -> np.ndarray:
    """How often each bucket occurs in one text, in parts: a part starts with the last letters of the one before, whose own n-grams count once."""
    low, n = text.lower(), np.zeros(dim, np.int64)
    carry = np.zeros(1, np.uint64)  # a word end before the first word
    for at in range(0, len(low) + 1, step):
        new = _codes(low[at : at + step] if at + step <= len(low) else low[at:] + " ")
        new = new[(new > 0) | np.concatenate([carry[-1:] > 0, new[:-1] > 0])]
        whole = np.concatenate([carry, new])
        for part, sign in ((whole, 1), (carry, -1)):
            for b, _ in _grams(part, dim, orders):
                n += sign * np.bincount(b, minlength=dim)
        carry = whole[-(max(orders) - 1) :] if max(orders) > 1 else whole[-1:]
    return n


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # DIM x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities, whether the text has a letter). Texts are taken a few at a time, so that memory is bounded by the longest."""
        logits, seen, at, dim = np.zeros((len(texts), len(self.langs)), np.float64), np.zeros(len(texts), bool), 0, len(self.table)
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < LONG:
                size += len(texts[end])
                end += 1
            sums = np.zeros((end - at, len(self.langs)))
            if size > LONG:  # one text
                n = counted(texts[at], dim)
                counts, sums[0] = np.array([n.sum()]), n @ self.table.astype(np.float64)
            else:
                b, who = buckets(texts[at:end], dim)
                counts = np.bincount(who, minlength=end - at)
                for k in range(len(self.langs)):
                    sums[:, k] = np.bincount(who, weights=self.table[b, k], minlength=end - at)
            seen[at:end] = counts > 0
            logits[at:end] = sums / np.maximum(counts, 1)[:, None] + self.bias
            at = end
        return softmax(logits / self.temperature), seen


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True)) if z.size else z
    return e / np.maximum(e.sum(axis=-1, keepdims=True), 1e-300)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], which: np.ndarray, dim: int) -> np.ndarray:
    """Some rows of mean bucket counts; rows are kept as (buckets, counts) and spread out a minibatch at a time."""
    x = np.zeros((len(which), dim), np.float32)
    for i, k in enumerate(which):
        at, n = rows[k]
        x[i, at] = n / n.sum()
    return x


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], *, dim: int = DIM, embed: int = EMBED, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, reject: float = REJECT, seed: int = 7) -> Model:
    """Fit on rows of (buckets, counts); every fourth row calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cal, fit = order[::4], np.setdiff1d(order, order[::4])
    if not len(fit):
        fit = order
    e, w, b = rng.normal(0, 0.1, (dim, embed)), rng.normal(0, 0.1, (embed, len(langs))), np.zeros(len(langs))
    scale = float(dim) ** 0.5  # mean features are small numbers; the embeddings' steps make up for it
    for epoch in range(epochs):
        step = rate / (1 + epoch / 3)
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            x = dense(rows, part, dim)
            h = x @ e
            g = softmax(h @ w + b)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ w.T
            w -= step * (h.T @ g)
            b -= step * 0.1 * g.sum(axis=0)
            at = np.unique(np.concatenate([rows[k][0] for k in part]))
            e[at] -= step * scale * (x[:, at].T @ back)
    table = e @ w
    z = np.vstack([dense(rows, part, dim) @ table for part in np.array_split(cal, max(1, len(cal) // batch))]) + b
    nll = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(cal)), y[cal]], 1e-12)).mean()
    grid = np.geomspace(0.05, 20, 60)
    temperature = float(grid[np.argmin([nll(t) for t in grid])])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[cal]]
    threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return Model(langs, table.astype(np.float32), b, temperature, threshold)


def sample_counts(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[str]]:
    """(buckets, counts) and labels of a bounded sample: about ``per_lang`` rows of each label, those with the smallest hash of id and text.

    Equal rows count once, so a repeated row can't fill the sample; what is left is cut in Spark, by rank as a part of the label's share, so
    that all labels are cut alike: only rows within ``max_grams`` come to the driver.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    small_batches(docs.sparkSession)
    counts = usable.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    if not counts:
        return [], np.zeros(0, int), []
    langs = [r["lang"] for r in counts]
    per = max(1, min(per_lang, max_rows // len(langs)))
    share = {r["lang"]: min(1.0, per / r["count"]) for r in counts}
    span = 1 << 32
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11)), F.lit(span))
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v * span))])
    picked = usable.select("doc_id", "text", "lang", (rank / limit[F.col("lang")]).alias("rank")).filter("rank < 1").dropDuplicates(["doc_id", "text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = counted(batch.column(0)[i].as_py())
                at = np.flatnonzero(n)
                if len(at):
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(x.astype(np.int32))) for x in (at, n[at])]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), *lists], ["lang", "rank", "at", "n"])

    rows = cut(picked.select("text", "lang", "rank").mapInArrow(run, "lang string, rank double, at array<int>, n array<int>"), "sampled")
    first = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # the hash gives per rows of a label on average; never over twice that, and never over max_grams n-grams
    ends = rows.select("rank", F.size("at").alias("grams")).orderBy("rank").limit(2 * per * len(langs)).select("rank", F.sum("grams").over(first).alias("sum"))
    last = ends.agg(F.max(F.when(F.col("sum") <= max_grams, F.col("rank")))).first()[0]
    got = rows.filter(F.col("rank") <= (last if last is not None else -1)).toPandas().sort_values(["lang", "rank"])
    counted_ = [(np.asarray(at, np.int32), np.asarray(n, np.float32)) for at, n in zip(got["at"], got["n"], strict=True)]
    return counted_, np.array([langs.index(v) for v in got["lang"]], int), langs


def fit(docs: DataFrame, **kw) -> Model | None:
    rows, y, langs = sample_counts(docs, **kw)
    return train(rows, y, langs) if rows else None


def _judge(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of each text."""
    whole = [t or "" for t in texts.to_pylist()]
    if model is None:
        return [UND] * len(whole), np.zeros(len(whole)), np.zeros(len(whole), bool)
    p, seen = model.scores(whole)
    score = np.where(seen, np.clip(p.max(axis=1), 0, 1), 0.0)
    return [model.langs[k] if s else UND for k, s in zip(p.argmax(axis=1), seen, strict=True)], score, seen & (score >= model.threshold)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred, score and accepted; reads only the text."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, accepted = _judge(model, b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, **kw) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, accepted. The model is fitted on the rows that aren't held out."""
    return predict(docs.withColumn("held_out", held_out()), fit(docs, **kw), ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, **kw) -> DataFrame:
    """The documents whose language is accepted, with the columns they had; each row is judged by itself, and each column sent once.
    Rows with a null text or one without a letter go; a null doc_id, repeated rows and extra columns change nothing."""
    model = fit(docs, **kw)
    return kept_rows(docs, lambda texts: _judge(model, texts)[2])
