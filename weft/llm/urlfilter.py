"""URL filters: rules on host suffix and path prefix, and for the rest naive Bayes over segmented host and path words.

Hosts run words together, so every host label is split by a unigram Viterbi search: known words cost their negative log frequency,
unknown ones a cost that grows with their length. The frequencies are counted over all pages: the words of their texts, and the words that
stand alone between hyphens of distinct hosts; the ``MAX_WORDS`` most frequent are kept, and a short list of common words counts once more.
Multinomial naive Bayes then scores the words of host and path. It is fitted on a
bounded sample of distinct hosts and paths, labelled by seed words among a host's segments (weak labels).

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest rule (host and path
together) wins. Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule, and gets the method's verdict for no
words at all (that of the prior).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import ascii_lower, cut

# The default rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# Common words of hosts, and the words that mark a host as unwanted.
COMMON = (
    "the of and to in for on is by my new your all best free home shop online store web site news blog world media group tech data cloud app "
    "game games play music video photo travel hotel health food car cars auto home house garden city life love kids school learn book books job jobs "
    "work money bank pay card loan credit invest market trade win big top hot live sport sports football team club art design print color style "
    "fashion shoe watch gold silver star sun blue red green black white north south east west america london paris berlin guide review deal deals "
    "sale cheap discount price buy sell gift box hub lab labs link list page mail forum chat wiki help info pro plus max one net mobile phone "
    "pills pill casino bet bets poker slots adult sex dating ads ad track tracker tracking click spam farm pharma viagra lottery x xxx"
).split()
UNWANTED = "pills pill casino bet bets poker slots adult sex ads ad track tracker spam pharma viagra lottery xxx".split()
#: Every seed word counts as seen so often in unwanted hosts.
MAX_URLS, BLOCK_AT, SEED_COUNT = 20_000, 0.5, 20
#: So many words are known to the segmenter at most (some 100 bytes each, sent to the tasks).
MAX_WORDS = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(got, pattern, 1)), F.regexp_extract(got, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, which are longer, override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the split of a run of letters with the least total cost."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values()) or 1.0
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.longest = max(map(len, self.cost), default=1)
        self.total, self.memo = total, {}

    def unknown(self, n: int) -> float:
        return math.log(self.total) + 3.0 * n

    def split(self, run: str) -> list[str]:
        if run in self.memo:
            return self.memo[run]
        best, back, low = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1), (math.inf, 0)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - self.longest), end):
                if (c := self.cost.get(run[start:end])) is not None and best[start] + c < best[end]:
                    best[end], back[end] = best[start] + c, start
            # an unknown word costs a constant and so much a letter, so the best place for it to start is carried along
            if best[end - 1] - 3.0 * (end - 1) < low[0]:
                low = best[end - 1] - 3.0 * (end - 1), end - 1
            if low[0] + 3.0 * end + self.unknown(0) < best[end]:
                best[end], back[end] = low[0] + 3.0 * end + self.unknown(0), low[1]
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        if len(self.memo) < 100_000 and len(run) <= 64:
            self.memo[run] = out[::-1]
        return out[::-1]


def lexicon(words_: list[str] = COMMON, seen: dict[str, int] | None = None) -> dict[str, float]:
    """Counts of the segmenter's words: as seen, common words once more, and unwanted ones as seeds."""
    out = dict.fromkeys(words_, 1.0)
    for w, n in (seen or {}).items():
        out[w] = out.get(w, 0) + n
    return out | {w: max(out.get(w, 0), SEED_COUNT) for w in UNWANTED}


def unigrams(pages: DataFrame, max_words: int = MAX_WORDS) -> dict[str, int]:
    """The most frequent words of all pages' texts and of the hyphenated labels of all distinct hosts, with their counts: at most max_words come
    to the driver, of words that occur equally often the first in order."""
    letters = r"[^\p{L}]+"
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    found = pages.select(F.explode(F.split(F.lower(text), letters)).alias("word"))
    hosts = pages.select(host_path(F.col("url"))[0].alias("h")).distinct()
    labels = hosts.select(F.explode(F.filter(F.split("h", r"\."), lambda x: x.contains("-"))).alias("l"))
    both = found.union(labels.select(F.explode(F.split("l", letters)).alias("word")))
    counts = cut(both.filter(F.length("word").between(2, 64)).groupBy("word").count(), "unigrams")
    # how many words occur how often: a short table, from which follows the least count that max_words leave room for
    left, least = max_words, math.inf
    for r in sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["count"]):
        if r["n"] > left:
            tied = counts.filter(F.col("count") == r["count"]).orderBy("word").limit(left)
            break
        left, least = left - r["n"], r["count"]
    else:
        tied = counts.limit(0)
    whole = counts.filter(F.col("count") >= least) if least < math.inf else counts.limit(0)
    return {r["word"]: r["count"] for r in whole.union(tied).collect()}


def tokens(host: str, path: str, seg: Segmenter) -> tuple[list[str], list[str]]:
    """Host words and path words. The last label isn't a word of the name, nor is www."""
    labels = re.split(r"\.", host.split("@")[-1].split(":")[0])
    names = labels[:-1] or labels
    runs = [r for label in names for r in re.findall(r"[^\W\d_]+|\d+", label) if r != "www"]
    h = [w for r in runs for w in (["#"] if r.isdigit() else seg.split(r))]
    p = [w for r in re.findall(r"[^\W\d_]+|\d+", path) for w in (["#"] if r.isdigit() else [r.lower()])]
    return h, p


@dataclass
class Bayes:
    logs: dict[str, tuple[float, float]]
    prior: tuple[float, float]
    unseen: tuple[float, float]

    def block(self, words_: list[str]) -> float:
        """Probability that it should be blocked; words never seen in training say nothing."""
        a, b = self.prior
        for w in words_:
            if w in self.logs:
                x, y = self.logs[w]
                a, b = a + x, b + y
        return 1 / (1 + math.exp(min(700, a - b)))


def fit(pages: DataFrame, max_urls: int = MAX_URLS, unwanted: list[str] = UNWANTED) -> tuple[Segmenter, Bayes]:
    host, path = host_path(F.col("url"))
    # one path per host and path shape keeps a busy host from filling the sample
    shaped = pages.filter("url IS NOT NULL").select(host.alias("h"), F.regexp_replace(path, r"\d+", "0").alias("p")).groupBy("h", "p").count().select("h", "p")
    n = shaped.count()
    span = 1 << 32
    picked = shaped.filter(F.pmod(F.xxhash64("h", "p", F.lit(17)), F.lit(span)) < int(min(1.0, max_urls / max(1, n)) * span)).orderBy("h", "p").limit(2 * max_urls).collect()
    seg = Segmenter(lexicon(seen=unigrams(pages)))
    counts, docs, bad = (Counter(), Counter()), [0, 0], set(unwanted)
    for r in picked:
        h, p = tokens(r.h, r.p, seg)
        k = int(bool(bad & set(h)))
        docs[k] += 1
        counts[k].update([f"h:{w}" for w in h] + [f"p:{w}" for w in p])
    counts[1].update({f"h:{w}": SEED_COUNT for w in unwanted})
    vocab = set(counts[0]) | set(counts[1])
    size = [sum(c.values()) + len(vocab) + 1 for c in counts]
    logs = {w: (math.log((counts[0][w] + 1) / size[0]), math.log((counts[1][w] + 1) / size[1])) for w in vocab}
    share = min(0.49, max(0.05, (docs[1] + 1) / (sum(docs) + 2)))  # a page without words is allowed
    prior = (math.log(1 - share), math.log(share))
    return seg, Bayes(logs, prior, (0.0, 0.0))


def judge(pages: DataFrame, rules=RULES, max_urls: int = MAX_URLS, block_at: float = BLOCK_AT) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (the method's probability of block) and host_words."""
    seg, bayes = fit(pages, max_urls)
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words_, score = [], []
            for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hw, pw = tokens(h, p, seg)
                words_.append(" ".join(hw))
                score.append(bayes.block([f"h:{w}" for w in hw] + [f"p:{w}" for w in pw]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(score, np.float64)), pa.array(words_, pa.string())], ["page_id", "host", "path", "score", "host_words"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parsed.mapInArrow(run, f"page_id {kind}, host string, path string, score double, host_words string")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"), "score", "host_words")
