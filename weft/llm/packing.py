"""Best-fit packing of token sequences by bin completion.

Documents become token ids with an end id; only documents longer than a sequence are cut. Pieces are then packed by lengths alone:
a bin is opened for the longest piece left and completed with an undominated filling of the rest of the bin (none in which a piece could
be exchanged for a longer one that is left); fillings are searched depth first, branches that would waste more than the best solution
known can afford are cut off, and the best-fit decreasing solution is the first incumbent. As equal lengths are interchangeable, a
filling is applied as often as the counts allow.

Pieces are dealt into groups of about ``GROUP`` by a hash of their running number, so every group is an even mixture of the corpus
however often one document is repeated; a group packs to within about one sequence of the least possible, and no task ever holds more
than a group's lengths.

The search is bounded by ``NODES`` fillings tried in a group; when they are used up the best packing so far stands (never worse than best
fit); at each step the 8 best of the fillings found in 512 looks, at most 16 lengths wide, are tried. A filling is applied as often as it fits, or once where that would waste more than can be afforded.

Nulls: a null text is an empty one: its one piece is the end id. A null doc_id is packed like any other. A special token that stands in a
text literally gets its id, as the plain tokenizer gives it.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, small_batches

CAPACITY, END, GROUP, NODES = 2048, 0, 32_768, 20_000
#: Bytes (as estimated) of pieces that an encoder remembers in each of two generations.
CACHE_BYTES = 24 << 20


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and ignores case, so what stands between ASCII white space is encoded by itself and remembered: at
    most twice CACHE_BYTES of pieces, of which those not met since the last CACHE_BYTES of new ones are forgotten. A letter and a mark after it are
    never in one token, so marks are split off first. New pieces are encoded many at a time: letters alone are one word, whose last id
    is a word end; between others stands a lone 0, whose id no piece without a 0 can give. Texts that hold a special token are split
    there first, as the tokenizer itself does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.marks = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self.tok.encode_special_tokens = True  # what is left between special tokens holds none
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        (self.zero,) = self._encode("0").tolist()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = self._encode(b" ".join(part).decode())
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(part):  # some letter isn't one to the tokenizer
                self.known.update((w, self._encode(w.decode()).tobytes()) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, cut.tolist(), strict=True):
                self.known[w] = raw[at:e]
                at = e

    def _others(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = self._encode(b" 0 ".join(part).decode())
            cut = np.append(np.flatnonzero(ids == self.zero), len(ids)) * 4
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, cut.tolist(), strict=True):
                self.known[w] = raw[at:e]
                at = e + 4

    def _learn(self, new: set[bytes]) -> None:
        if self.older:
            met = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in met)
            new = new.difference(met)
        ascii_ = [w for w in new if w.isalpha()]
        rest = [(w, w.decode()) for w in new.difference(ascii_)]
        wide = [w for w, t in rest if t.isalpha() and t.lower().isalpha()]
        self._letters(ascii_)
        self._letters(wide)
        odd = set(wide)
        self._others([w for w, _ in rest if w not in odd and b"0" not in w])
        self.known.update((w, self._encode(t).tobytes()) for w, t in rest if b"0" in w)
        self.size += sum(180 + len(w) + len(self.known[w]) for w in new)  # two objects and their place in the table, besides the bytes

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """(all ids one after another, offsets of each text in ids)."""
        marked = pc.match_substring_regex(texts, self.marks).to_numpy(zero_copy_only=False) if self.marks else np.zeros(len(texts), bool)
        if not marked.any():
            return self._plain(texts)
        raw, ends = self._plain(pc.if_else(pa.array(marked), "", texts))
        parts, lengths, done = [], np.diff(ends), 0
        for i in np.flatnonzero(marked).tolist():
            own = [self.special[p] if p in self.special else self._plain(pa.array([p], pa.large_string()))[0] for p in re.split(f"({self.marks})", texts[i].as_py())]
            parts += [raw[4 * done : 4 * int(ends[i])], *own]
            done, lengths[i] = int(ends[i]), sum(map(len, own)) // 4
        return b"".join([*parts, raw[4 * done :]]), np.concatenate([[0], np.cumsum(lengths)])

    def _plain(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The same for texts without special tokens. Texts are split and their pieces numbered by Arrow, so that only
        distinct pieces are looked up; the ids are then gathered by number."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([[:punct:]])", r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if new := set(words).difference(self.known):
            self._learn(new)
        own = list(map(self.known.__getitem__, words))
        if self.size > CACHE_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        to = np.cumsum(n)
        ids = np.frombuffer(b"".join(own), "<u4")
        flat = ids[np.repeat(start[at] - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)]
        ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        return flat.tobytes(), ends


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row."""
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers

        # one encoder, with what it has learnt, for all tasks of a worker
        kept = vars(tokenizers).setdefault("_weft_encoders", {})
        enc = kept.get(tokenizer) or kept.setdefault(tokenizer, Encoder(tokenizer))

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            raw, ends = enc.encode(pc.fill_null(pa.concat_arrays([b.column(1) for b in held]), "").cast(pa.large_string()))
            at, piece, start, length, crc = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True)):
                text = raw[lo:hi] + tail
                for k, s in enumerate(range(0, len(text), 4 * capacity)):
                    own = text[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) > 4 << 20:
                yield out(held)
                held = []
        if held:
            yield out(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fillings(counts: np.ndarray, room: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths longest first) of fillings of ``room`` from what is left, best first choice first, at most ``most`` of them.

    Only undominated ones: no length in a filling can be exchanged for a longer one that is left without overfilling.
    """
    seen = 0

    def search(left: int, upper: int, chosen: list[int]):
        nonlocal seen
        fit = np.flatnonzero(counts[1 : min(left, upper) + 1]) + 1
        fit = fit[counts[fit] > [chosen.count(int(f)) for f in fit]] if chosen and len(fit) and chosen[-1] <= min(left, upper) else fit
        if not len(fit):
            yield left, list(chosen)
            return
        rest = left - fit
        # first those that one more piece fills exactly, longest first; then the others, longest first
        exact = rest == 0
        pair = np.zeros(len(fit), bool)
        inside = (rest > 0) & (rest <= fit)
        pair[inside] = counts[rest[inside]] > (rest[inside] == fit[inside])
        order = np.concatenate([np.flatnonzero(exact), np.flatnonzero(pair & ~exact)[::-1], np.flatnonzero(~exact & ~pair)[::-1]])
        for j in order[:16]:
            seen += 1
            if seen > 64 * most:
                return
            chosen.append(int(fit[j]))
            yield from search(left - int(fit[j]), int(fit[j]), chosen)
            chosen.pop()

    got: list[tuple[int, list[int]]] = []
    keys: set[tuple[int, ...]] = set()
    for waste, f in search(room, room, []):
        if (key := tuple(f)) not in keys and not any(_dominated(counts, f, waste)):
            keys.add(key)
            got.append((waste, f))
        if waste == 0 or len(got) >= most:
            break
    yield from sorted(got, key=lambda g: (g[0], [-x for x in g[1]]))


def _dominated(counts: np.ndarray, filling: list[int], waste: int) -> Iterator[bool]:
    """Whether some length of the filling could grow into the waste by exchange with a longer one that is left."""
    for x in set(filling):
        if waste:
            longer = np.flatnonzero(counts[x + 1 : x + waste + 1]) + x + 1
            yield any(counts[y] > filling.count(int(y)) for y in longer)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over a histogram of lengths: (how often, lengths) patterns. The first incumbent."""
    left, out = counts.copy(), []
    top = capacity
    while True:
        at = np.flatnonzero(left[: top + 1])
        if not len(at):
            return out
        top = int(at[-1])
        bin_, room = [top], capacity - top
        left[top] -= 1
        while room:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            x = int(fit[-1])
            left[x] -= 1
            bin_.append(x)
            room -= x
        times = 1
        need = np.bincount(bin_, minlength=len(left))
        used = np.flatnonzero(need)
        more = int((left[used] // need[used]).min())
        times += more
        left[used] -= more * need[used]
        out.append((times, bin_))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest, over every cut a, of: bins for lengths over half, plus what lengths from a to half need beyond the room left by those up to capacity - a."""
    x = np.arange(capacity + 1)
    n, s = np.cumsum(counts[: capacity + 1]), np.cumsum(x * counts[: capacity + 1])
    half = capacity // 2
    a = np.arange(0, half + 1)
    before = np.where(a > 0, np.maximum(a - 1, 0), 0)
    small = s[half] - np.where(a > 0, s[before], 0)
    n_mid, s_mid = n[capacity - a] - n[half], s[capacity - a] - s[half]
    more = np.ceil(np.maximum(0, small - (n_mid * capacity - s_mid)) / capacity)
    return int((n[capacity] - n[half] + more).max())


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that together use ``counts`` up, in as few bins as the search finds."""
    total = int((np.arange(len(counts)) * counts).sum())
    if not total:
        return []
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    n_best = sum(t for t, _ in best)
    budget = [nodes]

    def complete(left: np.ndarray, waste: int) -> list[tuple[int, list[int]]] | None:
        """Depth first with an explicit stack: each level is one filling applied as often as it can be."""
        nonlocal n_best, best
        levels: list[tuple[Iterator, np.ndarray, int, int]] = []
        path: list[tuple[int, list[int]]] = []

        def opened(state, wasted):
            at = np.flatnonzero(state)
            top = int(at[-1])
            state = state.copy()
            state[top] -= 1
            return fillings(state, capacity - top, 8), state, top, wasted

        state, wasted = left, waste
        while True:
            if not state.any():
                if (n := sum(t for t, _ in path)) < n_best:
                    n_best, best = n, list(path)
                if n_best <= least or not levels:
                    return best
                state = None
            if state is not None:
                levels.append(opened(state, wasted))
            while levels:
                it, base, top, wasted = levels[-1]
                nxt = next(it, None)
                budget[0] -= 1
                if budget[0] < 0:
                    return best
                afford = (n_best - 1) * capacity - total
                if nxt is None:
                    levels.pop()
                    if path and len(path) >= len(levels):
                        path.pop()
                    continue
                w, fill = nxt
                if len(path) >= len(levels):
                    path.pop()
                if wasted + w > afford:  # cannot beat the incumbent below here
                    continue
                pattern = [top, *fill]
                need = np.bincount(pattern, minlength=len(base))
                used = np.flatnonzero(need)
                full = base.copy()
                full[top] += 1
                times = int((full[used] // need[used]).min())
                if wasted + times * w > afford:
                    times = 1
                full[used] -= times * need[used]
                path.append((times, pattern))
                state, wasted = full, wasted + times * w
                break
            else:
                return best

    if n_best > least:
        complete(counts, 0)
    return best


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number from 0, offset) of each piece."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    nxt = np.concatenate([[0], np.cumsum(counts)])[: len(counts)].copy()
    seq, off, base = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for times, pattern in pack_lengths(counts, capacity):
        at = 0
        for x in pattern:
            rows = order[nxt[x] : nxt[x] + times]
            seq[rows], off[rows] = np.arange(base, base + times), at
            nxt[x] += times
            at += x
        base += times
    return seq, off


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces that are at rest (a written table: their numbering must not change)."""
    n = parts.count()
    groups = max(1, math.ceil(n / group))
    dealt = parts.withColumn("__g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint"
    names = parts.columns

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        seq, off = place(part["length"].to_numpy().astype(np.int64), capacity)
        return part.select(names).append_column("sequence_id", pa.array(seq + (key[0].as_py() << 32))).append_column("offset", pa.array(off))

    return dealt.groupBy("__g").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place."""
    return pack(cut(pieces(docs, tokenizer, capacity, end), "pieces"), capacity)
