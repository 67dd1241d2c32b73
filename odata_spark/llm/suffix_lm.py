"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the text's tokens, each token closed by a space and the text by an end
symbol, so that the model also spells words it has never seen. All training documents are
counted: 6-grams of symbols per batch, summed in Spark, and marginalised to shorter ones.
A context of up to DEPTH symbols is a candidate if it was seen LEAST times. It is retained, with
its suffixes, if its next-symbol distribution diverges from its parent's: n * KL >= GAIN. All next
symbols of a context count, so that distributions sum to one. Distributions are smoothed towards
the parent's, and the longest retained suffix scores each symbol.

The tree grows with the corpus and stays in Spark, dealt by the last LOW + 1 symbols of context:
each task has all contexts that end so, and the counts of the grams of LOW + 1 symbols, which the
alphabet bounds. It scores the grams of its part. Grams with a share of HOT_GRAM or more of all
places (at most 1 / HOT_GRAM of them) are looked up in the scan; all others are joined by gram.

The base score needs the training count of every token. Tokens with a share of HOT or more (at
most 1 / HOT of them) are looked up in the scan; all others are joined by token. So no key of
that join exceeds those shares of the rows.

Defined results: a null or empty text is the end token alone. Repeated rows are scored alike,
each on its own. Without training rows N = V = 0 and symbols are uniform. An empty table gives
an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, materialize, ship

DEPTH = 5  # symbols of context; with the next one they fit 64 bits
LEAST, HOT, HOT_GRAM, GAIN, STRENGTH = 2, 1e-5, 1e-7, 12.0, 4.0
LOW = 2  # contexts of up to so many symbols are known to every task
END = b"\x00"  # the end symbol; a NUL in a text is counted as byte 1
END_WORD = b" "  # the end token among words, which hold no space
SYMBOLS = 256
MASK = np.uint64((1 << 48) - 1)
CACHE_BITS = 18
OUT_ROWS = 50_000  # rows that the executor gets from Python at once
HELD = 1_000_000  # counts of a kind that a task adds up before it hands them on
BUFFER = 4_000_000  # grams that a task counts at once
CHUNK, CHUNK_TEXTS = 1 << 19, 1 << 15  # bytes of texts, and texts, that are read at once
_FOLD = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256)).lower()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def codes(words: list[bytes]) -> np.ndarray:
    """Six symbols in each number, the last one lowest: one number for each symbol of the text."""
    raw = np.frombuffer(END * DEPTH + b" ".join(words).replace(END, b"\x01") + b" " * bool(words) + END, np.uint8).astype(np.uint64)
    n = len(raw) - DEPTH
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        out |= raw[k : k + n] << np.uint64(8 * (DEPTH - k))
    return out


def gram_key(gram: int) -> bytes:
    """Among words, which hold no space."""
    return b" " + gram.to_bytes(DEPTH + 1, "big")


@dataclass
class Chunk:
    """Some texts of a batch, read together: the words of all, and the grams of all, in the order of the texts."""

    at: int  # the first text's place in the batch
    words: pa.Array  # the different words
    codes: np.ndarray  # of each word of the texts, its place in `words`
    n_words: np.ndarray  # of each text
    grams: np.ndarray
    n_grams: np.ndarray  # of each text

    def __len__(self) -> int:
        return len(self.n_words)


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """tokens and codes of the texts, about CHUNK bytes of them at once."""
    texts = pa.array([], texts.type) if not len(texts) else texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).tolist() if len(texts) else [0]
    data = memoryview(texts.buffers()[2] or b"") if len(texts) else memoryview(b"")
    i = 0
    while i < len(texts):
        j = i + 1
        while j < len(texts) and j - i < CHUNK_TEXTS and ends[j + 1] - ends[i] <= CHUNK:
            j += 1
        yield _chunk(i, [data[ends[k] : ends[k + 1]] for k in range(i, j)])
        i = j


def _chunk(first: int, texts: list[memoryview]) -> Chunk:
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(_FOLD), np.uint8)
    space = raw == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # each word with one space after it
    size = np.array([len(t) + 1 for t in texts])
    size = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
    raw = raw[keep]
    last, ends = np.flatnonzero(raw == 32), np.cumsum(size)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(last), [None, pa.py_buffer(np.concatenate([[0], last + 1]).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    n_words = np.diff(np.searchsorted(last, ends), prepend=0)
    if not raw.all():
        raw = np.maximum(raw, 1)
    # Between texts, the end symbol and the context of the next text's first symbol.
    view, starts = memoryview(raw), ends - size
    line = END * DEPTH + (END * DEPTH).join([view[i:j] for i, j in zip(starts.tolist(), ends.tolist())]) + END
    one = np.frombuffer(line, np.uint8).astype(np.uint64)
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    grams = four[:-2] << np.uint64(16) | two[4:]
    own = np.ones(len(grams), bool)
    gap = (ends + DEPTH * np.arange(len(ends)))[:-1, None] + np.arange(1, DEPTH)
    own[gap.ravel()] = False
    return Chunk(first, pc.binary_slice(spelled.dictionary.cast(pa.binary()), 0, -1), spelled.indices.to_numpy(), n_words, grams[own], size + 1)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys each key begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, training -> partial counts: training tokens (word) and 6-grams (gram; n in training texts, places in all).

    A task adds up its own counts and hands them on when it holds more than HELD different ones of a kind.
    """
    names, one = ["word", "gram", "n", "places"], np.uint64(1)
    raw: list[np.ndarray] = []  # grams not yet counted, twice the gram and one more if in a training text
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    words: list[pa.Table] = []
    ends = 0

    def count() -> None:
        if raw:
            grams.append(np.unique(np.concatenate(raw), return_counts=True))
            raw.clear()

    def merge_grams() -> None:
        if len(grams) > 1:
            g, c = (np.concatenate(x) for x in zip(*grams))
            order = np.argsort(g, kind="stable")
            g = g[order]
            at = _runs(g)
            grams[:] = [(g[at], np.add.reduceat(c[order], at))]

    def merge_words() -> None:
        if len(words) > 1:
            words[:] = [pa.concat_tables(words).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]

    def flush_grams() -> Iterator[pa.RecordBatch]:
        for both, c in grams:
            g = both >> one
            at = _runs(g)
            places, n = np.add.reduceat(c, at), np.add.reduceat(np.where(both & one, c, 0), at)
            g = g[at].astype(np.int64)
            for i in range(0, len(g), OUT_ROWS):
                j = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(g[j]), pa.binary()), pa.array(g[j]), pa.array(n[j]), pa.array(places[j])], names)
        grams.clear()

    def flush_words() -> Iterator[pa.RecordBatch]:
        for t in words:
            for b in t.combine_chunks().to_batches(max_chunksize=OUT_ROWS):
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.nulls(len(b), pa.int64()), b.column("n"), pa.nulls(len(b), pa.int64())], names)
        words.clear()

    size = 0
    for b in batches:
        for x in chunks(b.column(0)):
            training = b.column(1).slice(x.at, len(x)).to_numpy(zero_copy_only=False).astype(bool)
            c = np.bincount(x.codes[np.repeat(training, x.n_words)], minlength=len(x.words))
            seen = np.flatnonzero(c)
            words.append(pa.table({"word": x.words.take(pa.array(seen)), "n": c[seen]}))
            ends += int(training.sum())
            raw.append(x.grams << one | np.repeat(training, x.n_grams).astype(np.uint64))
            size += len(raw[-1])
            if size > BUFFER:
                count()
                size = 0
                if sum(len(g) for g, _ in grams) > 2 * HELD:
                    merge_grams()
                    if len(grams[0][0]) > HELD:
                        yield from flush_grams()
            if sum(map(len, words)) > 2 * HELD:
                merge_words()
                if len(words[0]) > HELD:
                    yield from flush_words()
    count()
    merge_grams()
    yield from flush_grams()
    if ends:
        words.append(pa.table({"word": pa.array([END_WORD], pa.binary()), "n": [ends]}))
    merge_words()
    yield from flush_words()


class SuffixTree:
    """Retained contexts and their log10 probabilities, as sorted arrays of (context, symbol) codes by length."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], gain: float = GAIN, also: dict[int, np.ndarray] | None = None):
        """levels[k]: context codes, next symbols, counts, and the context's own total, for contexts of k symbols.

        also: by length, contexts of `levels` to retain since longer ones, not in `levels`, are.
        """
        self.contexts: list[np.ndarray] = [np.zeros(1, np.uint64)]
        base = np.full(SYMBOLS, 0.5)
        np.add.at(base, levels[0][1].astype(int), levels[0][2])
        self.root = np.log10(base / base.sum())
        self.entries: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0))]
        self.escape: list[np.ndarray] = [np.zeros(1)]
        keep: list[np.ndarray] = []
        for k in range(1, len(levels)):
            ctx, sym, n, total = levels[k]
            parent = self._prob(ctx & np.uint64((1 << 8 * (k - 1)) - 1), sym, k - 1, everything=True)
            p = (n + STRENGTH * 10**parent) / (total + STRENGTH)
            uniq, at = np.unique(ctx, return_inverse=True)
            div = np.bincount(at, n * (np.log(p) - parent * math.log(10)), len(uniq)) if len(uniq) else np.zeros(0)
            totals = np.zeros(len(uniq))
            totals[at] = total
            keep.append(np.union1d(uniq[div >= gain], (also or {}).get(k, uniq[:0])))
            self.contexts.append(uniq)
            code = ctx << np.uint64(8) | sym.astype(np.uint64)
            order = np.argsort(code)
            self.entries.append((code[order], np.log10(p[order])))
            self.escape.append(np.log10(STRENGTH / (totals + STRENGTH)))
        self.retained: list[np.ndarray] = [np.zeros(1, np.uint64)] + keep
        for k in range(len(keep), 1, -1):  # suffixes of retained contexts
            self.retained[k - 1] = np.union1d(self.retained[k - 1], self.retained[k] & np.uint64((1 << 8 * (k - 1)) - 1))
        for k in range(1, len(levels)):
            self.escape[k] = self.escape[k][np.searchsorted(self.contexts[k], self.retained[k])] if len(self.retained[k]) else np.zeros(0)
        self.contexts = self.retained

    def _prob(self, ctx: np.ndarray, sym: np.ndarray, k: int, everything: bool = False) -> np.ndarray:
        """log10 probability after the longest known suffix of at most k symbols."""
        out = self.root[sym.astype(int)]
        factor = np.zeros(len(ctx))
        done = np.zeros(len(ctx), bool)
        for j in range(min(k, len(self.contexts) - 1), 0, -1):
            todo = np.flatnonzero(~done)
            if not len(todo) or not len(self.contexts[j]):
                continue
            c = ctx[todo] & np.uint64((1 << 8 * j) - 1)
            at = np.minimum(np.searchsorted(self.contexts[j], c), len(self.contexts[j]) - 1)
            known = self.contexts[j][at] == c
            todo, c, at = todo[known], c[known], at[known]
            code = c << np.uint64(8) | sym[todo].astype(np.uint64)
            keys, logs = self.entries[j]
            e = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
            hit = keys[e] == code if len(keys) else np.zeros(len(code), bool)
            out[todo[hit]] = logs[e[hit]] + factor[todo[hit]]
            done[todo[hit]] = True
            factor[todo[~hit]] += self.escape[j][at[~hit]]
        out[~done] += factor[~done]
        return out

    def cache(self) -> list[np.ndarray]:
        return new_cache()

    def log10(self, grams: np.ndarray, cache: list[np.ndarray]) -> np.ndarray:
        """Of each symbol, by 6-gram code."""
        return cached(grams, cache, lambda g: self._prob(g >> np.uint64(8), (g & np.uint64(255)).astype(np.int64), DEPTH))


def new_cache() -> list[np.ndarray]:
    return [np.full(1 << CACHE_BITS, MASK + np.uint64(1), np.uint64), np.zeros(1 << CACHE_BITS)]


def cached(grams: np.ndarray, cache: list[np.ndarray], find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """find(grams), which is called on distinct ones that the cache lacks."""
    slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
    out = cache[1][slot]
    miss = np.flatnonzero(cache[0][slot] != grams)
    if len(miss):
        g, at = np.unique(grams[miss], return_inverse=True)
        p = find(g)
        out[miss] = p[at]
        s = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        cache[0][s], cache[1][s] = g, p
    return out


class HotGrams:
    """Grams in order of their hashes' first bits, with where each value of these begins, and log10 of their probabilities."""

    def __init__(self, grams: np.ndarray, p: np.ndarray, places: np.ndarray):
        """places: the grams of many come first among those of equal bits."""
        self.shift = np.uint64(63 - len(grams).bit_length())
        slot = self._slot(grams)
        order = np.lexsort((-places, slot))
        self.grams, self.p = np.append(grams[order], MASK + np.uint64(1)), np.append(p[order], np.nan)
        self.first = np.searchsorted(slot[order], np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability; NaN for other grams."""
        slot = self._slot(grams)
        at = self.first[slot]
        hit = self.grams[at] == grams
        out = np.where(hit, self.p[at], np.nan)
        todo = np.flatnonzero(~hit)
        at, end = at[todo], self.first[slot[todo] + 1]
        while len(todo):
            at = at + 1
            more = np.flatnonzero(at < end)
            todo, at, end = todo[more], at[more], end[more]
            hit = self.grams[at] == grams[todo]
            out[todo[hit]] = self.p[at[hit]]
            todo, at, end = todo[~hit], at[~hit], end[~hit]
        return out


def level(grams: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts of k symbols, those seen LEAST times, from grams (all those that end with such a context and a symbol)."""
    g, at = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
    n = np.bincount(at, n, len(g))
    c, at = np.unique(g >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, n, len(c))[at]
    keep = (total >= LEAST) & (n > 0)
    return (g >> np.uint64(8))[keep], (g & np.uint64(255)).astype(np.int64)[keep], n[keep], total[keep]


def gram_scores(grams: DataFrame) -> DataFrame:
    """grams (gram, n, places) -> gram, places, and log10 of its last symbol's probability after the others."""
    mask = (1 << 8 * (LOW + 1)) - 1
    low = grams.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    low_grams, low_n = low["g"].to_numpy(np.int64).astype(np.uint64), low["n"].to_numpy(float)
    lows = [level(low_grams, low_n, k) for k in range(LOW + 1)]
    shared = grams.sparkSession.sparkContext.broadcast(lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        gram, n, places = (np.concatenate([b.column(i).to_numpy() for b in t]) for i in range(3))
        g = gram.astype(np.uint64)
        tree = SuffixTree([*shared.value, *(level(g, n.astype(float), k) for k in range(LOW + 1, DEPTH + 1))])
        own = np.isin(g >> np.uint64(8) & np.uint64(mask), tree.retained[LOW + 1])
        p = tree._prob(g >> np.uint64(8), (g & np.uint64(255)).astype(np.int64), DEPTH)
        for i in range(0, len(g), OUT_ROWS):
            j = slice(i, i + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(gram[j]), pa.array(places[j]), pa.array(p[j], mask=~own[j])], ["gram", "places", "p"])

    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(mask))
    scored = materialize(grams.repartition(ending).mapInArrow(run, "gram long, places long, p double"), "lm_grams")
    also, suffix = {}, F.shiftright("gram", 8)
    for k in range(1, LOW + 1):
        found = scored.where("p is not null").select(suffix.bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("c")).distinct().collect()
        also[k] = np.array(sorted(r["c"] for r in found), np.uint64)
    top = grams.sparkSession.sparkContext.broadcast(SuffixTree(lows, also=also))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, p = b.column(0).to_numpy().astype(np.uint64), b.column(2).to_numpy(zero_copy_only=False).copy()
            todo = np.flatnonzero(np.isnan(p))
            p[todo] = top.value._prob(g[todo] >> np.uint64(8), (g[todo] & np.uint64(255)).astype(np.int64), LOW)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], ["gram", "places", "p"])

    return scored.mapInArrow(fill, "gram long, places long, p double")


def _rows(b: pa.RecordBatch, x: Chunk, hot_grams: HotGrams, hot: pa.Array, logs: np.ndarray) -> pa.RecordBatch:
    """uid, doc_id and text of a chunk -> its texts' rare tokens and grams, each a row, that are joined with their counts and scores.

    doc_id and the sums over the others are only on a text's first row. hot: the other tokens, and logs: what each adds.
    """
    texts = np.arange(len(x))
    place = pc.index_in(pa.concat_arrays([x.words, pa.array([END_WORD], pa.binary())]), hot).fill_null(-1).to_numpy()
    of, at = np.repeat(texts, x.n_words), place[x.codes]
    known = at >= 0
    hits, base = np.bincount(of[known], minlength=len(x)), np.bincount(of[known], logs[at[known]], len(x)).astype(float)
    # A text's place above the word's and the gram's.
    rare, tf = np.unique(of[~known] << 32 | x.codes[~known], return_counts=True)
    logp = hot_grams.find(x.grams)
    cold = np.flatnonzero(np.isnan(logp))
    gram, spots = np.unique(np.repeat(texts, x.n_grams)[cold].astype(np.uint64) << np.uint64(48) | x.grams[cold], return_counts=True)
    logp[cold] = 0
    score = np.add.reduceat(logp, np.cumsum(x.n_grams) - x.n_grams)
    packed = np.full((len(gram), DEPTH + 2), ord(b" "), np.uint8)  # gram_key of each
    packed[:, 1:] = gram.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 7 - DEPTH :]
    word = [x.words.take(pa.array(rare & 0xFFFFFFFF)), pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(np.arange(0, (len(gram) + 1) * (DEPTH + 2), DEPTH + 2, dtype=np.int32)), pa.py_buffer(packed)])]
    own = [rare >> 32, (gram >> np.uint64(48)).astype(np.int64)]
    if place[-1] >= 0:
        hits, base = hits + 1, base + logs[place[-1]]
        bare = np.flatnonzero(np.bincount(np.concatenate(own), minlength=len(x)) == 0)  # need a row: a key that nothing has
        word.append(pa.array([b"  "] * len(bare), pa.binary()))
    else:
        bare = texts
        word.append(pa.array([END_WORD] * len(bare), pa.binary()))
        tf = np.concatenate([tf, np.zeros(len(gram), np.int64), np.ones(len(bare), np.int64)])
    own = np.concatenate([*own, bare])
    tf, spots = np.concatenate([tf, np.zeros(len(own) - len(tf), np.int64)]), np.concatenate([np.zeros(len(rare), np.int64), spots, np.zeros(len(bare), np.int64)])
    at = np.full(len(own), -1)
    first = np.empty(len(x), np.int64)
    first[own[::-1]] = np.arange(len(own))[::-1]
    at[first] = texts
    once = pa.array(at, mask=at < 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(b.column(0).to_numpy()[own]), b.column(1).take(once), pa.concat_arrays(word), pa.array(tf), pa.array(spots), *(pa.array(y).take(once) for y in (x.n_words + 1, hits, base, score))],
        ["uid", "doc_id", "word", "tf", "places", "toks", "hits", "base", "score"],
    )


def score_documents(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and what other base scores need: train_words (V) and log_counts, the sum of log10(c + 1).

    base_score divides each token by (N + 1) * (V + 1), which is no distribution; the query op3 has its own.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    held = crc_mod(F.col("doc_id"), mod) == rest
    counts = docs.select("text", (~held).alias("training")).mapInArrow(_count, "word binary, gram long, n long, places long")
    counts = materialize(counts.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("places").alias("places")), "lm_counts")
    words, grams = counts.where("word is not null").select("word", F.col("n").alias("c")), counts.where("word is null").select("gram", "n", "places")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    n, v = int(n), int(v)
    floor = max(1.0, HOT * n)
    hot = {bytes(r["word"]): int(r["c"]) for r in words.where(F.col("c") >= floor).collect()}
    scored = materialize(gram_scores(grams), "lm_scores")
    often = max(1.0, HOT_GRAM * (scored.agg(F.sum("places")).first()[0] or 0))
    top = scored.where(F.col("places") >= often).select("gram", "p", "places").toPandas()
    found = HotGrams(top["gram"].to_numpy(np.int64).astype(np.uint64), top["p"].to_numpy(float), top["places"].to_numpy(np.int64))
    model = spark.sparkContext.broadcast((found, pa.array(hot.keys(), pa.binary()), np.log10(np.array([*hot.values()], float) + 1)))
    scale = math.log10(n + 1) + math.log10(v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in chunks(b.column(2)):
                yield _rows(b.slice(x.at, len(x)), x, *model.value)

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = rows.mapInArrow(run, f"uid long, doc_id {kind}, word binary, tf long, places long, toks long, hits long, base double, score double")
    keys = lambda batches: (pa.RecordBatch.from_arrays([pa.array([gram_key(x) for x in b.column(0).to_pylist()], pa.binary()), pa.nulls(b.num_rows, pa.int64()), b.column(1)], ["word", "c", "p"]) for b in batches)
    cold = words.where(F.col("c") < floor).withColumn("p", F.lit(None).cast("double"))
    cold = cold.union(scored.where(F.col("places") < often).select("gram", "p").mapInArrow(keys, "word binary, c long, p double"))
    c = F.coalesce("c", F.lit(0))
    joined = rows.join(cold, "word", "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("toks").cast("long").alias("n_tokens"),
        (F.sum("hits") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).cast("long").alias("n_known"),
        (F.sum("base") + F.sum(F.col("tf") * F.log10(c + 1))).alias("logs"),
        (F.sum("score") + F.sum(F.when(F.col("places") > 0, F.col("places") * F.col("p")).otherwise(0.0))).alias("score"),
    )
    return joined.select(
        "doc_id", (crc_mod(F.col("doc_id"), mod) == rest).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score", F.lit(v).cast("long").alias("train_words"), F.col("logs").alias("log_counts"),
    )
