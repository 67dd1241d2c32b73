"""Toxicity by weak supervision.

1. Entries (words, their beginnings, and runs of four characters inside them) are counted over the
   labelled training rows (MAX_LABELLED of them, a documented bound of the sample that the model is
   fitted on; their labels are broadcast, so that no text is shuffled); those that the likelihood ratio finds far more often in toxic texts are
   mined, CAPACITY of them at most, the strongest first (a documented bound of the model's size). A
   beginning counts as a family only if no single word makes up most of its texts. Fixed words that
   labelled rows show to be ordinary ones do not vote.
2. Voters of different evidence vote toxic, clean or abstain on every training document: fixed
   lexicons by kind, mined words, mined families (one word in a hundred or more), several different
   words of any of these, masked words, insults addressed to somebody, threats, shouting, repeated
   punctuation, and the absence of all of it.
3. A generative label model (EM on the histogram of vote patterns, 3 ** len(VOTERS) rows at most)
   estimates each voter's rates on toxic and clean text from all training documents, the labelled
   ones counted with their class besides (semi-supervised EM) and a prior worth PRIOR_ROWS rows, and
   then the correlations that remain given the class; correlated voters share their weight.
4. A linear classifier on words, character runs and patterns is trained by Spark on the posterior
   labels of all training documents. Each fixed word and pattern counts as PSEUDO toxic texts
   more, so that one the corpus lacks is not without weight.

Rows with crc32(doc_id) mod 5 = 0 are held out of all training. Scores read the text only.

Defined results: a null or empty text has no entries and gets the classifier's intercept.
Without labels the fixed lexicons and patterns decide. Repeated rows get equal scores. An empty
table gives an empty table. The two computed columns are added under `names`; on a clash the
computed column wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, crc_mod, materialize, ship

_WORD = re.compile(r"[^\W\d_]+")
GRAM, GRAM_SCALE = 4, 0.3
BEGINNINGS = (4, 5, 6)
CAPACITY, MEMO = 200_000, 400_000
#: Words of texts that a task of mine() counts at once, and rows that the executor gets from Python at once.
TALLY, OUT_ROWS = 150_000, 50_000
MAX_LABELLED = 200_000
PRIOR_ROWS, PSEUDO, RIDGE = 20.0, 3.0, 0.2
#: What tells the classes apart: of toxic texts, so many at most show no voter anything.
SILENT = 0.1
#: General lists of insults, by kind.
LEXICONS = {
    "stupid": frozenset("idiot idiots idiotic moron morons stupid dumb dumbass imbecile imbeciles clown clowns dimwit halfwit retard retarded brainless dummkopf idioten schwachkopf trottel crétin crétins imbécile abruti estúpido estúpida imbécil tonto".split()),
    "contempt": frozenset("scum loser losers pathetic worthless useless trash filth filthy disgusting vermin subhuman parasite parasites maggot maggots swine abschaum dreck miststück wertlos ordure minable misérable escoria basura asqueroso despreciable".split()),
    "obscene": frozenset("bastard bastards bitch bitches asshole assholes fuck fucking fucker fucked shit bullshit whore whores slut sluts cunt dickhead faggot faggots arschloch arschlöcher hurensohn wichser fotze scheiße connard connards salope enculé putain merde gilipollas puta cabrón mierda pendejo".split()),
}
YOU = frozenset("you your youre u ya du dich dir euch ihr tu te toi vous eres usted ustedes vosotros".split())
THREAT = re.compile(
    r"\b(?:i|we|they) (?:will|ll|am going to|are going to|gonna|shall|want to) (?:\w+ )?(?:kill|hurt|beat|destroy|smash|break|murder|stab|shoot|burn|crush) (?:you|your|u|him|her|them)\b"
    r"|\byou (?:will|ll|should|deserve to|are going to|must) (?:\w+ )?(?:die|suffer|burn|bleed|pay|regret)\b|\b(?:kill|hang|drown) yourself\b|\bgo (?:to hell|die)\b"
    r"|\bich (?:werde|will|bring|bringe|mach|mache) (?:dich|euch) (?:um|fertig|kaputt|töten|schlagen)\b|\bje vais (?:te|vous) (?:tuer|frapper|détruire)\b|\b(?:te|os) voy a (?:matar|golpear|destruir)\b"
)
#: A threat needs one of these words, and one of those below, so that others' texts need no pattern.
THREAT_WORDS = frozenset("kill hurt beat destroy smash break murder stab shoot burn crush die suffer bleed pay regret yourself hell um fertig kaputt töten schlagen tuer frapper détruire matar golpear destruir".split())
THREAT_SIGNS = frozenset("i we they you yourself go ich vais voy".split())
_MASKED = re.compile(r"(?<![^\s\"'(,.])[a-z]+(?:[*@$#!0-9]+[a-z]*)+")
_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"})
_INSIDE = re.compile(r"[a-z][*@$#!0-9]+[a-z]")
#: Bytes of lower-case text: all of ASCII but letters is a space; and letters, masks, and the rest.
_SPACED = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
_KINDS = bytes(97 if 97 <= c <= 122 else 42 if c in b"*@$#!0123456789" else 32 for c in range(256))
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_CAPITALS = bytes(range(65, 91))
VOTERS = (*LEXICONS, "mined", "family", "several", "masked", "addressed", "threat", "shouting", "punctuation", "nothing")
PATTERNS = ("family", "several", "masked", "addressed", "threat", "shouting", "punctuation")
FIXED = frozenset().union(*LEXICONS.values())
_ALL_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(FIXED):
    _ALL_BY_LENGTH.setdefault(len(_w), []).append(_w)


def words_of(text: str | None) -> list[str]:
    """What _WORD finds in the text in lower case."""
    low = (text or "").lower()
    return _split(low, low.encode("utf-8", "surrogatepass"))


def _split(low: str, raw: bytes) -> list[str]:
    """raw: low as UTF-8."""
    found = raw.translate(_SPACED).decode("utf-8", "surrogatepass").split()
    if low.isascii() or "".join(found).isalpha():
        return found
    return [w for x in found for w in ((x,) if x.isalpha() else _WORD.findall(x))]


def entries(word: str) -> list[str]:
    """The word; marked with a star its beginnings, and with a tilde the runs of GRAM characters of it and its bounds."""
    if len(word) < GRAM:
        return [word]
    whole = f"<{word}>"
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k), *("~" + whole[i : i + GRAM] for i in range(len(whole) - GRAM + 1))]


def unmasked(raw: str) -> bool:
    """Whether a word with masked letters inside can be one of the fixed lists."""
    plain = raw.translate(_LEET)
    if not raw[-1].isalpha():
        return False
    if "*" not in plain and "#" not in plain:
        return plain in FIXED
    if 2 * sum(c in "*#" for c in plain) > len(plain):
        return False
    pattern = re.compile("".join("." if c in "*#" else re.escape(c) for c in plain))
    return any(pattern.fullmatch(w) for w in _ALL_BY_LENGTH.get(len(plain), ()))


def mine(labelled: DataFrame, least: int = 3, llr: float = 25.0, times: float = 6.0, capacity: int = CAPACITY) -> tuple[list[str], list[str]]:
    """Entries of `least` toxic texts (toxic = 1) or more that are by the likelihood ratio far more frequent there than in
    others; and the fixed words that labelled texts show to be ordinary ones."""

    n = labelled.select("text", "toxic").mapInArrow(_count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    n = materialize(n.where((F.col("a") >= least) | F.col("entry").isin("", *sorted(FIXED))), "toxic_entries")
    total = n.where("entry = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return [], []
    ta, tb = float(total["a"]), float(total["b"])
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ea, eb = (a + b) * (ta / (ta + tb)), (a + b) * (tb / (ta + tb))
    ratio = 2 * (part(a, ea) + part(b, eb) + part(ta - a, ta - ea) + part(tb - b, tb - eb))
    often = (a + 0.5) / (ta + 1) > times * (b + 0.5) / (tb + 1)
    found = n.where((F.col("entry") != "") & (a >= least) & often & (ratio >= llr)).orderBy(ratio.desc(), "entry").limit(capacity).collect()
    largest: Counter = Counter()
    for r in found:
        if r["entry"][-1] != "*" and r["entry"][0] != "~":
            for k in BEGINNINGS:
                largest[r["entry"][:k] + "*"] = max(largest[r["entry"][:k] + "*"], r["a"])
    mined = [r["entry"] for r in found if r["entry"][-1] != "*" or 2 * largest[r["entry"]] < r["a"]]
    ordinary = n.where(F.col("entry").isin(*sorted(FIXED)) & (b >= least) & ((a + 0.5) / (ta + 1) < 2 * (b + 0.5) / (tb + 1)))
    return mined, sorted(r["entry"] for r in ordinary.collect())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> partial counts of the entries' texts, and of all texts (entry ""). A task adds them up and hands them on beyond MEMO."""
    held: list[pa.Table] = []

    def merge() -> None:
        held[:] = [pa.concat_tables(held).group_by("entry", use_threads=False).aggregate([("clean", "sum"), ("toxic", "sum")]).select(["entry", "clean_sum", "toxic_sum"]).rename_columns(["entry", "clean", "toxic"])]

    def flush() -> Iterator[pa.RecordBatch]:
        yield from held.pop().combine_chunks().to_batches(max_chunksize=OUT_ROWS)

    def add(texts: list[list[str]], toxic: list[bool]) -> Iterator[pa.RecordBatch]:
        held.append(_tally(texts, np.array(toxic, bool)))
        if sum(map(len, held)) > 2 * MEMO:
            merge()
            if len(held[0]) > MEMO:
                yield from flush()

    for b in batches:
        texts, toxic, size = [], [], 0
        for text, bad in zip(b.column(0), b.column(1).to_pylist()):
            texts.append(words_of(text.as_py()))
            toxic.append(bad == 1)
            size += len(texts[-1])
            if size > TALLY:
                yield from add(texts, toxic)
                texts, toxic, size = [], [], 0
        if texts:
            yield from add(texts, toxic)
    if held:
        merge()
        yield from flush()


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order; by sorting, which is faster here than numpy's own."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def _tally(texts: list[list[str]], toxic: np.ndarray) -> pa.Table:
    """entry, and how many of the texts (lists of words) that are not toxic and that are have it: what entries() gives, for all at once."""
    counts = [(pa.array([""]), np.array([[np.sum(~toxic)], [np.sum(toxic)]]))]
    raw = "".join([" ".join(x) + " " for x in texts if x]).encode()
    last = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(last), [None, pa.py_buffer(np.concatenate([[0], last + 1]).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    words = pc.binary_slice(spelled.dictionary, 0, -1).cast(pa.large_string()).cast(pa.string())
    long = pc.utf8_length(words).to_numpy()
    pairs = _distinct(np.repeat(np.arange(len(texts)), [len(x) for x in texts]) << 32 | spelled.indices.to_numpy())
    text, word = pairs >> 32, pairs & 0xFFFFFFFF  # each text's different words

    def seen(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        bad = toxic[text]
        return np.stack([np.bincount(at[~bad], minlength=n), np.bincount(at[bad], minlength=n)])

    def once(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        pairs = _distinct(text << 32 | at)
        return seen(pairs >> 32, pairs & 0xFFFFFFFF, n)

    counts.append((words, seen(text, word, len(words))))
    for k in BEGINNINGS:
        own = np.flatnonzero((long > k) & (long >= GRAM))
        found = pc.utf8_slice_codeunits(words.take(pa.array(own)), 0, k).dictionary_encode()
        at = np.full(len(words), -1)
        at[own] = found.indices.to_numpy()
        at = at[word]
        counts.append((pc.binary_join_element_wise(found.dictionary, "*", ""), once(text[at >= 0], at[at >= 0], len(found.dictionary))))
    # Runs of GRAM characters: of each word in turn, those that begin at its bound and at all letters but the last ones.
    own = np.flatnonzero(long >= GRAM)
    bounded = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(own)], pa.int64()), pc.binary_join_element_wise("<", words.take(pa.array(own)), ">", "")), "")[0].as_py()
    points = np.frombuffer(bounded.encode("utf-32-le"), np.uint32)
    begins = np.ones(len(points), bool)
    begins[(np.cumsum(long[own] + 2)[:, None] - np.arange(1, GRAM)).ravel()] = False
    begins = np.flatnonzero(begins)
    pair = pa.array(points[:-1].astype(np.int64) << 21 | points[1:]).dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = pa.array(pair[begins] << 32 | pair[begins + 2]).dictionary_encode()
    run = runs.indices.to_numpy()
    n = np.zeros(len(words), np.int64)
    n[own] = long[own] + 3 - GRAM
    each = n[word]
    at = np.repeat((np.cumsum(n) - n)[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    first = np.empty(len(runs.dictionary), np.int64)
    first[run[::-1]] = begins[::-1]
    letters = points[first[:, None] + np.arange(GRAM)]
    marked = np.concatenate([np.full((len(first), 1), ord("~"), np.uint32), letters], 1)
    size = 1 + (marked > 0x7F) + (marked > 0x7FF) + (marked > 0xFFFF).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size.sum(1))]).astype(np.int32)
    spelling = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(marked.tobytes().decode("utf-32-le").encode())])
    counts.append((spelling, once(np.repeat(text, each), run[at], len(first))))
    n = np.concatenate([c for _, c in counts], 1)
    return pa.table({"entry": pa.concat_arrays([e for e, _ in counts]), "clean": n[0], "toxic": n[1]})


class Reader:
    """Finds the entries of a text that the model knows, its patterns, and the voters' votes."""

    def __init__(self, mined: list[str], ordinary: list[str] = ()):
        self.mined, self.ordinary = frozenset(mined), frozenset(ordinary)
        self.known = self.mined | FIXED
        self.beginnings = {e[:-1] for e in self.known if e[-1] == "*"}
        self.grams = {e[1:] for e in self.known if e[0] == "~"}
        self.memo: dict[str, tuple[tuple[str, ...], int]] = {}
        self.miss: set[str] = set()
        self.bits = {k: 1 << i for i, k in enumerate((*LEXICONS, "mined", "family"))}

    def may_know(self, w: str) -> bool:
        """False only for words without known entries."""
        if w in self.known or w[:4] in self.beginnings or w[:5] in self.beginnings or w[:6] in self.beginnings:
            return True
        whole = f"<{w}>"
        return not self.grams.isdisjoint([whole[i : i + GRAM] for i in range(len(whole) - GRAM + 1)])

    def word(self, w: str) -> tuple[tuple[str, ...], int]:
        """Known entries of the word, and the bits of the voters that it moves."""
        found = tuple(e for e in entries(w) if e in self.known) if self.may_know(w) else ()
        bits = sum(self.bits[k] for k, words in LEXICONS.items() if w in words and w not in self.ordinary)
        if any(e[-1] == "*" for e in found):
            bits |= self.bits["family"]
        elif w in self.mined:
            bits |= self.bits["mined"]
        if not found:
            if len(self.miss) > MEMO:
                self.miss.clear()
            self.miss.add(w)
        else:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[w] = found, bits
        return found, bits

    def read(self, text: str | None) -> tuple[list[str], set[str]]:
        """Known entries (once for each different word that has them), and names of the voters that say toxic."""
        text = text or ""
        low = text.lower()
        raw = low.encode("utf-8", "surrogatepass")
        words = _split(low, raw)
        found: list[str] = []
        bits, hits, family = 0, {}, self.bits["family"]
        memo = self.memo
        for w in set(filterfalse(self.miss.__contains__, words)):
            some, b = memo.get(w) or self.word(w)
            found += some
            if b:
                bits |= b
                hits[w] = b
        votes = {k for k, b in self.bits.items() if bits & b}
        if bits & family and 100 * sum(hits.get(w, 0) & family > 0 for w in words) < len(words):
            votes.discard("family")  # a chance find in a long text
            hits = {w: b for w, b in hits.items() if b != family}
        if len(hits) > 1:
            votes.add("several")
        if b"a*" in raw.translate(_KINDS) and _INSIDE.search(low) and any(unmasked(m) for m in _MASKED.findall(low)):
            votes.add("masked")
        if hits and not YOU.isdisjoint(words) and any(hits.get(w, family) != family and not YOU.isdisjoint(words[max(0, i - 4) : i]) for i, w in enumerate(words)):
            votes.add("addressed")
        if not THREAT_WORDS.isdisjoint(words) and not THREAT_SIGNS.isdisjoint(words) and THREAT.search(" ".join(words)):
            votes.add("threat")
        if "!!" in text or "??" in text or "!?" in text:
            votes.add("punctuation")
        raw = text.encode("utf-8", "surrogatepass")
        capitals = len(raw) - len(raw.translate(None, _CAPITALS))  # three words of three letters, a fifth of all words
        if capitals >= max(9, 0.6 * len(words)) and (n := len(_SHOUT.findall(text))) >= 3 and 5 * n >= len(words):
            votes.add("shouting")
        return found + ["^" + p for p in PATTERNS if p in votes], votes

    @staticmethod
    def votes(said: set[str]) -> tuple[int, ...]:
        """1 toxic, -1 clean, 0 abstains, in the order of VOTERS."""
        v = [int(k in said) for k in VOTERS]
        v[-1] = -1 if said <= {"shouting", "punctuation"} else 0
        return tuple(v)


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, gold: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of each vote pattern; rates and correlations of the voters.

    prior: share of toxic texts among labelled ones; gold: for each pattern, how many labelled rows are toxic, and clean.
    """
    gold = np.zeros((len(votes), 2)) if gold is None else gold
    votes = votes.reshape(-1, len(VOTERS))
    one = np.stack([votes == -1, votes == 1], 2).astype(float)
    style = np.array([v in ("shouting", "punctuation") for v in VOTERS])
    # Voters are better than chance: any that names wording speaks for toxic, and none for clean.
    toxic = np.where((votes[:, ~style] == 1).any(1), 0.9, 0.02)
    share = np.ones(len(VOTERS))
    rho = np.zeros((len(VOTERS),) * 2)
    # Beta priors of PRIOR_ROWS rows for each voter's rate of saying anything.
    before = np.array([[0.25] * (len(VOTERS) - 1) + [0.02], [0.01] * (len(VOTERS) - 1) + [0.9]])
    says = np.array([1] * (len(VOTERS) - 1) + [0])  # which of the two votes each voter can give
    rate, odds = before.copy(), np.zeros(len(VOTERS))
    cast = one[:, np.arange(len(VOTERS)), says]
    for turn in range(2):
        for _ in range(rounds):
            for i, y in enumerate((toxic, 1 - toxic)):
                known = weight * y + gold[:, i]
                rate[i] = (known @ cast + PRIOR_ROWS * before[i]) / (known.sum() + PRIOR_ROWS)
            rate[0, -1] = min(rate[0, -1], SILENT)
            ratio = np.log(rate[0] / rate[1])
            odds = np.where(says == 1, np.maximum(ratio, 0), np.minimum(ratio, 0))  # abstaining tells nothing
            total = weight.sum()
            p = ((weight * toxic).sum() + PRIOR_ROWS * prior) / (total + PRIOR_ROWS)
            p = min(max(p, 1e-4), 0.9)
            z = math.log(p / (1 - p)) + cast @ (odds * share)
            toxic = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if turn == 0 and len(votes):
            for y in (toxic, 1 - toxic):
                w = weight * y / max(1e-9, (weight * y).sum())
                centred = cast - w @ cast
                cov = (centred * w[:, None]).T @ centred
                scale = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
                rho = np.maximum(rho, cov / scale[:, None] / scale)
            np.fill_diagonal(rho, 0)
            share = np.maximum(1 / (1 + np.clip(rho, 0, 1).sum(1)), 0.34)
    return toxic, {"rates": {v: [float(rate[0, k]), float(rate[1, k])] for k, v in enumerate(VOTERS)}, "odds": odds.tolist(), "correlation": rho.tolist()}


def train_linear(rows: DataFrame, names: list[str], ordinary: list[str] = ()) -> tuple[dict[str, float], float]:
    """rows (entries, target, n) -> weight of each name, and the intercept, by Spark's logistic regression.

    A row counts as n * target toxic and n * (1 - target) clean ones. The ridge is that of RIDGE
    rows whatever the number of rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    spark = rows.sparkSession
    pseudo = [([x], 1.0, PSEUDO) for x in [*sorted(FIXED - set(ordinary)), "^masked", "^addressed", "^threat"]] + [([], 0.0, PSEUDO * len(FIXED))]
    pseudo = spark.createDataFrame(pseudo, "entries array<string>, target double, n double")
    both = rows.select("entries", "target", F.col("n").cast("double").alias("n")).union(pseudo)
    both = both.select("entries", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("target")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("target"))).alias("weight")))).alias("x"))
    both = materialize(both.select("entries", "x.label", "x.weight").where("weight > 0"), "toxic_rows")
    total = both.agg(F.sum("weight")).first()[0]
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="entries", outputCol="counts").setMinTF(0.0).transform(both)
    scale = Vectors.dense([GRAM_SCALE if x.startswith("~") else 1.0 for x in names])
    scaled = ElementwiseProduct(scalingVec=scale, inputCol="counts", outputCol="features").transform(counted)
    model = LogisticRegression(maxIter=60, regParam=RIDGE / total, standardization=False, weightCol="weight").fit(scaled.select("features", "label", "weight"))
    found = model.coefficients.toArray()
    return {x: float(w * (GRAM_SCALE if x.startswith("~") else 1.0)) for x, w in zip(names, found)}, float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """docs (doc_id, text), labels (doc_id, toxic). Mining reads the labelled rows that are not held out, max_labelled ids
    of them at most (the first by hash); the label model and the classifier all documents that are not."""
    known, mined, ordinary = _mined(docs, labels, max_labelled)
    training = docs.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(known, "doc_id", "left").select("text", "toxic")
    return _learn(_read(training, mined, ordinary), mined, ordinary)


def fit_and_score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score, predicted of score(docs, fit(docs, labels)); texts are read for both at once."""
    known, mined, ordinary = _mined(docs, labels, max_labelled)
    found = materialize(_read(docs.select("doc_id", "text").join(known, "doc_id", "left").select("doc_id", "text", "toxic"), mined, ordinary), "toxic_read")
    model = _learn(found.where(crc_mod(F.col("doc_id"), 5) != 0), mined, ordinary)
    return _scored(found.select("doc_id", "entries"), "entries", lambda names, ordinary: lambda x: x.as_py(), model, ["doc_id"], ("score", "predicted"))


def _mined(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[DataFrame, list[str], list[str]]:
    """The labels that count (doc_id, toxic), broadcast, and what mine() finds in their texts."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    known = labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = F.broadcast(materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "known"))
    return known, *mine(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"))


def _read(docs: DataFrame, mined: list[str], ordinary: list[str]) -> DataFrame:
    """docs with, instead of the text, its known entries in order and the voters' votes."""
    shared = docs.sparkSession.sparkContext.broadcast((mined, ordinary))
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in batches:
            found, votes = [], []
            for text in b.column(at):
                some, said = reader.read(text.as_py())
                found.append(sorted(some))
                votes.append(list(reader.votes(said)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.list_(pa.string())), pa.array(votes, pa.list_(pa.int8()))], [*kept, "entries", "votes"])

    made = T.StructType([T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("votes", T.ArrayType(T.ByteType()))])
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *made]))


def _learn(read: DataFrame, mined: list[str], ordinary: list[str]) -> dict:
    """The model from the training rows (entries, votes, toxic)."""
    spark = read.sparkSession
    rows = materialize(read.groupBy("entries", "votes", "toxic").agg(F.count("*").alias("n")), "toxic_votes")
    found = rows.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    votes = np.array([r["votes"] for r in found], int).reshape(-1, len(VOTERS))
    seen = rows.where("toxic is not null").groupBy("votes", "toxic").agg(F.sum("n").alias("n")).collect()
    labelled_rows = sum(r["n"] for r in seen)
    prior = min(0.5, max(0.01, sum(r["n"] for r in seen if r["toxic"]) / labelled_rows if labelled_rows else 0.05))
    at = {tuple(v): i for i, v in enumerate(votes.tolist())}
    gold = np.zeros((len(votes), 2))
    for r in seen:
        gold[at[tuple(r["votes"])], 1 - r["toxic"]] += r["n"]
    toxic, about = label_model(votes, np.array([r["n"] for r in found], float), prior, gold)
    patterns = spark.createDataFrame([(v, float(t)) for v, t in zip(votes.tolist(), toxic)], "votes array<tinyint>, target double")
    names = sorted(set(mined) | FIXED | {"^" + p for p in PATTERNS})
    weights, bias = train_linear(rows.join(F.broadcast(patterns), "votes"), names, ordinary)
    return {"names": mined, "ordinary": ordinary, "weights": weights, "bias": bias, "label_model": about}


def score(docs: DataFrame, model: dict, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the probability that a text is toxic, and whether it is 0.5 or more."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in names]

    def entries_of(mined: list[str], ordinary: list[str]) -> Callable[[pa.Scalar], list[str]]:
        reader = Reader(mined, ordinary)
        return lambda x: sorted(reader.read(x.as_py())[0])

    return _scored(docs.select(*keep), "text", entries_of, model, keep, names)


def _scored(docs: DataFrame, source: str, entries_of: Callable, model: dict, keep: list[str], names: tuple[str, str]) -> DataFrame:
    """The columns `keep` and the two of `names`. entries_of: of mined and ordinary entries, makes what reads a row's entries, in order, from `source`."""
    shared = docs.sparkSession.sparkContext.broadcast((model["names"], model["ordinary"], {k: w for k, w in model["weights"].items() if w}, model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mined, ordinary, weights, bias = shared.value
        read, weight = entries_of(mined, ordinary), weights.get
        for b in batches:
            z = [bias + sum(weight(e, 0.0) for e in read(x)) for x in b.column(source)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], [*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)
