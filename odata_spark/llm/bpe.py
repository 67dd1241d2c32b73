"""BPE encoding and decoding with forced boundaries, from a public tokenizer's JSON file.

The file's normaliser (NFC, runs of white space to one space, lower case), its special tokens
and its word pattern are applied first. Inside a word, two neighbouring bytes that stand side
by side in no vocabulary token can never be merged, so the word is cut there for certain; the
fragments are encoded independently by merge rank and concatenated. Fragments and words are
remembered in bounded tables.

Defined results: a null or empty text has no tokens; repeated rows give equal values; an
empty table gives an empty table; only doc_id and text are read, and only doc_id and the computed
columns returned.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship

MEMO = 300_000


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    def __init__(self, spec_json: str):
        """spec_json: what the tokenizer's JSON file holds."""
        spec = json.loads(spec_json)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.byte = {c: b for b, c in letters.items()}
        self.joined = set()  # pairs of letters that stand side by side in some token
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        for t in self.vocab:
            body = t[: -len(self.end)] if t.endswith(self.end) and len(t) > len(self.end) else t
            self.joined.update(zip(body, body[1:]))
        self.memo: dict[str, tuple[int, ...]] = {}
        # Letters beyond Latin Extended-B: classes and case follow the library's own Unicode tables.
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(spec_json)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.far = regex.compile("[^\\x00-\u024f]")

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """Symbols of a word, cut where no token can reach across; the last symbol carries the word end."""
        symbols = list(symbols)
        cuts = [0, *(i for i in range(1, len(symbols)) if (symbols[i - 1], symbols[i]) not in self.joined), len(symbols)]
        symbols[-1] += self.end
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap over a linked list, for long fragments."""
        import heapq

        n = len(symbols)
        sym, prev, nxt = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] is not None else -1
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = a + b, None, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (r := self.ranks.get((sym[k], sym[nxt[k]]))) is not None:
                    heapq.heappush(heap, (r, k, sym[k], sym[nxt[k]]))
        return [s for s in sym if s is not None]

    def word(self, word: str, symbols: str | None = None) -> tuple[int, ...]:
        symbols = [self.letter[b] for b in word.encode("utf-8")] if symbols is None else list(symbols)
        ids = [self.vocab[s] for part in self.fragments(symbols) for s in (self.merge(part) if len(part) < 40 else self.merge_long(part))]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if word and len(word) < 64:
            self.memo[word] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        if "<|" in text:
            for m in self.special_pattern.finditer(text):
                self._plain(text[at : m.start()], ids)
                ids.append(self.special[m[0]])
                at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        if not text:
            return
        if self.far.search(text):
            for symbols, _ in self.split(self.normalize(text)):
                ids.extend(self.word("", symbols))
            return
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        known, add = self.memo.get, ids.extend
        for w in self.words.findall(text):
            add(known(w) or self.word(w))

    def decode(self, ids) -> str:
        """Tokens joined by spaces: the file names no decoder, so tokens come out as they are written."""
        token = self.token
        return " ".join([token[i] for i in ids])


_loaded: dict[int, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    with open(path, encoding="utf-8") as f:
        return ForcedBoundaryBPE(f.read())


def loaded(spec_json: str) -> ForcedBoundaryBPE:
    """One per process and file."""
    key = hash(spec_json)
    if key not in _loaded:
        _loaded[key] = ForcedBoundaryBPE(spec_json)
    return _loaded[key]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of their decoded text; with_ids: the ids and the text too."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:  # the driver's file goes along with the job; its size does not depend on the documents
        spec = spark.sparkContext.broadcast(f.read())
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            ids, counts, a, d, all_ids, texts = b.column(0), [], [], [], [], []
            for i in range(b.num_rows):
                got = bpe.encode(b.column(1)[i].as_py() or "")
                text = bpe.decode(got)
                counts.append(len(got))
                a.append(hashlib.sha256(np.array(got, dtype="<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(got)
                    texts.append(text)
            out = {"doc_id": ids, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}{more}")
