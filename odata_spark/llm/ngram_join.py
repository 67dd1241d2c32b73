"""N-gram Jaccard join by chosen paths.

Each distinct shingle set is a node (a 64-bit signature; copies are counted, not expanded).
In every run, a set chooses about SPREAD of its tokens by hash, so that similar sets choose
shared ones, and so falls into buckets by token; buckets that are too large are split
again by the tokens chosen for the next level, and so on. Small buckets are compared by brute
force on minhash sketches; buckets that stay large at the last level are compared in blocks.
Runs repeat until the target recall: with s = SPREAD * similarity expected shared tokens, and all
paths of a run choosing the same tokens at a level, a run keeps a pair at every level with
probability (1 - exp(-s)) ** DEPTH.

Buckets give candidate edges, one star for each local component, never all pairs. Candidate
components are then verified exactly on whole shingle sets (those of a large component go as
differences to its root's set), in pairs of blocks, so that no task holds a large component: links are counted for every node, and the verified edges make the
classes. The count of links between different near copies needs each pair of them compared
once, in blocks; nothing is emitted for each pair.

Words are `[^\\x20\\x09-\\x0D]+`. A text of fewer words than `width` has one shingle of all its
words. Defined results: null, empty and wordless texts are alone in their class, with no links.
Repeated rows are copies: they link each other. Rows count by their text, not by their id: rows
of one id, or without any, are in the classes of their texts, and class_key tells classes apart
even where their smallest ids are equal or null. An empty table gives an empty table. Only doc_id
and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, bitmap, bound_batches, materialize, might_hold, ship, text_or_empty
from .components import components

SPREAD, DEPTH = 2.0, 3
SMALL, BLOCK, WIDE = 64, 768, 1536
K1, K2 = "__nj_k1", "__nj_k2"
GOLD = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 300_000:
        _hashes.clear()
    for w in words:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out + h[k : k + n] + GOLD)
    return np.unique(out)


def signature(s: np.ndarray) -> int:
    """Of a set: the same for equal sets."""
    return int(mix(np.array([mix(s + GOLD).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def runs_for(recall: float, similarity: float) -> int:
    rho = (1 - math.exp(-SPREAD * similarity)) ** DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - rho))


def _describe(width: int, runs: int) -> Callable:
    """doc_id, text, k1, k2 -> doc_id, k1, k2, node, n, sketch (one byte of a minhash for each run and level), chosen (run, level, token)."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, runs * DEPTH + 1, dtype=np.uint64) * GOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, sketches, chosen = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), width)
                n = len(s)
                sizes.append(n)
                if not n:
                    nodes.append(None), sketches.append(b""), chosen.append([])
                    continue
                nodes.append(signature(s))
                limit = np.uint64(min(2**64 - 1, int(SPREAD / n * 2.0**64)))
                sketch, picks = [], []
                for k, seed in enumerate(seeds):
                    h = (s ^ seed) * GOLD
                    h ^= h >> np.uint64(32)
                    h *= np.uint64(0xD6E8FEB86659FD93)
                    sketch.append(int(mix(h.min(keepdims=True))[0] >> np.uint64(56)))
                    picks.append(s[h <= limit].view(np.int64).tolist())
                sketches.append(bytes(sketch))
                chosen.append(picks)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(chosen, pa.list_(pa.list_(pa.int64())))], ["doc_id", *b.schema.names[2:], "node", "n", "sketch", "chosen"])

    return run


def by_group(fn: Callable[[dict], Iterator[pa.RecordBatch]], key: str) -> Callable:
    """For batches sorted by key: calls fn with each group's columns, also where a group goes on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            rest = None
            if not t.num_rows:
                continue
            keys = t.column(key).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = t.slice(last)
            if last:
                yield from fn(t.slice(0, last).combine_chunks())
        if rest is not None and rest.num_rows:
            yield from fn(rest.combine_chunks())

    return run


def groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each item to the first of its component, from a symmetric matrix of links.

    Rows come sorted by node, so that buckets that share sets agree on the centre and repeat edges.
    """
    seen = np.zeros(len(linked), bool)
    out = []
    for i in np.flatnonzero(linked.any(1)):
        if seen[i]:
            continue
        seen[i] = True
        todo = [i]
        while todo:
            near = np.flatnonzero(linked[todo].any(0) & ~seen)
            seen[near] = True
            out += [(int(j), int(i)) for j in near]
            todo = near.tolist()
    return out


def bridges(linked: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Edges between the components that two blocks have on their own.

    Each block's own cell gives the edges inside it, so a cell of two blocks needs only those that join what they connect.
    """
    same = own[:, None] == own[None, :]
    centre = np.arange(len(linked))
    for j, i in stars(linked & same):
        centre[j] = i
    left, right = np.nonzero(linked & ~same)
    kept, at = np.unique(np.concatenate([centre[left], centre[right]]), return_inverse=True)
    joined = np.zeros((len(kept), len(kept)), bool)
    joined[at[: len(left)], at[len(left) :]] = True
    return [(int(kept[j]), int(kept[i])) for j, i in stars(joined | joined.T)]


def _candidates(threshold: float, agree: int) -> Callable:
    """Sorted bucket rows (path, block, node, n, sketch) -> candidate edges a, b."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        path, block, node, size = (t.column(c).to_numpy() for c in ("path", "block", "node", "n"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        left, right = [], []
        for a, b in groups(path):
            if b - a < 2:
                continue
            n, sk = size[a:b], sketch[a:b]
            linked = np.zeros((b - a, b - a), bool)
            for i in range(0, b - a, 64):
                linked[i : i + 64] = (sk[i : i + 64, None, :] == sk[None, :, :]).sum(-1) >= agree
            linked &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
            np.fill_diagonal(linked, False)
            own = block[a:b]
            for j, i in bridges(linked, own) if (own != own[0]).any() else stars(linked):
                left.append(node[a + j])
                right.append(node[a + i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, key: str, size: str, per: int) -> DataFrame:
    """Each row goes to every pair of blocks that its own block is in: `cell` names the pair, `block` the row's own."""
    many = F.ceil(F.col(size) / per).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), many).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return rows.withColumn("cell", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("other")


def _similar(lists: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets are similar. lists: each set's symmetric difference to one common set; sizes: of the whole sets.

    Two sets differ by as much as their differences to a third set do, so the third need not be known.
    """
    m, own = len(lists), np.array([len(x) for x in lists])
    _, at = np.unique(np.concatenate(lists), return_inverse=True)
    df = np.bincount(at)
    shared = df[at] > 1
    cols, of = (np.cumsum(df > 1) - 1)[at[shared]], np.repeat(np.arange(m), own)[shared]
    order = np.argsort(cols, kind="stable")
    cols, of = cols[order], of[order]
    both = np.zeros((m, m), np.float32)
    width = int(cols[-1]) + 1 if len(cols) else 0
    step = max(1, 8_000_000 // m)
    for c in range(0, width, step):
        lo, hi = np.searchsorted(cols, [c, c + step])
        dense = np.zeros((m, min(step, width - c)), np.float32)
        dense[of[lo:hi], cols[lo:hi] - c] = 1
        both += dense @ dense.T
    linked = np.zeros((m, m), bool)
    for i in range(m):
        whole = sizes[i] + sizes
        common = (whole - own[i] - own) / 2 + both[i]
        linked[i] = common >= threshold * (whole - common) - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _link_rows(node: np.ndarray, times: np.ndarray, linked: np.ndarray) -> Iterator[tuple]:
    """node, a star edge to another node (None for its centre), links."""
    count, to = linked @ times, {j: i for j, i in stars(linked)}
    for i in np.flatnonzero(linked.any(1)):
        yield int(node[i]), int(node[to[int(i)]]) if int(i) in to else None, int(count[i])


def _differences(threshold: float, block: int) -> Callable:
    """Sorted rows of a part (one block of a candidate component, and the component's root).

    A component of one block is verified here. Of a larger one come the differences of its sets
    to the root's: they lose nothing, and are much smaller than the sets.
    """

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        part, node, root, size, times, own = (t.column(c).to_numpy() for c in ("part", "node", "root", "size", "times", "own"))
        sets, out = t.column("shingles"), []
        for a, b in groups(part):
            rows = a + np.unique(node[a:b], return_index=True)[1]
            lists = [np.asarray(sets[int(r)].values) for r in rows]
            sizes = np.array([len(x) for x in lists])
            centre = lists[int(np.flatnonzero(node[rows] == root[a])[0])]
            lists = [np.setxor1d(x, centre, assume_unique=True) for x in lists]
            if size[a] <= block:
                out += [(*x, None, None, None, None, None) for x in _link_rows(node[rows], times[rows], _similar(lists, sizes, threshold))]
            else:
                out += [(int(node[r]), None, None, int(root[r]), int(size[r]), int(times[r]), int(n), x) for r, n, x in zip(rows, sizes, lists) if own[r]]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
        names = ["node", "to", "links", "root", "size", "times", "n", "differences"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def _verify(threshold: float) -> Callable:
    """Sorted rows of a cell (cell, block, node, times, n, differences) -> node, links (and a star edge to `to`)."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, block, node, times, n = (t.column(c).to_numpy() for c in ("cell", "block", "node", "times", "n"))
        sets, out = t.column("differences"), []
        for a, b in groups(cell):
            linked = _similar([np.asarray(sets[r].values) for r in range(a, b)], n[a:b], threshold)
            own = block[a:b]
            if (own != own[0]).any():  # each block's own pairs are counted in its own cell
                linked &= own[:, None] != own[None, :]
            out += _link_rows(node[a:b], times[a:b], linked)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["node", "to", "links"])

    return run


def grouped(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, "node").mapInArrow(by_group(fn, key), schema)


def candidate_edges(sets: DataFrame, chosen: DataFrame, threshold: float, runs: int) -> DataFrame:
    """sets (node, n, sketch, tokens: those chosen for each run's first level) -> edges a, b between sets that may be similar; some repeat.

    chosen (node, chosen) has the tokens of all levels, in any number of rows for a node; only those of nodes in large buckets are gathered.
    """
    agree = max(1, math.floor(runs * DEPTH * threshold - 4.2 * math.sqrt(runs * DEPTH * threshold * (1 - threshold))))
    rows = sets.select("node", F.posexplode("tokens").alias("run", "tokens")).select("node", "run", F.explode("tokens").alias("token"))
    rows = rows.select("node", F.xxhash64(F.col("run") * DEPTH, "token").alias("path"), "run")
    edges = None
    for level in range(DEPTH):
        if level:
            rows = materialize(rows, f"paths{level}")
        sizes = materialize(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{level}")
        # Most paths are of one set alone. A bitmap of the others keeps these from being shuffled; the join decides in any case.
        shared = might_hold(rows, "path", materialize(bitmap(sizes, "path"), f"shared{level}")).where("__maybe").drop("__maybe")
        full = materialize(shared.join(sizes, "path"), f"full{level}")
        small, large = full.where(F.col("size") <= SMALL), full.where(F.col("size") > SMALL)
        found = grouped(small.join(sets.select("node", "n", "sketch"), "node").select("path", F.lit(0).alias("block"), "node", "n", "sketch"), "path", _candidates(threshold, agree), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if level == DEPTH - 1:
            cells = _in_blocks(large.join(sets.select("node", "n", "sketch"), "node"), "path", "size", BLOCK)
            found = grouped(cells.select(F.col("cell").alias("path"), "block", "node", "n", "sketch"), "path", _candidates(threshold, agree), "a long, b long")
            edges = edges.union(found)
        elif large.isEmpty():
            break
        else:
            # One row for each node carries the tokens of all runs; they are dealt out after the join.
            asked = materialize(bitmap(large.select("node"), "node"), f"asked{level}")
            more = might_hold(chosen.select("node", F.filter("chosen", lambda x, k: k % DEPTH == level + 1).alias("next")), "node", asked)
            more = more.where("__maybe").groupBy("node").agg(F.first("next").alias("next"))
            rows = large.select("node", "run", "path").join(more, "node").select("node", "path", "run", F.explode(F.get("next", F.col("run"))).alias("token"))
            rows = rows.select("node", F.xxhash64("path", "token").alias("path"), "run")
    return edges


def with_keys(docs: DataFrame) -> DataFrame:
    """Two 64-bit hashes of id and text: rows that share both are repeated rows."""
    return docs.withColumns({K1: F.xxhash64("doc_id", "text"), K2: F.xxhash64(F.lit(1), "doc_id", "text")})


def _classes(docs: DataFrame, threshold: float, width: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, keys, node; null without words), and what is known of each node: its class, links and the class's first row."""
    runs = runs_for(recall, threshold)
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    docs = with_keys(docs.select("doc_id", "text"))
    all_docs = materialize(docs.mapInArrow(_describe(width, runs), f"doc_id {kind}, {K1} long, {K2} long, node long, n int, sketch binary, chosen array<array<long>>"), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", K1, K2)
    with_words = all_docs.where("node is not null")
    tokens = F.filter("chosen", lambda x, k: k % DEPTH == 0)
    sets = with_words.groupBy("node").agg(F.count("*").alias("times"), F.min(row).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first(tokens).alias("tokens"))
    sets = materialize(sets, "nodes")
    cand = components(candidate_edges(sets, with_words.select("node", "chosen"), threshold, runs))
    sized = cand.groupBy("root").agg(F.count("*").alias("size"))
    members = cand.join(sized, "root").join(sets.select("node", "times", F.col(f"row.{K1}").alias("__key")), "node")
    members = materialize(members, "members")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep, found = [], []
            for i, (node, text) in enumerate(zip(b.column(0).to_pylist(), b.column(4))):
                if node in seen:  # a repeated row
                    continue
                s = shingles(text.as_py(), width)
                if len(s) and signature(s) == node:  # another row may have the same key
                    seen.add(node)
                    keep.append(i)
                    found.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int32())) for c in range(4)), pa.array(found, pa.list_(pa.int64()))], ["node", "root", "size", "times", "shingles"])

    wanted = members.where("size > 1").select("node", "root", "size", "times", "__key")
    # Of the other texts, the bitmap keeps most from being shuffled; the join decides in any case.
    asked = materialize(bitmap(wanted, "__key"), "asked")
    texts = might_hold(docs.select("text", F.col(K1).alias("__key")), "__key", asked).where("__maybe")
    texts = wanted.join(texts, "__key").select("node", "root", "size", "times", "text")
    texts = texts.mapInArrow(with_sets, "node long, root long, size long, times long, shingles array<long>")
    many = F.ceil(F.col("size") / BLOCK).cast("int")
    texts = texts.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), many).cast("int"))
    texts = texts.withColumn("at", F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), many - 1)).otherwise(F.array("block"))))
    parts = texts.select(F.xxhash64("root", "at").alias("part"), "node", "root", "size", "times", (F.col("at") == F.col("block")).alias("own"), "shingles")
    first = materialize(grouped(parts, "part", _differences(threshold, BLOCK), "node long, to long, links long, root long, size long, times long, n long, differences array<long>"), "differences")
    cells = _in_blocks(first.where("differences is not null"), "root", "size", WIDE).select("cell", "block", "node", "times", "n", "differences")
    links = grouped(cells, "cell", _verify(threshold), "node long, to long, links long")
    links = materialize(links.union(first.where("differences is null").select("node", "to", "links")), "links")
    classes = components(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(sets.select("node", "row", "times"), "node")
    firsts = classes.groupBy("root").agg(F.min("row").alias("class_row"), F.sum("times").alias("in_class"))
    found = classes.select("node", "root").join(firsts, "root").join(counts, "node", "left")
    about = sets.select("node", "times", "row").join(found, "node", "left")
    about = about.select(
        "node",
        F.coalesce("root", "node").alias("class_key"),
        F.coalesce("class_row", "row").alias("class_row"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.col("times").alias("n_copies"),
        F.coalesce("in_class", "times").alias("in_class"),
    )
    return all_docs.select("doc_id", K1, K2, "node"), materialize(about, "classes")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), class_key (the class's own number; null
    for a text without words, which is alone), n_links, n_copies, in_class (rows of the class)."""
    rows, about = _classes(docs, threshold, width, recall)
    about = about.select("node", "class_key", F.col("class_row.doc_id").alias("class_id"), "n_links", "n_copies", "in_class")
    return rows.select("doc_id", "node").join(about, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_key",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("in_class", F.lit(1)).cast("long").alias("in_class"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (and of repeated rows any one), and all rows without words.

    Rows whose hashed key is not in a bitmap of those that go or are repeated stay where they are; the others are
    decided by their whole keys, in a shuffle.
    """
    rows, about = _classes(docs, threshold, width, recall)
    keys = rows.where("node is not null").groupBy(K1, K2).agg(F.first("node").alias("node"), F.count("*").alias("times"))
    first = (F.col(f"class_row.{K1}") == F.col(K1)) & (F.col(f"class_row.{K2}") == F.col(K2))
    care = materialize(keys.join(about.select("node", "class_row"), "node").select(K1, K2, "times", first.alias("first")).where("times > 1 or not first"), "care")
    wordless = F.length(F.btrim(text_or_empty(), F.lit(WS))) == 0
    marked = might_hold(with_keys(docs), K1, materialize(bitmap(care, K1), "cared")).withColumn("__maybe", F.col("__maybe") & ~wordless)
    gone = care.where("not first").select(K1, K2)
    stay = marked.where("__maybe").dropDuplicates([K1, K2]).join(gone, [K1, K2], "left_anti")
    return marked.where("not __maybe").select(*docs.columns).union(stay.select(*docs.columns))
