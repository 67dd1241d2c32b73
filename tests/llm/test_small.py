"""Brute force, round trips and edge cases on small tables."""

import hashlib
import html
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odata_spark.llm import bpe, components, html_extract, licenses, line_dedup, media, ngram_join, packing, quality, queries, suffix_lm, toxicity
from odata_spark.llm.common import BATCH_BYTES, materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra " * 30_000


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    shared = [words(rnd, 8) for _ in range(6)]
    out = []
    for i in range(60):
        lines = [words(rnd, rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 6))] + rnd.sample(shared, 2)
        out.append((i, "\n".join(lines), "en", "s", 1))
    base = words(rnd, 200).split()
    for i in range(60, 75):
        w = list(base)
        for _ in range(rnd.randrange(0, 12)):
            w[rnd.randrange(len(w))] = "x" + str(rnd.randrange(99))
        out.append((i, " ".join(w), "de", "s", 1))
    out += [(80, None, None, None, None), (81, "", "en", None, 0), (82, LONG, "es", "s", 1), (83, LONG, "es", "s", 1), (83, LONG, "es", "s", 1), (84, "two words", "en", "s", 1), (85, " \n\t\n ", "en", "s", 1), (None, "no id at all here, but some words", None, "s", 1), (86, out[0][1], "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return materialize(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup(docs, rows, empty):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(strip_key(line)) >= 20:
                holders[strip_key(line)].add(i)
    expected = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders[strip_key(x)]) < 3 or max((h for h in holders[strip_key(x)] if h is not None), default=None) == i]
        expected.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    out = line_dedup.line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [(r.doc_id, r["__ld_lines"], r["__ld_dropped"], r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and any(x[2] for x in got)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_moves_only_lines_that_recur(spark, monkeypatch):
    """Lines that a bitmap rules out are not shuffled with their positions, two tables are written, and keys are the contract's for any letters."""
    made, keep = {}, line_dedup.materialize

    def kept(df, name):
        made[name] = df
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "materialize", kept)
    rnd = random.Random(7)
    shared = ["  The SAME line In All Texts\r", "Ünd ÉINE Zeile MIT Ä und İ", "K (Kelvin) ſ and ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    cased = lambda x: "".join(c.swapcase() if c in "ABCDEFabcdef" and rnd.random() < 0.5 else c for c in x)
    rows = [(i, "\n".join([*(words(rnd, 9, 10**6) for _ in range(5)), *map(cased, shared), shared[1].lower()])) for i in range(40)]
    holders = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            holders[strip_key(line)].add(i)
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {i: "\n".join(x for x in t.split("\n") if len(holders[strip_key(x)]) < 3 or max(holders[strip_key(x)]) == i) for i, t in rows}
    assert list(made) == ["line_dups", "line_drops"] and made["line_drops"].count() == 39
    assert "__bits" in made["line_drops"]._jdf.queryExecution().optimizedPlan().toString()


def test_line_dedup_splits_a_text_once(spark):
    """A lambda that splits the text does so for each line it keeps."""
    text = "\n".join(f"this is the line of number {i} in each text" if i % 2 else f"own {i}" for i in range(3000))
    df = line_dedup.line_dedup(spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    inside = [x for x in re.findall(r"transform\(.*?lambdafunction\((.*?)lambda ", plan, re.S)]
    assert inside and not any("split(" in x for x in inside)
    assert {(r.doc_id, r["__ld_dropped"], len(r.text.split("\n"))) for r in df.collect()} == {(0, 1500, 1500), (1, 1500, 1500), (2, 1500, 1500), (3, 0, 3000)}


def brute_roots(rows):
    """For each row the number of its class, and its links."""

    def grams(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def brute_classes(rows):
    roots, links = brute_roots(rows)
    classes = defaultdict(list)
    for r, row in zip(roots, rows):
        classes[r].append(row[0])
    return sorted(((row[0], min((x for x in classes[r] if x is not None), default=None), n, len(classes[r])) for r, row, n in zip(roots, rows, links)), key=str)


def found_classes(out):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.in_class) for r in out), key=str)


@pytest.fixture(scope="module")
def odd_rows(rows):
    """Repeated ids with different texts, several rows without an id, repeated rows."""
    rnd = random.Random(4)
    more = [(None, words(rnd, 30)) for _ in range(4)] + [(7, words(rnd, 30)), (7, words(rnd, 30)), (62, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (None, None), (None, None)]
    return rows + [(i, t, "en", "s", 1) for i, t in more]


def test_jaccard(docs, rows, empty):
    got = found_classes(ngram_join.jaccard_classes(docs).collect())
    assert got == brute_classes(rows) and max(x[2] for x in got) > 3
    assert ngram_join.jaccard_classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_jaccard_of_odd_ids(spark, odd_rows):
    """Classes are told apart, and one row of each stays, whatever the ids are."""
    df = spark.createDataFrame(odd_rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("class_key", F.lit(0))
    out = ngram_join.jaccard_classes(df).collect()
    assert found_classes(out) == brute_classes(odd_rows)
    roots, _ = brute_roots(odd_rows)
    worded = {r for r, row in zip(roots, odd_rows) if (row[1] or "").split()}
    assert len({r.class_key for r in out if r.class_key is not None}) == len(worded)
    members = defaultdict(list)
    for r, row in zip(roots, odd_rows):
        members[r].append((row[0], row[1]))
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()]
    assert ngram_join.keep_one(df).columns == df.columns
    assert sorted((x for x in kept if not (x[1] or "").split()), key=str) == sorted(((i, t) for i, t, *_ in odd_rows if not (t or "").split()), key=str)
    for r in worded:
        here = [x for x in kept if x in members[r]]
        assert len(here) == 1 and here[0][0] == min((i for i, _ in members[r] if i is not None), default=None)
    assert sum(t is not None and bool(t.split()) for _, t in kept) == len(worded)


def test_jaccard_in_blocks(docs, rows, monkeypatch):
    """Large buckets and components go through splitting and pairs of blocks."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    assert found_classes(ngram_join.jaccard_classes(docs).collect()) == brute_classes(rows)


def test_jaccard_moves_only_shared_paths(spark, monkeypatch):
    """Texts that share no path with another give no path rows; of tokens, a set carries those of the first level."""
    rnd, made, keep = random.Random(5), {}, ngram_join.materialize

    def kept(df, name):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(ngram_join, "materialize", kept)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(60)) for _ in range(200)]
    near = texts[0].rsplit(" ", 2)[0] + " other end"
    rows = ngram_join.jaccard_classes(spark.createDataFrame(list(enumerate([*texts, near])), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i % 200 for i in range(201)}
    assert max(df.count() for df in made.values()) == len(rows)
    tokens = made["nodes"].select(F.posexplode("tokens").alias("run", "some"))
    assert tokens.agg(F.max("run")).first()[0] == ngram_join.runs_for(0.999, 0.8) - 1


def test_jaccard_recall_at_the_last_level():
    """Of pairs at Jaccard 0.8, 0.999 share a chosen token at every level of some run, as split buckets need."""
    pairs, texts = 4000, []
    for i in range(pairs):
        whole = [f"t{i}x{k}" for k in range(25)]
        texts += [" ".join(whole), " ".join(whole[:20])]
    runs = ngram_join.runs_for(0.999, 0.8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    with np.errstate(over="ignore"):
        chosen = next(ngram_join._describe(1, runs)(iter([batch]))).column("chosen").to_pylist()
    deep = lambda a, b: any(all(set(a[k]) & set(b[k]) for k in range(r * ngram_join.DEPTH, (r + 1) * ngram_join.DEPTH)) for r in range(runs))
    assert sum(not deep(chosen[2 * i], chosen[2 * i + 1]) for i in range(pairs)) <= 0.002 * pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (300, 200), (5, 5)]
    star = components.components(spark.createDataFrame([(i, 5000) for i in range(1, 4000)] + [(6000 + i, 7000 + i) for i in range(1000)], "a long, b long")).collect()
    assert {r.node for r in star if r.root == 1} == {*range(1, 4000), 5000} and len(star) == 6000
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 300: 100}


def test_quality(docs, rows, empty):
    feats = materialize(quality.features(docs), "feats")
    got = {r.doc_id: r for r in feats.collect()}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        repeated = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated))
    model = quality.fit(feats)
    out = quality.verdict(feats, model)
    assert out.where("base_failed and kept").isEmpty() and out.where("kept").count() > 50
    clash = quality.features(docs.withColumn("n_words", F.lit("clash")).withColumn("vote_length", F.lit("clash")))
    assert dict(clash.dtypes)["n_words"] == "bigint" and clash.columns.count("n_words") == 1 and [r.n_words for r in clash.orderBy("doc_id", "text").collect()] == [r.n_words for r in feats.orderBy("doc_id", "text").collect()]
    nothing = materialize(quality.features(empty), "feats")
    assert quality.verdict(nothing, quality.fit(nothing)).count() == 0


def test_quality_recovers_planted_rules():
    """Rules of known rates: EM finds them, gives a worthless rule no weight, and keeps texts with one vote against."""
    rnd = np.random.default_rng(5)
    n, k = 40_000, len(quality.VOTES)
    good = rnd.random(n) < 0.85
    on_good, on_bad = np.array([0.3, 0.02, 0.01, 0.1, 0.05, 0.02, 0.03, 0.04, 0.01, 0.08]), np.array([0.2, 0.6, 0.5, 0.7, 0.4, 0.6, 0.5, 0.8, 0.3, 0.5])
    against = rnd.random((n, k)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(rnd.random((n, k)) < 0.1, 0, np.where(against, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    rates = np.array([model["rates"][v] for v in quality.VOTES])
    assert rates[:, 0] == pytest.approx(on_good, abs=0.02) and rates[:, 1] == pytest.approx(on_bad, abs=0.04)
    assert model["odds"]["vote_length"][0] == 0
    odds = np.array([model["odds"][v] for v in quality.VOTES])
    kept = model["prior"] + sum(odds[j][votes[:, j] + 1] for j in range(k)) >= 0
    assert (kept == good).mean() > 0.97
    passes = (votes >= 0).all(1)
    assert (kept & ~passes & good).sum() > 0.3 * good.sum() and (kept == good).mean() > (passes == good).mean() + 0.2


def test_quality_of_real_rules(spark):
    """Repetitive, shouting and symbol texts go; a short but sound text stays though it draws a vote."""
    rnd = random.Random(6)
    sound = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "in", words(rnd, 1, 900), words(rnd, 1, 900)]) for _ in range(n)).replace("w", "word")
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [(i, sound(rnd.randrange(30, 300)).translate(letters)) for i in range(300)]
    texts += [(1000 + i, " ".join(w.upper() + "!!" for w in sound(120).translate(letters).split())) for i in range(15)]
    texts += [(2000 + i, " ".join(w + rnd.choice(["###", "%%%", "|"]) for w in sound(120).translate(letters).split())) for i in range(15)]
    feats = materialize(quality.features(spark.createDataFrame(texts, "doc_id long, text string")), "feats")
    out = quality.verdict(feats, quality.fit(feats)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out) and any(r.kept and r.vote_length < 0 for r in out)


def test_packing(docs, rows, empty):
    out = [r for r in packing.pack(docs, buckets=4, budget=500, shard=7).collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=str) == sorted(((i, len((t or "").split()) + 1) for i, t, *_ in rows), key=str)
    batches = defaultdict(list)
    longest = {b: max(r.n_tokens for r in out if r.bucket == b) for b in {r.bucket for r in out}}
    assert all(r.bucket_len == longest[r.bucket] for r in out) and max(longest.values()) > packing.EXACT
    for r in out:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for group in batches.values():
        assert len(group) == 1 or len(group) * group[0].bucket_len <= 500
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert packing.pack(empty).count() == 0


def test_boundaries_are_optimal():
    rnd = random.Random(5)
    from itertools import combinations

    def cost(lengths, counts, ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

    for _ in range(60):
        n = rnd.randrange(1, 9)
        lengths = sorted(rnd.sample(range(1, 60), n))
        counts = [rnd.randrange(1, 20) for _ in lengths]
        k = rnd.randrange(1, 5)
        best = min(cost(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], min(k, n) - 1))
        ends = packing.optimal_boundaries(np.array(lengths), np.array(counts), k)
        assert len(ends) <= k and cost(lengths, counts, ends) == best


def test_suffix_tree_lm(docs, rows, empty):
    got = {(r.doc_id, r.n_tokens): r for r in suffix_lm.score_documents(docs).collect()}
    counts, n = defaultdict(int), 0
    for i, text, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for t in [*re.findall(r"[^\x20\x09-\x0D]+", text or ""), None]:
                counts[t] += 1
                n += 1
    for i, text, *_ in rows:
        toks = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]
        r = got[i, len(toks)]
        assert r.train_tokens == n and r.n_known == sum(counts.get(t, 0) > 0 for t in toks) and r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(t, 0) + 1) / ((n + 1) * (len(counts) + 1))) for t in toks), rel=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_lm.score_documents(empty).count() == 0


def test_suffix_tree_sums_to_one():
    rnd = random.Random(1)
    grams = np.concatenate([suffix_lm.codes(words(rnd, 60, 12).encode().split()) for _ in range(40)])
    levels = []
    for k in range(suffix_lm.DEPTH + 1):
        g, n = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        c = g >> np.uint64(8)
        u, at = np.unique(c, return_inverse=True)
        levels.append((c, (g & np.uint64(255)).astype(np.int64), n.astype(float), np.bincount(at, n)[at].astype(float)))
    tree = suffix_lm.SuffixTree(levels)
    assert any(len(r) for r in tree.retained[2:])
    for context in np.unique(grams >> np.uint64(8))[:50]:
        codes = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.log10(codes & suffix_lm.MASK, tree.cache())).sum() == pytest.approx(1, abs=1e-6)


def test_suffix_tree_is_whole(spark, monkeypatch):
    """The dealt tree scores as one tree of all counts, rare contexts and next symbols too, whatever is looked up or joined."""
    rnd = random.Random(8)
    texts = [words(rnd, 200, 30) for _ in range(40)] + ["qzjx vkwy " * 9] * 4 + [LONG] * 12
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    seen = np.concatenate([suffix_lm.codes(t.encode().split()) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    levels = []
    for k in range(suffix_lm.DEPTH + 1):
        g, n = np.unique(seen & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        c = g >> np.uint64(8)
        u, at = np.unique(c, return_inverse=True)
        levels.append((c, (g & np.uint64(255)).astype(np.int64), n.astype(float), np.bincount(at, n)[at].astype(float)))
    tree = suffix_lm.SuffixTree([x if k == 0 else tuple(y[x[3] >= 2] for y in x) for k, x in enumerate(levels)])
    want = {i: tree.log10(suffix_lm.codes(t.encode().split()), tree.cache()).sum() for i, t in enumerate(texts)}
    for hot in (1e-3, 2.0):
        monkeypatch.setattr(suffix_lm, "HOT_GRAM", hot, raising=False)
        got = {r.doc_id: r.score for r in suffix_lm.score_documents(df).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_suffix_tree_and_nul_words(spark):
    rows = [(i, "\x00\x00 a b \x00\x00") for i in range(6)]
    got = suffix_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(6))
    counts = {"\x00\x00": 2 * n, "a": n, "b": n, None: n}
    want = sum(np.log10((counts[t] + 1) / ((5 * n + 1) * 5)) for t in ("\x00\x00", "a", "b", "\x00\x00", None))
    assert all(r.base_score == pytest.approx(want) and r.train_tokens == 5 * n for r in got)


def test_lm_query_keeps_its_contract(spark, rows, empty, tmp_path):
    """The base is sum of log10((c + 1) / (N + 1 * (V + 1))), a distribution over the training words and one unknown."""
    odd = rows + [(200 + i, t, "en", "s", 1) for i, t in enumerate(["\x00", "\x00\x00 \x01", "a\x1cb\x85c\xa0d", "İ É K ß", "\r\n\x0b\x0c x\ty", "The the THE", "a" * 7000])]
    training = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    for name, some in (("all", odd), ("held", [r for r in odd if not training(r[0])])):
        counts = defaultdict(int)
        for i, text, *_ in some:
            for t in split(text) if training(i) else ():
                counts[t] += 1
        n = sum(counts.values())
        want = sorted((str(i), not training(i), len(x := split(text)), sum(t in counts for t in x), n, sum(np.log10((counts.get(t, 0) + 1) / (n + 1 * (len(counts) + 1))) for t in x)) for i, text, *_ in some)
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = queries.op3_lm_scoring(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = sorted((str(r.doc_id), *r[1:6]) for r in out.collect())
        assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op3_lm_scoring(spark, f"{tmp_path}/none").count() == 0


def test_lm_batches_are_bounded(spark):
    """Texts go to Python a few at a time and counts come back in parts, and none is lost."""
    rnd = random.Random(4)
    texts = [words(rnd, 4000, 10**7) for _ in range(40)]
    parts = list(suffix_lm._count(iter([pa.RecordBatch.from_pydict({"text": texts, "training": [True] * 40})])))
    assert max(p.num_rows for p in parts) <= 50_000
    table, found = pa.Table.from_batches(parts).to_pylist(), defaultdict(int)
    for r in table:
        found[r["word"] if r["word"] is not None else r["gram"]] += r["n"]
    want = defaultdict(int, {b" ": 40})
    for t in texts:
        for w in t.encode().split():
            want[w] += 1
        for g in suffix_lm.codes(t.encode().split()).tolist():
            want[g] += 1
    assert found == want and len(found) > 150_000
    spark.conf.unset(BATCH_BYTES)
    suffix_lm.score_documents(spark.createDataFrame([(1, "a text")], "doc_id long, text string"))
    assert spark.conf.get(BATCH_BYTES, None) == str(2 << 20)
    spark.conf.unset(BATCH_BYTES)


def test_lm_chunks_read_as_texts(monkeypatch):
    rnd = random.Random(6)
    texts = ["", None, "\x00", "\x00\x00 \x01", "a\x1cb\x85c\xa0d", "İ É K ß ẞ", "\r\n\x0b\x0c x\ty", "The the  THE \n", "a" * 7000, " "] + [words(rnd, 60, 300) for _ in range(30)] + [""]
    for chunk, kind in ((1, pa.string()), (900, pa.large_string()), (1 << 19, pa.string())):
        monkeypatch.setattr(suffix_lm, "CHUNK", chunk)
        got = []
        for x in suffix_lm.chunks(pa.array(["cut", *texts], kind).slice(1)):
            assert x.at == len(got)
            w, g = np.cumsum(x.n_words), np.cumsum(x.n_grams)
            got += [([x.words[k].as_py() for k in x.codes[a - m : a]], x.grams[b - n : b].tolist()) for a, m, b, n in zip(w, x.n_words, g, x.n_grams)]
        assert got == [(f, suffix_lm.codes(f).tolist()) for f in map(suffix_lm.tokens, texts)]
    assert [*suffix_lm.chunks(pa.array([], pa.string()))] == []


def test_lm_tasks_add_up_their_counts(monkeypatch):
    """A key that many batches of a task have leaves it once, and no count is lost if the task holds too many."""
    rnd = random.Random(5)
    texts = [words(rnd, 400, 2000) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "training": [i % 7 > 0 for i in range(60)]})
    want = None
    for times in (1, 14):
        for held in (1_000_000, 1000):
            monkeypatch.setattr(suffix_lm, "HELD", held, raising=False)
            monkeypatch.setattr(suffix_lm, "BUFFER", 100_000, raising=False)
            table = pa.Table.from_batches(suffix_lm._count(iter([batch] * times)))
            total = defaultdict(lambda: [0, 0])
            for r in table.to_pylist():
                k = r["word"] if r["word"] is not None else r["gram"]
                total[k][0] += r["n"]
                total[k][1] += r["places"] or 0
            want = want or dict(total)
            assert total == {k: [times * a, times * b] for k, (a, b) in want.items()}
            if held > 1000:
                assert len(table) == len(total)


def test_licenses(docs, rows, empty):
    text = "Intro. Licensed under the Apache License, Version 2.0; CC-BY 4.0? Under the MIT License!"
    s = licenses.LicenseScanner().scan(text)
    assert s["base"] == {"apache", "cc-by", "mit"} and {"apache-2.0-notice", "mit-notice"} <= s["labels"] and "cc-by-4.0-notice" not in s["labels"]
    auto = licenses.Automaton("a [b c] d {2} e")
    for ok in ("a d e", "a b c d e", "a d x e", "a b c d x y e"):
        assert auto.match([w.encode() for w in ok.split()], 0) == len(ok.split())
    for bad in ("a b d e", "a d x y z e", "a c d e"):
        assert auto.match([w.encode() for w in bad.split()], 0) == -1
    assert licenses.scan_licenses(empty).count() == 0


def test_license_texts():
    """The whole mandatory wording must stand, word for word; names and numbering may differ."""
    scan = licenses.LicenseScanner().scan
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            plain = re.sub(r"\{\d+\}", "Jane Roe", re.sub(r"\[([^\]]*)\]", "", t))
            assert label in scan(f"Some words. {plain} More words.")["labels"], (label, plain)
            if label.endswith(("-text", "-header")):
                w = plain.split()
                assert label not in scan(plain.replace(max(w, key=len), "altered"))["labels"]
                assert label not in scan(" ".join(w[:-1]))["labels"] and label not in scan(" ".join(w[1:]))["labels"]


def test_license_table(spark, rows):
    rnd = random.Random(12)
    bits = ["MIT License", "apache\nLicense", "CC-BY", "cc by", "GNU General Public License", "gnu general public", "mit", "license", "é", "x1"]
    texts = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 30)))) for i in range(80)] + [(i, t) for i, t, *_ in rows] + [(900, "the mit license " * 40_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect()), key=str)
    want = []
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        found = [(at, label) for p, label in licenses.PHRASES.items() for at in range(len(w)) if w[at] == p.split()[0] and w[at : at + len(p.split())] == p.split()]
        want.append((i, len(w), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), ",".join(sorted({f[1] for f in found}))))
    assert got == sorted(want, key=str) and sum(x[2] for x in want) > 40_000


def test_toxicity(spark, empty):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rnd, 40, 300).split()
        if toxic:
            w[rnd.randrange(40)] = "vexu" + rnd.choice("abcdefghij") + "te"
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, LONG, "en", "s", 1)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    clash = docs.withColumn("score", F.lit("mine")).union(docs.withColumn("score", F.lit("mine")))
    kept = toxicity.score(clash, toxicity.fit(docs, known), names=("__s", "__p")).collect()
    assert len(kept) == 1204 and all(r.score == "mine" for r in kept) and len({(r.doc_id, r["__s"]) for r in kept}) == 602
    held = [r for r in out if r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out) and len(out) == 602
    model = toxicity.fit(empty, known.limit(0))
    assert toxicity.score(empty, model).count() == 0
    assert [r.predicted for r in toxicity.score(spark.createDataFrame([(1, "you stupid scum", "", "", 1), (2, "good day", "", "", 1)], SCHEMA), model).orderBy("doc_id").collect()] == [1, 0]


def test_toxicity_of_rare_words(spark):
    """Each of 50 insults is in 2 % of the toxic texts."""
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 6 == 0
        rows.append((i, words(rnd, 20, 300) + (f" {chr(97 + i // 6 % 25)}{'xq'[i // 150 % 2]}zut" if toxic else ""), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    insults = {t.split()[-1] for _, t, *_ in rows if t.endswith("zut")}
    assert len(insults) == 50 and insults <= set(model["names"])
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.98


def test_toxicity_beyond_the_mined_words(spark):
    """Words that only begin as mined ones do are clean; addressed insults, threats and masked words count though no text has them."""
    rnd = random.Random(11)
    rows = [(i, words(rnd, 40, 300) + (f" {rnd.choice(['pathetic', 'worthless', 'idiot'])} {rnd.choice(['pathetic', 'worthless', 'idiot'])}" if i % 6 == 0 else ""), "en", "s", 1) for i in range(1200)]
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int"))
    probes = {"the path to the house is worth the walk": 0, "worthy winners": 0, "good day": 0, "": 0, "i will hurt you, you filthy animal": 1, "you are a moron": 1, "shut up you f**king b*tch": 1, "what an id1ot you are": 1}
    got = {r.text: r.predicted for r in toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id long, text string"), model).collect()}
    assert got == probes and not {"path*", "wort*", "worth*"} & set(model["names"])


ODD = "aZeIil \n\t!*1@²½_'’«»éÉßẞİΣσς\u0307\xa0–中文か𝒜𝟙٣ǅ\x1c\x85"


def test_toxicity_splits_as_the_pattern(rows):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for text in [*odd, None, "", *(r[1] for r in rows)]:
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower())


def test_toxicity_counts_entries_once_a_task(monkeypatch):
    """What mining counts is the number of texts with each entry; a task hands an entry on once, unless it holds too many."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(ODD if i % 2 else "abcdefghé𝒜 ") for _ in range(rnd.randrange(120))) for i in range(400)] + [None, "", " ", "1"]
    toxic = [int(rnd.random() < 0.3) for _ in texts]
    want = defaultdict(lambda: [0, 0])
    for t, x in zip(texts, toxic):
        for e in {"", *(e for w in toxicity.words_of(t) for e in toxicity.entries(w))}:
            want[e][x] += 3
    monkeypatch.setattr(toxicity, "TALLY", 500, raising=False)
    for memo in (400_000, 1000):
        monkeypatch.setattr(toxicity, "MEMO", memo)
        found = []
        frame = type("Frame", (), {"select": lambda self, *a: self, "mapInArrow": lambda self, run, schema: found.append(run) or (_ for _ in ()).throw(StopIteration)})()
        with pytest.raises(StopIteration):
            toxicity.mine(frame)
        table = pa.Table.from_batches(found[0](iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(toxic)], ["text", "toxic"])] * 3)))
        got = defaultdict(lambda: [0, 0])
        for r in table.to_pylist():
            got[r["entry"]][0] += r["clean"]
            got[r["entry"]][1] += r["toxic"]
        assert got == want
        if memo > 1000:
            assert len(table) == len(want)


def test_toxicity_query_reads_a_text_once_for_both(spark, tmp_path, monkeypatch):
    """The query's rows are those of score(docs, fit(docs, labels)), from one scan of the texts besides mining."""
    rnd = random.Random(9)
    rows = [(i if i % 50 else None, words(rnd, 30, 60) + (rnd.choice([" you stupid xqzut", " i will hurt you", " s*upid!!", " SCUM SCUM SCUM"]) if i % 4 == 0 else "") if i % 61 else None, "en", "s", 1) for i in range(300)] + [(7, "again", "en", "s", 1)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    want = sorted((str(r.doc_id), r.score, r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    out = queries.op6_toxicity(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and "documents.parquet" not in str(out.inputFiles())
    got = sorted((str(r.doc_id), r.score, r.predicted) for r in out.collect())
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and [b for _, b, _ in got] == pytest.approx([b for _, b, _ in want], rel=1e-6)
    assert {r.held_out for r in out.collect()} == {True, False}


def test_label_model_recovers_planted_rates():
    rnd = np.random.default_rng(7)
    n, k = 50_000, len(toxicity.VOTERS)
    toxic = rnd.random(n) < 0.08
    on_toxic = np.array([0.3, 0.4, 0.2, 0.6, 0.2, 0.5, 0.1, 0.2, 0.05, 0.04, 0.04])
    on_clean = np.array([0.002, 0.004, 0.001, 0.01, 0.003, 0.002, 0.002, 0.001, 0.001, 0.04, 0.04])
    said = rnd.random((n, k - 1)) < np.where(toxic[:, None], on_toxic, on_clean)
    silent = ~said[:, : k - 3].any(1)
    votes = np.concatenate([said.astype(int), np.where(silent, -1, 0)[:, None]], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, of = np.unique(np.concatenate([patterns, votes[:2000]]), axis=0, return_inverse=True)
    gold = np.stack([np.bincount(of[len(patterns) :], w, len(patterns)) for w in (toxic[:2000], ~toxic[:2000])], 1)
    posterior, about = toxicity.label_model(patterns, counts.astype(float), 0.08, gold)
    rates = np.array([about["rates"][v] for v in toxicity.VOTERS])[: k - 3]
    assert rates[:, 0] == pytest.approx(on_toxic[: k - 3], abs=0.13) and rates[:, 1] == pytest.approx(on_clean[: k - 3], abs=0.01)
    by = {tuple(v): p for v, p in zip(patterns.tolist(), posterior)}
    assert np.mean([(by[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), toxic)]) > 0.96


def test_bpe(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    theirs, mine = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    rnd = random.Random(2)
    texts = ["", " ", "<|endoftext|> a<|startoftext|>", "İ ΣΑΣ ß", "it's we'RE", "a" * 700, "½ 12 日本 🙂", "\x85x y​"] + ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0x3000), rnd.randrange(0x10000, 0x1FA00)])) for _ in range(20)) for _ in range(400)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert got == want and mine.decode(got) == theirs.decode(want, skip_special_tokens=False)
    by_id = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    for i, t, *_ in rows:
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert by_id[i].n_tokens == len(want) and by_id[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_media(spark, docs, rows, empty):
    for r in media.text_media(docs, with_media=True).collect():
        payload = media.read_tiles(r.media, media.WIDTH).tobytes()
        first = np.load(io.BytesIO(r.media), allow_pickle=False)
        assert first.dtype == np.uint8 and first.shape[1:] == (media.WIDTH, 3) and r.media_bytes == len(r.media)
        assert len(payload) == r.payload_bytes and len(payload) % 192 == 0 and r.payload_bytes > 0 and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and payload[r.n_bytes :].strip(b" ") == b""
    assert media.text_media(empty).count() == 0
    image = np.random.default_rng(1).integers(0, 256, (21, 13, 3), np.uint8)
    assert (media.read_tiles(media.store_tiles(image, 8), 13, 8) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all() and (media.decode(media.encode_ppm(image)) == image).all()
    assert media.decode(b"P2 # c\n2 2\n255\n1 2 3 4").tolist() == [[1, 2], [3, 4]] and media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 1, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]] and media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    big = media.grey(image)
    assert media.area_resize(big, 7, 13) == pytest.approx(big.reshape(7, 3, 13).mean(1)) and media.area_resize(big, 8, 9).mean() == pytest.approx(big.mean())
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(image))), (2, bytearray(b"junk")), (3, None)], "media_id int, media binary")
    got = media.tiles(df).collect()
    assert len([r for r in got if r.media_id == 1]) == 4 and all(r.npy is None for r in got if r.media_id != 1)


def test_html(spark):
    article = "<article><h1>T&amp;t</h1><p><b>One &lt;x&gt;<br><p>Two\n  lines</p><div class='ad-box'>Buy</div><section id=comments><p>Nice!</p></section></article>"
    page = f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><!-- x -->@@{article}<footer>&copy; F</footer></body></html>"
    assert html_extract.extract(html_extract.parse(page.replace("@@", ""))) == "T&t One <x> Two lines"
    assert [html_extract.extract(html_extract.parse(x)) for x in ("", "<p", "plain &eacute; text", "<p>a</p><p>b", "<ul><li>a<li>b</ul>")] == ["", "", "plain é text", "a b", "a b"]
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Come back soon, reader</p></div><div><p>Story {i} tells much</p></div></body>") for i in range(20)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://other.example/", "<div><p>Come back soon, reader</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hashes", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert got == {i: f"Story {i} tells much" for i in range(20)} | {90: "", 91: "", 92: "Come back soon, reader"}
    mirrored = [(i, f"http://m.example/{i}", page.replace("@@", f"<div>{i}</div>")) for i in range(20)]
    got = html_extract.extract_main_text(spark.createDataFrame(mirrored, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T&t One <x> Two lines"} and len(got) == 20
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


def test_html_templates_decide(spark):
    """Where no tag or class tells anything, subtrees that recur on a host go, and the same ones stay elsewhere."""
    rnd = random.Random(13)
    pages, want = [], {}
    for h, n in (("big.example", 60), ("small.example", 4)):
        shared = [f"<div class='x{k}'><div>Part {k} of {h}</div><p>See {k}</p></div>" for k in range(4)]
        for i in range(n):
            own = f"Story {rnd.random()} of {h}"
            some = rnd.sample(shared, 2)
            pages.append((len(pages), f"https://{h}/{i}", f"<html><body><section>{some[0]}</section><section><p>{own}</p></section>{some[1]}</body></html>"))
            strip = lambda t: " ".join(re.sub(r"<[^>]*>", " ", t).split())
            want[len(pages) - 1] = own if n > 20 else f"{strip(some[0])} {own} {strip(some[1])}"
    pages += [(7, *pages[7][1:])] * 3  # repeated rows count once
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == len(pages) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_counts_of_subtrees(spark):
    """Recurring hashes of each page against counts in plain Python."""
    rnd = random.Random(14)
    pages = [(i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(f"<div>{rnd.randrange(12)}<p>{rnd.randrange(30)}</p></div>" for _ in range(4)) + "</body>") for i in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select(F.col("page_id").alias("key"), "url", "html")
    seen = materialize(df.mapInArrow(html_extract._subtrees, "key long, host long, page long, hash long"), "subtrees")
    got = {r.key: set(r.hashes) for r in html_extract.site_templates(seen, 4).collect()}
    found, on = {}, defaultdict(set)
    for i, url, page in pages:
        nodes = html_extract.hash_subtrees(html_extract.parse(page))
        found[i] = html_extract.countable(nodes)
        for h in found[i]:
            on[url[:17], h].add(nodes[-1].hash)
    want = {i: {h for h in found[i] if len(on[url[:17], h]) >= 4} for i, url, _ in pages}
    assert got == {i: h for i, h in want.items() if h} and any(want.values())


def test_html_wrappers_and_depth():
    ex = lambda t: html_extract.extract(html_extract.parse(t))
    assert ex("<div class='layout with-sidebar'><article>Hi</article></div>") == "Hi" and ex("<div class=sidebar><article>Hi</article></div>") == "Hi"
    assert ex("<div id=no-comments><article class='post'>A</article><section id=comments><article class=comment>B</article></section></div>") == "A"
    assert ex("<form><main>x</main></form><form>y</form>") == "x" and ex("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert ex("<div>" * 20_000 + "x") == "x" and ex("<b>" * 20_000 + "</i>" * 20_000 + "y") == "y" and ex("<b>" * 20_000 + "<p>z</p>" * 2_000) == " ".join("z" * 2_000)
    assert len(ex("<p>" + "word " * 400_000)) == 400_000 * 5 - 1


def test_batches_for_python_are_bounded(spark):
    """Long texts go to Python a few at a time, in every operator of the pipeline that runs there; a session's own bound stands."""
    long = materialize(spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 2000)).alias("text")), "long")
    known = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    largest = lambda: long.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    short, model = long.limit(1), {"names": [], "ordinary": [], "weights": {}, "bias": 0.0}
    for run in (lambda: ngram_join.keep_one(short), lambda: toxicity.fit(short, known), lambda: toxicity.score(short, model)):
        spark.conf.unset(BATCH_BYTES)
        assert largest() > 25_000_000
        run()
        assert largest() < 3_000_000
    spark.conf.set(BATCH_BYTES, "5000000")
    toxicity.score(short, model)
    assert 4_000_000 < largest() < 6_000_000
    spark.conf.unset(BATCH_BYTES)


def test_pipeline(spark, odd_rows, tmp_path):
    """Each stage against what its operator says of every row by itself; clashing columns, repeated and missing ids."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [*odd_rows, (None, "no words", "en", "s", 1), (3, "you stupid worthless idiot, " + odd_rows[2][1], "en", "s", 1)]
    clash = ["score", "predicted", "bucket", "n_words", "quality", "kept", "node", "__key"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d, texts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = materialize(stage(spark, d, str(tmp_path)), name)
        if name == "packing":
            assert d.count() == before.count()
            break
        assert d.columns == before.columns and d.where("score <> 'clash' or kept <> 'clash' or bucket <> 'clash'").isEmpty()
        texts.append(sorted(((r.doc_id, r.text) for r in d.collect()), key=str))
    feats = materialize(quality.features(docs.select("doc_id", "text")), "feats")
    kept = [(r.doc_id, r.text) for r in quality.verdict(feats, quality.fit(feats)).where("kept").collect()]
    assert texts[0] == sorted(kept, key=str) and sum(i is None for i, _ in kept) > 4 and sum(i == 7 for i, _ in kept) == 3
    gone = [x for x in texts[0] if x not in texts[1]]
    assert gone and all("idiot" in t for _, t in gone)
    roots, _ = brute_roots(texts[2])
    assert len(texts[3]) == len(set(roots)) < len(texts[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(texts[3])


def test_pipeline_of_nothing(spark, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
