"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import time

import numpy as np
from loomspark.llm import hmm, packing, queries
from pyspark.sql import functions as F


def test_packing_ranks_by_all_terms_of_a_seed():
    """A tail that shares 60 common terms goes before one that shares a single rarer term."""
    idf = np.concatenate([np.full(100, 1.0), np.full(20, 2.0)])
    seed, many, one = np.arange(120), np.arange(60), np.concatenate([[119], np.full(59, 99)])
    tails = [[k, 0, t.astype("<u4"), len(t)] for k, t in enumerate((seed, one, many))]
    assert [k for k in packing.Pool(tails, idf, 80.0).neighbours(0) if k][:2] == [2, 1]


def test_a_cut_tail_is_ranked_by_what_is_left():
    """After cuts, at any point, scores equal those of a pool made of what is left."""
    rng = np.random.default_rng(3)
    tails = [[k, 0, rng.integers(0, 60, rng.integers(20, 90)).astype("<u4"), 90] for k in range(40)]
    idf, mean = rng.random(60) + 0.1, 50.0
    pool = packing.Pool([list(t) for t in tails], idf, mean)
    next(pool.neighbours(3))  # scores are held ahead
    for k in (5, 7, 7, 39, 3):
        _, start, ids, n = pool.tails[k]
        pool.cut(k, [k, start + 9, ids[9:], n])
        fresh = packing.Pool([list(t) for t in pool.tails], idf, mean)
        assert np.allclose(pool.scores(np.arange(40)), fresh.scores(np.arange(40)), atol=1e-4)
        assert all(np.allclose(v[k], fresh.scores(np.array([s]))[0][k], atol=1e-4) for s, v in pool._scored.items() if s != k)


def test_packing_with_cuts_loses_no_id():
    rng = np.random.default_rng(4)
    tails = [[k, 0, rng.integers(0, 60, rng.integers(1, 90)).astype("<u4"), 90] for k in range(60)]
    pool = packing.Pool([list(t) for t in tails], rng.random(60) + 0.1, 50.0)
    parts = [p for w in [*packing.fill(pool, 64), *packing.powers(pool)] for p in w]
    for k, (_, _, ids, _) in enumerate(tails):
        mine = sorted((start, take.tolist()) for doc, start, take, _ in parts if doc == k)
        assert sum((take for _, take in mine), []) == ids.tolist()


def test_hmm_trains_until_the_likelihood_stops_rising(spark, monkeypatch):
    """One more round over all training rows gains less than 0.001 a token."""
    made, train = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a, **b: made.append((a, train(*a, **b))) or made[0][1])
    queries.op2_hmm_scores(spark, "/root/testdata/sf0.001")
    (rows, _, mass, *_), model = made[0]
    classes, first = hmm._joined([bytes(r.classes) for r in rows.where("train").select("classes").collect()])
    after = hmm.Model.made(*hmm.expected_counts(model, classes, *hmm._segments(classes, first))[:3], mass)
    was, now = (hmm.log_likelihood(m, classes, first).sum() for m in (model, after))
    assert now - was < 0.001 * len(classes)


def test_short_texts_without_a_retained_hash_are_found_in_longer_ones(spark, tmp_path):
    """Each text of five words is part of the long text after it; some have no hash below the threshold."""
    words = [f"w{k}" for k in range(40)]
    rows = [(2 * k + side, " ".join(words if side else words[k : k + 5])) for k in range(30) for side in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_scaled_sketches(spark, str(tmp_path)).where("doc_id % 2 = 0").collect()
    without = [r for r in found if r.fingerprint[0] not in "89"]  # the lowest eighth of the range
    assert without and all(r.near_next == 1.0 and abs(r.jaccard_next - 1 / 36) < 1e-12 for r in without)


def test_near_dedup_keeps_one_row_of_a_group(spark):
    """Rows that repeat, two texts with one doc_id, and copies without a doc_id."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (3, b), (None, b + " end"), (4, c), (4, b), (None, c), (5, "no copy of this one"), (6, ""), (6, ""), (7, None), (None, ""), (None, "alone and without id")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"]
    want = [(1, a), (3, b), (4, c), (5, "no copy of this one"), (6, ""), (7, None), (None, ""), (None, "alone and without id")]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


CLASHES = ("target", "below", "copies", "source_size", "passes", "mix_size", "mix_source", "n_words", "n_removed", "kept_text", "spans", "_doc", "_text", "copy", "kept_id", "row_key", "_row_key", "n_shingles", "component_id", "kept", "score", "own0", "extra0", "sketch", "edited", "next_row", "shard", "rare", "col")


def test_columns_may_have_any_name(spark, tmp_path):
    """Documents with columns named as operators name theirs: the same results, and the columns stay."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[(k * 7) % 50 : (k * 7) % 50 + 90]), "en", "ab"[k % 2], 9) for k in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    for name, df in (("plain", plain), ("wide", wide)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    ops = [n for n in queries.queries() if n not in ("op6_cover_tree", "op8_preference_pairs", "op13_prefix_trie", "pipeline")]
    for name in ops:
        # sums of floats come in the order in which tasks end
        near = lambda r: repr([float(f"{v:.10g}") if isinstance(v, float) else v for v in r])
        a, b = (sorted(map(near, queries.queries()[name](spark, f"{tmp_path}/{side}").collect())) for side in ("plain", "wide"))
        assert a == b, name
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, f"{tmp_path}/wide")
        assert out.columns == wide.columns and {r.target for r in out.collect()} == {"own target"}


def test_vectors_without_an_id_link(spark):
    """Null and repeated vec_ids take part; a component is named by its least id that isn't null."""
    from loomspark.llm import covertree

    near = [[1.0, 0.01 * k, 0.0] for k in range(3)]
    rows = [(None, near[0], 1), (5, near[1], 1), (None, near[2], 1), (None, [0.0, 0.0, 1.0], 1), (7, [0.0, 1.0, 0.0], 1), (7, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0], 2), (None, [0.0, 2.0], 2), (None, None, 1)]
    out = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = [(None, 2, 5, False), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_forward_recursion_is_exact():
    """Equal to the sum over all paths, on a tiny model."""
    from itertools import product

    rng = np.random.default_rng(0)
    k, n = 3, 4
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    emit = rng.dirichlet(np.ones(hmm.CLASSES), k).T
    sequences = [[5, 9, 1, 5], [2], [7, 7, 7], []]
    first = np.cumsum([0, *map(len, sequences)])
    model = hmm.Model(start, move, emit)
    got = hmm.log_likelihood(model, np.array(sum(sequences, [])), first)
    counts = hmm.expected_counts(model, np.array(sum(sequences, [])), first, np.ones(len(sequences), bool))
    total, moves = 0.0, np.zeros((k, k))
    for s, value in zip(sequences, got, strict=True):
        paths = {p: np.prod([(start[p[0]] if t == 0 else move[p[t - 1], p[t]]) * emit[s[t], p[t]] for t in range(len(s))]) for p in product(range(k), repeat=len(s))}
        whole = sum(paths.values())
        assert abs(value - np.log10(whole)) < 1e-9
        total += np.log10(whole)
        for p, share in paths.items():
            for t in range(1, len(s)):
                moves[p[t - 1], p[t]] += share / whole
    assert abs(counts[3] - total) < 1e-4 and np.allclose(counts[1], moves, atol=1e-4) and n == max(map(len, sequences))


def test_bm25_scores_equal_brute_force():
    """Every seed of a shard against every tail, by the formula."""
    rng = np.random.default_rng(2)
    tails = [[k, 0, rng.integers(0, 40, rng.integers(1, 60)).astype("<u4"), 1] for k in range(50)]
    idf, mean = rng.random(40) + 0.1, 30.0
    packing_scores = packing.Pool([list(t) for t in tails], idf, mean).scores(np.arange(50))
    for i, a in enumerate(tails):
        for j, b in enumerate(tails):
            tf = {t: int((b[2] == t).sum()) for t in set(a[2].tolist()) & set(b[2].tolist())}
            want = sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(b[2]) / mean)) for t, n in tf.items())
            assert abs(packing_scores[i, j] - want) < 1e-3


def test_packing_reruns_agree(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    one, two = (sorted(map(tuple, packing.pack(d, queries.vocabulary(), shard=16).where("sequence_id % 2 = 1").drop("ids").collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_sum_of_squares_is_the_sum_over_pairs():
    """The machine's pairwise part against all pairs of features."""
    from loomspark.llm import quality

    rng = np.random.default_rng(4)
    m = quality.Machine(0.3, rng.normal(0, 0.1, quality.SIZE), rng.normal(0, 0.1, (quality.SIZE, quality.FACTORS)))
    f = quality.Features(np.array([3, 9, 3, 12]), np.array([0, 4]), (np.arange(quality.N_STATS) * quality.BINS + (1 << quality.WORD_BITS))[None])
    x = [(i, 0.25) for i in f.index] + [(i, 1.0) for i in f.bins[0]]
    pairs = sum(m.factors[a] @ m.factors[b] * p * q for k, (a, p) in enumerate(x) for b, q in x[:k])
    z = m.bias + sum(m.weights[a] * p for a, p in x) + pairs
    assert abs(m.score(f)[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_minhash_recall_at_the_threshold():
    """Pairs at 0.75 share a table key with the chance that the README states."""
    from loomspark.llm import minhash

    found = 0
    for seed in range(400):
        r = np.random.default_rng(seed)
        both, one, two = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
        sides = []
        for s in (np.concatenate([both, one]), np.concatenate([both, two])):
            factors = minhash._constants(2 * minhash.TABLES * minhash.HALF)
            least = np.array([((s ^ (s >> np.uint64(29))) * f).min() for f in factors]).reshape(2 * minhash.TABLES, minhash.HALF)
            sides.append(least)
        same = (sides[0] == sides[1]).all(axis=1)
        found += bool(same[: minhash.TABLES].any() and same[minhash.TABLES :].any())
    assert found / 400 > 0.96


def test_sketch_containment_is_near_the_exact_share(spark):
    """Mean error against all shingles, by length of the shorter text."""
    from loomspark.llm import fingerprint

    rng = np.random.default_rng(5)
    rows = []
    for n in (30, 300, 3000):
        for _ in range(12):
            words = [f"w{k}" for k in rng.integers(0, 10**6, n)]
            part = words[: n // 2] + [f"x{k}" for k in rng.integers(0, 10**6, n // 4)]
            rows.append((n, " ".join(part), " ".join(words)))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    a, b = (fingerprint.sketch(F.col(c)) for c in "ab")
    exact = fingerprint.containment(fingerprint.sketch(F.col("a"), 1), fingerprint.sketch(F.col("b"), 1), 1)
    share = fingerprint.containment(a, b)
    error = {r.n: r.e for r in df.select("n", F.abs(share - exact).alias("e")).groupBy("n").agg(F.avg("e").alias("e")).collect()}
    assert error[30] == 0 and error[300] < 0.08 and error[3000] < 0.04


def test_blocks_of_windows_hold_every_window_once():
    """The blocks of a text's runs cover its windows, and equal passages have equal blocks."""
    import pyarrow as pa
    from loomspark.llm import substring

    rng = np.random.default_rng(8)
    shared = [f"s{k}" for k in range(120)]
    texts = pa.array([" ".join([f"{x}{k}" for k in rng.integers(0, 999, 70)] + shared + [f"{x}{k}" for k in rng.integers(0, 999, 40 + n)]) for n, x in enumerate("ab")])
    r = substring.runs(texts)
    spans = pa.array([r[r.text == k][["first", "n", "anchor"]].to_dict("records") for k in range(2)], pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64())])))
    text, first, anchor, hashes, singles = substring.blocks(texts, spans)
    sizes = np.diff(singles.offsets.to_numpy())
    assert sizes.max() <= substring.BLOCK
    for k, words in enumerate(map(str.split, texts.to_pylist())):
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first[text == k], sizes[text == k], strict=True)])
        assert sorted(covered.tolist()) == list(range(len(words) - substring.WINDOW + 1))
    one, two = (set(zip(anchor[text == k].tolist(), hashes[text == k].tolist(), strict=True)) for k in (0, 1))
    lone, both = (set(np.concatenate([singles[int(b)].values.to_numpy() for b in np.flatnonzero(text == k)]).tolist()) for k in (0, 1))
    assert len(lone & both) == 120 - substring.WINDOW + 1 and one & two


def test_sketch_bounds_and_merges_by_brute_force(spark):
    """Every pair of texts of 1 to 700 words: retained hashes, merges, containment and resemblance
    in plain Python from all hashes of the texts."""
    from loomspark.llm import fingerprint

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40 if n % 3 else 10**6, n)) for n in (1, 4, 6, 30, 63, 68, 69, 200, 511, 700)]
    pool = texts[-1].split()
    texts += ["", " ".join(pool[:5]), " ".join(pool[100:160]), " ".join(pool[:400])]
    top, k_least = int(2**64 * fingerprint.FRACTION) - 2**63, fingerprint.LEAST
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, j int, a string, b string")
    a, b, whole_a, whole_b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")), fingerprint.sketch(F.col("a"), 1), fingerprint.sketch(F.col("b"), 1)
    found = df.select(a.alias("x"), b.alias("y"), whole_a.alias("all_x"), whole_b.alias("all_y"), fingerprint.merged(a, b).alias("m"), fingerprint.containment(a, b).alias("c"), fingerprint.resemblance(a, b).alias("r"))

    def kept(hashes):
        low = [h for h in hashes if h < top]
        return low if len(low) >= k_least else hashes[:k_least]

    unknown = 0
    for r in found.collect():
        assert r.x == kept(r.all_x) and r.y == kept(r.all_y) and r.m == kept(sorted({*r.all_x, *r.all_y}))
        bounds = [2**63 if len(h) < k_least else max(kept(h)[-1], top - 1) for h in (r.all_x, r.all_y)]
        x, y = ({h for h in hashes if h <= min(bounds)} for hashes in (r.all_x, r.all_y))
        if not r.all_x or not r.all_y:
            assert r.c == r.r == float(r.all_x == r.all_y)
            continue
        assert r.r == len(x & y) / len(x | y)
        unknown += r.c is None
        assert r.c == (len(x & y) / min(len(x), len(y)) if x and y else None)
    assert unknown


def test_forest_of_links_joins_what_links_do():
    """A chain of 30,000 points in linear time, and random links: as many edges as components lost."""
    from loomspark.llm import covertree

    chain = covertree.Links(30_000)
    start = time.perf_counter()
    for k in range(29_999):
        chain.join(k, np.array([k + 1]))
    assert time.perf_counter() - start < 10 and len(set(chain.roots(np.arange(30_000)).tolist())) == 1
    rng = np.random.default_rng(3)
    links, sets = covertree.Links(300), [{k} for k in range(300)]
    for _ in range(120):
        a, points = int(rng.integers(300)), rng.integers(0, 300, 3)
        links.join(a, points)
        met = set().union(sets[a], *(sets[p] for p in points.tolist()))
        for k in met:
            sets[k] = met
    want = {frozenset(x) for x in map(frozenset, sets)}
    roots = links.roots(np.arange(300))
    assert {frozenset(np.flatnonzero(roots == r).tolist()) for r in set(roots.tolist())} == want
    assert len(links.edges) == 300 - len(want)
    again = covertree.Links(300)
    for a, b in links.edges:
        again.join(a, np.array([b]))
    assert len(again.edges) == len(links.edges) and {tuple(again.roots(np.arange(300)) == r) for r in set(again.roots(np.arange(300)).tolist())} == {tuple(roots == r) for r in set(roots.tolist())}


def test_traversal_of_clusters_by_brute_force():
    """Clusters of many widths: counts of links and components as all pairs give them, between two trees and within one."""
    from loomspark.llm import covertree

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    u = np.concatenate([c + rng.normal(size=(15 + k, 16)) * (0.02 + 0.02 * (k % 20)) for k, c in enumerate(centres)])
    u /= np.sqrt((u**2).sum(axis=1))[:, None]
    rng.shuffle(u)
    n, weight = len(u), rng.integers(1, 4, len(u))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    half = np.arange(n) < n // 3
    one, two = covertree.tree(u, np.flatnonzero(half)), covertree.tree(u, np.flatnonzero(~half))
    links = covertree.Links(n)
    for a, b in ((one, one), (two, two), (one, two)):
        covertree.traverse(u, weight, a, b, 0.93, links)
    assert near.sum() > 5000 and (links.counts == near @ weight).all()
    least = np.arange(n)
    while (lower := np.minimum(least, np.where(near, least, n).min(axis=1))).tolist() != least.tolist():
        least = lower
    roots = links.roots(np.arange(n))
    assert len(set(roots.tolist())) == len(set(least.tolist())) == len(set(zip(roots.tolist(), least.tolist(), strict=True)))
    assert len(links.edges) == n - len(set(least.tolist()))
