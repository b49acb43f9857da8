"""Rows without ids and rows that repeat, clashing columns, planes of bits, and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from loomspark.llm import bitplane, covertree, preferences, quality, queries
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OVER_DOCUMENTS = ("op1_retrieval_packing", "op2_hmm_scores", "op3_scaled_sketches", "op4_factorisation_machine", "op5_source_mix", "op7_tensored_minhash", "op9_bitplane_tokens", "op10_substring_dedup", "op11_license_rules", "op12_merkle_manifest")


def words(seed: int, n: int) -> str:
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 4000, n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated doc_ids, rows that repeat whole, null and empty texts, null sources."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(None, words(1, 80), "en", "a", 1), (None, words(1, 80), "en", "a", 1), (None, None, None, None, None), (None, "", "en", None, 0), (3, words(2, 60), "en", "a", 2)]
    rows += [(3, words(2, 60), "en", "a", 2), (3, words(3, 60), "de", "b", 3), (4, None, "de", "b", None), (5, "short", "de", "b", 5)] + [(k, words(k, 40), "en", "a", k) for k in range(10, 30)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_every_row_counts(spark, odd, name):
    path, ids = odd
    rows = queries.queries()[name](spark, path).collect()
    if name == "op1_retrieval_packing":  # pieces: each document's begin at 0
        rows = [r for r in rows if r.start == 0]
    assert Counter(r.doc_id for r in rows) == ids


def test_quality_of_empty_tables(spark, tmp_path):
    """No documents: no scores.  No labels: every document has one, by a model without training."""
    docs = spark.createDataFrame([(1, "some text", "en", "a", 9), (2, None, "en", "a", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = [r.score for r in quality.scored(docs, quality.train(docs, none)).collect()]
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    assert quality.scored(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_vectors_and_turns_keep_their_results_under_clashing_columns(spark):
    r = np.random.default_rng(5)
    vectors = spark.createDataFrame([(k, [float(x) for x in r.normal(size=4)], k % 2) for k in range(40)], "vec_id long, embedding array<double>, label int")
    names = ("block", "point", "key", "a", "b", "root", "n_links", "kept", "component_id", "pivot", "node")
    same = lambda f, x: sorted(map(repr, f(x).collect())) == sorted(map(repr, f(x.withColumns({n: F.lit("own") for n in names})).collect()))
    assert same(lambda x: covertree.near_vectors(x).select("vec_id", "n_links", "component_id", "kept"), vectors)
    turns = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"t{c}{t}") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string")
    names = ("turns", "t", "last", "answer", "next_row", "_key", "_range")
    assert same(lambda x: preferences.format_pairs(preferences.swapped_pairs(x)), turns)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_of_bytes_and_bits_round_trip(spark, tmp_path, bits):
    ids = np.random.default_rng(6).integers(0, 1 << 32, 1003, dtype=np.uint64).astype("<u4")
    assert (bitplane._ids(bitplane._planes(ids, bits), len(ids), bits) == ids).all()
    docs = spark.createDataFrame([(k, words(k, k * 37 % 90), "en", "a", 1) for k in range(50)] + [(None, None, "en", "a", 1)], DOCS)
    rows = bitplane.read_shards(bitplane.write_shards(docs, queries.vocabulary(), bits=bits, folder=f"{tmp_path}/shards", shards=3))
    plain = bitplane.read_shards(bitplane.write_shards(docs, queries.vocabulary(), folder=f"{tmp_path}/plain", shards=2))
    assert rows.exceptAll(plain).count() == 0 and rows.count() == plain.count() == 51


def shingles(text: str | None) -> set:
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def deduplicated(docs: dict[int, str]) -> set[int]:
    """Least id of each group of texts that links join."""
    root, sets = {d: d for d in docs}, {d: shingles(t) for d, t in docs.items()}
    find = lambda d: d if root[d] == d else find(root[d])
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in docs}


def without_repeats(docs: dict[int, str | None]) -> dict[int, str | None]:
    first, tokens = {}, {d: WORD.findall(t or "") for d, t in docs.items()}
    for d in sorted(tokens):
        for k in range(len(tokens[d]) - 49):
            first.setdefault(tuple(tokens[d][k : k + 50]), d)
    out = {}
    for d, w in tokens.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for j in range(k, k + 50)}
        out[d] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else docs[d]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: all rows of the whole run, but the order of packing."""
    import corpus_pipeline
    import duckdb
    from tokenizers import Tokenizer

    base, passage = words(100, 120).split(), words(101, 70)
    near = [" ".join(base[:j] + ["x"] + base[j + 1 :]) for j in (3, 40, 90)]
    texts = [" ".join(base), *near, " ".join(base), None, "", "few words", words(7, 200)]
    texts += [f"{words(200 + k, 50)} {passage} {words(300 + k, 40)}" for k in range(4)] + [words(400 + k, 60 + 9 * k) for k in range(20)]
    rows = [(k, t, "en", "abc"[k % 3], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    accepted = {r.doc_id for r in queries.op4_factorisation_machine(spark, sf).collect() if r.score >= 0.3}
    assert accepted
    docs = {k: t for k, t, *_ in rows if k in accepted}
    kept = deduplicated(docs)
    cut = without_repeats({d: t for d, t in docs.items() if d in kept})
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(d, t, "abc"[d % 3]) for d, t in cut.items()])
    mixed = con.sql(queries.OP5_SQL).fetchall()
    sizes = {d: len(WORD.findall(t or "")) for d, t in cut.items()}
    times = {d: taken // size for d, size, _, _, taken in mixed if size}
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = {d: [*tokenizer.encode(cut[d] or "", add_special_tokens=False).ids, 0] for d in cut}
    out = corpus_pipeline.run(spark, sf).collect()
    placed, copies = defaultdict(list), Counter(r.doc_id for r in out if r.start == 0)
    assert {d: n for d, n in copies.items() if sizes[d]} == {d: n for d, n in times.items() if n}
    for r in out:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        placed[r.sequence_id].append((r.offset, r.length))
    for d, n in copies.items():
        assert sum(r.length for r in out if r.doc_id == d) == n * len(want[d])
    for pieces in placed.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()


def test_sketches_of_parts_merge(spark):
    from loomspark.llm import fingerprint

    a, b = words(8, 300), words(9, 300)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.merged(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("m"), fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y")).first()
    assert row.m == sorted({*row.x, *row.y}) and hashlib.sha256(str(row.m).encode()).hexdigest()
