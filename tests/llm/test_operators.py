"""The training-data operators on tables of edge cases, against SQL or brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from loomspark.llm import minhash, quality, queries
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"


def passage(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, 5000, n))


def texts() -> list[str | None]:
    base = passage(1, 300)
    near = [" ".join("X" if j == 7 * k + 3 else w for j, w in enumerate(base.split())) for k in range(12)]
    shared = passage(2, 80)
    edge = [None, "", "   ", "one", "Two words", "two WORDS", "a b c d e", "ünï 😀 　 ok\r\nline", "<|endoftext|> x"]
    mixed = [f"{passage(10 + k, 60)} {shared} {passage(40 + k, 50)}" for k in range(5)]
    return [*edge, base, base, *near, *mixed, passage(3, 12_000), " ".join(["same"] * 400), base.upper()]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Edge cases in documents, with columns whose names an operator may use itself."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", [None, "hot", "hot", "b"][k % 4], len(t or ""), "n", "k") for k, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    r = np.random.default_rng(0)
    centre = r.normal(size=(4, 6))
    vectors = [(k, [float(x) for x in centre[k % 4] + 0.12 * r.normal(size=6)], [0, 1, None][k % 3]) for k in range(90)]
    vectors += [(90, None, 0), (91, [0.0] * 6, 0), (92, [float("nan")] * 6, 0), (93, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (94, vectors[0][1], 0), (95, [1.0, 2.0], 0), (96, [2.0, 4.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{path}/embeddings.parquet")
    turns = [(c, t, ["user", "assistant", None][(t + c) % 3], [f"say {c} {t}", None, ""][(c * t) % 3]) for c in range(6) for t in range(c + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    labels = [(k, int(k % 2), 0) for k in range(len(rows))] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "conversations", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_edges_equal_sql(spark, sf, same_rows, name):
    same_rows(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n != "op4_factorisation_machine"))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts()]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_loses_no_id(spark, sf, ids):
    rows = queries.op1_retrieval_packing(spark, sf).collect()
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        whole = [*ids[r.doc_id], 0]
        assert r.doc_tokens == len(whole) and crc(whole[r.start : r.start + r.length]) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.start, r.length))
    for k, whole in enumerate(ids):
        at = 0
        for start, length in sorted(starts[k]):
            assert start == at and length > 0
            at += length
        assert at == len(whole) + 1
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.02 * sum(len(x) + 1 for x in ids)


def test_token_files_round_trip(spark, sf, ids):
    at = 0
    for r in sorted(queries.op9_bitplane_tokens(spark, sf).collect()):
        whole = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)


def test_hmm_base_and_exact_likelihood(spark, sf):
    rows = {r.doc_id: r for r in queries.op2_hmm_scores(spark, sf).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*WORD.findall(lower(t)), None] for t in texts()]
    training = Counter(w for k, d in enumerate(tokens) if zlib.crc32(str(k).encode()) % 5 != 1 for w in d)
    n, v = sum(training.values()), len(training)
    for k, d in enumerate(tokens):
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 5 == 1, len(d), sum(w in training for w in d), n)
        base = sum(math.log10((training[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_fingerprints(spark, sf):
    rows = sorted(queries.op3_scaled_sketches(spark, sf).collect())
    t = [x or "" for x in texts()]
    by_text = defaultdict(set)
    for k, r in enumerate(rows):
        following, half = t[(k + 1) % len(t)], len(t[k]) // 2
        edited = t[k][: len(t[k]) - half] + following[:half]
        assert r.n_chars == len(t[k]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t[k]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert rows[9].near_next == 1.0  # a copy follows


def test_native_operators_have_no_python(spark, sf):
    plans = [queries.op3_scaled_sketches(spark, sf), queries.op5_source_mix(spark, sf), queries.op8_preference_pairs(spark, sf)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", text)


def test_quality_learns_from_text_alone(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op4_factorisation_machine(spark, sf_dir)
    labelled = rows.where("held_out").join(queries.documents(spark, sf_dir, "labels").where("quality is not null"), "doc_id").toPandas()
    good, bad = (labelled[labelled.quality == q].score.to_numpy() for q in (1, 0))
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.8
    docs = queries.documents(spark, sf_dir)
    blind = docs.withColumn("source", F.lit("?")).withColumn("lang", F.lit(None).cast("string"))
    machine = quality.train(docs, queries.training_labels(spark, sf_dir))
    assert quality.scored(docs, machine).select("doc_id", "score").exceptAll(quality.scored(blind, machine).select("doc_id", "score")).count() == 0


def test_minhash_group_of_near_copies_and_repeats(spark):
    """A group larger than several blocks, rows that repeat, and null ids."""
    base = passage(5, 200).split()
    rows = [(k, " ".join(base[:j] + ["z"] + base[j + 1 :])) for k, j in enumerate(list(range(200)) * 2)]
    rows += [(7, rows[7][1]), (None, "alone with no id here"), (None, None), (900, passage(6, 90)), (900, passage(7, 90))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == (0 if r.doc_id is not None and r.doc_id < 900 else r.doc_id)


def test_forest_skips_connected_classes():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in range(4)]
    assert len(list(minhash._forest([b"a", b"b", b"c", b"d"], sets, [b"r", b"r", b"s", b"r"], 75))) == 1
    assert list(minhash._forest([b"a", b"b"], sets[:2], [b"r", b"r"], 75)) == []


def test_preference_masks_cover_answers(spark, sf):
    for r in queries.op8_preference_pairs(spark, sf).collect():
        for text, mask in ((r.chosen_text, r.chosen_mask), (r.rejected_text, r.rejected_mask)):
            for span in mask.split():
                low, high = map(int, span.split("-"))
                assert text[low:high].endswith("<|im_end|>")


def test_pipeline_keeps_order_and_columns(spark):
    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "substring_dedup", "source_mix", "packing"]
    seen = docs
    for _, stage in p.STAGES[:2]:
        kept = stage(spark, seen, sf_dir)
        assert kept.columns == docs.columns and kept.exceptAll(seen).count() == 0
        seen = kept
    cut = p.substring_dedup(spark, seen, sf_dir)
    assert cut.count() == seen.count() and cut.columns == docs.columns
