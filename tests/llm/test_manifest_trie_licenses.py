"""License scans, Merkle manifests and prefix tries on edge cases, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomspark.llm import licenses, manifest, queries, trie
from loomspark.llm.license_rules import RULES, SIGNATURES, read

NEW = ("op11_license_rules", "op12_merkle_manifest", "op13_prefix_trie")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def texts() -> list[str | None]:
    edge = [None, "", "  ", "!!!", "cc", "CC BY", "cc-by", "Cc By cc by CC-BY-SA 4.0", "by cc", "ccc by", "GENERAL PUBLIC LICENSE", "x general public license, version 2"]
    notices = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License. All rights reserved.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License, version 3 or any later version"]
    odd = ["Kopyright 2020 all riKhts reserved", "İ cc by İ", "é cc by 日本 all rights reserved", "all rights\x85reserved", "all\trights\nreserved <cc><by> #cc#by#"]
    long = ["filler " * 3000 + "all rights reserved " * 700 + "mit license " * 300]
    return [*edge, *notices, *odd, *long, "see the license file for more details", "public domain, no warranty of any kind"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("new")
    rows = [(k, t, [None, "en", "en", "en", "é", "z", "日"][k % 7], [None, "", "s"][k % 3], None if k % 5 == 0 else k) for k, t in enumerate(texts())]
    rows += [(1000 + k, f"text {k}", "en", "s", k) for k in range(700)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    turns = []
    for c in [*range(40), 100, 101, 102, 205, 299, 300]:
        turns += [(c, t, ["user", None][t % 2], [f"hello {min(t, c % 3)}", None, "längst 😀"][(t * (c % 4)) % 3]) for t in range(c % 9)]
    turns += [(7, None, "user", "first"), (7, 1, "a", "tie"), (7, 1, "a", "tie"), (400, 0, "user", ""), (None, 0, "user", "lost"), (None, None, None, None)]
    turns += [(c, t, "user", f"deep {t if t < 12 else c}") for c in range(500, 530) for t in range(14)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", NEW)
def test_new_operators_equal_sql(spark, sf, same_rows, name):
    same_rows(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_hundreds_of_rules_have_their_keyword():
    assert len(RULES) > 200 and len(SIGNATURES.strip().splitlines()) + 3 == len(RULES)

    @settings(max_examples=1500, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.pattern, fullmatch=True))))
    def holds(pair):
        assert f"<{pair[0].keyword}>" in pair[1]

    holds()


def detections(text: str | None, rules) -> list[tuple]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    marked = "".join(f"<{w}>" for w in words)
    found = []
    for r in rules:
        if r.keyword in words:
            for m in re.finditer(r.pattern, marked):
                first = marked[: m.start()].count("<")
                found.append((first, first + m.group().count("<"), r))
    stays = lambda a, b, r: r.base or not any(c <= a and d >= b and e.tier <= r.tier and (d - c > b - a or e.tier < r.tier or e.rule < r.rule) for c, d, e in found)
    return sorted((a, b, r.label, stays(a, b, r)) for a, b, r in found)


def test_detections_equal_brute_force(spark):
    rules = read("1 long mit: under the mit license( now)?\n2 mid mit: the mit license\n2 same mit: the mit license\n3 wide license: @ @ @ license\n2 part license: license now")
    rows = [(0, "under the MIT license now"), (1, "the mit license the mit license"), (2, "all rights reserved"), (3, None), (4, "a b c license now cc by")]
    found = licenses.scanned(spark.createDataFrame(rows, "id int, text string"), rules).collect()
    for r, (_, text) in zip(sorted(found), rows, strict=True):
        assert sorted((d.first_word, d.end_word, d.label, d.kept) for d in r.detections) == detections(text, rules)


def test_scans_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "MIT license", "x", 3, "y")], "doc_id int, text string, detections string, N_Words int, `a.b` string")
    row = licenses.scanned(docs).first()
    assert row["a.b"] == "y" and row.n_words == 2 and [d.label for d in row.detections if d.kept] == ["mit"]
    assert "N_Words" not in licenses.scanned(docs).columns


def test_scan_is_native(spark, sf):
    plan = licenses.summarised(licenses.scanned(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def merkle(nodes: list[str]) -> tuple[list[list[tuple[str, str]]], str]:
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, j in enumerate(at):
            run = level[j - j % 2 : j - j % 2 + 2]
            paths[k].append(("".join(run[: j % 2]), "".join(run[j % 2 + 1 :])))
        at = [j // 2 for j in at]
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return paths, level[0]


def expected_manifest(rows) -> list[tuple]:
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(text(v) for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for g in order}
    trees = {g: merkle([leaf(r) for r in held[g]]) for g in order}
    crown, root = merkle([trees[g][1] for g in order])
    out = []
    for g, above in zip(order, crown, strict=True):
        for r, below in zip(held[g], trees[g][0], strict=True):
            path = below + above
            node = leaf(r, 1 if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else 0)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r.doc_id, leaf(r), trees[g][1], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, sf).collect()), key=repr) == expected_manifest(docs.collect())


@pytest.mark.parametrize("n", [1, 3, 257])
def test_manifest_of_any_size(spark, tmp_path, n):
    rows = [(k, f"t{k}", None if n < 4 else "en", "s", None) for k in range(n)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == expected_manifest(docs.collect())


def test_manifest_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (3, "c", "en", "s", 1), (3, "c", "en", "s", 1), (3, "d", "en", "s", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{DOCS}, leaf string, _at string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_manifest(docs.collect())


def expected_trie(rows) -> list[tuple]:
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", hashlib.sha256((r.text or "").encode()).hexdigest(), r.text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    members, ends, children, leaves, saved = (defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    up = lambda k: min(members[k[:-1]]) if k else None
    return sorted(((len(k), min(m), up(k), len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items()), key=repr)


@pytest.mark.parametrize("most", [1, 20, 200_000])
def test_trie_equals_brute_force(spark, sf, most):
    """However little a task may hold, and so however often subtries are dealt anew."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    got = trie.nodes(trie.rebuilt(trie.sequences(rows)), most_turns=most)
    columns = [c.split()[0] for c in trie.NODE.split(", ")]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == expected_trie(rows.collect())


def test_trie_hashes_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    turns = spark.createDataFrame([(c, 0, "user", "same") for c in range(37)], "conv_id long, turn long, role string, text string")
    node = trie.nodes(trie.sequences(turns)).where("depth = 1").first()
    assert node.n_convs == 37 and node.ends_sha256 == sha(",".join(map(str, range(37)))) and node.saved_tokens == 36 * 4


@pytest.mark.parametrize("name", NEW)
def test_new_operators_on_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_path_folds_to_the_root(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", k) for k in range(5)], DOCS)
    rows = manifest.verified(manifest.manifest(docs), "leaf")
    assert all(r.verified for r in rows.collect())
