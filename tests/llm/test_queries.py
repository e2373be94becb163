"""The registered queries on the smallest tables, against brute force or SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from authscope.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import slow_components, slow_fill, slow_fingerprint, slow_measures, slow_secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_language(spark, docs):
    found = rows(spark, "op1_language_id")
    assert {r["doc_id"] for r in found} == set(docs) and len(found) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if r["held_out"]]) >= 0.95


def test_quality(spark, docs):
    for r in rows(spark, "op2_quality_rules"):
        n, chars, symbols, lines, repeats = slow_measures(docs[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("name, table", [("op3_chat_formatting", "conversations"), ("op5_warc_archive", "pages")])
def test_sql(spark, name, table):
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    theirs = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in rows(spark, name)))) == sorted(map(str, theirs.fetchall()))


def test_neighbours(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()}
    found = defaultdict(list)
    for r in rows(spark, "op4_nearest_neighbours"):
        assert r["score"] == pytest.approx(np.linalg.norm(x[r["query_id"]] - x[r["vec_id"]]))
        found[r["query_id"]].append(r["vec_id"])
    assert set(found) == {i for i in x if i % 100 == 0}
    true = {q: sorted((np.linalg.norm(x[q] - v), i) for i, v in x.items() if i != q)[:10] for q in found}
    assert np.mean([len({i for _, i in true[q]} & set(found[q])) / 10 for q in found]) >= 0.9


def test_secrets(spark, docs):
    for r in rows(spark, "op6_secret_scan"):
        base = slow_secrets(docs[r["doc_id"]]["text"])
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, "op7_token_counts"):
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4") for i, d in docs.items()}
    at, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op8_packing"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        at[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, ends in [(s, len(ids[i])) for i, s in at.items()] + [(s, None) for s in sequences.values()]:
        end = 0
        for start, length in sorted(spans):
            assert start == end
            end += length
        assert end == ends if ends else end <= 2048
    assert set(at) == set(docs) and len(sequences) * 2048 <= 1.05 * sum(map(len, ids.values())) + 2048


def test_mix(spark, docs):
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows(spark, "op9_curriculum_mix"):
        d = docs[r["doc_id"]]
        assert r["size"] == slow_measures(d["text"])[0] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        targets[d["source"]] = r["target"]
    names = sorted(sizes)
    expected = slow_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [targets[s] for s in names] == pytest.approx(expected) and all(abs(taken[s] - targets[s]) <= 1 for s in names)


def test_near_duplicates(spark, docs):
    fps = {i: slow_fingerprint(d["text"]) for i, d in docs.items()}
    expected = slow_components(fps)
    found = rows(spark, "op10_simhash_components")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{f:016x}", expected[i]) for i, f in fps.items()}
