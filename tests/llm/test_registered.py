"""Registered queries without SQL, and the pipeline, against brute force over whole small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from ledgerloom.llm import queries
from ledgerloom.llm.pii_segments import KINDS, luhn
from tests.llm import odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    return {i: t or "" for i, t in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def near_roots(texts):
    """Shingle sets and component of each text."""
    sets, holders = {}, defaultdict(list)
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[i]:
            holders[x].append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        shared = Counter(j for x in own for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in texts}


def test_near_duplicates(spark, texts):
    sets, roots = near_roots(texts)
    got = {tuple(r) for r in queries.op1_min_max_dedup(spark, SF).collect()}
    assert got == {(i, len(sets[i]), roots[i], roots[i] == i) for i in texts}


def test_passages(spark, texts):
    words = {i: t.encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    want = set()
    for i, w in words.items():
        stay = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                stay[j : j + 35] = [False] * 35
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        want.add((i, len(w), len(w) - len(kept), sha(b" ".join(kept))))
    assert {tuple(r) for r in queries.op4_fm_index_dedup(spark, SF).collect()} == want


def test_personal_data(spark, texts):
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda d, m: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 9 <= len(d) <= 15),
    }
    got = {r.doc_id: r for r in queries.op5_pii_segments(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = [
            (m.start(), KINDS.index(k), f"{k}:{m.start()}:{m.end()}")
            for k, (p, good) in patterns.items()
            for m in re.finditer(p, t)
            if good(re.sub("[^0-9]", "", m.group()), m.group())
        ]
        listed = [s for *_, s in sorted(base)]
        assert got[i].base_sha256 == sha(",".join(listed).encode())
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in listed) for k in KINDS]
        assert set(listed) <= set(got[i].spans.split(","))


def test_quality(spark, texts):
    got = {r.doc_id: r for r in queries.op8_attention_mil(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM read_parquet('/root/testdata/sf0.01/labels.parquet')").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    apart = [got[i].predicted == q for i, q in labels if got[i].held_out]
    assert sum(apart) / len(apart) > 0.93


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for r in queries.op9_piece_transducer(spark, SF).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids)
        assert r.round_trip == ("▁" not in texts[r.doc_id])


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.columns[:5] == columns and (n == 4 or len(docs.columns) == 5)
        kept.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    good, exact, near, mixed, _ = kept
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall())
    judged = [labels[i] for i, _ in good if i in labels]
    assert sum(judged) / len(judged) > 0.95 and sum(judged) > 0.97 * sum(labels.values())
    first = {}
    for i, t in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(i for i, _ in exact) == sorted(first.values())
    roots = near_roots(dict(exact))[1]
    assert sorted(i for i, _ in near) == sorted(set(roots.values()))
    assert {i for i, _ in mixed} <= {i for i, _ in near} and abs(len(mixed) / len(near) - 1) < 0.2
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    rows = docs.collect()
    assert len(rows) == len(mixed) and all(list(r.ids) == library.encode(r.text) and r.round_trip for r in rows)


@pytest.mark.parametrize("table", [odd.docs, odd.empty, odd.clashing])
def test_stages_take_odd_tables(spark, table):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        assert set(docs.columns) <= set(done.columns), name
        done.write.format("noop").mode("overwrite").save()
