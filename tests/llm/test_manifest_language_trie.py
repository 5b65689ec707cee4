"""Merkle manifest, language identification and prefix trie on odd rows, against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, merkle, prefix_trie, queries
from tests.llm import odd


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------------------


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, add=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + add
    return sha("".join(field(v) for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def proofs_of(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), where every third row claims another leaf."""
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(trees[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for k in keys}
    levels = {k: tree_of([leaf_of(r) for r in ordered[k]]) for k in keys}
    top = tree_of([levels[k][-1][0] for k in keys])
    for tree, k in enumerate(keys):
        for i, r in enumerate(ordered[k]):
            siblings, node = "", leaf_of(r, int(r["doc_id"] is not None and r["doc_id"] % 3 == 0))
            for own, place in ((levels[k], i), (top, tree)):
                for nodes in own[:-1]:
                    beside = nodes[place ^ 1] if place ^ 1 < len(nodes) else ""
                    siblings += beside
                    node = sha(beside + node if place % 2 else node + beside)
                    place //= 2
            yield r["doc_id"], leaf_of(r), levels[k][-1][0], top[-1][0], sha(siblings), node, node == top[-1][0]


def claimed(docs):
    add = F.when(F.coalesce("doc_id", F.lit(1)) % 3 == 0, 1).otherwise(0)
    return merkle.leaf([docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"] + add, docs["text"]])


def shown(manifest):
    return merkle.verified(manifest.proofs(), "claimed").select(
        "id", "node", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified"
    )


@pytest.mark.parametrize("every", [2, 5])
def test_proofs_against_brute_force(spark, every):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in odd.rows()]
    rows += [
        {"doc_id": 200 + i, "text": f"t{i % 50}", "lang": ["aa", "é", None, "", "z"][min(4, i % 9)], "source": None, "n_chars": i}
        for i in range(300)
    ]
    rows += [rows[-1], rows[-1]]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], odd.SCHEMA).repartition(6)
    got = shown(merkle.build(docs, every=every, claimed=claimed(docs))).collect()
    assert Counter(tuple(r) for r in got) == Counter(proofs_of(rows))


def test_stored_manifest_is_opened_again(spark, tmp_path):
    docs = odd.docs(spark)
    built = merkle.build(docs, path=str(tmp_path / "m"), every=2, claimed=claimed(docs))
    again = merkle.opened(spark, str(tmp_path / "m"), every=2)
    assert again.root() == built.root() is not None
    assert Counter(shown(again).collect()) == Counter(shown(built).collect())
    assert len([p for p in (tmp_path / "m" / "rows").iterdir()]) == 3  # 11 leaves have 4 levels above them: two are kept


def test_manifest_of_odd_tables(spark):
    nothing = odd.empty(spark)
    manifest = merkle.build(nothing, claimed=claimed(nothing))
    assert manifest.root() is None and shown(manifest).count() == 0
    clashing = odd.clashing(spark).withColumns({n: F.lit(n) for n in ("tree", "at", "of", "path", "level", "claimed", "id")})
    docs = odd.docs(spark)
    plain = shown(merkle.build(docs, claimed=claimed(docs)))
    assert Counter(shown(merkle.build(clashing, claimed=claimed(clashing))).collect()) == Counter(plain.collect())
    one = odd.docs(spark).filter("doc_id = 4")
    got = shown(merkle.build(one, claimed=claimed(one))).first()
    assert got["node"] == got["subroot"] == got["root"] and got[4] == sha("") and got["verified"]


# --- languages --------------------------------------------------------------------------------------------


def test_runs_of_bytes_against_plain_counts():
    texts = ["Ab, c", "", None, "é1é", " ..x"]
    (_, _, buckets, firsts), *_ = language_id.runs_of_bytes(pa.array(texts))
    for i, text in enumerate(texts):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        kept = " ".join(kept.split()) + " " if kept.strip() else ""
        data = b"   " + kept.encode()
        want = Counter()
        for k in range(language_id.ORDERS):
            for j in range(3, len(data)):
                code = sum(data[j - x] << (8 * x) for x in range(k + 1))
                factor = int(language_id._FACTORS[k])
                want[((code * factor + k) % 2**32) >> (32 - language_id.BUCKET_BITS)] += 1
        assert Counter(buckets[:, firsts[i] : firsts[i + 1]].ravel().tolist()) == want


def test_machines_separate_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = [(np.array([i % 2, 5], np.int32), np.array([1.0, rng.random()], np.float32)) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    w = language_id.support_vectors(x, y)
    margins = np.array([w[f] @ v + w[-1] for f, v in x])
    assert (margins * y > 0.9).all()


def test_languages_held_out(spark):
    got = queries.op12_language_families(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    apart = [r.lang_pred == labels[r.doc_id] for r in got if r.held_out and r.lang_pred != "und" and labels[r.doc_id]]
    assert len(apart) > 100 and sum(apart) / len(apart) > 0.97


def test_languages_of_odd_tables(spark):
    words = {"en": "the thing and this whale", "de": "und schöne Häuser zwischen", "fr": "les eaux où était", "xx": "kwak zork blub"}
    rows = [(i, words[k] + f" {i}", k, "s", 1) for i in range(160) for k in [list(words)[i % 4]]]
    learned = spark.createDataFrame(rows + [rows[0]] * 5, odd.SCHEMA)
    model = language_id.train(learned)
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"], "only xx": ["xx"]}
    docs = spark.createDataFrame([(i, w, None, None, None) for i, w in enumerate(words.values())], odd.SCHEMA)
    assert [r.lang_pred for r in language_id.identify(docs, model).orderBy("doc_id").collect()] == list(words)
    clashing = odd.clashing(spark).withColumns({n: F.lit(n) for n in ("lang_pred", "own_lang", "id", "same", "found", "job")})
    got = language_id.identify(clashing, model).collect()
    assert len(got) == len(odd.rows())
    for r in got:
        known = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not known) and (known or r.score == 0)
    assert language_id.identify(odd.empty(spark), model).count() == 0
    nothing = language_id.train(odd.empty(spark))
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd.docs(spark), nothing).collect()} == {("und", 0.0)}
    alone = language_id.train(learned.filter("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, alone).collect()} == {("fr", 1.0)}


def test_one_word_of_a_hundred_thousand_letters(spark):
    docs = spark.createDataFrame([(1, "ab" * 100_000, "en", "s", 1), (2, " " * 100_000, "en", "s", 1)], odd.SCHEMA)
    model = language_id.Model({"germanic": ["en"]})
    assert [r.lang_pred for r in language_id.identify(docs, model).orderBy("doc_id").collect()] == ["en", "und"]


# --- conversations ----------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie_of(rows, rebuild=True):
    grouped = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            same = hashlib.md5((text or "").encode()).hexdigest()
            grouped[c].append((turn is not None, turn or 0, role or "", same, text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in grouped.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in below[n]) if below[n] else 1
        saved[n] = sum(saved[x] for x in below[n]) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
        if n:
            below[n[:-1]].append(n)
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n],
         sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))))
        for n, m in members.items()
    )


def odd_turns():
    rnd, rows = random.Random(3), []
    for c in [*range(260), -5, -105, 1000, 1001, None]:
        for t in range(rnd.choice([1, 2, 5, 9, 30])):
            turn, role = rnd.choice([t, t, t, None]), rnd.choice(["u", "u", None])
            rows.append((c, turn, role, rnd.choice(["a", "a", "a", "b", "", None])))
    rows += [(5000, i, "u", "a" * (i % 3)) for i in range(500)] + [(5001, i, "u", "a" * (i % 3)) for i in range(430)]
    rows += [(c, 0, "u", "the same for a third of all") for c in range(7000, 7800)]
    return [r for r in rows if r[0] != 100]


@pytest.mark.parametrize(("make", "rebuild", "block"), [
    (prefix_trie.rebuilt_trie, True, 4), (prefix_trie.own_trie, False, 4), (prefix_trie.own_trie, False, 1), (prefix_trie.own_trie, False, 7),
])
def test_trie_against_brute_force(spark, monkeypatch, make, rebuild, block):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)  # so that ids of one node are joined from several pieces
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert Counter(tuple(r) for r in make(turns, block).collect()) == trie_of(rows, rebuild)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(empty).count() == 0 and prefix_trie.own_trie(empty).count() == 0
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, None, None, None), (None, 1, "u", "x"), (3, 1, "u", "y" * 200_000)]
    names = ("at", "of", "same", "t1", "t2", "chars", "total", "depth", "n_convs", "path", "b", "k1", "x1")
    turns = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(n) for n in names})
    assert Counter(tuple(r) for r in prefix_trie.own_trie(turns).collect()) == trie_of(rows, False)
