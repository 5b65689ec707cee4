"""Licence scan, segments of the random field and documents of one template against brute force."""

from __future__ import annotations

import random

import pytest
import regex

from ledgerloom.llm import licences as LI
from ledgerloom.llm import min_max_dedup as MM
from ledgerloom.llm import pii_segments as PI
from ledgerloom.llm.licence_texts import LICENCES


def plain_form(text: str) -> str:
    """Canonical lines of a text, step by step."""
    out = (text or "").lower().translate({ord(c): "\n" for c in LI.LINE_ENDS})
    if regex.search(LI._GRANT, out):
        out = regex.sub(LI.COPYRIGHT_END, r"\1\n", regex.sub(LI.COPYRIGHT_START, "\n", out))
    out = regex.sub(LI.COPYRIGHT_LINE, " ", out)
    for spelling, common in LI.SPELLINGS:
        put = regex.sub(r"\$(\d)", r"\\g<\1>", common)
        out = regex.sub(spelling, put, out)
    out = regex.sub(r"[^\p{L}\p{N}\n]+", " ", out)
    return regex.sub(r" ?\n[ \n]*", "\n", out).strip(" \n")


def names_in(texts: list[str], known: dict[str, str]) -> set[str]:
    return {known[f] for f in (t.replace("\n", " ") for t in texts) if f in known}


def rewrapped(text: str, rnd: random.Random) -> str:
    """The same words in other lines, case and punctuation."""
    words = text.split(" ") if rnd.random() < 0.5 else text.split()
    out = "".join(w + rnd.choice([" ", " ", " ", "\n", "  "]) for w in words)
    return rnd.choice([str.upper, str, lambda t: t.replace(",", " ;"), lambda t: t.replace("\n", "\n  ")])(out)


def test_licence_scan_against_brute_force(spark):
    rnd = random.Random(9)
    forms = {name: plain_form(body).replace("\n", " ") for name, body in LICENCES.items()}
    known = {form: name for name, form in forms.items()}
    short = {f: n for f, n in known.items() if len(f.split(" ")) <= LI.SHORT}
    long = {f: n for f, n in known.items() if len(f.split(" ")) > LI.SHORT}
    small = [name for name, body in LICENCES.items() if len(body) < 3000]
    texts: list[str | None] = [None, "", "no licence here", "licence " * 300]
    for name in small:
        body = LICENCES[name]
        texts.append(rewrapped(body, rnd))
        around = ["Own words of a file", "more, of them"]
        texts.append(f"{around[0]}\n{body}\n{around[1]}")
        texts.append(f"{around[0]}\n\n{body}\n\nCopyright 2019 {'Very Long Holder Name ' * 30}\n{rnd.choice(list(LICENCES.values()))[:200]}")
        other = LICENCES[rnd.choice(small)]
        texts.append(f"{body}\n{other}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in LI.scan(docs).collect()}
    for i, text in enumerate(texts):
        form = plain_form(text or "")
        lines = form.split("\n")
        runs = ["\n".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1) if b - a < len(lines)]
        blocks = [f for f in map(plain_form, regex.split(LI.BLANK_LINES, text or "")) if "\n" in f and len(f) < len(form)]
        within = names_in(runs, long) | names_in(blocks, short)
        own = [known.get(plain_form(line).replace("\n", " ")) for line in (text or "").split("\n")]
        assert got[i].whole_licence == known.get(form.replace("\n", " ")), i
        assert set((got[i].line_licences or "").split(",")) - {""} == {n for n in own if n}, i
        assert got[i].n_licence_lines == sum(n is not None for n in own), i
        assert set((got[i].block_licences or "").split(",")) - {""} == within, (i, text)


def best_by_trying(field: PI.Field, island: PI.Island) -> float:
    """The highest score of any segmentation."""
    n = len(island.tokens)

    def go(at: int, touching: bool) -> float:
        if at == n:
            return 0.0
        best = field.outside(island.forms[at]) + go(at + 1, False)
        for end in range(at + 1, n + 1):
            if at in island.segments(end):
                value = max(field.scores(island.look(at, end))) + touching * field.beside + go(end, True)
                best = max(best, value)
        return best

    return go(0, False)


def score_of(field: PI.Field, island: PI.Island, found: list[tuple[int, int, int]]) -> float:
    covered = {t for s, e, _ in found for t in range(s, e)}
    total = sum(field.outside(island.forms[t]) for t in range(len(island.tokens)) if t not in covered)
    for n, (s, e, k) in enumerate(found):
        total += field.scores(island.look(s, e))[k] + (n > 0 and found[n - 1][1] == s) * field.beside
    return total


@pytest.mark.parametrize("seed", range(20))
def test_best_segmentation_against_all_of_them(seed):
    rnd = random.Random(seed)
    parts = ["12", "345", ".", "-", "+", " ", "a", "@", "b1", "(", ")", "7"]
    for _ in range(10):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 9)))
        island = PI.Island(text, 0, len(text))
        weights = {"beside": rnd.uniform(-2, 2)}
        for e in range(1, len(island.tokens) + 1):
            weights[f"out|{island.forms[e - 1]}"] = rnd.uniform(-1, 1)
            for s in island.segments(e):
                weights |= {f"{k}|{f}": rnd.uniform(-1, 1) for k in PI.KINDS for f in island.look(s, e)}
        field = PI.Field(weights)
        found = field.best(island)
        assert abs(score_of(field, island, found) - best_by_trying(field, island)) < 1e-9


def test_examples_are_drawn_for_each_kind(spark):
    """Rare kinds among many plain numbers, in every partition; drawn alike however the table is cut."""
    texts = [f"plain {i} {i * 7} x" for i in range(3000)]
    texts += [f"mail a{i}@b{i}.org now" for i in range(30)] + [f"at 10.0.{i}.7 end" for i in range(5)]
    texts += ["y " + "9" * 5000 + " z", "call +1 (741) 555-3069 now", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (PI.train(docs.repartition(n), examples=20) for n in (3, 7))
    assert one.examples == two.examples and one.weights == two.weights
    assert one.examples["email"] == 20 and one.examples["ip"] == 5 and one.examples["phone"] == 1 and one.examples["none"] >= 20


def test_documents_of_one_template_against_brute_force(spark, monkeypatch):
    """Crowded bands: what is alike beside a shared template is found by rare shingles, in small groups and in large ones."""
    monkeypatch.setattr(MM, "FEW", 4)
    monkeypatch.setattr(MM, "PAIRS_A_SHINGLE", 0)
    rnd = random.Random(1)
    template = [f"t{i}" for i in range(40)]
    rows = [template[:20] + [f"u{rnd.randrange(10**9)}" for _ in range(20)] + template[20:] for _ in range(150)]
    for c in range(12):
        source = rows[rnd.randrange(150)]
        for k in range(rnd.choice([1, 3, 12])):
            rows.append([*source[: 20 + k % 20], f"v{c}x{k}", *source[21 + k % 20 :]])
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in MM.near_duplicates(docs.repartition(4)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
