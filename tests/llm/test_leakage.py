"""Leaked passages against a brute-force aligner."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import leakage
from tallyglass.llm.text import words

VOCAB = [f"w{i}" for i in range(40)]


def brute(doc, item):
    """Whether some 12 words of the item are in the document with at most one edit."""
    n = leakage.WINDOW
    grams = {tuple(doc[i : i + k]) for k in (n - 1, n, n + 1) for i in range(len(doc) - k + 1)}
    for j in range(len(item) - n + 1):
        w = tuple(item[j : j + n])
        if w in grams:
            return True
        for g in grams:
            if len(g) == n and sum(a != b for a, b in zip(g, w, strict=True)) <= 1:
                return True
            if len(g) == n - 1 and any(w[:k] + w[k + 1 :] == g for k in range(n)):
                return True
            if len(g) == n + 1 and any(g[:k] + g[k + 1 :] == w for k in range(1, n)):
                return True
    return False


def found(docs, items):
    index = leakage.ItemIndex(list(enumerate(items)))
    return {(d, i) for d, i, n, s in index.search([" ".join(d) for d in docs])}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    items = [[rng.choice(VOCAB) for _ in range(rng.randrange(11, 30))] for _ in range(3)]
    docs = []
    for _ in range(4):
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.randrange(8, 20)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(part) + 1)
            kind = rng.randrange(3)
            part = part[:k] + ([rng.choice([*VOCAB, "other"])] if kind else []) + part[k + (kind < 2) :]
        docs.append([rng.choice(["other", "w1", "x"]) for _ in range(rng.randrange(4))] + part + [rng.choice(["other", "w2"]) for _ in range(rng.randrange(4))])
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute(doc, item)}
    assert found(docs, items) == want


def test_words_ignore_form():
    plain = "The first line holds nine words and a half 12".split()
    for text in (
        "The **first** line\n> holds <b>nine</b> words, “and” a half: 12", "Ｔhe first li​ne ho­lds n<i>in</i>e words &amp; and a half １２", "THE FIRST LINE—HOLDS nine words\r\nand a half ¹²", "<p>The first line</p><p>holds nine words and a half 12",
    ):
        assert words(text) == [w.lower() for w in plain]
    assert words(None) == [] and words("") == [] and words("_ - !") == []


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def run(spark, docs, items):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, similarity double")
    return {(r.doc_id, r.item_id): (r.n_words, r.similarity) for r in leakage.leaks(df, "doc_id", "text", items).collect()}


def test_instruction_is_no_passage(spark):
    tail = "Please answer only in one single word or else in one plain round number."
    items = [(i, f"{i} unique{i} question number{i} about thing{i} here{i} and there{i} with some{i} more{i} words{i} at{i} end{i}. {tail}") for i in range(5)]
    got = run(spark, [tail, f"x {items[2][1]}"], items)
    assert set(got) == {(1, 2)}


def test_edges(spark):
    assert run(spark, [ITEM, None, "", ITEM.upper() + " " + ITEM], []) == {}
    assert run(spark, [], [(1, ITEM)]) == {}
    assert run(spark, [ITEM], [(1, None), (2, ""), (3, "too short")]) == {}
    got = run(spark, [ITEM, None, "", f"{ITEM} {ITEM}", "q " * 400_000 + ITEM + " z" * 100_000], [(7, ITEM), (8, ITEM)])
    assert set(got) == {(d, i) for d in (0, 3, 4) for i in (7, 8)}
    assert got[0, 7] == (16, 1.0)


def test_passes_are_alike(spark, monkeypatch):
    items = [(i, " ".join(f"{w}{i % 3}" for w in ITEM.split())) for i in range(6)]
    docs = [items[0][1], items[1][1], "none"]
    whole = run(spark, docs, items)
    monkeypatch.setattr(leakage, "PASS_WORDS", 20)
    assert run(spark, docs, items) == whole and len(whole) == 4


def test_one_edit_stays_within_the_radius_and_the_similarity():
    rng = random.Random(3)
    names = [[f"v{rng.randrange(300)}" for _ in range(leakage.WINDOW)] for _ in range(200)]
    index = leakage.ItemIndex(list(enumerate(names)))
    moved = []
    for number, item in enumerate(names):
        k, kind, word = rng.randrange(12), rng.randrange(3), rng.choice(["other", "v1"])
        doc = [*(item[:k] + ([word] if kind else []) + item[k + (kind < 2) :]), "v2"][: leakage.WINDOW]
        ids = np.array([index.vocabulary.get(w, index.n) for w in doc])
        got = [(int(w), float(s)) for _, ws, sims in index.candidates(ids, np.array([0])) for w, s in zip(ws, sims, strict=True)]
        mine = [s for w, s in got if index.owner[index.starts[w]] == number]
        assert len(mine) == 1 and mine[0] >= index.least[number] - 1e-9
        a, b = index.hasher(ids, np.array([0]))[0], index.tables.prints[number]
        moved.append(sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True)))
        assert (a != b).sum() <= leakage.RADIUS
    assert np.mean(moved) > 3 and max(moved) > 8  # fingerprints found at a distance, not only equal ones


def test_each_candidate_once():
    rng = np.random.default_rng(1)
    held, asked = rng.integers(0, 3, (300, leakage.BLOCKS)).astype(np.uint64), rng.integers(0, 3, (200, leakage.BLOCKS)).astype(np.uint64)
    got = [(int(a), int(b)) for x, y in leakage.BlockTables(held).candidates(asked) for a, b in zip(x, y, strict=True)]
    want = {(i, j) for i in range(200) for j in range(300) if (asked[i] != held[j]).sum() <= leakage.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want
