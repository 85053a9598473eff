"""Spelling variants against brute force."""

import random

import pytest

from quernstone.llm import spelling_variants as sv


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    found = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        found[w] = (best if best and counts[best] >= 2 * n else None, n, len(others))
    rows = set()
    for w, (form, n, k) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


@pytest.mark.parametrize("filter_words", [sv.FILTER_WORDS, 60])
def test_variants_equal_brute_force(spark, filter_words):
    rng = random.Random(4)
    counts = {}
    while len(counts) < 300:
        counts["".join(rng.choices("abé", k=rng.randrange(1, 8)))] = rng.choice((3, 3, 6, 7, 12, 25, 60, 200, 1000, 10**10))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in sv.variants(words, filter_words=filter_words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain(counts)


def test_all_neighbours_are_made():
    word, alphabet = "abba", "abc"
    made = {n for _, n in sv.neighbours([word], alphabet, lambda h: range(len(h)))}
    want = {word[:i] + word[i + 1 :] for i in range(4)} | {word[:i] + c + word[i + 1 :] for i in range(4) for c in alphabet} | {word[:i] + c + word[i:] for i in range(5) for c in alphabet}
    assert made == want - {word}


def test_a_long_chain_ends_at_its_last_form(spark):
    chain = {"a" * k: 3 * 2**k for k in range(5, 40)}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in sv.variants(words).collect()}
    assert set(got.values()) == {"a" * 39} and len(got) == 35


def test_words_of_odd_texts(spark):
    texts = [None, "", "12 --", "Ärger ärger ÄRGER", "x" * 100_000, "house house House", "hause", "Grüße×grüße", "hause hause"]
    docs = spark.createDataFrame([(i if i < 7 else None, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, n int")
    words = {r["word"]: r["n"] for r in sv.vocabulary(sv.misspelt(docs, 10**9)).collect()}
    assert words == {"house": 3, "hause": 3}
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in sv.variants(sv.vocabulary(sv.misspelt(docs, 10**9))).collect()}
    assert got == {"house": (None, "house", 1), "hause": (None, "hause", 1)}
    assert sv.variants(sv.vocabulary(sv.misspelt(docs.limit(0), 97))).count() == 0
