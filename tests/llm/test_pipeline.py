"""The pipeline's near-dedup against brute force, on planted near copies."""

import random

import pytest

import corpus_pipeline


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    """Least id reachable by links of similarity 0.8."""
    sets = [shingles(t) for _, t in rows]
    label = [k for k, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    while True:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label, links, sets


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    texts = [None, "", "  ", "one two", "One  two", "one two three"]
    for k in range(120):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 150, 400]))]
        texts.append(" ".join(w))
        own, wish = shingles(texts[-1]), rng.choice([0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.9, 0.95])
        copy = list(w)
        for at in rng.sample(range(len(w)), len(w)):  # until the similarity asked for is next
            was, copy[at] = copy[at], f"x{rng.randrange(3000)}"
            if jaccard(own, shingles(" ".join(copy))) < wish:
                copy[at] = was
                if wish >= 0.8:
                    break
                copy[at] = "y"
                break
        texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_near_dedup_is_that_of_brute_force(spark, planted):
    label, links, sets = brute(planted)
    assert sum(jaccard(sets[i], sets[j]) < 0.86 for i, j in links) > 20  # near the limit
    assert sum(0.65 < jaccard(sets[i], sets[i - 1]) < 0.8 for i in range(7, len(sets), 2)) > 20
    docs = spark.createDataFrame([(k, t) for k, t in planted], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {k for k, _ in planted if label[k] == k}
