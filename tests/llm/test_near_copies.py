import random

import corpus_pipeline


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 8, 14):  # similarities of about 0.95 to 0.5
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[7], None, " ", "one two", "One  two", "one three"]
    sets, root = list(map(grams, texts)), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [r[0] for r in corpus_pipeline.near_copies(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted(set(root))
