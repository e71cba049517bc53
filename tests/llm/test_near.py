"""Near copies of the pipeline against all pairs, with planted ones of a similarity around 0.8."""

import random

import corpus_pipeline
from tests.llm.cases import documents
from tidemark.llm import near


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_stay(rows):
    """The rows of least id of each component, over all pairs."""
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if plain_similar(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g, key=lambda d: (d is None, d)) for g in groups.values())


def planted():
    """Texts with copies that differ by a run or by scattered words, and chains of copies."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([40, 120, 400]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            copy = list(rnd.choice([base, rows[-1][1].split()]))
            for _ in range(rnd.randint(0, 1 + len(copy) // 50)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            cut = rnd.randint(0, len(copy) // 8)
            rows.append((len(rows), " ".join(copy[cut:])))
    rows += [(1000, None), (1001, " \n"), (1002, "A b"), (1003, "a  B")]
    rnd.shuffle(rows)
    return rows


def test_pipeline_near_copies_by_all_pairs(spark):
    rows = planted()
    sets = [plain_set(t) for _, t in rows]
    hard = [1 for i in range(len(rows)) for j in range(i) if sets[i] != sets[j] and 0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.95]
    missed = [1 for i in range(len(rows)) for j in range(i) if 0.7 <= len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) < 0.8]
    assert len(hard) > 30 and len(missed) > 10
    docs = documents(spark, [(d, t, None, None, 0) for d, t in rows])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == plain_stay(rows)
    assert corpus_pipeline.drop_near_copies(spark, documents(spark, []), "").count() == 0


def test_similarity_is_exact_at_its_edge():
    text = " ".join(f"w{i}" for i in range(84))  # 80 shingles
    shorter, other = " ".join(text.split()[:68]), " ".join(text.split()[:67])  # 64 and 63 of them
    assert near.alike(near.shingle_set(text), near.shingle_set(shorter))
    assert not near.alike(near.shingle_set(text), near.shingle_set(other))
