import random
from itertools import combinations

import numpy as np

from drainwatch.llm.bottom_sketch import Sketching, common_counts, near_duplicates
from drainwatch.llm.components import components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    least = {n: i for n, (i, _) in enumerate(sets)}
    changed = True
    pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {i: (len(s), least[n]) for n, (i, s) in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    base = [[word() for _ in range(rng.choice([3, 8, 40, 150]))] for _ in range(12)]
    for b in base:
        rows += [list(b) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(6)):
            c = list(b)
            for _ in range(rng.randrange(1, 5)):
                c[rng.randrange(len(c))] = word()
            rows.append(c)
    # Many versions of one text, and many texts that are mostly one passage.
    rows += [[*passage, *[word() for _ in range(rng.randrange(12))]] for _ in range(40)]
    edited = base[-1]
    for _ in range(40):
        edited = list(edited)
        edited[rng.randrange(len(edited))] = word()
        rows.append(edited)
    rng.shuffle(rows)
    texts = [" ".join(r) for r in rows] + ["", " \n", None, "one", "One", "one two", "ONE\ttwo"]
    return list(enumerate(texts, 10))


def test_components_equal_brute_force(docs):
    for seed, how in ((1, Sketching(3, 85, block=8)), (2, Sketching(pairs_up_to=4, block=16)), (3, Sketching(3, 85, kept=128))):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows, "kept"), how).collect()}
        assert got == brute(rows, how.shingle, how.percent)


def test_null_ids_repeated_rows_and_an_empty_table(docs):
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, text), (4, text), (4, text), (4, "other words here now then"), (9, text + " end"), (7, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(rows, "component_id")).collect()), key=str)
    assert got == sorted([(None, 2996, None, True), (4, 2996, 4, True), (4, 2996, 4, True), (4, 1, 4, True), (9, 2997, 4, False), (7, 0, 7, True), (None, 0, None, True)], key=str)
    assert near_duplicates(docs(rows).limit(0)).collect() == []


def test_common_counts_of_a_block():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (1, 50, 8000, 8000, 0, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = common_counts(sets)
    shared = ~np.eye(len(sets), dtype=bool)
    assert (got[shared] == np.array(want)[shared]).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(1000, i) for i in range(1001, 1100)]
    links = spark.createDataFrame(chain[::-1] + star + [(5, 5), (3, 2)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    assert components(links.limit(0)).collect() == []
