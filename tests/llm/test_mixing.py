import math
import random
import re

from drainwatch.llm.mixing import materialise, measured, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Split by weight, stop sources at their cap, split the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def corpus(seed):
    rng = random.Random(seed)
    sources = ["a", "ab", "é", "z", "日本", None]
    return [(i, " ".join(rng.choice(["w", "xy", "z%#"]) for _ in range(rng.choice([0, 1, 3, 50]))) or None, rng.choices(sources, [9, 3, 1, 1, 1, 1])[0]) for i in range(200)]


def test_targets_and_taken_words(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        got = mix(measured(docs(rows))).collect()
        size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
        of = {}
        for i, _, s in rows:
            of[s] = of.get(s, 0) + size[i]
        want = brute_targets(of)
        taken = {}
        for r in got:
            assert (r["size"], r.source_size) == (size[r.doc_id], of[r.source])
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
            assert 0 <= r.taken <= 2 * r["size"]
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
        whole = {s: math.floor(math.floor(want[s] + 0.5) / of[s]) for s in want if of[s]}
        # Complete passes come first, and one document at most gives a part of itself.
        assert all(r.taken >= whole[r.source] * r["size"] for r in got if r.source in whole)
        parts = [r.source for r in got if r["size"] and r.taken % r["size"]]
        assert len(parts) == len(set(parts))


def test_reruns_agree_and_better_documents_come_earlier(docs):
    rows = [(i, ("good words only " * 10 if i % 2 else "#$% *** &&& " * 10), "abcd"[i // 2 % 4]) for i in range(800)]
    first, second = (sorted((r.doc_id, r.taken) for r in mix(measured(docs(rows))).collect()) for _ in range(2))
    assert first == second
    last = [r for r in mix(measured(docs(rows)), weights=(1, 1, 1, 1), share=0.5).collect()]
    taken = {k: sum(r.taken for r in last if r.doc_id % 2 == k) for k in (0, 1)}
    assert taken[1] > 1.5 * taken[0]


def test_null_ids_repeated_rows_empty_texts_and_clashing_names(docs, spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (1, "", "s"), (1, None, "s"), (2, "x " * 3000, "s"), (2, "x " * 3000, "s")]
    for extra in ("size", "TAKEN", "_key", "_rank"):
        got = mix(measured(docs(rows, extra))).collect()
        assert len(got) == 6 and sum(r.taken for r in got) == math.floor(1.5 * 6006 + 0.5)
    assert mix(measured(docs([(1, "a", "s")]).limit(0))).collect() == []
    assert [r.taken for r in mix(measured(docs([(1, None, "s")]))).collect()] == [0]


def test_materialise_repeats_whole_documents_and_cuts_one(docs):
    rows = [(i, f"a{i}\tb{i}  c{i} d{i}", "s") for i in range(5)]
    out = materialise(mix(measured(docs(rows)))).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == 30
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "extra"}
    whole = dict((i, t) for i, t, _ in rows)
    cut = [r for r in out if r.text != whole[r.doc_id]]
    assert len(cut) == 1 and cut[0].text == " ".join(whole[cut[0].doc_id].split()[: len(cut[0].text.split())]) and cut[0].n_chars == len(cut[0].text)
