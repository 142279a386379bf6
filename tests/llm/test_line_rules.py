import random
import re
from collections import Counter

from drainwatch.llm.line_rules import LineRules, clean_lines, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_base_figures_equal_brute_force(docs):
    rng = random.Random(6)
    pieces = ["a", "b", "cc", "日本", "é", "😀", "#", "a|b", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\xa0", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(200))) for _ in range(150)] + [None, "", " \n "]
    got = {r.doc_id: r for r in clean_lines(docs(list(enumerate(texts)), "n_words")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.kept and r.base_failed)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."


def test_bad_lines_go_and_documents_that_lose_too_much(docs):
    rng = random.Random(7)
    good = "\n".join(prose(rng, 30) for _ in range(4))
    bad = {
        "shout": prose(rng, 90).upper(), "symbols": " ".join(f"{w}***" for w in prose(rng, 90).split()), "navigation": prose(rng, 90).replace(" ", " | "),
        "echo": " ".join(w for w in prose(rng, 12).split() for _ in range(9)), "boilerplate": prose(rng, 60) + " We use cookies to " + prose(rng, 60),
    }
    rows = [(0, good), *[(i + 1, t) for i, t in enumerate(bad.values())], (50, good + "\n" + prose(rng, 20).upper()), (51, (prose(rng, 60) + "\n") * 5)]
    got = {r.doc_id: r for r in clean_lines(docs(rows)).collect()}
    assert got[0].kept and got[0].n_removed_words == 0
    assert not any(got[i + 1].kept for i in range(len(bad)))
    # One bad line of many costs itself, not the document.
    assert got[50].kept and got[50].n_removed_words == 20
    assert not got[51].kept and got[51].n_dup_lines == 4


def test_long_texts_repeats_and_empty_tables(docs):
    text = "w%d x " * 10_000 % tuple(range(10_000))
    got = clean_lines(docs([(1, text), (1, text), (None, None)])).collect()
    assert sorted((r.n_words, r.kept) for r in got) == [(0, False), (20_000, True), (20_000, True)]
    assert clean_lines(docs([(1, "a")]).limit(0)).collect() == []
    assert judge("a b c a b c", LineRules())[4] == 6


def test_short_lines_line_ends_and_phrases(docs):
    rng = random.Random(8)
    bare = lambda n: prose(rng, n)[:-1]
    menu = "\n".join(bare(2).capitalize() for _ in range(40))
    lower = "\n".join(bare(2) for _ in range(40))
    article = "\n".join(prose(rng, 20) for _ in range(6))
    named = article + "\n" + "\n\n".join(f"{x}\n{prose(rng, 12)}" for x in ("Home", "About us", "READ MORE »", "Privacy policy", "> Sign up"))
    table = "\n".join(bare(7).capitalize() for _ in range(20))
    words = bare(300).split()
    wrapped = "\n".join(" ".join(words[i : i + 10]) for i in range(0, 300, 10))
    headed = "\n".join(f"{bare(2).capitalize()}\n{prose(rng, 40)}" for _ in range(4))
    phrase = " ".join(prose(rng, 20) for _ in range(20)) + " You can read more here. " + prose(rng, 20)
    chinese = "\n".join("".join(rng.choice("日本語文字列") for _ in range(30)) + "。" for _ in range(60))
    texts = [menu, lower, named, table, wrapped, headed, phrase, chinese, article + "\n\n" + "Home\nShop now\nOur new bags"]
    got = {r.doc_id: r for r in clean_lines(docs(list(enumerate(texts)))).collect()}
    lost = {i: (r.n_removed_words, r.kept) for i, r in got.items()}
    assert lost == {0: (80, False), 1: (80, False), 2: (11, True), 3: (140, False), 4: (0, True), 5: (0, True), 6: (5, True), 7: (0, True), 8: (6, True)}
