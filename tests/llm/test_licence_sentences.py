import random
import re
import time

from drainwatch.llm.licence_sentences import COMMENT_LINE, COMMENT_WORD, SENTENCES, normal, scan_licences


def found(docs, texts, extra="extra"):
    return {r.doc_id: (r.n_sentences, r.sentences, r.licences) for r in scan_licences(docs(list(enumerate(texts)), extra)).collect()}


def test_statements_full_texts_wrapped_texts_and_their_order(docs):
    mit = " ".join(SENTENCES[s] for s in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    wrapped = mit.replace(" copies of the", "\n * copies of the").replace(" WARRANTIES OF", "\n# WARRANTIES OF").replace("obtaining a copy", "obtaining\na copy")
    turned = SENTENCES["bsd-binary"] + " " + SENTENCES["bsd-source"] + " " + SENTENCES["bsd-redistribution"]
    texts = [
        "Words here. Released under the MIT License. More words.",
        "a line without an end\nLicensed under the Apache License, Version 2.0.\nanother line",
        "Intro.\n\n" + wrapped + "\n\nThe end.",
        turned,
        SENTENCES["bsd-redistribution"] + "\n" + SENTENCES["bsd-source"] + "\nOther words in between.\n" + SENTENCES["bsd-binary"] + "\n" + SENTENCES["bsd-endorse"],
        "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.",
        "This is not a licence. See the licence of the other work.",
        "  RELEASED under  the\tMIT   licence. released UNDER the mit license.",
        None,
        "",
    ]
    got = found(docs, texts, "licences")
    assert got[0] == (1, "mit-released", "MIT")
    assert got[1] == (1, "apache-licensed", "Apache-2.0")
    assert got[2] == (4, "mit-grant,mit-notice,mit-as-is,mit-liability", "MIT")
    assert got[3] == (3, "bsd-binary,bsd-source,bsd-redistribution", "")  # all of it, in the wrong order
    assert got[4][2] == "BSD-3-Clause"
    assert got[5] == (2, "mit-released,gpl3-work", "GPL-3.0-only,MIT")
    assert got[6] == (0, "", "") and got[8] == (0, "", "") and got[9] == (0, "", "")
    assert got[7][2] == "MIT"


def test_long_texts_repeated_rows_null_ids_and_an_empty_table(docs):
    long = "Some words of no meaning. " * 20_000 + "Licensed under CC BY-NC 4.0."
    rows = [(1, long), (1, long), (None, "Released under the MIT License."), (None, None)]
    got = sorted((str(r.doc_id), r.licences) for r in scan_licences(docs(rows, "_row")).collect())
    assert got == [("1", "CC-BY-NC-4.0"), ("1", "CC-BY-NC-4.0"), ("None", ""), ("None", "MIT")]
    assert scan_licences(docs(rows).limit(0)).collect() == []


def test_normal_forms_are_distinct():
    assert len({normal(s) for s in SENTENCES.values()}) == len(SENTENCES)
    assert normal("  The (“Software”),\tÉ 2.0. ") == "the software 2 0"


def test_wrapped_notices_behind_lines_without_an_end(docs):
    def wrapped(prefix, *names):
        words, lines = " ".join(SENTENCES[n] for n in names).split(), []
        for i in range(0, len(words), 9):
            lines.append(prefix + " ".join(words[i : i + 9]))
        return "\n".join(lines)

    mit = ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")
    texts = [
        "# Copyright (c) 2020 Foo\n#\n" + wrapped("# ", *mit),
        "/*\n * Copyright (c) 2020 Foo\n" + wrapped(" * ", *mit) + "\n */",
        "// Copyright 2020 Foo\n//\n//\n" + wrapped("// ", "bsd-redistribution", "bsd-source", "bsd-binary"),
        "dnl Copyright 2020 Foo\ndnl\n" + wrapped("dnl ", "isc-grant"),
        "; a file without a licence\n;\n; Permission is hereby granted, free of charge\n; to nobody.",
    ]
    got = found(docs, texts)
    assert got[0] == got[1] == (4, ",".join(mit), "MIT")
    assert got[2] == (3, "bsd-redistribution,bsd-source,bsd-binary", "BSD-2-Clause")
    assert got[3] == (1, "isc-grant", "ISC") and got[4] == (0, "", "")


def brute(text):
    """The known sentences of a text in order, found line by line in plain Python."""
    known = {normal(s): i for i, s in SENTENCES.items()}
    text = re.sub(COMMENT_LINE, "\n", re.sub(COMMENT_WORD, r"\1\2#", text))
    text = re.sub(r"\n[\x20\x09-\x0D]*\n", "\x01", re.sub(r"([.!?]|conditions:|met:)[\x20\x09-\x0D]+", "\\1\x01", text))
    out = []
    for sentence in text.split("\x01"):
        if normal(sentence) in known:
            out.append(known[normal(sentence)])
            continue
        lines = [n for n in map(normal, sentence.split("\n")) if n]
        if "\n" not in sentence:
            continue
        runs = [(i, j, known[" ".join(lines[i : j + 1])]) for i in range(len(lines)) for j in range(i, min(len(lines), i + 90)) if " ".join(lines[i : j + 1]) in known]
        out += [name for i, j, name in sorted(runs) if not any(a <= i and j <= b and b - a > j - i for a, b, _ in runs)]
    return out


def test_random_notices_against_brute_force(docs):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = SENTENCES[rng.choice(list(SENTENCES))].split()
            if rng.random() < 0.2:
                words = words[: rng.randint(1, len(words))]
            width, mark = rng.choice([1, 2, 5, 9, 100]), rng.choice(["", "# ", " * ", "// ", "REM "])
            lines += rng.choice([[], [mark + "Copyright 2020 Foo"], ["the", "software"], [mark.strip()]])
            lines += [mark + " ".join(words[k : k + width]) for k in range(0, len(words), width)]
            lines += rng.choice([[], [""], ["in no event", "this"]])
        texts.append("\n".join(lines))
    got = found(docs, texts)
    assert {k: v[1] for k, v in got.items()} == {k: ",".join(brute(t)) for k, t in enumerate(texts)}
    assert sum(v[0] for v in got.values()) > 150


def test_many_lines_take_time_in_proportion(docs):
    words = ["the", "software", "this"] * 34_000
    grant = SENTENCES["mit-grant"].split()
    started = time.time()
    got = found(docs, ["\n".join(words[:100_000] + grant + words[:1000])])
    assert got[0][1] == "mit-grant"
    assert time.time() - started < 60
