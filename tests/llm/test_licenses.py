import random
import re
from pathlib import Path

import pytest

from sparkvane.llm.licenses import NEGATIONS, PHRASES, TEMPLATES, Automaton, scan_licenses, whole_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


ROWS = [
    (20, "Licensed under the Apache License, Version 2.0."), (21, "This work is licensed under the GNU General Public License, version 3."),
    (22, "Released under the MIT License."), (23, "Licensed under CC BY-NC 4.0."), (24, "licensed under the Apache License, Version 3.0"),
    (25, "cc by cc by CC-BY MIT License mit license gnu general public license license"), (26, "the gnu general public"), (27, "apache"), (28, "license apache license gnu"),
    (29, "Copyright (c) 2020 2021 Jane Doe and others. All rights reserved"), (30, "Copyright none all rights"),
    (31, "licensed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"), (32, "general public license gnu"),
]


def test_base_against_brute_force(docs, clashing, odd):
    rows = odd + ROWS
    want = sorted((repr((i, *brute(t))) for i, t in rows))
    for df in (docs(rows), clashing(rows)):
        got = scan_licenses(df).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(docs([])).count() == 0


def test_labels_of_templates(docs):
    got = {r.doc_id: r for r in scan_licenses(docs(ROWS)).collect()}
    assert got[20].labels == "apache,apache-2.0" and got[21].labels == "gpl,gpl-3.0" and got[22].labels == "mit" and got[23].labels == "cc-by,cc-by-nc"
    assert got[24].labels == "apache" and got[24].score == 0.5 and got[20].score == 1.0
    assert got[29].labels == "proprietary" and got[30].labels == "" and got[31].labels == "gpl,gpl-3.0"


def test_mandatory_wording_must_match(docs):
    t = (("t", 'begin [[one two]] <<var;match="[a-z]";max=2>> [[x]] finish'),)
    rows = [(1, "begin finish"), (2, "begin one two finish"), (3, "begin one finish"), (4, "begin a b finish"), (5, "begin a b c finish"), (6, "begin one two a x finish"), (7, "begin x finish"), (8, "a begin begin a finish")]
    got = {r.doc_id: r.labels for r in scan_licenses(docs(rows), (), t).collect()}
    assert got == {1: "t", 2: "t", 3: "", 4: "t", 5: "", 6: "t", 7: "t", 8: "t"}
    with pytest.raises(ValueError):
        Automaton.compile((("t", '<<var;match="a";max=1>> b'),))


def test_query_against_brute_force(spark):
    from sparkvane.llm.queries import QUERIES

    got = QUERIES["op4_licenses"](spark, "/root/testdata/sf0.01").collect()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(repr((i, *brute(t))) for i, t in texts)
    assert sum(r.n_base for r in got) > 5


MARK = re.compile(r'(\[\[)|(\]\])|<<var;match="([^"]*)";max=([0-9]+)>>|([^\s\[\]<>]+)')


def pattern(markup):
    """The markup as a regular expression over words with a space after each."""
    out = ""
    for begin, end, match, most, text in MARK.findall(markup):
        out += "(?:" if begin else ")?" if end else f"(?:(?=(?:{match}) )[^ ]+ ){{0,{most}}}" if most else "".join(f"{w} " for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))
    return re.compile(out)


def labels_by_patterns(text, templates=TEMPLATES):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = set()
    for label, markup in templates:
        compiled = pattern(markup)
        for i in range(len(words)):
            if not NEGATIONS.intersection(words[max(0, i - 3) : i]) and compiled.match("".join(f"{w} " for w in words[i : i + 2000])):
                found.add(label)
                break
    return found


def filled(markup, r, optional=0.5):
    """A text that the markup allows."""
    out, hidden = [], []
    for begin, end, match, most, text in MARK.findall(markup):
        if begin:
            hidden.append(r.random() < optional or any(hidden))
        elif end:
            hidden.pop()
        elif not any(hidden):
            out += [r.choice(["2020", "2021"]) if "[0-9]{4}" in match else "4" if "[0-9]" in match else r.choice("Jane Doe and others GmbH".split()) for _ in range(r.randint(0, int(most)))] if most else [r.choice([text, text.upper()])]
    return "".join(w + r.choice([" ", "\n", ", "]) for w in out)


def test_labels_against_patterns(docs):
    r = random.Random(3)
    rows, whole = [], []
    for i in range(160):
        label, markup = r.choice(TEMPLATES)
        text = filled(markup, r)
        whole.append(label)
        kind = i % 4
        if kind == 1:  # a word of it is changed
            words = text.split()
            words[r.randrange(len(words))] = "tampered"
            text = " ".join(words)
        elif kind == 2:
            text = r.choice(["this is not ", "it was never ", "nor is it ", "no longer "]) + text
        elif kind == 3:
            text = f"some words here {text} and then {filled(r.choice(TEMPLATES)[1], r)}"
        rows.append((i, text))
    got = {x.doc_id: x for x in scan_licenses(docs(rows), ()).collect()}
    for i, text in rows:
        want = labels_by_patterns(text)
        assert got[i].labels == ",".join(sorted(want)) and got[i].score == (1.0 if want else 0.0)
        if i % 4 in (0, 3):
            assert whole[i] in want
    assert len({got[i].labels for i, _ in rows}) > 15


def test_no_license_is_told_by_its_beginning(docs):
    rows = [
        (1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: you pay us."),
        (2, "This is not licensed under the MIT license"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs(rows)).collect()}
    assert got == {1: ("", 0.0), 2: ("mit", 0.5), 3: ("", 0.0)}


def test_whole_texts(docs):
    folder = Path("/usr/share/common-licenses")
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "MPL-2.0", "CC0-1.0", "Artistic") if (folder / n).exists()]
    if not names:
        pytest.skip("no license texts here")
    texts = {n: (folder / n).read_text(errors="replace") for n in names}
    templates = tuple(whole_text(n, t) for n, t in texts.items())
    rows = [(i, f"before\n{t}\nafter") for i, t in enumerate(texts.values())] + [(100 + i, t.replace(" the ", " a ", 1) if " the " in t else "x") for i, t in enumerate(texts.values())] + [(200 + i, t.upper()) for i, t in enumerate(texts.values())]
    got = {r.doc_id: r.labels for r in scan_licenses(docs(rows), (), templates).collect()}
    for i, n in enumerate(names):
        assert n in got[i].split(",") and n not in got[100 + i].split(",") and n in got[200 + i].split(",")


def test_other_lines_may_be_optional(docs):
    template = whole_text("x", "Copyright 2001 Somebody\nFirst line here\nCopyright (c) 2002 Them\nlast line")
    rows = [(1, "copyright 1999 Other People first line here (c) me last line"), (2, "first line here last line"), (3, "first line last line")]
    assert {r.doc_id: r.labels for r in scan_licenses(docs(rows), (), (template,)).collect()} == {1: "x", 2: "x", 3: ""}
