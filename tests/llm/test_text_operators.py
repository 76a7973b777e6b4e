"""BPE, personal data, licenses, quality rules: against the library or brute force."""

import hashlib
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import bpe, license_rules, licenses, pii, quality_rules, queries

PATH = queries.tokenizer_path()
ENCODER, LIBRARY = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
ODD = "abcdefgh   ''.,!?0123ÉéΣσςİıſKﬁ①²½   \x1c\x85​‍😀漢字か국ا٣अ́̈<|>\n\tĀ_﻿"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=60) | st.text(max_size=40).filter(lambda t: not re.search("[\ud800-\udfff]", t)))
def test_bpe_is_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids, decoded = ENCODER.encode_batch([text])[0]
    assert ids == " ".join(map(str, want))
    assert decoded == LIBRARY.decode(want, skip_special_tokens=False) == ENCODER.decode(want)


def test_bpe_documents(spark, edge_docs, empty_docs):
    got = sorted(map(tuple, bpe.digest(edge_docs, PATH).collect()), key=str)
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digest(empty_docs, PATH).count() == 0
    one = bpe.encode(edge_docs.where("doc_id = 9"), PATH).first()
    assert one["decoded"] == "one</w>" and len(one["ids"]) == 1


def test_bpe_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Bpe(PATH)
    for t in ("some words here", "other words there " + "x" * 200, "some words here"):
        assert own.encode_batch([t, t])[1][0] == " ".join(map(str, LIBRARY.encode(t, add_special_tokens=False).ids))


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c@d.e", "@", ".", "1", "25", "0", "-", " ", "+", "(", ")", "a", "Z", "é", "٣", "4111111111111111", "127.0", "256", "+1 (212) 555-0199"]), max_size=14).map("".join))
def test_plain_detectors(text):
    assert [(s.kind, s.start, s.end) for s in pii.detect(text)] == brute_pii(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe (at) example [dot] com now", "email:5:36"),
        ("john at mail dot example dot org ok", "email:0:32"),
        ("we met at noon, dot com", ""),
        ("call plus four nine one two three four five six seven eight nine", "phone:5:64"),
        ("one two three four", ""),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ x", "email:0:16"),
        ("é jоhn@exаmple.com", "email:2:18"),
        ("+1 (٢12) 555-0199", "phone:0:17"),
        ("card 4111 1111 1111 1111.", "card:5:24"),
        ("john [at] example dot com", "email:0:25"),
        ("john at example [dot] com", "email:0:25"),
        ("john@example dot com", "email:0:20"),
        ("j.doe at example.com", "email:0:20"),
        ("look at example.com", ""),
        ("+ plus one two three four five six seven eight nine plus", "phone:2:51"),
        ("plus one two three four five six seven eight nine ones", "phone:0:49"),
    ],
)
def test_disguises_map_back(text, found):
    assert ",".join(map(str, pii.spans(text)[1])) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call plus 44 seven nine 11 123 456 78 x", "phone:5:37"),
        ("plus four four 20 seven 946 0 958", "phone:0:33"),
        ("4111 1111, 11, 11, 11, 1, one", "card:0:29"),
        ("4111, 1111, 11, 11, 11, 1, 1", ""),
        ("one two three four five six seven, 4111, 1111, 11, 11, 11, 1, 1", ""),
    ],
)
def test_mixed_digit_words_alone(text, found):
    for before in ("", "none of the phones there: one, two; "):
        assert ",".join(f"{s.kind}:{s.start - len(before)}:{s.end - len(before)}" for s in pii.spans(before + text)[1]) == found


def test_any_mix_of_disguises_maps_back():
    rng = random.Random(12)
    ats, dots = ["@", " at ", "  AT  ", " (at) ", "[at]", "{ arroba }", "＠", "@"], [".", " dot ", " [dot] ", "(punkt)", "．", "<point>"]
    alike = {b: a for a, b in pii.LOOKALIKES.items()}
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    for _ in range(3000):
        name, parts = rng.choice(["john", "j.doe", "a_b", "mia7"]), [rng.choice(["example", "mail-host", "x9"]) for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org"])]
        at, dot = rng.choice(ats), [rng.choice(dots) for _ in parts[1:]]
        source = name + at + parts[0] + "".join(d + p for d, p in zip(dot, parts[1:], strict=True))
        if rng.random() < 0.3:
            source = "".join(alike.get(c, c) if c not in "atdo" and rng.random() < 0.3 else c for c in source)
        plain = at.strip().lower() == "at" and set(dot) <= {".", "．"} and name == "john"
        before, after = rng.choice(["", "write: ", "é\n", "> "]), rng.choice(["", " now", "!", "\n\n"])
        got = [str(s) for s in pii.spans(before + source + after)[1] if s.kind == "email"]
        if not plain:  # plain spans within it stay
            assert f"email:{len(before)}:{len(before) + len(source)}" in got and len(got) <= 2, before + source + after
        digits = [str(rng.randint(0, 9)) for _ in range(rng.randint(9, 12))]
        said = [words[int(d)] if rng.random() < 0.6 else d for d in digits]
        if any(x in words for x in said):
            phone = rng.choice(["plus ", "+ ", "Plus, "]) + "".join(x + rng.choice([" ", "-", ", "]) for x in said[:-1]) + said[-1]
            got = [str(s) for s in pii.spans(before + phone + after)[1] if s.kind == "phone"]
            assert got == [f"phone:{len(before)}:{len(before) + len(phone)}"], before + phone + after


def test_long_runs_take_linear_time():
    began, n = time.time(), 1_000_000
    for t in ("1" * 500_000, "a" * 500_000 + "@", "a@" * 200_000, "+1" * 200_000, "( " * 200_000, "1." * 200_000):
        pii.spans(t)
    for t in (" " * n, "\t" * n, "\n" * n, "a" + " " * n + "(at)" + " " * n + "b", "(" + " " * n, "( at" + " " * n, "x at" + " " * n, "x@y dot" + " " * n + "z at ", "+ " * n, "one " * n, "one, " * n + "ones", "plus " * n, "7 " * n + "one", "a at b" * n, "a.b dot " * n):
        pii.spans(t)
        pii.redact(t)
    assert time.time() - began < 120


def test_pii_documents(spark, edge_docs, empty_docs):
    more = spark.createDataFrame([(77, "x a@b.cd 127.0.0.1 and a (at) b (dot) cd", "en", "a", 40)], "doc_id long, text string, lang string, source string, n_chars long")
    row = pii.digest(more).first()
    assert tuple(row)[:5] == (77, 1, 1, 0, 0) and row["base_sha256"] == sha("email:2:8,ip:9:18") and row["spans"] == "email:2:8,email:23:40,ip:9:18"
    clean = pii.redacted(more).first()
    assert clean["text"] == "x [EMAIL] [IP] and [EMAIL]" and clean["n_chars"] == len(clean["text"])
    assert pii.digest(edge_docs).where(f"base_sha256 = '{sha('')}' and spans = ''").count() == edge_docs.count()
    out = pii.redacted(edge_docs)
    assert out.columns == edge_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, edge_docs.collect()))
    assert pii.digest(empty_docs).count() == 0 == pii.redacted(empty_docs).count()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    found = []
    for anchor, label, keyword, rx, priority, sure in licenses.rules():
        for i, x in enumerate(w):
            ahead = " ".join(w[i : i + licenses.SPAN])
            if x == anchor and keyword in ahead and (m := re.match(f"(?:{rx})(?= |$)", ahead)):
                found.append((i, i + m[0].count(" ") + 1, priority, label, sure, len(found)))
    order = {r: n for n, r in enumerate((a, lab, rx) for a, lab, _, rx, _, _ in licenses.rules())}
    assert len(order) > 700 and len(license_rules.signatures()) >= 390
    stay = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:3] != d[:3] or e[5] < d[5]) for e in found)]
    sure = max([d[4] for d in stay] + [0.9 if labels else 0.0])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[3] for d in stay})), sure


def test_licenses(spark, edge_docs, empty_docs):
    rng = random.Random(8)
    parts = ["under", "the", "MIT", "license", "Licensed", "Apache", "License,", "version", "2.0", "cc", "by", "nc", "sa", "CC-BY-NC", "4.0", "GNU", "general", "public", "é", "x", "BSD", "3-clause", "released", "terms", "of", "SPDX-License-Identifier:", "All rights reserved", "redistribution and use in source and binary forms, with or without modification", "mozilla", "unlicense", "\n", "--"]
    texts = [None, "", "!!", "under the mit license", "cc by nc cc by nc", "undér the mit licensé"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts.append("Licensed under the MIT license. " * 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.digest(df).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == brute_licenses(t), t
    assert got[len(texts) - 1] == (15000, 3000, 1, 14996, "mit", "mit", 0.95)
    assert licenses.digest(edge_docs).count() == edge_docs.count() and licenses.digest(empty_docs).count() == 0
    assert "Python" not in licenses.digest(df)._jdf.queryExecution().toString()


def example(rx, whole):
    """A text that the expression matches: with all optional parts or with none."""
    rx = rx.replace("licen[cs]e", "license")
    rx, before = re.sub(r"\[(.)[^]]*\](?:\{([0-9])\})?", lambda m: m[1] * int(m[2] or 1), rx), None
    rx = rx.replace(" ?", " ").replace("licen[cs]e", "license")  # "gpl2" and "licence" are not the anchors
    while rx != before:
        before = rx
        rx = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not whole else m[1].split("|")[0], rx, count=1)
    return rx.split("|")[0]


def test_each_license_rule_alone(spark):
    texts = [(example(rx, whole), keyword) for _, _, keyword, rx, _, _ in licenses.rules() for whole in (False, True)]
    texts = [t if keyword in t else f"{t} {keyword}" for t, keyword in texts]
    texts += ["released under the MPL 2.0", "available under BSD 3-clause", "distributed under the terms of the Apache 2.0", "CC0 1.0", "WTFPL", "0BSD"]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.digest(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_licenses(t), t
        assert got[i][5], t


#: Lines as they stand in files, and labels that must be found.
WRITTEN = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2-1"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "linux-syscall"),
    ("SPDX-License-Identifier: (MIT)", "mit"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("Distributed under the Boost Software License, Version 1.0. (See https://www.boost.org/LICENSE_1_0.txt)", "boost-1"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("License :: OSI Approved :: BSD License", "bsd"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("Made available under the Open Database License: this database is made available under the Open Database License", "odbl"),
    ("you can redistribute it under the same terms as Perl itself", "perl"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.", "proprietary"),
    ("(c) Verlag, Alle Rechte vorbehalten", "all-rights-reserved"),
    ("Tous droits réservés", "all-rights-reserved"),
    ("The Software shall be used for Good, not Evil.", "json"),
)


def test_written_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRITTEN)], "doc_id long, text string")
    for r in licenses.digest(df).collect():
        text, label = WRITTEN[r["doc_id"]]
        assert label in r["labels"].split(","), (text, r["labels"])
        assert tuple(r)[1:] == brute_licenses(text)


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(three) if three.count(x) > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_quality_rules(spark, edge_docs, empty_docs):
    rng = random.Random(9)
    table = np.zeros(quality_rules.BUCKETS)
    for _ in range(300):
        t = "".join(rng.choice(["a ", "b ", "c\n", "é\x0b", "#x ", "\n", " ", "a b\n", " ", "|"]) for _ in range(rng.randint(0, 60)))
        got = quality_rules.measure(t, table, table, table)
        assert got[:5] == brute_rules(t)
        n, again = got[0], got[4]
        assert got[5] == (n < 50 or 100 * again > 50 * n)
    good = [(i, " ".join(f"good{rng.randint(0, 40)}" for _ in range(80))) for i in range(60)]
    junk = [(100 + i, " ".join(f"junk{rng.randint(0, 40)}%%" for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (101, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    trusted, raw = quality_rules.gram_counts(docs, labels)
    assert trusted.sum() == 40 * 159 and raw.sum() == 90 * 159
    want = [np.zeros(quality_rules.BUCKETS, int) for _ in range(2)]
    for i, t in good + junk:
        g = np.bincount(quality_rules.grams(quality_rules.word_numbers(t.encode().split())), minlength=quality_rules.BUCKETS)
        want[1] += g
        want[0] += g if i < 40 else 0
    assert (want[0] == trusted).all() and (want[1] == raw).all()
    ratios = [math.log((want[0][b] + 16384 * (want[1][b] + 1) / (raw.sum() + 16384)) / (trusted.sum() + 16384)) - math.log((want[1][b] + 1) / (raw.sum() + 16384)) for b in range(quality_rules.BUCKETS)]
    scores = {i: round(sum(ratios[b] for b in quality_rules.grams(quality_rules.word_numbers(t.encode().split()))) / 159, 9) for i, t in good + junk}
    own = []
    for _, t in good[:40]:
        g = quality_rules.grams(quality_rules.word_numbers(t.encode().split())).tolist()
        p = {b: (want[1][b] + 1) / (raw.sum() + 16384) for b in g}
        own.append(sum(math.log((want[0][b] - g.count(b) + 16384 * p[b]) / (trusted.sum() - 159 + 16384)) - math.log(p[b]) for b in g) / 159)
    mean = sum(own) / 40
    limit = mean - max(4 * math.sqrt(sum((x - mean) ** 2 for x in own) / 40), 0.05)
    out = {r["doc_id"]: r for r in quality_rules.digest(docs, labels).collect()}
    assert all(abs(out[i]["score"] - scores[i]) < 1e-8 and out[i]["kept"] == (scores[i] >= limit) for i in out)
    assert all(out[i]["kept"] == (i < 100) for i in out)
    none = quality_rules.digest(edge_docs, labels.limit(0)).collect()
    assert len(none) == edge_docs.count() and all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.digest(empty_docs, labels).count() == 0


def test_tape_equals_lists():
    """Places after several rewrites, against a source span for each character."""
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 30)
        text, start, end = "".join(rng.choice("abcdefg") for _ in range(n)), list(range(n)), list(range(1, n + 1))
        tape = pii.Tape.of(text)
        for _ in range(4):
            edits, at = [], 0
            while at < len(text) and rng.random() < 0.8:
                s = rng.randint(at, len(text) - 1)
                e = rng.randint(s + 1, min(len(text), s + 4))
                edits.append((s, e, "".join(rng.choice("XYZ") for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))))
                at = e
            tape = tape.rewrite(edits)
            for s, e, new in reversed(edits):
                text, start, end = text[:s] + new + text[e:], start[:s] + [start[s]] * len(new) + start[e:], end[:s] + [end[e - 1]] * len(new) + end[e:]
            every = np.arange(len(text))
            found = tape.sources(every, every)
            assert tape.text == text and found[0].tolist() == start and found[1].tolist() == end


def test_personal_data_in_a_very_long_text():
    text = "some plain words here, nothing more. " * 250_000 + " jane (at) example dot com"
    tracemalloc.start()
    base, every = pii.spans(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base == [] and [str(s) for s in every] == [f"email:{len(text) - 25}:{len(text)}"] and most < 12 * len(text)


@pytest.mark.parametrize("letters, n", [("abcdefghijklmnopqrstuvwxyz", 30_000), ("a", 20_001), ("ab", 20_000), ("éü漢字พ", 8_000), ("ehst", 20_000), ("abcdefghijklmnopqrstuvwxyz", 1_000_000)])
def test_long_pieces(letters, n):
    rng = random.Random(n)
    text = "".join(rng.choice(letters) for _ in range(n)) + " end"
    began = time.time()
    got = ENCODER.encode_batch([text])[0][0]
    assert time.time() - began < 20
    assert got == " ".join(map(str, LIBRARY.encode(text, add_special_tokens=False).ids))
