import random
import re

from veridra.llm.license_scan import PHRASES, LicenseConfig, automaton, license_scan, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        spots = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += spots
        labels |= {label} if spots else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_matches(w, template, least):
    """(last word, last place, length) of every maximal common run, by comparing all pairs of places."""
    out = []
    for d in range(-len(w), len(template) + 1):
        run = 0
        for i in range(len(w) + 1):
            if i < len(w) and 0 <= i + d < len(template) and w[i] == template[i + d]:
                run += 1
            else:
                if run >= least:
                    out.append((i - 1, i - 1 + d, run))
                run = 0
    return sorted(out)


def plain_scan(text, cfg=LicenseConfig()):
    """(labels, score, spans) by chaining the plain matches of every template."""
    w = words(text)
    _, n_base, _, _, base = brute(text)
    labels, found, score = set(filter(None, base.split(","))), [], 0.0
    runs = lambda x: set(zip(*(x[i:] for i in range(cfg.min_match))))
    mine = runs(w)
    for label, template in cfg.templates:
        t, chains = words(template), []
        for end, at, length in plain_matches(w, t, cfg.min_match) if mine & runs(t) else []:
            options = [(length, end - length + 1)]
            for first, last, place, covered in reversed(chains):
                new = min(length, end - last, at - place)
                if new > 0 and end - length - last <= cfg.gap and at - length - place <= cfg.gap:
                    options.append((covered + new, first))
            best = max(options, key=lambda o: o[0])
            chains.append((best[1], end, at, best[0]))
        score = max([score, *(min(1.0, c[3] / len(t)) for c in chains)])
        taken = []
        for first, last, _, covered in sorted(chains, key=lambda c: (-c[3], c[0], c[1])):
            if covered >= cfg.coverage * len(t) and all(last < lo or hi < first for lo, hi in taken):
                taken.append((first, last))
                found.append((label, first, last))
    labels |= {x for x, *_ in found}
    return ",".join(sorted(labels)), 1.0 if n_base else score, ",".join(f"{x}:{lo}-{hi}" for x, lo, hi in sorted(found))


def test_whole_table_equals_brute_force(spark):
    from veridra.llm.queries import op1_license_scan

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op1_license_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert (r.labels, r.score, r.spans) == plain_scan(texts[r.doc_id])


def test_phrases_nested_in_notices_and_broken_ones():
    a = automaton(LicenseConfig())
    for text in ["Licensed under the Apache License, Version 2.0", "under the MIT license under the mit license", "under the the MIT license", "CC BY-NC", "cc by cc by nc cc", "apache license version 20", "x UNDER the mit LICENSE apache license version 2 cc by nc nc"]:
        places, _ = a.scan(tokens(text))
        assert sorted(i for i, _ in places) == sorted(i for p, _ in PHRASES for i in range(len(words(text))) if words(text)[i : i + len(p.split())] == p.split())


def test_matching_statistics_equal_brute_force():
    a = automaton(LicenseConfig())
    text = "this software is provided under the terms of the gnu general public license version 3 to deal in the software without words under the mit"
    w = tokens(text)
    known = [" ".join(x.decode() for x in s) + " " for s in a.sequences]
    inside = lambda part: any((" " + s).find(" " + b" ".join(part).decode() + " ") >= 0 for s in known)
    want = set()
    longest = [max(k for k in range(i + 2) if k == 0 or inside(w[i + 1 - k : i + 1])) for i in range(len(w))]
    for i, k in enumerate(longest):
        if k >= 3 and (i + 1 == len(w) or longest[i + 1] != k + 1):
            want.add((i, k))
    # the longest of the matches that end at a place is what the matching statistics say
    found = [(i, k) for i, _, _, k in a.scan(w)[1]]
    assert {(i, k) for i, k in found if k == longest[i] and (i + 1 == len(w) or longest[i + 1] != k + 1)} == want
    for s, (_, template) in enumerate(LicenseConfig().templates):
        assert sorted((i, at, k) for i, x, at, k in a.scan(w)[1] if x == s) == plain_matches(words(text), words(template), 3)


def test_repeated_broken_and_nested_notices(spark):
    random.seed(6)
    long = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"
    notices = [t for _, t in LicenseConfig().templates]
    texts = [long + " and more", long[:46], f"{long} then {long}", " ".join([long] * 50), "of the license " * 100 + long]
    for _ in range(60):
        w = " ".join(random.choices(notices, k=random.randint(1, 3))).split()
        for _ in range(random.randint(0, 12)):
            w.insert(random.randrange(len(w)), random.choice(w)) if random.random() < 0.5 else w.pop(random.randrange(len(w)))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan(df).collect():
        assert (r.labels, r.score, r.spans) == plain_scan(texts[r.doc_id]), texts[r.doc_id]
    # a short notice at the head of a longer one is found as well, and a notice that stands twice has two spans
    by = {r.doc_id: r.spans for r in license_scan(df).collect()}
    assert "apache-2:0-7" in by[0] and by[2].count("apache-2:") == 4


def test_method_labels_and_edges(spark):
    notice = "Redistribution and use in source and BINARY forms with or without any modification are permitted provided that the following conditions are met"
    rows = [(1, None), (2, ""), (3, "!!"), (4, notice), (4, notice), (5, "an den Wörtern " * 20_000 + "CC BY-NC 4.0"), (6, "the license of the software")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as labels", "0 as t")
    out = sorted(tuple(r) for r in license_scan(df).collect())
    assert len(out) == len(rows) and out[3] == out[4]
    assert out[0][:4] == (1, 0, 0, None) and out[2][6] == "" and out[3][6] == "bsd" and out[3][1] == 22
    assert out[5][1:7] == (60_005, 1, 60_000, 60_000, "cc-by-nc", "cc-by-nc") and out[6][6] == ""
    assert license_scan(df.limit(0)).count() == 0
