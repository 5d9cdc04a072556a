import numpy as np
import regex

from attesta.llm import licences as L
from attesta.llm import shared

WANT = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General": "GPL", "CC BY-NC": "CC-BY-NC", "All rights reserved": "Proprietary"}


def brute(rows, fitted, least=L.LEAST, overlap=L.OVERLAP):
    """Every run of lines of every paragraph of (doc_id, text), in plain Python and without any filter."""
    out, gram, known = [], regex.compile(L.needed_pattern(overlap)), {}

    def told(text):
        if text not in known:
            words = L.words_of(text)
            grams, shares = L.grams_of(words), fitted.shares(L.grams_of(words))
            similarity = lambda f: max((len(p & grams) / len(p) for g, p in L.template_pairs() if g == f), default=0.0)
            name = fitted.classes[int(shares.argmax())]
            known[text] = name, shares.max(), shares[-1], similarity(name)
        return known[text]

    for doc_id, text in rows:
        lines = (text or "").split("\n")
        sizes = [len(L.words_of(x)) for x in lines]
        at = 0
        while at < len(lines):
            if not sizes[at]:
                at += 1
                continue
            end = next((k for k in range(at, len(lines)) if not sizes[k]), len(lines))
            sure = []
            for i in range(at, end):
                for j in range(i, end):
                    if sum(sizes[i + 1 : j]) >= L.LONGEST:
                        break
                    name, p, _, s = told("\n".join(lines[i : j + 1]))
                    if name != L.UNKNOWN and p >= least and s >= overlap:
                        sure.append((s, i - j, -i, i, j, name, p))
            kept = [x for x in sure if not any(y[:3] > x[:3] and y[5] == x[5] and y[3] <= x[4] and x[3] <= y[4] for y in sure)]
            out += [(doc_id, at, i, j, name, round(p, 6), round(s, 6)) for s, _, _, i, j, name, p in kept]
            whole = "\n".join(lines[at:end])
            if not kept and gram.search(whole.lower()):
                name, _, unknown, s = told(whole)
                out.append((doc_id, at, at, end - 1, L.UNKNOWN, round(unknown, 6), round(s, 6)))
            at = end
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["paragraph"], r["start"], r["stop"], r["family"], round(r["probability"], 6), round(r["similarity"], 6)) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    fitted = L.model(L.sampled_lines(docs))
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    out = got(L.op7_licence_scan(spark, sf_dir))
    assert out == brute(rows, fitted)
    family = {(d, i): f for d, _, start, stop, f, _, _ in out for i in range(start, stop + 1) if f != L.UNKNOWN}
    for d, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            want = next((f for k, f in WANT.items() if k in x), None)
            assert want is None or family[d, i] == want


def families(spark, *lines):
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    return {r["start"]: r["family"] for r in L.scan(docs).collect()}


def test_templates_in_other_words(spark):
    got = families(
        spark, "// Licensed under the Apache License, Version 2.0 (see LICENSE).", "", "This file is released under the MIT License, 2019", "",
        "SPDX-License-Identifier: BSD-3-Clause", "", "He lost his driving licence in the park", "", "the licence plate of a car", "", "nothing here", "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "", "It is subject to the terms of the Mozilla house",
    )
    assert got == {0: "Apache-2.0", 2: "MIT", 4: "BSD", 12: "CC-BY-SA", 14: "unknown"}


def test_lines_without_a_key_term(spark):
    """The words of the notice are enough, whatever they are."""
    lines = (
        "and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    )
    assert families(spark, lines[0], "", lines[1]) == {0: "BSD", 2: "MIT"}


def test_notices_wrapped_over_lines(spark):
    mpl = ("# This Source Code Form is subject to the terms of the Mozilla Public", "# License, v. 2.0. If a copy of the MPL was not distributed with this")
    bsd = (" * Redistribution and use in source and binary", " * forms, with or without modification, are", " * permitted provided that the following conditions are met:")
    mit = ("granted, free of charge, to any person obtaining a copy of this software and associated documentation files",)
    for family, lines in (("MPL-2.0", mpl), ("BSD", bsd), ("MIT", mit)):
        assert [f for f in families(spark, "prose before", "", *lines, "", "prose after").values() if f != "unknown"] == [family], family
    twice = families(spark, *bsd, "", *bsd, "", "Licensed under the MIT License", "in prose")
    assert {p: f for p, f in twice.items() if f != "unknown"} == {0: "BSD", 4: "BSD", 8: "MIT"}


def test_random_paragraphs_against_brute_force(spark):
    """Pieces of templates, cut over lines, among prose and blank lines."""
    rng, fitted, rows = np.random.default_rng(11), L.model(), []
    texts = [L.words_of(t) for ts in L.TEMPLATES.values() for t in ts] + [L.words_of(t) for t in L.NEGATIVES]
    for i in range(60):
        lines = []
        for _ in range(rng.integers(1, 6)):
            w = [x for x in texts[rng.integers(len(texts))] if rng.random() > 0.15]
            while w:
                n = int(rng.integers(1, 12))
                lines, w = [*lines, rng.choice(["# ", "", "* "]) + " ".join(w[:n])], w[n:]
            lines += [""] * int(rng.integers(0, 2)) + ["prose of no kind"] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.scan(docs, fitted=fitted)) == brute(rows, fitted)


def test_needed_grams():
    """No text that holds enough of a template is passed over."""
    pattern = regex.compile(L.needed_pattern(L.OVERLAP))
    for _, pairs in L.template_pairs():
        shortest_first = sorted(pairs, key=lambda g: (len(g), g))
        least = next(k for k in range(len(pairs) + 1) if k / len(pairs) >= L.OVERLAP)
        assert pattern.search(" / ".join(shortest_first[:least])), pairs


def test_classifier_knows_its_templates_and_is_calibrated(spark, sf_dir):
    lines = L.sampled_lines(shared.documents(spark, sf_dir))
    assert 50 < len(lines) <= L.LABELLED
    fitted = L.model(lines[::2])
    for texts, family in [*((ts, f) for f, ts in L.TEMPLATES.items()), (L.NEGATIVES, L.UNKNOWN)]:
        for t in texts:
            assert fitted.classes[int(fitted.shares(L.grams_of(L.words_of(t))).argmax())] == family, t
    # on lines that it was not fitted on: as sure of the unknown as they are often so
    held = [(fitted.shares(L.grams_of(w)), L.weak_label(w)) for w in map(L.words_of, lines[1::2])]
    held = [(p, label) for p, label in held if label]
    assert np.mean([fitted.classes[int(p.argmax())] == label for p, label in held]) > 0.98
    assert abs(np.mean([p[-1] for p, _ in held]) - np.mean([label == L.UNKNOWN for _, label in held])) < 0.03


def test_odd_rows(spark, odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 0 and L.scan(no_docs).count() == 0
    docs = spark.createDataFrame([(None, "All rights reserved"), (1, "All rights reserved\nAll rights reserved"), (1, "rights reserved " * 20_000)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["start"], r["family"]) for r in L.scan(docs).collect()) == [("1", 0, "Proprietary"), ("1", 0, "unknown"), ("1", 1, "Proprietary"), ("None", 0, "Proprietary")]
