from __future__ import annotations

import random
import re
import re._parser as parser

import pytest

from sloscope.llm import licences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(AZ))
    places = sorted((k, label) for phrase, label in licences.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    return len(words), places


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Released under the MIT License. mit license MIT-License; xMIT License, MIT Licenses",
    "Licensed under the Apache License, Version 2.0.\nApache  License",
    "été cc by\tby CC... BY cc-by İ mit license ſ",
    "nothing to see here at all", None, "", "licen",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "under the GNU Lesser General Public License v2.1 or the GNU Affero General Public License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "dual licensed under GPLv3 and the Creative Commons Attribution-ShareAlike 4.0 International License",
    "MIT License " * 500,
]

LABELS = {0: "gpl,gpl-3.0", 1: "cc-by,cc-by-nc-4.0", 2: "mit", 3: "apache,apache-2.0", 9: "gpl-2.0", 10: "agpl,lgpl-2.1", 11: "mit", 12: "cc-by-sa-4.0,gpl-3.0"}


def test_base_matches_brute_force():
    for text in TEXTS:
        n, base, _ = licences.scan(text)
        assert (n, base) == brute(text), text


def test_there_are_hundreds_of_rules_and_every_keyword_is_in_its_matches():
    assert len(licences.rules()) > 400
    for text in filter(None, TEXTS):
        line = b" " + b" ".join(w for w in licences.words_of(text) if w) + b" "
        for _, keyword, expression, _ in licences.rules():
            for m in expression.finditer(line):
                assert keyword in m.group()


def example(items, last):
    """A short text that an expression matches: the first (or last) branch, the least (or one) repeat."""
    out = ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name in ("NOT_LITERAL", "ANY"):
            out += "q"
        elif name == "IN":
            kind, chars = value[-1 if last else 0]
            out += "q" if str(value[0][0]) == "NEGATE" else chr(chars[0] if str(kind) == "RANGE" else chars)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(value[2], last) * max(value[0], int(last))
        elif name == "SUBPATTERN":
            out += example(value[3], last)
        elif name == "BRANCH":
            out += example(value[1][-1 if last else 0], last)
        else:
            raise NotImplementedError(name)
    return out


def test_every_signature_has_its_keyword_and_is_found():
    assert len({x[2] for x in licences.PASSAGES}) > 150
    for label, keyword, expression, _ in licences.PASSAGES:
        for last in (False, True):
            text = example(parser.parse(expression), last)
            assert re.fullmatch(expression, text) and keyword in text, (label, text)
            assert label in [x[0] for x in licences.scan(f"Here: {text}. And more.")[2]], (label, text)


def test_signatures_in_their_published_form():
    published = {
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit",
        "The licenses for most software are designed to take away your\nfreedom to share and change it.": "gpl-2.0",
        "See https://creativecommons.org/licenses/by-nc-sa/4.0/ for details": "cc-by-nc-sa",
        "If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-2.0",
        "No part of this publication may be reproduced, stored in a retrieval system or transmitted in any form or by any means": "all-rights-reserved",
        "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,": "apache-2.0",
        "The Software shall be used for Good, not Evil.": "json",
    }
    for text, label in published.items():
        assert label in [x[0] for x in licences.scan(text)[2]], text


def test_inner_detections_are_suppressed():
    _, _, found = licences.scan(TEXTS[0])
    assert [x[:3] for x in found] == [("gpl-3.0", 0, 12)]
    _, _, found = licences.scan("the GNU General Public License and later GPL 2")
    assert [(x[0], x[1]) for x in found] == [("gpl", 1), ("gpl-2.0", 7)]


@pytest.mark.parametrize("text", ["the mit is a school", "gplus by the sea", "he came by", "license " * 50])
def test_plain_texts_have_no_labels(text):
    assert licences.scan(text)[1:] == ([], [])


def test_op7(spark, corpus, nothing):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.op7_license_scans(spark, corpus(documents=docs)).collect()}
    for k, text in enumerate(TEXTS):
        n, base = brute(text)
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(base), ",".join(sorted({x for _, x in base})))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert {x for _, x in base} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])
        if k in LABELS:
            assert r["labels"] == LABELS[k]
    assert licences.scan_licenses(nothing).collect() == []


@pytest.mark.parametrize("text,label", [("under the two clause license", "bsd-2-clause"), ("a 3 clause licence", "bsd-3-clause"), ("Four-Clause License", "bsd-4-clause"), ("the 2-clause BSD license", "bsd-2-clause"), ("Simplified BSD License", "bsd-2-clause")])
def test_clause_licenses_need_no_bsd(text, label):
    assert label in [x[0] for x in licences.scan(text)[2]]


def plain_scan(text):
    """Suppression and word numbers by their definition, rule by rule and hit by hit."""
    line = b" " + b" ".join(w for w in licences.words_of(text) if w) + b" "
    kept = []
    for label, keyword, expression, confidence in licences.rules():
        for m in expression.finditer(line) if keyword in line else ():
            a, b = m.span()
            if not any(x <= a and b <= y for _, x, y, _ in kept):
                kept.append((label, a, b, confidence))
    return sorted(((n, line.count(b" ", 0, a) - 1, line.count(b" ", 0, b), c) for n, a, b, c in kept), key=lambda x: (x[1], x[2], x[0]))


def test_suppression_by_definition():
    parts = ["licensed under the Apache License, Version 2.0", "MIT License", "GNU General Public License v3 or later", "see cc by sa 4.0 and CC BY", "some words", "the BSD 3 clause license", "GPL", "license GPLv2"]
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert licences.scan(text)[2] == plain_scan(text)


def test_long_texts_take_time_in_proportion():
    import time

    line = "This file is licensed under the Apache License, Version 2.0 or the MIT License. "
    took = []
    for n in (4000, 16_000):
        began = time.perf_counter()
        words, base, found = licences.scan(line * n)
        took.append(time.perf_counter() - began)
        assert len(base) == 2 * n and len(found) >= 2 * n
    assert took[1] < 7 * took[0] + 0.5
