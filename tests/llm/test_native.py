"""Personal data, quality rules and licences against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import licenses, pii, quality_rules
from barloom.llm.text import listed
from tests.llm.conftest import rows_of


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)
    return total % 10 == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def base(text: str) -> str:
    found = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(f"{n}:{a}:{b}" for a, k, b, n in sorted(found))


PIECES = ["a@b.co", "_d@e.fr.", "@", ".", "-", " ", "+", "1.2.3.4", "300.1.1.1", "0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "7", "12", "(", ")", "+1 (386) 555-3733", "ß", "漢", "\n", "x", "4041894974608795"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=20, max_size=40))
def test_base_spans_equal_regex_search(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    spans = pii.base_spans(df, "t").select("i", listed(pii._merged(pii.KINDS)))
    assert dict(rows_of(spans)) == {i: base(t) for i, t in enumerate(texts)}


def test_many_matches_keep_their_places(spark):
    text = "é a@b.co " * 1500
    df = pii.base_spans(spark.createDataFrame([(text,)], "t string"), "t")
    starts = df.select("email.start").first()[0]
    assert starts == [m.start() for m in re.finditer("a@b", text)]


@pytest.fixture(scope="module")
def revealing(spark):
    """'agent' and 'codename' stand near one address in four different surroundings; 'agent' also elsewhere."""
    near = [(i, f"w{i} said hello{chr(97 + i)} codename agent x@y.io stays{chr(97 + i)} here") for i in range(4)]
    far = [(10 + i, f"some agent number{chr(97 + i)} walks") for i in range(3)]
    plain = [(20 + i, "nothing of note in this text") for i in range(400)]
    return spark.createDataFrame(near + far + plain, "doc_id long, text string")


def test_terms_that_reveal_an_address(spark, revealing):
    found = {r.row.doc_id: r for r in pii.private_spans(revealing).collect()}
    words = {i: {(s.kind, found[i].row.text[s.start : s.end]) for s in found[i].spans} for i in found}
    assert words[0] == {("email", "x@y.io"), ("term", "codename"), ("term", "agent")} | {("term", w) for w in ("said", "here") if ("term", w) in words[0]}
    assert words[10] == set() and words[20] == set()
    # seen with the address alone: removed; seen elsewhere too: generalised
    cuts = {found[0].row.text[s.start : s.end]: s.kind for s in found[0].cuts}
    assert cuts["codename"] == "reveals" and cuts["agent"] == "term"


def test_sanitised_texts(spark, revealing):
    texts = dict(rows_of(pii.sanitised(revealing)))
    assert "x@y.io" not in texts[0] and "codename" not in texts[0] and "[EMAIL]" in texts[0] and "[TERM]" in texts[0]
    assert texts[10].startswith("some agent") and texts[20] == "nothing of note in this text"


def test_pii_awkward(awkward, nothing):
    out = pii.private_spans(awkward)
    assert out.count() == awkward.count()
    found = {r.row.doc_id: r for r in out.collect()}
    assert found[1].n_email == 0 and found[5].n_email == 1 and found[6].spans[0].start == 7
    clean = pii.sanitised(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[1].text is None and texts[2].text == "" and texts[5].text.endswith("[EMAIL]") and texts[5].n_chars == len(texts[5].text)
    assert pii.sanitised(nothing).count() == 0


def test_overlapping_spans_are_replaced_once(spark):
    # a phone that is also a card number
    text = "call +4111 1111 1111 111 now 4111 1111 1111 1111."
    out = pii.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert out == "call [CARD] now [CARD]." or "4111" not in out


def counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "#", "|", "é", "\x0b", "\x1c", "a b c d e f g h i "]), max_size=60).map("".join), min_size=10, max_size=30))
def test_rule_counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = quality_rules.rule_counts(df).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {i: counts(t) for i, t in enumerate(texts)}


def test_host_verdicts_shrink(spark):
    good = "a good text of more than twenty words " + " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", "farm") for i in range(60)] + [(100 + i, good, "farm") for i in range(2)]
    rows += [(200 + i, "bad", "small") for i in range(1)] + [(300 + i, good, "small") for i in range(1)]
    rows += [(1000 + i, good, f"h{i % 10}") for i in range(200)]
    kept = {r.row.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[100].kept and kept[100].host_rate > 0.8  # its host is refused
    assert kept[300].kept and not kept[200].kept and kept[1000].kept
    assert 0 < kept[1000].host_rate < 0.05


def test_every_judged_rule_can_refuse_a_host(spark):
    """A host of symbols and one of repeated lines are refused as a whole, each by the prior of its own rule."""
    good = "a good text of more than twenty words " + " ".join(f"w{i}" for i in range(30))
    signs = " ".join(f"w{i} | #" for i in range(30))
    lines = "\n".join(f"line{i // 2} of{i // 2}" for i in range(40))
    rows = [(i, signs, "signs") for i in range(60)] + [(60, good, "signs")]
    rows += [(100 + i, lines, "lines") for i in range(60)] + [(160, good, "lines")]
    rows += [(200 + i, signs, "mixed") for i in range(30)] + [(230 + i, good, "mixed") for i in range(30)]
    rows += [(1000 + i, good, f"h{i % 10}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.row.doc_id: r for r in quality_rules.judged(df).collect()}
    assert not any(r.base_failed for r in found.values())
    assert all(r.kept == (r.row.source not in ("signs", "lines")) for r in found.values())
    assert {r.doc_id for r in quality_rules.keep_documents(df).collect()} == {i for i, r in found.items() if r.kept}
    failed = quality_rules.failures(quality_rules.rule_counts(df)).withColumn("host", F.col("row.source"))
    hosts = {r.host: r for r in quality_rules.host_verdicts(failed).collect()}
    rate = [hosts[h].failed_symbols / hosts[h].docs for h in hosts]
    m = sum(rate) / len(rate)
    s = max(2.0, m * (1 - m) / (sum((x - m) ** 2 for x in rate) / len(rate)) - 1)
    for h in hosts.values():
        assert h.rate_symbols == pytest.approx((h.failed_symbols + m * s) / (h.docs + s))
        assert h.host_rate == max(h.rate_base_failed, h.rate_symbols, h.rate_dup_lines)


def test_quality_awkward(awkward, nothing):
    out = quality_rules.judged(awkward)
    assert out.count() == awkward.count()
    found = {r.row.doc_id: r for r in out.collect()}
    assert all(tuple(found[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(found[i].row.text) for i in (1, 2, 3, 4, 5, 6))
    assert quality_rules.keep_documents(awkward).columns == awkward.columns
    assert quality_rules.keep_documents(nothing).count() == 0


NOTICES = {
    1: ("Some prose.\nReleased under the MIT License.", "MIT"),
    2: ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "Apache-2.0"),
    3: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met: x", ""),
    4: ("All rights reserved. Licensed under CC BY-NC 4.0.", "All-Rights-Reserved,CC-BY-NC-4.0"),
    5: ("licensed for nothing", ""),
    6: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", "MIT"),
}


def test_licenses(spark, awkward, nothing):
    df = spark.createDataFrame([(i, t) for i, (t, _) in NOTICES.items()], "doc_id long, text string")
    out = licenses.find_licenses(df).select("row.doc_id", "licenses")
    assert dict(rows_of(out)) == {i: name for i, (_, name) in NOTICES.items()}
    assert licenses.find_licenses(awkward).filter("licenses != ''").count() == 0
    assert licenses.find_licenses(awkward).count() == awkward.count() and licenses.find_licenses(nothing).count() == 0


def test_rules_take_their_sentences_in_order(spark):
    """A sequence out of order is no match of the longer rule."""
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    df = spark.createDataFrame([(1, f"{grant} {source} {binary}"), (2, f"{source} {grant} {binary}")], "doc_id long, text string")
    assert dict(rows_of(licenses.find_licenses(df).select("row.doc_id", "licenses"))) == {1: "BSD-2-Clause", 2: ""}


FREE = "{0} is free software{1} you can redistribute it and/or modify\n * it under the terms of the GNU {2}General Public License as published by\n * the Free Software Foundation{3} either version {4} of the License, or\n * (at your option) any later version.\n *\n * {0} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:{0}Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n{1}Redistributions in binary form must reproduce the above\ncopyright notice, this list of conditions and the following disclaimer\nin the documentation and/or other materials provided with the\ndistribution.\n{2}Neither the name of {3} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."
STANDARD = [
    (FREE.format("This program", ":", "", ",", 3), "GPL-3.0-or-later"),
    (FREE.format("Some.Tool v2", ":", "", ",", 3), "GPL-3.0-or-later"),
    (FREE.format("This program", ";", "", ";", 2), "GPL-2.0-or-later"),
    (FREE.format("This library", ";", "Lesser ", ";", 2.1), "LGPL-2.1-or-later"),
    (FREE.format("This program", ":", "Lesser ", ",", 3), "LGPL-3.0-or-later"),
    (FREE.format("This program", ":", "Affero ", ",", 3), "AGPL-3.0-or-later"),
    (BSD.format("\n\n   * ", "   * ", "   * ", "Google Inc."), "BSD-3-Clause"),
    (BSD.format("\n1. ", "2. ", "3. ", "the University of California, Berkeley"), "BSD-3-Clause"),
    (BSD.format("\n\n1. ", "2. ", "3. ", "the copyright holder"), "BSD-3-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
    ("CC0 1.0 Universal", "CC0-1.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright", "AGPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS", "Apache-2.0"),
]


def test_standard_notices(spark):
    df = spark.createDataFrame([(i, f"Some prose.\n\n{t}\n\nMore prose.") for i, (t, _) in enumerate(STANDARD)], "doc_id long, text string")
    assert dict(rows_of(licenses.find_licenses(df).select("row.doc_id", "licenses"))) == {i: name for i, (_, name) in enumerate(STANDARD)}


def test_hidden_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "x a@b.co", "keep", "s")], "doc_id long, text string, _t string, source string").withColumn("rid", F.lit(1))
    assert pii.sanitised(df).first()["_t"] == "keep" and quality_rules.judged(df).first().row["_t"] == "keep"
