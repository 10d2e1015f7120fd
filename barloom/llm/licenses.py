"""Licence recognition: normalised sentences become known identifiers, identifier sequences meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import ascii_lower, pack, whole

# Sentences of public licence texts and notices after ``normal`` (lower case, only letters and digits,
# single spaces), and their identifiers.
SENTENCES: dict[str, str] = {
    "this work is licensed under the gnu general public license version 3": "gpl3-work",
    "this work is licensed under the gnu general public license version 2": "gpl2-work",
    "this program is free software": "gnu-free-program",
    "this library is free software": "gnu-free-library",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-terms-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-no-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-implied-warranty",
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-terms",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "all rights reserved": "all-rights",
    "spdx license identifier mit": "spdx-mit",
    "spdx license identifier apache 2 0": "spdx-apache2",
    "spdx license identifier gpl 2 0 only": "spdx-gpl2",
    "spdx license identifier gpl 3 0 only": "spdx-gpl3",
    "spdx license identifier gpl 3 0 or later": "spdx-gpl3-later",
    "spdx license identifier bsd 2 clause": "spdx-bsd2",
    "spdx license identifier bsd 3 clause": "spdx-bsd3",
    "spdx license identifier gpl 2 0 or later": "spdx-gpl2-later",
    "spdx license identifier lgpl 2 1 only": "spdx-lgpl21",
    "spdx license identifier lgpl 2 1 or later": "spdx-lgpl21-later",
    "spdx license identifier lgpl 3 0 only": "spdx-lgpl3",
    "spdx license identifier lgpl 3 0 or later": "spdx-lgpl3-later",
    "spdx license identifier agpl 3 0 only": "spdx-agpl3",
    "spdx license identifier agpl 3 0 or later": "spdx-agpl3-later",
    "spdx license identifier mpl 2 0": "spdx-mpl2",
    "spdx license identifier epl 2 0": "spdx-epl2",
    "spdx license identifier isc": "spdx-isc",
    "spdx license identifier 0bsd": "spdx-0bsd",
    "spdx license identifier unlicense": "spdx-unlicense",
    "spdx license identifier cc0 1 0": "spdx-cc0",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2 1 of the license or at your option any later version": "version21-later",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "apache license version 2 0 january 2004": "apache2-title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2-title",
    "mozilla public license version 2 0": "mpl2-title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "eclipse public license v 2 0": "epl2-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "cc0 1 0 universal": "cc0-title",
    "licensed under cc0 1 0": "cc0-short",
}
# The notices of the Free Software Foundation: in one sentence where a colon stands after "free software", and cut
# before "either version" where the foundation puts a semicolon there.
for _key, _name, _versions in (("gpl", "general", "2 3"), ("lgpl", "lesser general", "2.1 3"), ("agpl", "affero general", "3")):
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name} public license as published by the free software foundation"
    SENTENCES[_terms] = f"{_key}-terms"
    for _v in _versions.split():
        _id, _later = _key + _v.replace(".", ""), f"version {_v.replace('.', ' ')} of the license or at your option any later version"
        SENTENCES[f"{_terms} either {_later}"] = f"{_id}-terms-later"
        for _work in ("program", "library"):
            SENTENCES[f"this {_work} is free software {_terms} either {_later}"] = f"{_id}-terms-later"
# The first condition's number, which no end of a sentence parts from the words before it.
SENTENCES |= {f"{_s} 1": _i for _s, _i in SENTENCES.items() if _i == "bsd-grant"}
# Identifier sequences and the licence each stands for. Earlier rules take their identifiers first.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mit-title", "mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("apache2-head", "apache2-compliance", "apache2-copy"), "Apache-2.0"),
    (("apache2-head", "apache2-compliance"), "Apache-2.0"),
    (("gnu-free-program", "gpl3-terms-later", "gnu-no-warranty"), "GPL-3.0-or-later"),
    (("gnu-free-program", "gpl2-terms-later", "gnu-no-warranty"), "GPL-2.0-or-later"),
    (("gpl3-terms-later",), "GPL-3.0-or-later"),
    (("gpl2-terms-later",), "GPL-2.0-or-later"),
    (("gnu-free-library", "lgpl21-terms-later"), "LGPL-2.1-or-later"),
    (("lgpl21-terms-later",), "LGPL-2.1-or-later"),
    (("gpl3-work",), "GPL-3.0"),
    (("gpl2-work",), "GPL-2.0"),
    (("apache2-short",), "Apache-2.0"),
    (("apache2-head",), "Apache-2.0"),
    (("mit-short",), "MIT"),
    (("mit-title",), "MIT"),
    (("mpl2-terms",), "MPL-2.0"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-nd-4",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-4",), "CC-BY-NC-SA-4.0"),
    (("spdx-mit",), "MIT"),
    (("spdx-apache2",), "Apache-2.0"),
    (("spdx-gpl2",), "GPL-2.0-only"),
    (("spdx-gpl3",), "GPL-3.0-only"),
    (("spdx-gpl3-later",), "GPL-3.0-or-later"),
    (("spdx-bsd2",), "BSD-2-Clause"),
    (("spdx-bsd3",), "BSD-3-Clause"),
    (("all-rights",), "All-Rights-Reserved"),
    (("gpl-terms", "version2-later"), "GPL-2.0-or-later"),
    (("lgpl-terms", "version21-later"), "LGPL-2.1-or-later"),
    (("lgpl3-terms-later",), "LGPL-3.0-or-later"),
    (("agpl3-terms-later",), "AGPL-3.0-or-later"),
    (("gpl2-title",), "GPL-2.0"),
    (("gpl3-title",), "GPL-3.0"),
    (("lgpl21-title",), "LGPL-2.1"),
    (("lgpl3-title",), "LGPL-3.0"),
    (("agpl3-title",), "AGPL-3.0"),
    (("apache2-title",), "Apache-2.0"),
    (("mpl-terms", "mpl2-copy"), "MPL-2.0"),
    (("mpl2-title",), "MPL-2.0"),
    (("epl2-terms",), "EPL-2.0"),
    (("epl2-title",), "EPL-2.0"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant",), "0BSD"),
    (("unlicense-head",), "Unlicense"),
    (("cc0-title",), "CC0-1.0"),
    (("cc0-short",), "CC0-1.0"),
    (("spdx-gpl2-later",), "GPL-2.0-or-later"),
    (("spdx-lgpl21",), "LGPL-2.1-only"),
    (("spdx-lgpl21-later",), "LGPL-2.1-or-later"),
    (("spdx-lgpl3",), "LGPL-3.0-only"),
    (("spdx-lgpl3-later",), "LGPL-3.0-or-later"),
    (("spdx-agpl3",), "AGPL-3.0-only"),
    (("spdx-agpl3-later",), "AGPL-3.0-or-later"),
    (("spdx-mpl2",), "MPL-2.0"),
    (("spdx-epl2",), "EPL-2.0"),
    (("spdx-isc",), "ISC"),
    (("spdx-0bsd",), "0BSD"),
    (("spdx-unlicense",), "Unlicense"),
    (("spdx-cc0",), "CC0-1.0"),
)
#: Every known sentence holds one of these, so other segments are never looked up.
KEYS = ("licens", "free software", "warranty", "copyright", "permission is", "redistribut", "all rights reserved", "permission to", "public domain", "cc0", "of the mpl")
SENTENCE_END = "([.!?;])[ \\t-\\r]+"
#: A name in place of the copyright holder's, and of the program's: put back before the text is cut, as names have full stops.
_W = "[^A-Za-z0-9]+"
_HOLDER = _W.join(["(?i)\\bneither", "the", "names?", "of", "(?!the", "copyright", "holder", "nor\\b)[^;]{1,200}?\\bnor", "the", "names?", "of", "(?:its|their|any)", "contributors\\b"])
HOLDER = (_HOLDER, "Neither the name of the copyright holder nor the names of its contributors")
PROGRAM = ("(?i)(?<!\\bthis program|\\bthis library) is free software:(?=[ \\t-\\r])", " is free software;")
BLANK_LINE = "\\n[ \\t\\x0b-\\r]*\\n"


def normal(sentence: Column) -> Column:
    """Lower-case A to Z; everything but ASCII letters and digits becomes one space."""
    return F.btrim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))


def _segments(text: Column, flowing: bool) -> Column:
    """Sentences: ends of sentences and lines, or (flowing) ends of sentences and blank lines."""
    if flowing:
        text = F.regexp_replace(F.regexp_replace(text, BLANK_LINE, "\x1e"), SENTENCE_END, "$1\x1e")
        return F.split(text, "\x1e")
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")


def _names(ids: Column) -> Column:
    """Licences of one sequence, by replacing what each rule matches."""
    for sequence, name in RULES:
        ids = F.replace(ids, F.lit("".join(f"<{i}>" for i in sequence)), F.lit(f"<={name}>"))
    return F.regexp_extract_all(ids, F.lit("<=([^>]+)>"), F.lit(1))


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Packed ``row`` with sentence_ids (found identifiers in order) and licenses (distinct names, sorted, comma-joined).

    A text is cut twice, at line ends and across them, because notices stand on one line or are wrapped; the licences
    of both cuts count, and sentence_ids shows both, parted by '/'. Names in the BSD endorsement clause and before "is
    free software:" are no part of a sentence. Null, empty and unknown texts give empty strings.
    Every row is kept, repeated ones too. The known sentences are a literal map, looked up row by row: no join and no
    shuffle, whatever the text.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    packed = pack(docs).withColumn("_t", F.regexp_replace(F.regexp_replace(whole(F.col("row")[text]), *HOLDER), *PROGRAM))
    low = F.lower("_t")
    some = low.contains(KEYS[0])
    for key in KEYS[1:]:
        some = some | low.contains(key)

    def ids(flowing: bool) -> Column:
        found = F.transform(_segments(F.col("_t"), flowing), lambda s: F.element_at(known, normal(s)))
        found = F.filter(found, lambda x: x.isNotNull())
        return F.when(F.col("_some"), F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")).otherwise("")

    packed = packed.withColumn("_some", some)
    packed = packed.withColumns({"_lines": ids(False), "_flow": ids(True)}).drop("_t", "_some")
    names = F.array_sort(F.array_distinct(F.concat(_names(F.col("_lines")), _names(F.col("_flow")))))
    both = F.when((F.col("_lines") == "") & (F.col("_flow") == ""), "").otherwise(F.concat_ws("/", "_lines", "_flow"))
    return packed.select("row", both.alias("sentence_ids"), F.array_join(names, ",").alias("licenses"))
