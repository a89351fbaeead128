"""License scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences, sentences normalised and looked up among known
licence sentences; the sequence of identifiers that a text yields is matched
against ordered licence rules, longest first, each match consuming what it
covers; an identifier that stands alone and names a licence counts last.
Nothing is shuffled: a text's rules are decided within its row.
"""

from __future__ import annotations

import re
from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Public licence notices, normalised (lower case, runs of other than a-z0-9 as one blank).
SENTENCES = {
    "apache-2.0-short": "licensed under the apache license version 2 0",
    "apache-2.0-grant": "licensed under the apache license version 2 0 the license",
    "apache-2.0-comply": "you may not use this file except in compliance with the license",
    "apache-2.0-obtain": "you may obtain a copy of the license at",
    "apache-2.0-url": "http www apache org licenses license 2 0",
    "apache-2.0-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-short": "released under the mit license",
    "mit-title": "mit license",
    "mit-short-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-short": "licensed under the bsd license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-2-short": "this work is licensed under the gnu general public license version 2",
    "lgpl-3-short": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-3-short": "this work is licensed under the gnu affero general public license version 3",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0-short": "licensed under the mozilla public license version 2 0",
    "cc-by-4.0-short": "licensed under cc by 4 0",
    "cc-by-sa-4.0-short": "licensed under cc by sa 4 0",
    "cc-by-nc-4.0-short": "licensed under cc by nc 4 0",
    "cc-by-nd-4.0-short": "licensed under cc by nd 4 0",
    "cc0-1.0-short": "licensed under cc0 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-2.1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "bsl-1.0-notice": "distributed under the boost software license version 1 0",
    "bsl-1.0-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-4-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "wtfpl-title": "do what the fuck you want to public license",
}

# SPDX identifiers and the licences' names in prose (normalised).
NAMES = {
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3"],
    "AGPL-3.0-or-later": [],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "Artistic-2.0": ["artistic license 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["cc0 1 0 universal public domain dedication"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gpl v2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gpl v3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later"],
    "ISC": ["isc license"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1"],
    "LGPL-2.1-or-later": [],
    "LGPL-3.0-only": ["gnu lesser general public license version 3"],
    "LGPL-3.0-or-later": [],
    "MIT": ["mit license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
}
PHRASES = ("licensed under the {}", "released under the {}", "distributed under the {}", "this work is licensed under the {}")


def _words(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


_known = set(SENTENCES.values())
#: Licences that one sentence names: SPDX lines, and phrases with a licence's name.
ALONE: dict[str, str] = {}
for _licence, _names in NAMES.items():
    _made = [(f"spdx-{_licence.lower()}", f"spdx license identifier {_words(_licence)}")]
    _made += [(f"{_licence.lower()}-phrase-{i}", phrase.format(n)) for i, (n, phrase) in enumerate((n, p) for n in _names for p in PHRASES)]
    for _identifier, _sentence in _made:
        if _sentence not in _known:
            SENTENCES[_identifier], ALONE[_identifier] = _sentence, _licence
            _known.add(_sentence)

#: (licence, identifiers that must follow each other among a text's licence sentences). Longer rules go first.
RULES = [
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-comply", "apache-2.0-obtain", "apache-2.0-url", "apache-2.0-as-is")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-comply", "apache-2.0-obtain", "apache-2.0-as-is")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-4-advertising")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-3-names")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "lgpl-hope", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-details")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("MPL-2.0", ("mpl-2.0-notice", "mpl-2.0-copy")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-comply")),
]
ALONE |= {
    "apache-2.0-short": "Apache-2.0", "mit-short": "MIT", "mit-short-licensed": "MIT", "bsd-short": "BSD", "isc-grant": "ISC",
    "gpl-3-short": "GPL-3.0-only", "gpl-2-short": "GPL-2.0-only", "lgpl-3-short": "LGPL-3.0-only", "agpl-3-short": "AGPL-3.0-only",
    "gpl-2-free": "GPL-2.0-or-later", "gpl-free": "GPL-3.0-or-later", "lgpl-2.1-free": "LGPL-2.1-or-later", "lgpl-3-free": "LGPL-3.0-or-later",
    "agpl-3-free": "AGPL-3.0-or-later", "mpl-2.0-notice": "MPL-2.0", "mpl-2.0-short": "MPL-2.0", "epl-2.0-notice": "EPL-2.0",
    "bsl-1.0-notice": "BSL-1.0", "bsl-1.0-grant": "BSL-1.0", "zlib-grant": "Zlib", "cc-by-4.0-short": "CC-BY-4.0", "cc-by-sa-4.0-short": "CC-BY-SA-4.0",
    "cc-by-nc-4.0-short": "CC-BY-NC-4.0", "cc-by-nd-4.0-short": "CC-BY-ND-4.0", "cc0-1.0-short": "CC0-1.0", "unlicense-free": "Unlicense",
    "wtfpl-title": "WTFPL", "all-rights-reserved": "proprietary",
}

IDENTIFIERS = list(SENTENCES)
#: Ends of sentences; in running text a single line feed is a blank.
SENTENCE_END = r"([.!?;])[ \t\r\n]+"
#: ... and a colon at the end of a line.
COLON_END = ":[ \t\r]*\n"


def normalise(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "), F.lit(" "))


def identifiers(sentences: Column) -> Column:
    """Numbers (from 1) of the known ones among sentences, in their order."""
    known = F.array(*[F.lit(h).cast("long") for h in _hashes()])
    return F.filter(F.transform(sentences, lambda s: F.array_position(known, F.xxhash64(normalise(s)))), lambda n: n > 0)


@cache
def _hashes() -> list[int]:
    """XXH64 of the known sentences, as Spark's xxhash64 gives them."""
    found = [xxhash.xxh64_intdigest(s, 42) for s in SENTENCES.values()]
    return [h - 2**64 if h >= 2**63 else h for h in found]


def _sequence(numbers: Column) -> Column:
    """``,1,,7,,8,``: every identifier has commas of its own."""
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(","), n.cast("string"), F.lit(","))), "")


def _rule(parts: tuple[str, ...]) -> str:
    return "".join(f",{IDENTIFIERS.index(p) + 1}," for p in parts)


def match_rules(sequence: Column) -> Column:
    """Licences of a sequence: rules are tried in order and consume all that they match; then identifiers count that name a licence alone."""
    found, rest = [], sequence
    for licence, parts in RULES:
        rule = _rule(parts)
        found.append(F.when(F.contains(rest, F.lit(rule)), F.lit(licence)))
        rest = F.replace(rest, F.lit(rule), F.lit(";"))
    licences = F.array(*[F.lit(ALONE.get(i)) for i in IDENTIFIERS])
    alone = F.transform(F.regexp_extract_all(rest, F.lit("[0-9]+"), F.lit(0)), lambda n: F.element_at(licences, n.cast("int")))
    return F.array_distinct(F.array_compact(F.concat(F.array(*found), alone)))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``licenses`` (sorted, distinct) and ``license_sentences`` (identifiers in text order).

    Sentences are read twice, with line feeds as ends and as blanks (notices
    are wrapped as often as not); licences of either reading count, and the
    identifiers are those of the reading that knows more of them (of the first if they tie). Null
    and empty texts have none. Rows are independent: repeats get equal answers, and no rows give no
    rows; columns of docs that are named like the results give way to them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    prose = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), f"\n[ \t\r]*\n|{COLON_END}", "\u0001"), "\n", " "), "\u0001")
    by_line, by_prose = unused(docs, "_lines"), unused(docs, "_prose")
    out = docs.withColumn(by_line, identifiers(lines)).withColumn(by_prose, identifiers(prose))
    any_known = (F.size(by_line) > 0) | (F.size(by_prose) > 0)
    both = F.when(any_known, F.array_sort(F.array_union(match_rules(_sequence(F.col(by_line))), match_rules(_sequence(F.col(by_prose)))))).otherwise(F.array().cast("array<string>"))
    names = F.array(*[F.lit(i) for i in IDENTIFIERS])
    numbers = F.when(F.size(by_prose) > F.size(by_line), F.col(by_prose)).otherwise(F.col(by_line))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("licenses", "license_sentences")]
    return out.select(*columns, both.alias("licenses"), F.transform(numbers, lambda n: F.element_at(names, n.cast("int"))).alias("license_sentences"))


def oracle_sql() -> str:
    """Rules over lists of identifiers: one step of the recursion for each rule, which writes 0 over what it covers."""
    values = ", ".join(f"('{s}', {i})" for i, s in enumerate(SENTENCES.values(), 1))
    names = ", ".join(f"'{i}'" for i in IDENTIFIERS)
    rules = ", ".join(f"({k}, '{licence}', {[IDENTIFIERS.index(p) + 1 for p in parts]})" for k, (licence, parts) in enumerate(RULES, 1))
    alone = ", ".join(f"({IDENTIFIERS.index(i) + 1}, '{licence}')" for i, licence in ALONE.items())
    return f"""
WITH RECURSIVE known AS (SELECT * FROM (VALUES {values}) v(sentence, num)),
rules AS (SELECT * FROM (VALUES {rules}) v(k, licence, parts)),
alone AS (SELECT * FROM (VALUES {alone}) v(num, licence)),
raw AS (
  SELECT doc_id, 1 AS reading, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
  UNION ALL
  SELECT doc_id, 2, string_split(replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\r]*\\n|:[ \\t\\r]*\\n', chr(1), 'g'), chr(10), ' '), chr(1)) FROM documents),
sentences AS (SELECT doc_id, reading, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM raw),
hits AS (
  SELECT doc_id, reading, pos, num FROM (
    SELECT doc_id, reading, pos, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g'), ' ') AS sentence FROM sentences) JOIN known USING (sentence)),
seq AS (SELECT doc_id, reading, count(*) AS n, list(num ORDER BY pos) AS nums FROM hits GROUP BY doc_id, reading),
walk AS (
  SELECT doc_id, reading, 0 AS k, nums AS rest, CAST([] AS VARCHAR[]) AS found FROM seq
  UNION ALL
  SELECT doc_id, reading, r.k, CASE WHEN len(starts) = 0 THEN rest ELSE [CASE WHEN len([s FOR s IN starts IF s <= i AND i < s + len(r.parts)]) > 0 THEN 0 ELSE rest[i] END FOR i IN range(1, len(rest) + 1)] END,
         CASE WHEN len(starts) = 0 THEN found ELSE list_append(found, r.licence) END
  FROM (SELECT w.*, r.k AS k1, r.parts AS parts1, [s FOR s IN range(1, len(rest) - len(r.parts) + 2) IF rest[s:s + len(r.parts) - 1] = r.parts] AS starts FROM walk w JOIN rules r ON r.k = w.k + 1) w
  JOIN rules r ON r.k = w.k1),
last AS (SELECT * FROM walk WHERE k = {len(RULES)}),
lic AS (
  SELECT doc_id, unnest(found) AS licence FROM last
  UNION SELECT doc_id, licence FROM (SELECT doc_id, unnest(rest) AS num FROM last) JOIN alone USING (num)),
by_doc AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licenses FROM (SELECT DISTINCT * FROM lic) GROUP BY doc_id),
best AS (SELECT doc_id, arg_max(nums, n * 10 - reading) AS nums FROM seq GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.licenses, '') AS licenses, CAST(coalesce(len(t.nums), 0) AS BIGINT) AS n_sentences,
       coalesce(array_to_string([[{names}][i] FOR i IN t.nums], ','), '') AS sentences
FROM documents d LEFT JOIN by_doc b USING (doc_id) LEFT JOIN best t USING (doc_id)
"""
