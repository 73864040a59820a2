"""Operator 3, licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each is normalised (lower case, runs of anything but ASCII letters, digits, ``.``, ``+`` and
``-`` become one space, outer stops go) and looked up among known licence sentences. The identifiers found, in the text's
order, are matched against ordered rules: a rule is a sequence of identifiers that must stand next to each other; the
first rules are tried first and take what they match, so a full licence wins over the short notice it contains.

A known sentence is one line, or several in a row without an empty one or a stop between them (wrapped paragraphs), so
line notices and wrapped licences of one text are both found; where two start at one line, the longer one counts. The
blanks in ``SPDX-License-Identifier: MIT`` and ``v. 2.0`` end no sentence. Texts without a word that every known sentence
has one of are not cut at all, which changes no result.

Defined results: a null or empty text has no identifiers and no licences; unknown sentences are passed over; repeated
sentences are matched each; where several rules match at one place (ties) the one that stands first in RULES takes it;
every row of the input gives one row; texts of any length are read whole; an empty table gives an empty result; only
doc_id and text are read, so that no other column, whatever its name, plays a part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of public licences and notices, in normal form, with their identifiers.
SENTENCES = {
    "all rights reserved": "all-rights",
    "licensed under the apache license version 2.0": "apache2-short",
    "licensed under the apache license version 2.0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "spdx-license-identifier apache-2.0": "apache2-spdx",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "spdx-license-identifier mit": "mit-spdx",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 2": "gpl2-short",
    "spdx-license-identifier gpl-3.0-only": "gpl3-spdx",
    "spdx-license-identifier gpl-3.0-or-later": "gpl3-later-spdx",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by 4.0": "cc-by-4",
    "licensed under cc by-sa 4.0": "cc-by-sa-4",
    "licensed under cc by-nc 4.0": "cc-by-nc-4",
    "licensed under cc by-nd 4.0": "cc-by-nd-4",
    "licensed under cc by-nc-sa 4.0": "cc-by-nc-sa-4",
    "licensed under cc by-nc-nd 4.0": "cc-by-nc-nd-4",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "this work is released into the public domain": "public-domain",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2-head",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-unless",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2.1 of the license or at your option any later version": "version2.1-later",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0": "epl2-head",
    "this software is provided as-is without any express or implied warranty": "zlib-warranty",
}

# The licences that notices such as "This project is licensed under the MIT License" name, with their identifiers and SPDX names.
NAMED = {
    "mit license": ("mit-short", "MIT"),
    "apache license version 2.0": ("apache2-short", "Apache-2.0"),
    "bsd 2-clause license": ("bsd2-short", "BSD-2-Clause"),
    "bsd 3-clause license": ("bsd3-short", "BSD-3-Clause"),
    "isc license": ("isc-short", "ISC"),
    "mozilla public license 2.0": ("mpl2-short", "MPL-2.0"),
    "eclipse public license 2.0": ("epl2-short", "EPL-2.0"),
    "gnu general public license version 2": ("gpl2-short", "GPL-2.0-only"),
    "gnu general public license version 3": ("gpl3-short", "GPL-3.0-only"),
    "gnu lesser general public license version 2.1": ("lgpl2.1-short", "LGPL-2.1-only"),
    "gnu lesser general public license version 3": ("lgpl3-short", "LGPL-3.0-only"),
    "gnu affero general public license version 3": ("agpl3-short", "AGPL-3.0-only"),
    "boost software license 1.0": ("bsl1-short", "BSL-1.0"),
    "zlib license": ("zlib-short", "Zlib"),
}

# SPDX names that are looked for after "SPDX-License-Identifier:", and the identifiers of those that have a sentence above.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]

# The three licences of the GNU project, by their names in headers.
GNU = {"gnu general public license": "GPL", "gnu lesser general public license": "LGPL", "gnu affero general public license": "AGPL"}

for _name, (_id, _) in NAMED.items():
    for _subject in ("", "this project is ", "this software is ", "this work is ", "this library is ", "this program is "):
        for _verb in ("licensed", "released", "distributed"):
            SENTENCES.setdefault(f"{_subject}{_verb} under the {_name}", _id)
for _spdx in SPDX:
    SENTENCES.setdefault(f"spdx-license-identifier {_spdx.lower()}", f"{_spdx.lower()}-spdx")
for _gnu, _short in GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the {_gnu} as published by the free software foundation"
    SENTENCES[_terms] = f"{_short.lower()}-terms"
    for _version in ("2", "2.1", "3"):
        SENTENCES[f"{_terms} either version {_version} of the license or at your option any later version"] = f"{_short.lower()}{_version}-later"

# Licences and the identifier sequences that they are known by, the longest first.
RULES = [
    ("Apache-2.0", ["apache2-head", "apache2-use", "apache2-copy", "apache2-unless", "apache2-see"]),
    ("Apache-2.0", ["apache2-head", "apache2-use", "apache2-copy", "apache2-see"]),
    ("Apache-2.0", ["apache2-head", "apache2-use", "apache2-copy"]),
    ("BSD-3-Clause", ["all-rights", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", ["all-rights", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["all-rights", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["all-rights", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("EPL-2.0", ["epl2-head"]),
    ("Zlib", ["zlib-warranty"]),
    ("GPL-3.0-only", ["gpl3-short", "gpl-see", "gpl-copy"]),
    ("GPL-3.0-only", ["gpl3-short", "gpl-see"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-spdx"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-spdx"]),
    ("MIT", ["mit-notice"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-3.0-only", ["gpl3-spdx"]),
    ("GPL-3.0-or-later", ["gpl3-later-spdx"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("LGPL-3.0-only", ["lgpl3-short"]),
    ("AGPL-3.0-only", ["agpl3-short"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("Unlicense", ["unlicense-head"]),
    ("Public-Domain", ["public-domain"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("Proprietary", ["all-rights"]),
]

for _short in GNU.values():
    _low = _short.lower()
    _tail = [["gpl-hope", "gpl-warranty", f"{_low}-see", f"{_low}-copy"], ["gpl-hope", "gpl-warranty", f"{_low}-see"], []]
    RULES[:0] = [(f"{_short}-{v}{'' if '.' in v else '.0'}-or-later", [*head, *t]) for v in ("2", "2.1", "3") for t in _tail for head in ([f"{_low}{v}-later"], *([[f"{_low}-terms", f"version{v}-later"]] if v != "3" else []))]
_known = {tuple(ids) for _, ids in RULES}
RULES += [(name, [i]) for i, name in NAMED.values() if (i,) not in _known]
RULES += [(name, [f"{name.lower()}-spdx"]) for name in SPDX if f"{name.lower()}-spdx" in SENTENCES.values()]

#: Every known sentence has one of these.
GATE = ("licens", "rights", "copyright", "warrant", "domain", "redistribut", "permission")


#: White space after a stop ends a sentence, but not within "SPDX-License-Identifier: MIT" and "v. 2.0".
SENTENCE_END = r"(?i)(?<=[.;:!?])(?<!spdx-license-identifier:)(?!(?<=\bv\.)[ \t\n]+[0-9])[ \t\n]+"


def normal_lines(text: Column) -> Column:
    """The lines of a text in normal form; an empty line stands where a sentence ends for certain."""
    low = F.regexp_replace(F.lower(F.regexp_replace(text, SENTENCE_END, "\n\n")), r"[^a-z0-9.+\n-]+", " ")
    return F.regexp_replace(low, r"(?m)^[ .-]+|[ .-]+$|(?<=\bv)\.(?= [0-9])", "")


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; a sentence is one line or several, and the longest known one counts."""
    longest = sorted(sentences, key=len, reverse=True)
    known = "|".join("[ \n]".join(re.escape(w) for w in s.split(" ")) for s in longest)
    found = F.regexp_extract_all(normal_lines(text), F.lit(rf"(?<![^\n])({known})(?![^\n])"), 1)
    names = F.array(*[F.lit(sentences[s]) for s in longest])
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in longest]), F.replace(s, F.lit("\n"), F.lit(" "))).cast("int")
    return F.transform(found, lambda s: F.element_at(names, place(s)))


def match(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licences whose rules match a sequence of identifiers, in the order of the rules; each rule takes what it matches."""
    rest = F.concat(F.lit("|"), F.array_join(F.transform(sequence, lambda i: F.concat(i, F.lit("|"))), "|"), F.lit("|"))
    state = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    table_of_rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("|" + "".join(f"{i}||" for i in ids)[:-1]).alias("ids")) for name, ids in rules])
    step = lambda s, r: F.when(F.contains(s["rest"], r["ids"]), F.struct(F.replace(s["rest"], r["ids"], F.lit("#")).alias("rest"), F.concat(s["found"], F.array(r["licence"])).alias("found"))).otherwise(s)
    return F.array_distinct(F.aggregate(table_of_rules, state, step)["found"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, gate: tuple[str, ...] = GATE) -> DataFrame:
    """doc_id, sentence_ids and licences (arrays) of every row of ``docs``."""
    missed = [s for s in sentences if not any(g in s for g in gate)]
    if missed:
        raise ValueError(f"sentences that the gate would miss: {missed}")
    may = lambda low: F.greatest(F.lit(False), *[F.coalesce(F.contains(low, F.lit(g)), F.lit(False)) for g in gate])
    text = F.when(_let(F.lower("text"), may), F.col("text")).otherwise("")
    result = lambda ids: F.struct(ids.alias("sentence_ids"), match(ids, rules).alias("licences"))
    found = _let(identifiers(text, sentences), result)
    return docs.select("doc_id", F.inline(F.array(found)))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.size("sentence_ids").cast("bigint").alias("n_sentences"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({n}, {_quoted(name)}, {_quoted('|' + ''.join(f'{i}||' for i in ids)[:-1])})" for n, (name, ids) in enumerate(RULES, 1))
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(n, licence, ids) AS (VALUES {rules}),
texts AS (
  SELECT doc_id, 0 AS reading, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, 1, regexp_replace(coalesce(text, ''), '([^\n])\n([^\n])', '\1 \2', 'g') FROM documents),
cut AS (
  SELECT doc_id, reading, string_split(regexp_replace(t, '([.;:!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS ss FROM texts),
s AS (
  SELECT doc_id, reading, unnest(ss) AS sentence, unnest(generate_series(1, len(ss))) AS i FROM cut),
hits AS (
  SELECT doc_id, reading, i, id FROM s JOIN known
  ON known.sentence = regexp_replace(regexp_replace(lower(s.sentence), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g')),
seqs AS (
  SELECT doc_id, reading, list(id ORDER BY i) AS ids FROM hits GROUP BY doc_id, reading),
best AS (
  SELECT d.doc_id, coalesce(arg_max(q.ids, len(q.ids) * 2 - q.reading), []) AS ids FROM documents d LEFT JOIN seqs q USING (doc_id) GROUP BY d.doc_id),
fold AS (
  SELECT doc_id, ids, 0 AS n, CASE WHEN len(ids) = 0 THEN '||' ELSE '|' || array_to_string(list_transform(ids, lambda x: x || '|'), '|') || '|' END AS rest, []::VARCHAR[] AS found FROM best
  UNION ALL
  SELECT doc_id, f.ids, r.n, CASE WHEN contains(rest, r.ids) THEN replace(rest, r.ids, '#') ELSE rest END,
         CASE WHEN contains(rest, r.ids) AND NOT list_contains(found, licence) THEN list_append(found, licence) ELSE found END
  FROM fold f JOIN rules r ON r.n = f.n + 1)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licences, len(ids)::BIGINT AS n_sentences
FROM fold WHERE n = {len(RULES)}
"""


ORACLE = _oracle()
