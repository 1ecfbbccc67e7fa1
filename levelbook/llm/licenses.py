"""Licence scan by sentence rules, in DataFrame functions only.

Texts are cut into sentences, sentences normalised to lower-case letters and digits with
single spaces, and looked up in a table of known licence sentences. What is left of a
document is a sequence of sentence identifiers, which is compared with ordered rules: a rule
names a licence and the identifiers that have to follow each other. Rules are tried in order;
a rule that is part of a longer one that already matched adds nothing.

A sentence may be wrapped over several lines, and a notice may stand on a line of its own without
a mark at its end. So what stands between two sentence ends (or blank lines) is looked up as a whole, else by
its last lines, the longest known run of them; the lines before that are looked up one by one, and all that is known counts, in
the order of the text.

Defined cases: NULL and empty texts have no sentences and no licence; repeated rows are
scanned each for itself; NULL ids stay; an empty table gives an empty result; other columns
are ignored; a sentence that occurs twice gives its identifier twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, as they are written.
SENTENCES: dict[str, str] = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License "
    'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mit-short": "Released under the MIT License.",
    "mit-name": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "This work has been dedicated to the public domain.",
    "reserved": "All rights reserved.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
    "the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
    "third-parties to whom the Software is furnished to do so, all subject to the following:",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
    "your option) any later version.",
    "lgpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
}


# Identifiers of public licences and their names.
NAMES: dict[str, str] = {
    "0BSD": "BSD Zero Clause License",
    "AFL-3.0": "Academic Free License v3.0",
    "AGPL-3.0-only": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-2.0": "Artistic License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License 1.0",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 Unported License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal License",
    "CDDL-1.0": "Common Development and Distribution License 1.0",
    "ECL-2.0": "Educational Community License, Version 2.0",
    "EPL-1.0": "Eclipse Public License 1.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "EUPL-1.2": "European Union Public License 1.2",
    "GFDL-1.3-only": "GNU Free Documentation License, version 1.3",
    "GPL-2.0-only": "GNU General Public License, version 2",
    "GPL-3.0-only": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-2.1-only": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-only": "GNU Lesser General Public License, version 3",
    "LPPL-1.3c": "LaTeX Project Public License v1.3c",
    "MIT": "MIT License",
    "MIT-0": "MIT No Attribution License",
    "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0",
    "MS-PL": "Microsoft Public License",
    "MulanPSL-2.0": "Mulan Permissive Software License, Version 2",
    "NCSA": "University of Illinois/NCSA Open Source License",
    "ODbL-1.0": "Open Database License v1.0",
    "OFL-1.1": "SIL Open Font License 1.1",
    "OSL-3.0": "Open Software License 3.0",
    "PostgreSQL": "PostgreSQL License",
    "PSF-2.0": "Python Software Foundation License 2.0",
    "Unlicense": "Unlicense",
    "UPL-1.0": "Universal Permissive License v1.0",
    "Vim": "Vim License",
    "WTFPL": "Do What The F*ck You Want To Public License",
    "Zlib": "zlib License",
}
# How a notice names its licence, by identifier of the form.
FORMS: dict[str, str] = {
    "licensed": "Licensed under the {}.",
    "released": "Released under the {}.",
    "work": "This work is licensed under the {}.",
    "project": "This project is licensed under the {}.",
}
def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


@dataclass(frozen=True)
class Rule:
    """Sentences that follow each other, with no other known sentence between, name a licence."""

    licence: str
    sentences: tuple[str, ...]


#: Longer rules of a licence stand before shorter ones that they contain.
RULES = (
    Rule("Apache-2.0", ("apache-notice", "apache-may-not", "apache-copy", "apache-unless")),
    Rule("Apache-2.0", ("apache-notice", "apache-may-not")),
    Rule("Apache-2.0", ("apache-short",)),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    Rule("GPL-3.0-or-later", ("gpl-free",)),
    Rule("GPL-3.0-only", ("gpl3-short",)),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("MIT", ("mit-grant",)),
    Rule("MIT", ("mit-short",)),
    Rule("MIT", ("mit-name",)),
    Rule("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-redistribution",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    Rule("CC-BY-4.0", ("cc-by-short",)),
    Rule("CC-BY-4.0", ("cc-by-long",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("Proprietary", ("reserved",)),
    Rule("MPL-2.0", ("mpl-subject",)),
    Rule("ISC", ("isc-permission",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("BSL-1.0", ("boost-permission",)),
    Rule("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    Rule("GPL-2.0-or-later", ("gpl2-free",)),
    Rule("LGPL-3.0-or-later", ("lgpl-free",)),
    Rule("AGPL-3.0-or-later", ("agpl-free",)),
)


ID_KEY = "-id"


def _named() -> tuple[dict[str, str], tuple[Rule, ...]]:
    """The sentences of all names in all forms, and an identifier after the tag of a source file."""
    known = {normal(s) for s in SENTENCES.values()}
    sentences, rules = {"spdx": "SPDX-License-Identifier:"}, []
    for licence, name in NAMES.items():
        for form, text in FORMS.items():
            key = f"{licence}-{form}".lower()
            if normal(text.format(name)) not in known:
                sentences[key] = text.format(name)
                rules.append(Rule(licence, (key,)))
        sentences[licence.lower() + ID_KEY] = licence
        rules.append(Rule(licence, ("spdx", licence.lower() + ID_KEY)))
    return sentences, tuple(rules)


_SENTENCES_OF_NAMES, _RULES_OF_NAMES = _named()
SENTENCES |= _SENTENCES_OF_NAMES
RULES += _RULES_OF_NAMES

# Every known sentence but an identifier holds one of these, so other texts need not be cut into sentences.
# They are single words, as any space, line end or mark may stand between two.
HINTS = r"(?i)licen[cs]e|permission|permitted|redistribut|software|domain|reserved|distributed"
SENTENCE_END = r"([.!?;:])[ \t\r]+"



def _parts(key: str) -> dict[str, str]:
    """The sentences that the cutting of texts makes of one entry of ``SENTENCES``: their
    identifiers (the entry's, numbered from the second part on) and normalised forms."""
    found = [normal(x) for x in re.sub(SENTENCE_END, r"\1\n", SENTENCES[key]).split("\n")]
    return {key if i == 0 else f"{key}-{i + 1}": part for i, part in enumerate(x for x in found if x)}


def parts_of(rule: Rule) -> tuple[str, ...]:
    """The sentences of ``rule`` as texts are cut."""
    return tuple(_table()[part] for key in rule.sentences for part in _parts(key).values())


def _table() -> dict[str, str]:
    """Identifiers by normalised sentence. What several entries begin with has the identifier of the first."""
    found: dict[str, str] = {}
    for entry in SENTENCES:
        for key, sentence in _parts(entry).items():
            found.setdefault(sentence, key)
    return found


#: No known sentence has more words, hence more lines.
MOST_LINES = max(len(sentence.split()) for sentence in _table())
_BREAK = "\x01"


def sentence_ids(text: Column) -> Column:
    """The known sentences of a text by identifier, in order; empty where there are none."""
    table = F.create_map(*[F.lit(x) for pair in _table().items() for x in pair])
    cut = F.regexp_replace(F.regexp_replace(text, r"\n[ \t\r]*\n", _BREAK), r"([.!?;:])[ \t\r\n]+", f"$1{_BREAK}")
    flat = F.regexp_replace(F.lower(cut), f"[^a-z0-9\n{_BREAK}]+", " ")

    def lines(sentence: Column) -> Column:
        return F.filter(F.transform(F.split(sentence, "\n"), lambda line: F.trim(line)), lambda line: line != "")

    def known(own: Column) -> Column:
        n = F.size(own)
        runs = F.filter(
            F.transform(
                F.sequence(F.least(n, F.lit(MOST_LINES)), F.lit(1), F.lit(-1)),
                lambda k: F.struct(k.alias("k"), table[F.array_join(F.slice(own, -k, k), " ")].alias("key")),
            ),
            lambda run: run["key"].isNotNull(),
        )
        return F.flatten(F.transform(F.array(F.struct(F.get(runs, F.lit(0)).alias("run"))), lambda x: F.concat(
            F.transform(F.slice(own, 1, n - F.coalesce(x["run"]["k"], F.lit(0))), lambda line: table[line]),
            F.array(x["run"]["key"]),
        )))

    sentences = F.filter(F.transform(F.split(flat, _BREAK), lines), lambda own: F.size(own) > 0)
    found = F.array_compact(F.flatten(F.transform(sentences, known)))
    # An identifier alone is a word like others; it counts after the tag.
    tagged = F.transform(F.array(F.struct(found.alias("keys"))), lambda x: F.filter(
        x["keys"], lambda key, i: ~key.endswith(ID_KEY) | F.coalesce(F.get(x["keys"], i - 1) == "spdx", F.lit(False))
    ))[0]
    return F.when(text.rlike(HINTS), tagged).otherwise(F.array().cast("array<string>"))


def _inside(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    n = len(short)
    return n < len(long) and any(long[i:i + n] == short for i in range(len(long) - n + 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``sentence_ids``, ``licences`` (in the order of the rules, each once),
    ``first_licence`` and ``n_sentences``, one row per document. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text).alias("sentence_ids"))
    sequence = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))

    def matched(rule: Rule) -> Column:
        return sequence.contains("  ".join(parts_of(rule)).join("  "))

    names = []
    for rule in RULES:
        hit = matched(rule)
        for longer in RULES:
            if longer.licence != rule.licence and _inside(rule.sentences, longer.sentences):
                hit = hit & ~matched(longer)
        names.append(F.when(hit, F.lit(rule.licence)))
    licences = F.array_distinct(F.array_compact(F.array(*names)))
    return found.select("doc_id", "sentence_ids", licences.alias("licences")).select(
        "doc_id",
        "sentence_ids",
        "licences",
        F.get("licences", F.lit(0)).alias("first_licence"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
    )


def oracle(table: str = "documents") -> str:
    """The scan as DuckDB SQL, with the lists joined to texts (see the query ``op10``)."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = " ".join(f"WHEN {quoted(sentence)} THEN {quoted(key)}" for sentence, key in _table().items())

    def look(sentence: str) -> str:
        return f"CASE {sentence} {known} END"

    cut = (f"regexp_replace(regexp_replace(text, '\\n[ \\t\\r]*\\n', chr(1), 'g'), "
           f"'([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g')")
    flat = f"regexp_replace(lower({cut}), '[^a-z0-9\\n\\x01]+', ' ', 'g')"

    def has(rule: Rule) -> str:
        return f"contains(sequence, {quoted('  '.join(parts_of(rule)).join('  '))})"

    names = []
    for rule in RULES:
        hit = has(rule)
        for longer in RULES:
            if longer.licence != rule.licence and _inside(rule.sentences, longer.sentences):
                hit += f" AND NOT {has(longer)}"
        names.append(f"CASE WHEN {hit} THEN {quoted(rule.licence)} END")
    distinct = f"list_filter([{', '.join(names)}], lambda x, i: x IS NOT NULL)"
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
        sentences AS (
            SELECT r, n, list_filter(list_transform(string_split(s, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS lines
            FROM (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS n
                  FROM (SELECT r, string_split({flat}, chr(1)) AS parts FROM texts))),
        tails AS (
            SELECT r, n, k, {look("array_to_string(lines[len(lines) - k + 1:], ' ')")} AS key
            FROM (SELECT *, unnest(range(1, least(len(lines), {MOST_LINES}) + 1)) AS k FROM sentences)),
        longest AS (SELECT r, n, max(k) AS k, arg_max(key, k) AS key FROM tails WHERE key IS NOT NULL GROUP BY r, n),
        hits AS (
            SELECT r, n, i, {look("lines[i]")} AS key
            FROM (SELECT r, n, lines, unnest(range(1, len(lines) - coalesce(k, 0) + 1)) AS i
                  FROM sentences LEFT JOIN longest USING (r, n))
            UNION ALL SELECT r, n, 1000000000, key FROM longest),
        found AS (
            SELECT any_value(doc_id) AS doc_id, coalesce(list(key ORDER BY n, i) FILTER (WHERE key IS NOT NULL), []) AS keys
            FROM texts LEFT JOIN hits USING (r) GROUP BY r),
        chosen AS (
            SELECT doc_id, list_filter(keys, lambda k, i: NOT ends_with(k, '{ID_KEY}') OR (i > 1 AND keys[i - 1] = 'spdx')) AS ids
            FROM found),
        sequences AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS sequence FROM chosen),
        named AS (SELECT doc_id, ids, {distinct} AS names FROM sequences),
        once AS (SELECT doc_id, ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM named)
        SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
               coalesce(array_to_string(names, ' '), '') AS licences,
               names[1] AS first_licence, CAST(len(ids) AS BIGINT) AS n_sentences
        FROM once"""
