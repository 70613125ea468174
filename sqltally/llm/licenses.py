"""Licence scan by sentence rules, with built-in functions only.

A text is cut into sentences, each sentence is normalised (ASCII letters in
lower case, everything else but digits a space) and looked up in a table of
known licence sentences.  The identifiers found, in text order, form a
sequence; ordered rules are matched against it, the most specific first.  A
rule takes the identifiers it matches, so a later rule cannot use them again.

No shuffle: every document is handled in its own row, whole.

Defined results: a null or empty text has no sentences and no licences; the
same sentence twice counts twice; unknown sentences are passed over, so a rule
may match across them; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.common import col, text_of

# Known licence sentences as public licences print them, by
# identifier.  They are normalised by ``normalise`` before use.
SENTENCES = {
    "mit-line": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions"),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software"),
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version"),
    "gpl2-free": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version"),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-copy": (
        "You should have received a copy of the GNU General Public License along with this program"),
    "apache2-line": "Licensed under the Apache License, Version 2.0",
    "apache2-grant": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License"),
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-nc-4-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4-line": "Licensed under CC BY 4.0",
    "cc-by-sa-4-line": "Licensed under CC BY-SA 4.0",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer"),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution"),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-line": "Released under CC0 1.0",
    "public-domain": "This work is in the public domain",
    "all-rights": "All rights reserved",
}

# The ordered rules.  Each names a licence and the sentence
# identifiers that must follow one another in the sequence of known sentences.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0", ["gpl3-line"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-line"]),
    ("CC-BY-4.0", ["cc-by-4-line"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-line"]),
    ("Public-Domain", ["public-domain"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sentence ends at closing marks before white space, before a numbered item, at
# an empty line, and at a line end before a capitalised word; other line ends are
# wrapped lines.
END_MARKS = r"[.!?]+[ \t\r\n]+"
LIST_ITEM = r"\r?\n[ \t]*[0-9]+[.)][ \t]+"
EMPTY_LINE = r"\r?\n[ \t]*\r?\n"
NEW_LINE_WORD = r"\r?\n([A-Z][a-z])"
NOT_WORD = "[^a-z0-9\u0001]+"


def normalise(sentence: str) -> str:
    """The normalised form of one known sentence (driver side, table set-up)."""
    low = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in sentence)
    return " ".join("".join(c if c in LOWER or c in "0123456789" else " " for c in low).split())


def known() -> list[tuple[str, str]]:
    """(normalised sentence, identifier), each sentence once."""
    return list({normalise(s): k for k, s in SENTENCES.items()}.items())


def sentences(text: Column) -> Column:
    """array<string>: the normalised sentences of a text, in order."""
    cut = F.regexp_replace(F.regexp_replace(text, LIST_ITEM, "\u0001"), END_MARKS, "\u0001")
    cut = F.regexp_replace(cut, EMPTY_LINE, "\u0001")
    cut = F.regexp_replace(cut, NEW_LINE_WORD, "\u0001$1")
    words = F.regexp_replace(F.translate(cut, UPPER, LOWER), NOT_WORD, " ")
    return F.transform(F.split(words, "\u0001"), lambda s: F.trim(s))


def identifiers(text: Column) -> Column:
    """array<string>: identifiers of the known sentences, in text order."""
    table = known()
    texts = F.array(*[F.lit(s) for s, _ in table])
    names = F.array(*[F.lit(k) for _, k in table])
    hits = F.filter(sentences(text), lambda s: F.array_contains(texts, s))
    return F.transform(hits, lambda s: F.element_at(names, F.array_position(texts, s).cast("int")))


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def match_rules(ids: Column) -> Column:
    """array<string>: a licence for each match of a rule, in rule order."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(_pattern(seq)).alias("seq"))
                      for name, seq in RULES])
    start = F.struct(
        F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"),
        F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        left = F.replace(acc["left"], rule["seq"], F.lit("#"))
        n = ((F.length(acc["left"]) - F.length(left)) / (F.length(rule["seq"]) - 1)).cast("int")
        return F.struct(left.alias("left"),
                        F.concat(acc["found"], F.array_repeat(rule["licence"], n)).alias("found"))

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(
        F.aggregate(rules, start, step, lambda acc: acc["found"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids array<string>, licences array<string>) per row of ``docs``."""
    ids = docs.select(col(id_col), identifiers(text_of(text_col)).alias("sentence_ids"))
    return ids.select(col(id_col), "sentence_ids", match_rules(F.col("sentence_ids")).alias("licences"))


def query(docs: DataFrame) -> DataFrame:
    s = scan(docs)
    return s.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_known"),
                    F.array_join("sentence_ids", ",").alias("sentence_ids"),
                    F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"),
                    F.size("licences").cast("bigint").alias("n_matches"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB twin of ``query``: the same steps, one CTE for each rule."""
    table = known()
    pairs = ", ".join(f"({_quote(s)}, {_quote(k)})" for s, k in table)
    steps, prev = [], "seq"
    for i, (name, ids) in enumerate(RULES):
        p = _quote(_pattern(ids))
        steps.append(
            f"r{i} AS (SELECT row, doc_id, ids, replace(lft, {p}, '#') AS lft, list_concat(found, list_transform("
            f"range((length(lft) - length(replace(lft, {p}, '#'))) // {len(_pattern(ids)) - 1}), "
            f"lambda x: {_quote(name)})) AS found FROM {prev})")
        prev = f"r{i}"
    return f"""
WITH known(sentence, id) AS (VALUES {pairs}),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT row, doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '{LIST_ITEM}', chr(1), 'g'), '{END_MARKS}', chr(1), 'g'),
    '{EMPTY_LINE}', chr(1), 'g'), '{NEW_LINE_WORD}', chr(1) || '\\1', 'g') AS text FROM docs),
words AS (SELECT row, doc_id, string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'),
    '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1)) AS parts FROM cut),
parts AS (SELECT row, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM words),
hits AS (SELECT row, list(id ORDER BY pos) AS ids FROM parts JOIN known ON trim(part, ' ') = sentence GROUP BY row),
seq AS (SELECT row, doc_id, coalesce(ids, []) AS ids,
    coalesce(list_aggregate(list_transform(ids, lambda i: '<' || i || '>'), 'string_agg', ''), '') AS lft,
    []::VARCHAR[] AS found FROM docs LEFT JOIN hits USING (row)),
{', '.join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids,
    array_to_string(list_sort(list_distinct(found)), ',') AS licences, len(found)::BIGINT AS n_matches FROM {prev}
"""
