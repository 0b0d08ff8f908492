"""Licence recognition by sentences, with DataFrame functions alone.

A text is normalised (ASCII letters in lower case, other signs to blanks) and
cut into sentences at punctuation and blank lines; single line ends are soft,
and the signs that lead comment lines are blanks.  A known sentence becomes its
identifier, wherever in a sentence of the text it stands as whole words; of
several that start at one word the longest counts.  A sentence that starts with
"copyright" becomes ``Copyright``, and a line inside one if a sign or year follows.  The sequence of identifiers is
then matched against ordered rules: an earlier rule takes its identifiers, so
that a more specific licence is named before a more general one.  Identifiers
of a rule must follow each other among the known sentences of the text;
sentences that are not known may stand between them.

Everything happens inside a row: nothing shuffles.  The tables are parameters
of small size (they become part of the plan).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import texts

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "you may not use this file except in compliance with the license": "Compliance",
    "you may obtain a copy of the license at": "ObtainCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "AsIsBasis",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "either version 3 of the license or at your option any later version": "OrLater",
    "or at your option any later version": "OrLater",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByRef",
    "this work is dedicated to the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}

# The notices of the GNU licences, as they are worded in the licences themselves.
NOTICES = {
    f"gnu {name} public license {words} version {version} of the license": f"{identifier}{version}Ref"
    for name, identifier, versions in (("general", "Gpl", (2, 3)), ("lesser general", "Lgpl", (3,)), ("affero general", "Agpl", (3,)))
    for version in versions
    for words in ("as published by the free software foundation either", "as published by the free software foundation")
}

# Licence names and the sentence identifiers that say so, the more specific first.
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-2.0", ("Apache2Ref", "Compliance", "ObtainCopy", "AsIsBasis")),
    ("BSD-3-Clause", ("BsdGrant", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant",)),
    ("GPL-3.0-or-later", ("Gpl3Ref", "OrLater")),
    ("GPL-2.0-or-later", ("Gpl2Ref", "OrLater")),
    ("LGPL-3.0-or-later", ("Lgpl3Ref", "OrLater")),
    ("AGPL-3.0-or-later", ("Agpl3Ref", "OrLater")),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitRef",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("Copyright", "AllRights")),
    ("All-Rights-Reserved", ("AllRights",)),
)

COPYRIGHT = "Copyright"
HARD_END = r"[.!?:;]+[ \t\r]+|[.!?:;]+\n|\n[^a-z0-9\n]*\n|[.!?:;]+$"


def normalised_sentences(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits: a blank between words, a tab at a soft line end, a new line after a sentence."""
    hard = F.regexp_replace(F.lower(text), HARD_END, "\n\n")
    soft = F.regexp_replace(hard, r"(?<!\n)\n(?!\n)", "\t")
    plain = F.regexp_replace(soft, r"[^a-z0-9\n\t]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]*\n[ \t\n]*", "\n"), r" *\t[ \t]*", "\t")


def sentence_identifiers(text: Column, sentences: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences, in the order of the text."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    longest_first = sorted(sentences, key=lambda s: (-len(s), s))
    phrases = "|".join(s.replace(" ", r"[ \t]") for s in longest_first)
    pattern = rf"(?<=^|\n) ?copyright(?=[ \t])|(?<=\t)copyright(?= (?:c|by|[0-9]{{4}}) )|(?<![a-z0-9])(?:{phrases})(?![a-z0-9])"
    found = F.regexp_extract_all(normalised_sentences(text), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.when(F.trim(s) == "copyright", F.lit(COPYRIGHT)).otherwise(F.try_element_at(known, F.translate(s, "\t", " "))))


def apply_rules(identifiers: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Licences of an identifier sequence (a string ";A;;B;"), as a comma-joined string in the order of the rules."""
    start = F.struct(identifiers.alias("left"), F.lit("").alias("found"))

    def step(state: Column, rule: tuple[str, Sequence[str]]) -> Column:
        name, sequence = rule
        needle = "".join(f";{s};" for s in sequence)
        has = F.contains(state["left"], F.lit(needle))
        named = F.contains(F.concat(F.lit(","), state["found"], F.lit(",")), F.lit(f",{name},"))
        found = F.when(has & ~named, F.when(state["found"] == "", F.lit(name)).otherwise(F.concat(state["found"], F.lit("," + name)))).otherwise(state["found"])
        return F.struct(F.replace(state["left"], F.lit(needle), F.lit("|")).alias("left"), found.alias("found"))

    # one lambda per rule: each state is computed once, whatever refers to it
    state = F.array(start)
    return reduce(lambda s, rule: F.transform(s, lambda x: step(x, rule)), rules, state)[0]["found"]


def recognise(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES | NOTICES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) per row.

    n_sentences counts the known sentences, sentence_ids lists them in order,
    blank-joined; licenses is comma-joined in the order of the rules, each
    licence once, and empty where none is recognised.  Null text counts as
    empty.  Rows of equal text get equal results, repeated rows each get a row,
    a null doc_id stays null, and an empty table gives an empty result.
    """
    first = sorted({s.split(" ", 1)[0] for s in sentences} | {"copyright"})
    # a text without the first word of any known sentence has none: most texts stop here
    hint = F.lower("text").rlike(rf"(^|[^a-z0-9])({'|'.join(first)})([^a-z0-9]|$)")
    ids = F.when(hint, sentence_identifiers(F.col("text"), sentences)).otherwise(F.array().cast("array<string>"))
    rows = texts(docs).select("doc_id", F.explode(F.array(ids)).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda s: F.concat(F.lit(";"), s, F.lit(";"))), "")
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"),
        apply_rules(joined, rules).alias("licenses"),
    )


def oracle_sql(sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> str:
    """The same result in DuckDB SQL."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sentences.items()) + "}"
    steps, left, found = [], "ids0", "''"
    for n, (name, sequence) in enumerate(rules):
        needle = "".join(f";{s};" for s in sequence)
        steps.append(
            f"s{n + 1} AS (SELECT *, replace(left{n}, '{needle}', '|') AS left{n + 1}, CASE WHEN contains(left{n}, '{needle}') "
            f"AND NOT contains(',' || found{n} || ',', ',{name},') THEN CASE WHEN found{n} = '' THEN '{name}' ELSE found{n} || ',{name}' END ELSE found{n} END AS found{n + 1} FROM s{n})"
        )
    return f"""
WITH a AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?:;]+[ \\t]+|[.!?:;]*\\r?\\n|[.!?:;]+$', chr(10), 'g'),
    '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), chr(10)) AS parts FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: CASE WHEN starts_with(trim(p), 'copyright ') THEN '{COPYRIGHT}' ELSE ({known})[trim(p)] END), lambda i: i IS NOT NULL) AS ids FROM a),
s0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: ';' || i || ';'), ''), '') AS left0, '' AS found0 FROM b),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, found{len(rules)} AS licenses FROM s{len(rules)}"""
