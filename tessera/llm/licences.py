"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, which are normalised to lower-case letters and digits with single blanks and looked up
among known licence sentences; of references ("licensed under ...", "License: ...", SPDX tags) the names are. What remains is a short sequence of identifiers. Ordered rules are matched against it:
the first rules need the most sentences, a rule puts a mark in place of the identifiers it has matched, so that what
stood on both sides doesn't become a sequence, and what no rule takes is reported. References to a licence that the
catalogue doesn't know are reported too. Sentences may end at line ends or run over them: a stretch between ends of sentences and blank
lines that is known as a whole is one sentence, and of any other stretch each line is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import shielded
from tessera.llm.licence_texts import catalogue

# Identifier and normalised wording of the sentences that the SQL knows, which stays as it is.
SQL_SENTENCES = {
    "ApacheRef": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "ApacheUse": ("you may not use this file except in compliance with the license",),
    "ApacheCopy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "ApacheAsIs": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "Gpl3Ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "Gpl3Later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "Gpl2Later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "GplHope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "GplSee": ("see the gnu general public license for more details",),
    "MitRef": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "MitGrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitAsIs": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "BsdForms": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "CcByNcRef": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CcByRef": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "Reserved": ("all rights reserved",),
}
# Licence and the sequence of identifiers that it takes, in order of trial.
SQL_RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("Gpl3Later", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2Later", "GplHope", "GplSee")),
    ("MIT", ("MitGrant", "MitAsIs")),
    ("BSD", ("BsdForms", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitGrant",)),
    ("BSD", ("BsdForms",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("All-rights-reserved", ("Reserved",)),
)

BLANK = r"[\x20\x09-\x0D]"
END = rf"([.!?]){BLANK}+|\n[^a-z0-9\n]*\n"  # of a sentence, or a line without letters and digits
# A word of every sentence that can be known; other pieces are not looked up.
CUE = r"licen|under|subject|reserved|permission|redistribut|warrant|software|contributors|copyright|anyone|\bmpl\b|\bcc0\b"
_SUBJECT = r"(?:(?:this|the|all|our|it|these)(?: (?!not |no |never |neither )[a-z0-9]+){0,4} (?:is|are) |(?:code|content|text|documentation|software|source) )?"
REFERENCE = (
    r"^(?:(?:except where|unless) (?:otherwise )?(?:noted|stated) )?(?:(?:spdx )?licen[sc]e(?: identifier)?|"
    + _SUBJECT
    + r"(?:dual |also |freely )?(?:licen[sc]ed|released|distributed|published|provided|made available|available|subject)(?: to you)? (?:under|to)) (.+)$"
)
# Pattern and what takes its place, in a normalised reference, in this order.
PLAIN = (
    (r" or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?: at your option)?(?= |$)", " orlater"),
    (r" (?:see|in) (?:the )?(?:accompanying )?(?:licen[sc]e|copying|file|readme|root)(?: .*)?$| at your option$", ""),
    (r"\b(?:terms and conditions|terms|conditions|the|of|either|both|licen[sc]es?|a|an|only|international|unported|generic)\b", " "),
    (r"(?:\bversion ?|\bv ?|(?<=gpl)v)(?=[0-9])", ""),
    (r" +", " "),
    (r"([0-9]) 0(?= |$)", "$1"),
)

TAKEN = "|#|"  # in place of identifiers that a rule has taken

SENTENCES, RULES, NAMES = catalogue(SQL_SENTENCES, SQL_RULES)
KNOWN = {wording: name for name, wordings in SENTENCES.items() for wording in wordings}


def _map(known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))


def _let(value: Column, then) -> Column:
    """then(value), which may use it more than once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _plain(reference: Column) -> Column:
    for pattern, to in PLAIN:
        reference = F.regexp_replace(reference, pattern, to)
    return F.trim(reference)


def _named(sentence: Column, whole: bool) -> Column:
    """array<string> of the identifiers of what a reference names; whole: only if all names are known."""
    terms = F.filter(F.transform(F.split(_plain(F.regexp_extract(sentence, REFERENCE, 1)), r"(?:^| )(?:and|or|with)(?= |$)"), lambda x: F.trim(x)), lambda x: x != "")

    def looked_up(t: Column) -> Column:
        found = F.filter(F.transform(t, lambda x: F.element_at(_map(NAMES), x)), lambda x: x.isNotNull())
        return _let(found, lambda x: F.when(F.size(x) == F.size(t), x).otherwise(F.array().cast("array<string>"))) if whole else found

    return F.when(sentence.rlike(REFERENCE), _let(terms, looked_up)).otherwise(F.array().cast("array<string>"))


def _known(piece: Column, whole: bool) -> Column:
    """array<string> of the identifiers of a lower-case piece of text, empty for an unknown one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(piece, r"([0-9])\+", "$1 or later"), "[^a-z0-9]+", " "))

    def looked_up(sentence: Column) -> Column:
        wording = F.regexp_replace(sentence, r"^(?:[a-z0-9]+ ){1,4}is (free software you can|distributed in the hope)", "this program is $1")
        return _let(F.element_at(_map(KNOWN), wording), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(_named(sentence, whole)))

    return F.when(piece.rlike(CUE), _let(plain, looked_up)).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    """Stretches of a lower-case text between ends of sentences and blank lines."""
    return F.split(F.regexp_replace(F.lower(text), END, "$1\u0001"), "\u0001")


def _sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in its order.

    No piece of a line reaches over the end of a stretch, so that every sentence of either cut has its place.
    """
    none = F.array().cast("array<string>")

    def either(piece: Column) -> Column:
        lines = F.flatten(F.transform(F.split(piece, "\n"), lambda line: _known(line, False)))
        return F.when(piece.rlike(CUE), _let(_known(piece, True), lambda x: F.when(F.size(x) > 0, x).otherwise(lines))).otherwise(none)

    return F.when(text.rlike(f"(?i:{CUE})"), F.flatten(F.transform(_pieces(text), either))).otherwise(none)


def _unknown(text: Column) -> Column:
    """What references to licences name, where none of it is known."""
    none = F.array().cast("array<string>")

    def of(sentence: Column) -> Column:
        plain = F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
        named = F.regexp_extract(plain, REFERENCE, 1)
        strange = sentence.rlike(r"licen[sc]e|spdx") & plain.rlike(REFERENCE) & (F.size(F.split(named, " ")) <= 12) & (F.size(_known(sentence, False)) == 0)
        return F.when(strange, F.array(named)).otherwise(none)

    lines = F.flatten(F.transform(_pieces(text), lambda p: F.when(p.rlike(CUE), F.split(p, "\n")).otherwise(none)))
    return F.when(text.rlike(r"(?i:licen[sc]e|spdx)"), F.flatten(F.transform(lines, of))).otherwise(none)


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `sentences` (identifiers in the order of the text), `licences` (in the order of the rules, each once),
    `left` (identifiers that no rule took) and `unknown` (names in references to licences, none of them known), all
    array<string>.

    A null or empty text has empty arrays. Columns of these names are replaced, all others stay, whatever their names;
    every row is judged by itself, so repeated rows repeat their result.
    """
    added = ("sentences", "licences", "left", "unknown")
    inside, restored = shielded(df.drop(*added), text)
    body = F.coalesce(F.col(text), F.lit(""))
    out = inside.withColumns({"sentences": _sentences(body), "unknown": _unknown(body)})
    # identifiers between bars, each with a bar of its own on both sides, so that a rule can't match parts of names
    out = out.withColumn("__seq", F.concat(F.lit("|"), F.array_join("sentences", "||"), F.lit("|"))).withColumn("__found", F.array().cast("array<string>"))
    state = F.struct(F.col("__seq").alias("seq"), F.col("__found").alias("found"))
    rules = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"|{s}|" for s in rule)).alias("run")) for licence, rule in RULES))
    taken = F.aggregate(
        rules,
        state,
        lambda s, r: F.when(s["seq"].contains(r["run"]), F.struct(F.replace(s["seq"], r["run"], F.lit(TAKEN)).alias("seq"), F.array_append(s["found"], r["licence"]).alias("found"))).otherwise(s),
    )
    out = out.withColumn("__taken", F.when(F.size("sentences") > 0, taken))
    rest = F.filter(F.split("__taken.seq", r"\|+"), lambda x: ~x.isin("", "#"))
    none = F.array().cast("array<string>")
    return restored(out.withColumns({"licences": F.array_distinct(F.coalesce("__taken.found", none)), "left": F.coalesce(rest, none)}), *added)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the known sentences, the licences and what no rule took of all documents, joined by commas."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licences(docs)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), *(F.array_join(c, ",").alias(c) for c in ("sentences", "licences", "left")))


def _sql() -> str:
    def known(text: str) -> str:
        names = ", ".join(f"'{w}': '{n}'" for n, wordings in SQL_SENTENCES.items() for w in wordings)
        return f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: map_extract_value(MAP {{{names}}}, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))), lambda x: x IS NOT NULL)"

    steps = ["s0 AS (SELECT doc_id, sentences, CASE WHEN len(sentences) > 0 THEN concat('|', array_to_string(sentences, '||'), '|') ELSE '' END AS seq, CAST([] AS VARCHAR[]) AS found FROM cut)"]
    for k, (licence, rule) in enumerate(SQL_RULES):
        run = "".join(f"|{s}|" for s in rule)
        steps.append(f"s{k + 1} AS (SELECT doc_id, sentences, replace(seq, '{run}', '{TAKEN}') AS seq, CASE WHEN contains(seq, '{run}') AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END AS found FROM s{k})")
    return f"""
WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), both_ways AS (
  SELECT doc_id, {known(f"regexp_replace(t, '([.!?]){BLANK}+', '\\1' || chr(10), 'g')")} AS lines,
    {known(f"translate(regexp_replace(regexp_replace(t, '([.!?]){BLANK}+|\\n\\n+', '\\1' || chr(1), 'g'), '\\n', ' ', 'g'), chr(1), chr(10))")} AS runs FROM low
), cut AS (
  SELECT doc_id, CASE WHEN len(runs) > len(lines) THEN runs ELSE lines END AS sentences FROM both_ways
), {", ".join(steps)}
SELECT doc_id, CAST(len(sentences) AS BIGINT) AS n_sentences, array_to_string(sentences, ',') AS sentences, array_to_string(found, ',') AS licences,
  array_to_string(list_filter(string_split(seq, '|'), lambda x: x NOT IN ('', '#')), ',') AS "left" FROM s{len(SQL_RULES)}
"""


OP6_SQL = _sql()
