"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into pieces, each normalised to lower-case ASCII letters and
digits with single spaces.  Full stops, question marks and blank lines (comment marks alone are one) end a
sentence; a line break, colon or semicolon ends a piece, and pieces that follow one another
can be one sentence, so wrapped texts behind comment marks are read, and notices of one line as well.
Where several begin, the longest is taken.  Sentences that are known become identifiers, and the
sequence of a document's identifiers is matched, left to right, against ordered
rules: at a place the first rule that fits wins and takes its identifiers.

Defined cases: null and empty texts have no sentence and no licence; identifiers
that no rule takes are reported as ``partial``; a licence that occurs again is
listed again; very long texts without an anchor word are not cut at all; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of well-known licences, normalised.  One key may have several spellings.
SENTENCES = {
    "gpl3-notice": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl2-notice": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "agpl3-notice": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "ccbync4-notice": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "ccby4-notice": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "ccbysa4-notice": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "cc0-notice": ("released under cc0 1 0", "licensed under cc0 1 0"),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "apache2-notice": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "bsd3-notice": ("released under the bsd 3 clause license", "licensed under the bsd 3 clause license"),
    "mpl2-notice": ("licensed under the mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "mit-title": ("mit license", "the mit license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    "apache2-file": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "gpl3-file": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl2-file": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 2 of the license or at your option any later version",
    ),
    "spdx-mit": ("spdx license identifier mit",),
    "spdx-apache2": ("spdx license identifier apache 2 0",),
    "spdx-gpl3": ("spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
}

# Ordered rules: longer texts before the notices that begin like them.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-notice", "apache2-file", "apache2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-file")),
    ("GPL-3.0-or-later", ("gpl3-file",)),
    ("GPL-2.0-or-later", ("gpl2-file",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
)

# A sentence ends at a line break, or at a full stop, question mark, colon or semicolon with any marks after it, before a space.
SENTENCE_END = r"\n|[.?:;][^A-Za-z0-9\s]*(?:\s|$)"
# The same in two kinds, marked with letters that a lower-cased text does not have: what no sentence goes across, and what one may.
HARD_END = r"[.?][^A-Za-z0-9\s]*(?:\s|$)|\n(?=[^a-z0-9\n]*\n)"
SOFT_END = r"\n|[:;][^A-Za-z0-9\s]*(?:\s|$)"
# Every known sentence holds one of these.
ANCHOR = "licen|permission|software|redistribution|cc0"


def _names(sentences: dict) -> dict[str, str]:
    return {text: name for name, texts in sentences.items() for text in texts}


def sentence_ids(text: Column, sentences: dict = SENTENCES, anchor: str = ANCHOR) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = _names(sentences)
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    low = F.lower(text)
    marked = F.regexp_replace(F.regexp_replace(low, HARD_END, " H "), SOFT_END, " S ")
    normal = F.regexp_replace(F.concat(F.lit("H "), marked, F.lit(" H")), "[^a-z0-9HS]+", " ")
    longest = sorted(known, key=len, reverse=True)
    pattern = "(?<=[HS] )(" + "|".join(x.replace(" ", " (?:S )*+") for x in longest) + ")(?= [HS])"
    ids = F.transform(F.regexp_extract_all(normal, F.lit(pattern), F.lit(1)), lambda s: F.element_at(lookup, F.regexp_replace(s, " S(?= )", "")))
    return F.when(low.rlike(anchor), ids).otherwise(F.array().cast("array<string>"))


def _sequence(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict = SENTENCES, rules=RULES, anchor: str = ANCHOR) -> DataFrame:
    """id_col, sentence_ids, licenses (as matched, in order), status (none, partial, matched).

    ``partial`` is a document with known sentences that no rule took.
    """
    rule_of = {_sequence(ids): licence for licence, ids in rules}
    pattern = "(" + "|".join(rule_of) + ")"
    lookup = F.create_map(*[F.lit(x) for pair in rule_of.items() for x in pair])
    # One element to explode, so that the cutting is done once and not again for every column made of it.
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.array(sentence_ids(F.col(text_col), sentences, anchor))).alias("ids"))
    sequence = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    matched = F.regexp_extract_all(sequence, F.lit(pattern), F.lit(1))
    rest = F.length(F.regexp_replace(sequence, pattern, "")) > F.when(F.size("ids") == 0, 2).otherwise(0)
    return found.select(
        F.col("id").alias(id_col),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.transform(matched, lambda m: F.element_at(lookup, m)), ",").alias("licenses"),
        F.when(F.coalesce(F.size("ids"), F.lit(0)) == 0, "none").when(rest, "partial").otherwise("matched").alias("status"),
    )
