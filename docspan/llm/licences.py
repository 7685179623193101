"""Licence scans by sentence rules, as DataFrame operations only.

A text that can hold a licence sentence at all is laid out anew: comment marks go, the lines of a paragraph become one line, and
list items, blank lines and SPDX lines stand alone. It is then cut into sentences. A sentence is normalised and mapped to the
identifiers of all known licence sentences and names in it. The identifiers, in order, are read from the left against ordered
licence rules: the first rule that fits at a place names the licence and uses up its sentences. Sentences that stand beside any
licence (copyright lines, reservations of rights) are skipped for that, and sentences far apart never make up one licence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.quality_rules import bound

#: A few words between two parts of a sentence.
FEW = "(?: [a-z0-9.]+){0,12}? "
LATER = "(?: [a-z0-9.]+){0,8}? or (?:at your option )?any later version"
#: Identifier, rule over normalised sentences, and what every match holds in lower-case text before normalising. Where two
#: rules fit at one place, the earlier one counts. Fixed values.
SENTENCES = (
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission"),
    ("mit-notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included", "permission"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications", "permission"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribut"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice", "redistribut"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice", "redistribut"),
    ("bsd-endorse", r"neither the name" + FEW + r"(?:may|nor the names of its contributors may) be used to endorse or promote products", "endorse"),
    ("asis-warranty", r"(?:software|work|program|material) is (?:provided|distributed)(?: by(?: [a-z]+){1,6})? (?:on an )?as is", r"as[^a-z0-9]+is(?:[^a-z0-9]|$)"),
    ("liability", r"in no event shall" + FEW + r"be (?:held )?liable", "liable"),
    ("gpl3-text", r"gnu general public license version 3 29 june 2007", r"licen[cs]e"),
    ("gpl2-text", r"gnu general public license version 2 june 1991", r"licen[cs]e"),
    ("agpl3-text", r"gnu affero general public license version 3 19 november 2007", r"licen[cs]e"),
    ("lgpl3-text", r"gnu lesser general public license version 3 29 june 2007", r"licen[cs]e"),
    ("lgpl21-text", r"gnu lesser general public license version 2\.1 february 1999", r"licen[cs]e"),
    ("apache2-text", r"apache license version 2\.0 january 2004", r"licen[cs]e"),
    ("agpl3-later", r"gnu affero general public license" + FEW + "version 3" + LATER, r"licen[cs]e"),
    ("agpl3", r"gnu affero general public license(?:" + FEW + r"version 3| v ?3)\b|\bagpl ?v?(?:ersion )?3(?:\.0)?\b", r"licen[cs]e|gpl"),
    ("lgpl3-later", r"gnu lesser general public license" + FEW + "version 3" + LATER, r"licen[cs]e"),
    ("lgpl3", r"gnu lesser general public license(?:" + FEW + r"version 3| v ?3)\b|\blgpl ?v?3(?:\.0)?\b", r"licen[cs]e|gpl"),
    ("lgpl21-later", r"gnu lesser general public license" + FEW + r"version 2\.1" + LATER, r"licen[cs]e"),
    ("lgpl21", r"gnu lesser general public license(?:" + FEW + r"version 2\.1| v ?2\.1)|\blgpl ?v?2\.1\b", r"licen[cs]e|gpl"),
    ("gpl3-later", r"gnu general public license" + FEW + "version 3" + LATER, r"licen[cs]e"),
    ("gpl2-later", r"gnu general public license" + FEW + "version 2" + LATER, r"licen[cs]e"),
    ("gpl3", r"gnu general public license(?:" + FEW + r"version 3| v ?3)\b|\bgpl ?v?(?:ersion )?3(?:\.0)?\b", r"licen[cs]e|gpl"),
    ("gpl2", r"gnu general public license(?:" + FEW + r"version 2| v ?2)\b|\bgpl ?v?(?:ersion )?2(?:\.0)?\b", r"licen[cs]e|gpl"),
    ("gpl-any", r"gnu general public license", r"licen[cs]e"),
    ("later-option", r"or at your option any later version", r"any[^a-z0-9]+later[^a-z0-9]+version"),
    ("apache2", r"apache (?:software )?license(?:" + FEW + r"version 2\.0| v ?2\.0| 2\.0|" + FEW + r"version 2\b)|\bapache 2\.0 license", r"licen[cs]e"),
    ("apache-condition", r"you may not use this file except in compliance with the license", "compliance"),
    ("mpl2-exhibit", r"this source code form is subject to the terms of the mozilla public license v ?2\.0", r"licen[cs]e"),
    ("mpl2", r"mozilla public license(?:" + FEW + r"version 2\.0| v ?2\.0| 2\.0)|\bmpl ?v?2\.0\b", r"licen[cs]e|mpl[^a-z0-9]*v?[^a-z0-9]*2"),
    ("epl2", r"eclipse public license(?:" + FEW + r"version 2\.0| v ?2\.0| 2\.0)", r"licen[cs]e"),
    ("ofl11", r"(?:sil )?open font license(?:" + FEW + r"version 1\.1| v ?1\.1| 1\.1)", r"licen[cs]e"),
    ("boost", r"boost software license(?:" + FEW + r"version 1\.0| v ?1\.0| 1\.0)?", r"licen[cs]e"),
    ("odbl", r"open database license|\bodbl\b", r"licen[cs]e|odbl"),
    ("artistic2", r"artistic license(?:" + FEW + r"version 2\.0| v ?2\.0| 2\.0)", r"licen[cs]e"),
    ("wtfpl", r"do what the fuck you want to public license|\bwtfpl\b", r"licen[cs]e|wtfpl"),
    ("zlib", r"\bzlib license", r"licen[cs]e"),
    ("cc-by-nc-sa-4", r"(?:\bcc by nc sa|attribution non ?commercial share ?alike)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc-by-nc-nd-4", r"(?:\bcc by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc-by-nd-4", r"(?:\bcc by nd|attribution no ?deriv(?:ative)?s)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc-by-nc-4", r"(?:\bcc by nc|attribution non ?commercial)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc-by-sa-4", r"(?:\bcc by sa|attribution share ?alike)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc-by-4", r"(?:\bcc by|creative commons attribution)(?: version| v)? ?4\.0", r"attribution|cc[^a-z0-9]+by"),
    ("cc0", r"\bcc0\b|dedicated" + FEW + "to the public domain", r"cc0|public[^a-z0-9]+domain"),
    ("mit", r"\bmit license\b|\bmit x11 license\b|\blicense mit\b", r"licen[cs]e"),
    ("bsd3", r"\bbsd 3 clause\b|\b3 clause bsd\b|\bnew bsd license\b|\bmodified bsd license\b", "bsd"),
    ("bsd2", r"\bbsd 2 clause\b|\b2 clause bsd\b|\bsimplified bsd license\b", "bsd"),
    ("isc", r"\bisc license\b", r"licen[cs]e"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("all-rights", r"all rights reserved", "reserved"),
    ("copyright", r"^copyright\b", "copyright"),
)
UNKNOWN = "unknown"
#: Identifiers that may stand between the sentences of any licence.
BESIDE = ("all-rights", "copyright", UNKNOWN)
#: SPDX identifiers that are named in an SPDX line, and older spellings of some. Fixed values.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear",
    "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Ruby", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
SPDX_BEFORE = {
    "agpl-3.0": "AGPL-3.0-only", "agpl-3.0+": "AGPL-3.0-or-later", "gpl-2.0": "GPL-2.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only",
    "gpl-3.0+": "GPL-3.0-or-later", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0-only", "lgpl-3.0+": "LGPL-3.0-or-later",
}
SPDX_NAMES = {**{name.lower(): name for name in SPDX}, **SPDX_BEFORE}
SPDX_LINE = "spdx-license-identifier:"
SPDX_WORD = r"[a-z0-9][a-z0-9.+-]*"
#: Licence and the identifiers that make it up, in order of trial: "a b" in a row, "b?" may be missing. Fixed values.
LICENCES = (
    ("MIT", ("mit-grant", "mit-notice?", "asis-warranty?", "liability?")),
    ("BSL-1.0", ("boost-grant", "mit-notice?", "asis-warranty?", "liability?")),
    ("ISC", ("isc-grant", "asis-warranty?", "liability?")),
    ("Zlib", ("asis-warranty?", "liability?", "zlib-grant")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "asis-warranty?", "liability?")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "asis-warranty?", "liability?")),
    ("Apache-2.0", ("apache2-text",)),
    ("Apache-2.0", ("apache2", "apache-condition?", "asis-warranty?")),
    ("GPL-3.0", ("gpl3-text",)),
    ("GPL-2.0", ("gpl2-text",)),
    ("AGPL-3.0", ("agpl3-text",)),
    ("LGPL-3.0", ("lgpl3-text",)),
    ("LGPL-2.1", ("lgpl21-text",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3", "later-option")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl3", "later-option")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-2.1-or-later", ("lgpl21", "later-option")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-3.0-or-later", ("gpl3", "later-option")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-or-later", ("gpl2", "later-option")),
    ("AGPL-3.0", ("agpl3",)),
    ("LGPL-3.0", ("lgpl3",)),
    ("LGPL-2.1", ("lgpl21",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("GPL", ("gpl-any",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2-exhibit",)),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-2.0", ("epl2",)),
    ("OFL-1.1", ("ofl11",)),
    ("BSL-1.0", ("boost",)),
    ("ODbL-1.0", ("odbl",)),
    ("Artistic-2.0", ("artistic2",)),
    ("WTFPL", ("wtfpl",)),
    ("Zlib", ("zlib",)),
    ("MIT", ("mit",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("ISC", ("isc",)),
    ("Unlicense", ("unlicense",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
)
RESERVED = "Proprietary"
#: Sentences further apart than this make up no licence together.
MOST_APART = 4
#: Steps of the new layout: pattern and replacement ($1 is the first group).
BREAK = "\x01"
LAYOUT = (
    (r"\r\n?", "\n"),
    (r"(?i)(SPDX-License-Identifier:[^\n]*)", f"{BREAK}$1{BREAK}"),
    (r"(?m)^[ \t]*(?:(?://|#|\*|--|;|>|%|/\*|<!--)+[ \t]*)+", ""),
    (r"(?m)^[ \t]*(?:[-•]|\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{2,4})[.)])[ \t]+", BREAK),
    (r"\n[ \t]*\n", BREAK),
    (r"\n", " "),
    (r"(?i)\bv\. ?([0-9])", "v$1"),
)
SENTENCE_END = r"""\x01|[.;!?]["')]*(?:[ \t]+|$)"""
WORDED = "[A-Za-z]{2}"


def _stems() -> str:
    """A text without any of these, in lower case, has no sentence of the rules: their stems, and what SPDX lines and unknown
    licences are told by."""
    return "|".join(sorted({stems for _, _, stems in SENTENCES} | {"licen[cs]e"}))


#: Follows from the rules.
HINT = _stems()
def laid_out(text: Column) -> Column:
    out = text
    for pattern, replacement in LAYOUT:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def normalised(sentence: Column) -> Column:
    """Lower case; British spelling as American; comment marks, quotes and other signs as blanks, but stops within versions;
    blanks as one space, none at the ends."""
    plain = F.regexp_replace(F.lower(sentence), "licence", "license")
    plain = F.regexp_replace(plain, "[^a-z0-9.]+", " ")
    plain = F.regexp_replace(plain, r"([a-z])\.|\.([^0-9]|$)", "$1 $2")
    return F.trim(F.regexp_replace(plain, " +", " "))


def any_sentence() -> str:
    """All sentence rules in order of trial, as one group."""
    return "(" + "|".join(rule for _, rule, _ in SENTENCES) + ")"


def identifiers(sentence: Column) -> Column:
    """Identifiers of all sentence rules that a normalised sentence meets, from the left; ``unknown`` for one that speaks of a
    licence and meets none."""

    def name(fit: Column) -> Column:
        out = None
        for identifier, rule, _ in SENTENCES:
            own = fit.rlike(f"^(?:{rule})$")
            out = F.when(own, identifier) if out is None else out.when(own, identifier)
        return out

    found = F.transform(F.regexp_extract_all(sentence, F.lit(any_sentence()), F.lit(1)), name)
    unknown = F.when(F.contains(sentence, F.lit("license")), F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda ids: F.when(F.size(ids) > 0, ids).otherwise(unknown))


def spdx_identifiers(sentence: Column) -> Column:
    """Identifiers of the licences that an SPDX line names; operators, exceptions and unlisted names give none."""
    known = F.create_map(*[F.lit(x) for name, full in SPDX_NAMES.items() for x in (name, f"spdx-{full.lower()}")])
    words = F.regexp_extract_all(F.regexp_extract(F.lower(sentence), f"{SPDX_LINE}(.*)", 1), F.lit(f"({SPDX_WORD})"), F.lit(1))
    return F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda i: i.isNotNull())


def rule_pattern(parts: tuple[str, ...]) -> str:
    """Pattern of a licence rule over identifiers in angle brackets."""
    escaped = [p.replace(".", r"\.").replace("+", r"\+") for p in parts]
    return "".join(f"(?:<{p[:-1]}>)?" if p.endswith("?") else f"<{p}>" for p in escaped)


def any_rule() -> str:
    """All licence rules in order of trial, as one group."""
    return "(" + "|".join(rule_pattern(parts) for _, parts in LICENCES) + ")"


def found_licences(sequence: Column) -> Column:
    """Licences of a sequence of identifiers in angle brackets, from the left; a bar parts what is far apart."""

    def name(fit: Column) -> Column:
        out = None
        for licence, parts in LICENCES:
            own = fit.rlike(f"^{rule_pattern(parts)}$")
            out = F.when(own, licence) if out is None else out.when(own, licence)
        return out

    return F.transform(F.regexp_extract_all(sequence, F.lit(any_rule()), F.lit(1)), name)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentences (array of at, id, text of the sentences with an identifier, one entry per
    identifier, ``at`` counting all sentences with a word from 0), sequence (their identifiers joined by spaces), licences (in
    order of appearance, repeated if found again), licence (the different ones joined by " AND ", empty if none) and n_unknown
    (sentences that speak of a licence and meet no rule). ``Proprietary`` is named where rights are reserved and no licence is found.

    Null and empty texts have no sentences. No row leaves its task; repeated rows give repeated results; other columns are not
    read."""
    text = F.col("text").cast("string")

    def entries(x: Column) -> Column:
        is_spdx = F.contains(F.lower(x["text"]), F.lit(SPDX_LINE))
        ids = F.when(is_spdx, spdx_identifiers(x["text"])).otherwise(bound(normalised(x["text"]), identifiers))
        return F.transform(ids, lambda i: F.struct(x["at"].alias("at"), i.alias("id"), x["text"].alias("text")))

    def sentences(t: Column) -> Column:
        cut = F.filter(F.split(t, SENTENCE_END), lambda s: s.rlike(WORDED))
        numbered = F.transform(cut, lambda s, i: F.struct(i.alias("at"), s.alias("text")))
        hinted = F.filter(numbered, lambda x: F.lower(x["text"]).rlike(HINT))
        return F.flatten(F.transform(hinted, entries))

    empty = F.array().cast("array<struct<at:int,id:string,text:string>>")
    rows = docs.select(F.col("doc_id").cast("long"), F.when(F.lower(text).rlike(HINT), sentences(laid_out(text))).alias("_s"))
    rows = rows.select("doc_id", F.coalesce("_s", empty).alias("sentences"))
    of_licences = F.filter("sentences", lambda x: ~x["id"].isin(*BESIDE))
    rows = rows.select("doc_id", "sentences", of_licences.alias("_l"))

    def part(x: Column, k: Column) -> Column:
        far = (k > 0) & (x["at"] - F.get(F.col("_l"), k - 1)["at"] > MOST_APART)
        return F.concat(F.when(far, "|").otherwise(""), F.lit("<"), x["id"], F.lit(">"))

    rows = rows.select("doc_id", "sentences", found_licences(F.array_join(F.transform("_l", part), "")).alias("_f"))
    reserved = F.exists("sentences", lambda x: x["id"] == "all-rights")
    rows = rows.select(
        "doc_id", "sentences", F.array_join(F.transform("sentences", lambda x: x["id"]), " ").alias("sequence"),
        F.when((F.size("_f") == 0) & reserved, F.array(F.lit(RESERVED))).otherwise(F.col("_f")).alias("licences"),
    )
    return rows.select(
        "*", F.array_join(F.array_distinct("licences"), " AND ").alias("licence"),
        F.size(F.filter("sentences", lambda x: x["id"] == UNKNOWN)).cast("long").alias("n_unknown"),
    )
