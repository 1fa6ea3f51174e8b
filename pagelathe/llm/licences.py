"""Licence scans by sentence rules (after German, Manabe and Inoue, 2010). DataFrame expressions throughout.

A text is cut into sentences, which are normalised; each is mapped to the identifier of a known licence sentence, or,
if it looks like licence wording, to UNKNOWN. The sequence of identifiers is then matched against ordered rules: a
rule's licence is reported where its sequence stands, and what it matched is consumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, table

UNKNOWN = "unknown"

#: A text is looked at only if its lower case holds one of these words or phrases: every pattern of SENTENCES implies
#: one. A sentence that no pattern knows counts as unknown licence wording only if it holds one.
ANCHORS = ["licen", "copyright", "permission", "redistribut", "warrant", "spdx", "liable", "cc0"]
_PHRASES = ["public domain", "all rights reserved", "creative commons", "software is provided", "free software", "general public", "copy of the mpl", "cc by", "origin of this software", "altered source versions", "notice may not be removed", "anyone is free to copy"]
ANCHOR_PHRASES = "|".join(x.replace(" ", "[^a-z0-9]+") for x in _PHRASES)

_CC_KINDS = [
    ("by-nc-nd", "attribution-noncommercial-noderiv(ative)?s"), ("by-nc-sa", "attribution-noncommercial-sharealike"), ("by-nc", "attribution-noncommercial"),
    ("by-nd", "attribution-noderiv(ative)?s"), ("by-sa", "attribution-sharealike"), ("by", "attribution"),
]
_CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0"]
_CC = [(kind, name, v) for kind, name in _CC_KINDS for v in _CC_VERSIONS]

#: Notices of the GNU licences that stand in one sentence, with "any later version".
_GNU_LATER = [("lgpl", "lesser", "3", "3"), ("lgpl", "lesser", "2.1", r"2\.1"), ("lgpl", "lesser", "2", "2"), ("agpl", "affero", "3", "3")]

#: (identifier, pattern of the whole normalised sentence), the first that matches counts. The wording is that of
#: the published licences and of the notices that they recommend.
SENTENCES: list[tuple[str, str]] = [
    ("apache-2-notice", r"(this (work|file|software|project|document) is )?licensed under the apache license version 2\.0( the license)?"),
    ("apache-2-except", r"you may not use this file except in compliance with the license"),
    ("apache-2-copy", r"you may obtain a copy of the license at.*"),
    ("apache-2-asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-release", r"((this|the) (work|file|software|project|program|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of the )?mit license"),
    ("mit-title", r"(the )?mit license( mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.* to deal in the software without restriction.*"),
    ("mit-notice", r".*the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("mit-liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*"),
    ("isc-grant", r"permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("isc-asis", r"the software is provided as is and the author disclaims all warranties with regard to this software.*"),
    ("bsd-release", r".*(released|licensed|distributed|available) under (the )?(terms of the )?(bsd|new bsd|modified bsd|3-clause bsd|bsd 3-clause) license"),
    ("bsd2-release", r".*(released|licensed|distributed|available) under (the )?(terms of the )?(simplified bsd|2-clause bsd|bsd 2-clause) license"),
    ("bsd-conditions", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"([0-9*-]+\.? )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"([0-9*-]+\.? )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer.*"),
    ("bsd-endorse", r"([0-9*-]+\.? )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-asis", r"this software is provided by .* as is and any express or implied warranties.* are disclaimed"),
    ("bsd-liable", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages.*"),
    ("gpl-3-notice", r"(this (work|file|software|project|program) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license version 3(\.0)?( only)?"),
    ("gpl-2-notice", r"(this (work|file|software|project|program) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license version 2(\.0)?( only)?"),
    ("gpl-free", r".*is free software"),
    ("gpl-terms-3", r"(.*is free software )?you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or.*"),
    ("gpl-terms-2", r"(.*is free software )?you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or.*"),
    ("gpl-redistribute", r"(.*is free software )?you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-later-3", r"either version 3 of the license or.*"),
    ("gpl-later-2", r"either version 2 of the license or.*"),
    ("gpl-later-2.1", r"either version 2\.1 of the license or.*"),
    ("gpl-later", r"either version [0-9.]+ of the license or.*"),
    ("gpl-published", r"license as published by the free software foundation.*"),
    *[(f"{short}-later-{v}", rf".*redistribute it and/or modify it under the terms of the gnu {name} general public license.*either version {e} of the license or.*") for short, name, v, e in _GNU_LATER],
    ("lgpl-notice", r".*(licensed|released|distributed|redistribute it and/or modify it) under the (terms of the )?gnu lesser general public( license.*)?"),
    ("agpl-notice", r".*(licensed|released|distributed|redistribute it and/or modify it) under the (terms of the )?gnu affero general public license.*"),
    ("gpl-hope", r".*is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-merchant", r"without even the implied warranty of.*"),
    ("gpl-copy", r"(you should have received|see the) .*gnu (lesser |affero )?general public( license.*)?|(gnu )?(lesser |affero )?general public license for more details|license along with this .*|if not (see|write to) .*(gnu|licen|free software).*"),
    *[
        (f"cc-{kind}-{v}", rf".*(licensed|released|available|distributed) under (a |the )?(terms of the )?(cc[ -]{kind}[ -]{v}|creative commons {name} {v}.*)".replace(v, v.replace(".", r"\.")))
        for kind, name, v in _CC
    ],
    ("cc0", r"(.*[^a-z0-9])?cc0([^a-z0-9].*)?|.*(dedicated .*to the public domain|creative commons zero).*"),
    ("mpl-2", r".*subject to the terms of the mozilla public license v(ersion)?\.? ?2\.0.*"),
    ("mpl-2-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("epl-2", r".*eclipse public license( -)? v(ersion)?\.? ?2\.0.*"),
    ("epl-1", r".*eclipse public license( -)? v(ersion)?\.? ?1\.0.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-free", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("zlib-asis", r"this software is provided as-is without any express or implied warranty"),
    ("zlib-liable", r"in no event will the authors? be held liable for any damages.*"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose.*"),
    ("zlib-origin", r"([0-9]+\.? )?the origin of this software must not be misrepresented.*"),
    ("zlib-altered", r"([0-9]+\.? )?altered source versions must be plainly marked as such.*"),
    ("zlib-notice", r"([0-9]+\.? )?this notice may not be removed or altered from any source distribution"),
    ("bsl-title", r"((released|licensed|distributed) under the )?boost software license( -)? version 1\.0.*"),
    ("bsl-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("public-domain", r".*(is|are) (hereby )?(released|placed|put) (in|into) the public domain.*"),
    ("all-rights", r"(.* )?all rights reserved"),
    ("copyright", r"(portions )?copyright( c)? .*[0-9]{4}.*"),
]

#: (licence, pattern of identifiers): tried in order, each over what the rules before left of ";id;id;id;".
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", r";apache-2-notice(;(apache-2-except|apache-2-copy|apache-2-asis|apache-2-see))*(?=;)"),
    ("MIT", r"(;(mit-title|copyright|all-rights))*;mit-grant(;mit-notice)?(;mit-asis)?(;mit-liable)?(?=;)"),
    ("MIT", r";mit-release(?=;)"),
    ("MIT", r";mit-title(?=;)"),
    ("ISC", r";isc-grant(;isc-asis)?(?=;)"),
    ("BSD-3-Clause", r";bsd-conditions;bsd-source;bsd-binary;bsd-endorse(;bsd-asis)?(;bsd-liable)?(?=;)"),
    ("BSD-2-Clause", r";bsd-conditions;bsd-source;bsd-binary(;bsd-asis)?(;bsd-liable)?(?=;)"),
    ("BSD-3-Clause", r";bsd-release(?=;)"),
    ("BSD-2-Clause", r";bsd2-release(?=;)"),
    ("GPL-3.0-or-later", r"(;gpl-free)?(;gpl-terms-3|;gpl-redistribute;gpl-later-3)(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    ("GPL-2.0-or-later", r"(;gpl-free)?(;gpl-terms-2|;gpl-redistribute;gpl-later-2)(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    ("GPL-3.0-only", r";gpl-3-notice(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    ("GPL-2.0-only", r";gpl-2-notice(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    *[
        (f"{short.upper()}-{v if '.' in v else v + '.0'}-or-later", rf"(;gpl-free)?(;{short}-notice(;gpl-published)?;gpl-later-{e}|;{short}-later-{e})(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)")
        for short, _, v, e in _GNU_LATER
    ],
    ("LGPL", r"(;gpl-free)?;lgpl-notice(;gpl-published)?(;gpl-later[0-9.-]*)?(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    ("AGPL", r"(;gpl-free)?;agpl-notice(;gpl-published)?(;gpl-later[0-9.-]*)?(;gpl-hope)?(;gpl-merchant)?(;gpl-copy)*(?=;)"),
    *[(f"CC-{kind.upper()}-{v}", rf";cc-{kind}-{v}(?=;)".replace(v, v.replace(".", r"\."))) for kind, _, v in _CC],
    ("CC0-1.0", r";cc0(?=;)"),
    ("MPL-2.0", r";mpl-2(;mpl-2-copy)?(?=;)"),
    ("EPL-2.0", r"(;epl-2)+(?=;)"),
    ("EPL-1.0", r"(;epl-1)+(?=;)"),
    ("Unlicense", r";unlicense(;unlicense-free)?(?=;)"),
    ("Zlib", r"(;zlib-asis)?(;zlib-liable)?;zlib-grant(;zlib-origin)?(;zlib-altered)?(;zlib-notice)?(?=;)"),
    ("BSL-1.0", r";bsl-title(;bsl-grant)?(?=;)"),
    ("BSL-1.0", r";bsl-grant(?=;)"),
    ("public-domain", r";public-domain(?=;)"),
    ("all-rights-reserved", r"(;copyright)*;all-rights(?=;)"),
    ("copyright-only", r"(;copyright)+(?=;)"),
    ("UNKNOWN", rf"(;{UNKNOWN})+(?=;)"),
]

_COMMENT = r"(?m)^[ \t]*(//+|#+|\*+|--+)[ \t]*"
_WRAPPED = r"\r?\n[ \t]*([a-z(])"
_WRAPPED_CAPITALS = r"([A-Z,])\r?\n[ \t]*([A-Z]{2})"
_END = r"([.!?;]+)[ \t\r]+"
_SPDX = r"spdx-license-identifier\s*:?\s*([a-z0-9.+-]+( (and|or|with) [a-z0-9.+-]+)*)"
_SPDX_JOINS = " (and|or) "


def _anchored(lowered: Column) -> Column:
    hit = F.lit(False)
    for a in ANCHORS:
        hit = hit | F.contains(lowered, F.lit(a))
    return hit | lowered.rlike(ANCHOR_PHRASES)


def sentences(text: Column) -> Column:
    """Normalised sentences, in order: lower case, words and versions, single blanks.

    Comment marks go, a line that begins in lower case, or in capitals like the end of the line before, continues
    that line, and a sentence ends with its line or at a mark followed by white space.
    """
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _COMMENT, ""), _WRAPPED, " $1"), _WRAPPED_CAPITALS, "$1 $2")
    cut = F.split(F.regexp_replace(joined, _END, "$1\n"), "\n")
    return F.transform(cut, lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.+/-]+", " ")), "[. ]+$", ""))


def sentence_id(sentence: Column) -> Column:
    """The identifier of a normalised sentence, UNKNOWN of one that looks like licence wording, else null."""
    out = F.when(sentence.rlike(_SPDX), F.concat(F.lit("spdx-"), F.regexp_extract(sentence, _SPDX, 1)))
    for name, pattern in SENTENCES:
        out = out.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.when(_anchored(sentence), F.lit(UNKNOWN))


def _matched(ids: Column) -> Column:
    """Licences of a sequence of identifiers, by the first place of their rules in RULES, each once."""
    rules = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("pattern")) for a, b in RULES])
    start = F.struct(F.concat(F.lit(";"), F.array_join(ids, ";"), F.lit(";")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.regexp(state["rest"], rule["pattern"])
        return F.struct(
            F.when(hit, F.regexp_replace(state["rest"], rule["pattern"], F.lit(""))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"),
        )

    stated = F.flatten(F.transform(F.filter(ids, lambda x: x.startswith("spdx-")), lambda x: F.split(F.regexp_replace(x, "^spdx-", ""), _SPDX_JOINS)))
    tagged = F.transform(stated, lambda x: F.concat(F.lit("SPDX:"), x))
    return F.array_distinct(F.concat(F.aggregate(rules, start, apply)["found"], tagged))


def licence_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, n_sentences, n_unknown) of every row of docs (doc_id, text, ...).

    sentence_ids joins the identifiers by ';' in the order of the text, licences the licences by ','; both are empty
    and the counts 0 where a text, null or empty included, has no licence wording. n_sentences counts the known
    sentences and those that look like licence wording, n_unknown the latter. Of an SPDX expression every identifier is
    reported, with its exception. Null and repeated doc_ids stay rows of
    their own; other columns are ignored.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(as_long("doc_id").alias("doc_id"), F.when(_anchored(F.lower(text)), sentences(text)).otherwise(none).alias("s"))
    named = read.select("doc_id", F.array_compact(F.transform("s", sentence_id)).alias("ids"))
    licences = F.when(F.size("ids") > 0, _matched(F.col("ids"))).otherwise(none)
    return named.select(
        "doc_id",
        F.array_join("ids", ";").alias("sentence_ids"),
        F.array_join(licences, ",").alias("licences"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x == UNKNOWN)).cast("long").alias("n_unknown"),
    )


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same for DuckDB, from the same tables. Its regular expressions have no look-ahead: a rule's closing ';' is
    kept by the replacement instead, and rules are applied one after the other."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    hit = lambda x: "(" + " OR ".join(f"contains({x}, {q(a)})" for a in ANCHORS) + f" OR regexp_matches({x}, {q(ANCHOR_PHRASES)}))"
    case = " ".join(f"WHEN regexp_full_match(s, {q(p)}) THEN {q(n)}" for n, p in SENTENCES)
    steps, last = [], "r0"
    for k, (licence, pattern) in enumerate(RULES, 1):
        p = pattern.removesuffix("(?=;)") + ";"
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, regexp_replace(rest, {q(p)}, ';', 'g') AS rest,"
            f" CASE WHEN regexp_matches(rest, {q(p)}) AND NOT list_contains(found, {q(licence)}) THEN list_append(found, {q(licence)}) ELSE found END AS found FROM {last})"
        )
        last = f"r{k}"
    return f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {q(_COMMENT)}, '', 'g'), {q(_WRAPPED)}, ' \\1', 'g'), {q(_WRAPPED_CAPITALS)}, '\\1 \\2', 'g'), {q(_END)}, '\\1' || chr(10), 'g'), chr(10)) AS s
  FROM documents WHERE {hit('lower(text)')}
), plain AS (
  SELECT doc_id, list_transform(s, lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9.+/-]+', ' ', 'g')), '[. ]+$', '')) AS s FROM cut
), named AS (
  SELECT doc_id, list_filter(list_transform(s, lambda s: CASE WHEN regexp_matches(s, {q(_SPDX)}) THEN 'spdx-' || regexp_extract(s, {q(_SPDX)}, 1) {case} WHEN {hit('s')} THEN {q(UNKNOWN)} END), lambda x: x IS NOT NULL) AS ids FROM plain
), r0 AS (
  SELECT doc_id, ids, ';' || array_to_string(ids, ';') || ';' AS rest, CAST([] AS VARCHAR[]) AS found FROM named WHERE len(ids) > 0
), {', '.join(steps)}
SELECT d.doc_id, coalesce(array_to_string(ids, ';'), '') AS sentence_ids,
       coalesce(array_to_string(list_concat(found, list_transform(flatten(list_transform(list_filter(ids, lambda x: starts_with(x, 'spdx-')), lambda x: string_split_regex(x[6:], {q(_SPDX_JOINS)}))), lambda x: 'SPDX:' || x)), ','), '') AS licences,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences,
       CAST(coalesce(len(list_filter(ids, lambda x: x = {q(UNKNOWN)})), 0) AS BIGINT) AS n_unknown
FROM documents d LEFT JOIN {last} USING (doc_id)
"""


OP5_SQL = _sql()
