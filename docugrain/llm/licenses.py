"""License scans by sentence rules, with DataFrame functions only.

Method: a text with a licence word is normalised (lower case, punctuation and white space as one space, which drops comment
signs too) and cut into pieces at line ends and after ``.``, ``!``, ``?`` or ``;`` before white space. A known licence
sentence is met where its words are those of whole pieces side by side within a paragraph, so wrapped lines, comment
signs and stops within a sentence don't matter; years and holders of a copyright line are left out. Of sentences that begin at one
piece the longest is taken. This gives the text's sequence of sentence identifiers. Rules, in
order, then match identifier sequences: a rule holds if its identifiers stand in the sequence in its order, side by side. The first rule that
matches a stretch of the sequence takes it, so that a longer form (a full licence text) goes before its own parts.

Some sentences are patterns, as their words vary: copyright lines, the endorsement clause with any holder, and tags and phrases that
name licences by their SPDX identifiers (``SPDX-License-Identifier: MIT OR Apache-2.0``, "either of", "License: X"). The last
give one identifier for each licence named, which is its own rule. Where a clause of a longer rule is there in part only, it counts as there,
so that no shorter rule takes the text.

All is done within a row: no shuffle, no join; the tables of sentences and rules are literals of a fixed, small size.

Defined results: null, empty text and text without a known sentence give an empty list; equal rows give equal lists; a
sentence that is given twice counts twice; texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Known licence sentences, normalised as below, by identifier.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license", "the mit license mit", "license mit", "spdx license identifier mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "distributed under the apache license version 2 0", "apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"],
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3-notice": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"],
    "agpl3-notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3-notice": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd2-notice": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by-4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nc-nd-4": ["licensed under cc by nc nd 4 0"],
    "cc-by-nc-sa-4": ["licensed under cc by nc sa 4 0"],
    "cc0": ["licensed under cc0 1 0", "released under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "spdx license identifier cc0 1 0"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2-unless": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-language": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache2-notice-comply": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "gpl-details": ["see the gnu general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl21-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-redistribute": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl-warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-details": ["see the gnu lesser general public license for more details"],
    "lgpl21-notice": ["licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1"],
    "agpl3-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl-details": ["see the gnu affero general public license for more details"],
    "bsd-disclaimer": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "isc-notice": ["isc license", "licensed under the isc license", "released under the isc license", "spdx license identifier isc"],
    "isc-disclaimer": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib-disclaimer": ["this software is provided as is without any express or implied warranty"],
    "zlib-liability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-notice": ["zlib license", "licensed under the zlib license", "spdx license identifier zlib"],
    "bsl1-notice": ["distributed under the boost software license version 1 0", "boost software license version 1 0", "licensed under the boost software license version 1 0", "spdx license identifier bsl 1 0"],
    "bsl1-copy": ["see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt", "see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt"],
    "bsl1-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "epl2-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0",
        "eclipse public license v 2 0", "eclipse public license version 2 0", "spdx license identifier epl 2 0",
    ],
    "epl1-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
        "eclipse public license v 1 0", "eclipse public license version 1 0", "spdx license identifier epl 1 0",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["all rights reserved"],
    "copyright": ["copyright"],
}
# Rules in order, (licence, identifiers side by side).
RULES = [
    ("MIT", ["mit-notice", "copyright", "mit-grant", "mit-condition", "as-is", "mit-liability"]),
    ("MIT", ["copyright", "mit-grant", "mit-condition", "as-is", "mit-liability"]),
    ("MIT", ["mit-notice", "copyright", "mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache2-notice-comply", "apache2-copy", "apache2-unless", "apache2-language"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-unless", "apache2-language"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-notice-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-notice-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty", "gpl-details", "gpl-received"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty", "agpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty", "lgpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("Zlib", ["zlib-disclaimer", "zlib-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-notice", "copyright", "isc-grant", "isc-disclaimer"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("BSL-1.0", ["bsl1-notice", "bsl1-copy"]),
    ("BSL-1.0", ["bsl1-notice", "bsl1-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("AGPL-3.0-only", ["agpl3-notice"]),
    ("LGPL-3.0-only", ["lgpl3-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("LGPL-2.1-only", ["lgpl21-notice"]),
    ("Zlib", ["zlib-notice"]),
    ("BSL-1.0", ["bsl1-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-Rights-Reserved", ["all-rights"]),
]
# SPDX identifiers; versions of licences that come "only" or "or later"; exceptions.
SPDX = ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "MPL-1.1", "EPL-1.0", "EPL-2.0", "Unlicense", "WTFPL", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "Artistic-2.0", "PostgreSQL", "Python-2.0", "OFL-1.1", "EUPL-1.2"]
GNU = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception"]
#: Other names of licences, normalised, where a text names several or follows "license" and a colon.
NAMES = {"apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "apache 2 license": "Apache-2.0", "mit license": "MIT", "bsd 3 clause license": "BSD-3-Clause", "bsd 2 clause license": "BSD-2-Clause", "isc license": "ISC", "gplv3": "GPL-3.0-only", "gplv2": "GPL-2.0-only", "gnu general public license version 3": "GPL-3.0-only", "gnu general public license version 2": "GPL-2.0-only", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0"}
#: Identifiers of licences that a sentence names begin so.
NAMED = "spdx:"
#: Every known sentence has one of these words, so others needn't be normalised.
WORDS = "(?i)licen[sc]e|copyright|permission|permitted|warrant|redistribut|spdx|copies of the|provided with|provided as|provided by the|held liable|be liable|endorse|compliance|free software|public domain|rights reserved|creative commons|made available under"
COPYRIGHT = "^copyright( c)?( [0-9]{4})( [0-9]{4})*( .*)?$"
COPYRIGHT_PIECE = "copyright(?:(?: c)?(?: [0-9]{4})+(?: [^\\n]*)?)?"
#: A stop that more of its line follows; comment words at the beginning of a line (signs go with the punctuation).
INNER_STOP = "[.!?;][ \\t\\r\\x0b\\x0c]+(?=[^ \\t\\r\\x0b\\x0c\\n])"
WORD_PREFIX = "(?m)^[ \\t]*(?:rem|dnl)(?=[ \\t\\n])"
NOT_PIECE = "[^a-z0-9\\n]+"


def named() -> dict[str, str]:
    """Normalised names of licences and what they stand for."""
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower())
    own = {plain(x): x for x in SPDX}
    for x in GNU:
        own |= {plain(x): f"{x}-only", f"{plain(x)} only": f"{x}-only", f"{plain(x)} or later": f"{x}-or-later"}
    return own | {f"{k} with {plain(e)}": f"{v} WITH {e}" for k, v in own.items() for e in EXCEPTIONS} | NAMES


def any_name() -> str:
    return "(?:" + "|".join(sorted(named(), key=lambda k: (-len(k), k))) + ")"


#: Sentences whose words vary. A piece that holds the core of the endorsement clause counts as the clause.
ENDORSE = "neither the name of (?:[a-z0-9]+ ){1,24}?nor the names of (?:[a-z0-9]+ ){1,6}?may be used to endorse or promote products derived from this software without (?:specific )?prior written permission"
ENDORSE_PART = "(?:[a-z0-9]+\\x20){0,60}?endorse or promote products(?:\\x20[a-z0-9]+){0,60}?"


def naming() -> list[str]:
    """Sentences that name licences."""
    name = f"(?:the )?{any_name()}(?: licen[sc]e)?"
    several = f"{name}(?:(?: or| and) {name})*"
    return [
        f"spdx license identifier {several}",
        f"(?:(?:this|the) (?:project|software|work|crate|library|code) is )?(?:dual |multi )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:either (?:of )?|both )?{several}(?: at your (?:option|choice))?",
        f"licen[sc]e {several}",
    ]


def pieces(text: Column) -> Column:
    """The text in normalised pieces, each between line ends; an empty line between paragraphs."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), WORD_PREFIX, ""), INNER_STOP, "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, NOT_PIECE, " "), " *\n *", "\n")
    return F.concat(F.lit("\n"), F.btrim(plain, F.lit(" ")), F.lit("\n"))


def sentences() -> list[str]:
    """Patterns of all sentences with spaces between words: known ones, longer ones first, then those whose words vary."""
    known = sorted((s for own in SENTENCES.values() for s in own), key=lambda s: (-len(s), s))
    return [*(s for s in known if s != "copyright"), COPYRIGHT_PIECE, ENDORSE, *naming(), ENDORSE_PART]


def known_sentence() -> str:
    """A pattern for all of them, from one end of a piece to another; words are divided by a space or by the end of a piece."""
    # A copyright line ends with its piece: a holder's words don't run on.
    spaced = [x if x == COPYRIGHT_PIECE else x.replace(" ", "[ \\n]") for x in sentences()]
    return "(?<=\\n)(?:" + "|".join(spaced) + ")(?=\\n)"


def identifiers(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, own in SENTENCES.items() for s in own for x in (s, name)))
    licenses = F.create_map(*(F.lit(x) for k, v in named().items() for x in (k, NAMED + v)))

    def of(s: Column) -> Column:
        plain = F.regexp_replace(F.replace(s, F.lit("\n"), F.lit(" ")), COPYRIGHT, "copyright")
        listed = F.transform(F.regexp_extract_all(plain, F.lit(rf"\b{any_name()}\b"), F.lit(0)), lambda n: F.try_element_at(licenses, n))
        one = F.when(plain.contains("endorse or promote"), "bsd-endorse").otherwise(F.try_element_at(known, plain))
        return F.when(one.isNotNull(), F.array(one)).otherwise(listed)

    return F.flatten(F.transform(F.regexp_extract_all(pieces(text), F.lit(known_sentence()), F.lit(0)), of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses (in order of the rules' first match), for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text.rlike(WORDS), identifiers(text)).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    # The sequence as text, each identifier between two bars: "|a||b|". A matched stretch becomes "#", which no rule has, so each is taken once.
    rows = base.withColumn("_left", F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), ""))
    rows = rows.withColumn("_state", F.aggregate(
        F.array(*(F.struct(F.lit(name).alias("license"), F.lit("".join(f"|{i}|" for i in own)).alias("rule")) for name, own in RULES)),
        F.struct(F.col("_left").alias("left"), F.array().cast("array<string>").alias("licenses")),
        lambda state, rule: F.when(F.contains(state.left, rule.rule), F.struct(F.replace(state.left, rule.rule, F.lit("#")).alias("left"), F.array_append(state.licenses, rule.license).alias("licenses"))).otherwise(state),
    ))
    direct = F.transform(F.filter("sentence_ids", lambda i: i.startswith(NAMED)), lambda i: F.substring(i, len(NAMED) + 1, F.length(i)))
    return rows.select("doc_id", "sentence_ids", F.array_distinct(F.concat("_state.licenses", direct)).alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB SQL: pieces between doubled line ends, so that a match takes one of its own at either side; rules one after another."""
    known = "MAP {" + ", ".join(f"{_quoted(s)}: {_quoted(name)}" for name, own in SENTENCES.items() for s in own) + "}"
    licenses = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(NAMED + v)}" for k, v in named().items()) + "}"
    replaced = lambda x, pattern, by: f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    text = replaced("lower(coalesce(text, ''))", "(?m)^[ \\t]*(?:rem|dnl)([ \\t\\n])", "\\1")
    for _ in range(2):  # a stop that follows a stop is met the second time
        text = replaced(text, "[.!?;][ \\t\\r\\x0b\\x0c]+([^ \\t\\r\\x0b\\x0c\\n])", "\n\\1")
    text = replaced(replaced(text, NOT_PIECE, " "), " *\\n *", "\n\n")
    spaced = [x if x == COPYRIGHT_PIECE else x.replace(" ", "(?: |\\n\\n)") for x in sentences()]
    found = f"regexp_extract_all(chr(10) || chr(10) || trim({text}, ' ') || chr(10) || chr(10), {_quoted('\\n(' + '|'.join(spaced) + ')\\n')}, 1)"
    plain = f"regexp_replace(replace(s, chr(10) || chr(10), ' '), {_quoted(COPYRIGHT)}, 'copyright')"
    steps, at = [], "r"
    for k, (name, own) in enumerate(RULES):
        rule = _quoted("".join(f"|{i}|" for i in own))
        steps.append(f"s{k} AS (SELECT doc_id, ids, replace(rest, {rule}, '#') AS rest, CASE WHEN contains(rest, {rule}) AND NOT list_contains(found, {_quoted(name)}) THEN list_append(found, {_quoted(name)}) ELSE found END AS found FROM {at})")
        at = f"s{k}"
    return f"""
WITH p AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {_quoted(WORDS)}) THEN {found} ELSE [] END AS ss FROM documents),
n AS (SELECT doc_id, [{plain} FOR s IN ss] AS ss FROM p),
q AS (SELECT doc_id, flatten([CASE WHEN contains(s, 'endorse or promote') THEN ['bsd-endorse'] WHEN {known}[s] IS NOT NULL THEN [{known}[s]] ELSE [{licenses}[x] FOR x IN regexp_extract_all(s, {_quoted(r"\b" + any_name() + r"\b")})] END FOR s IN ss]) AS ids FROM n),
r AS (SELECT doc_id, ids, array_to_string(['|' || i || '|' FOR i IN ids], '') AS rest, []::VARCHAR[] AS found FROM q),
{", ".join(steps)},
t AS (SELECT doc_id, ids, list_concat(found, [i[{len(NAMED) + 1}:] FOR i IN ids IF starts_with(i, {_quoted(NAMED)})]) AS found FROM {at})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string([x FOR x, i IN found IF list_position(found, x) = i], ',') AS licenses FROM t"""
