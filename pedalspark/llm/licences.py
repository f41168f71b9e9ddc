"""Licence scans by canonical digest, in DataFrame operations only.

A text is brought to a canonical form: A-Z lower-cased, copyright statements and the numbers of lists dropped, every run
of other characters than letters and digits made one space, equivalent spellings made one if the text speaks of a licence,
permission or warranty. The form is the same however the text is wrapped or commented. The SHA-256 of a whole text's form is hash-joined with those of known licences; that of
each line which names a licence, without a copyright statement before it, is looked up among one-line notices, which are
made from verbs and names by rule. The lists are fixed and small, so they are broadcast; no text is shuffled.

Defined cases: null texts and those without letters or digits have a null digest and no licence; repeated rows have
equal results; several notices are listed in alphabetical order, each once; a text of any length has one digest; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
TEXTS: dict[str, list[str]] = {
    "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT],
    "ISC": [f"{head}Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC}" for head in ("", "ISC License\n", "The ISC License\n")],
    "0BSD": [f"{head}Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC}" for head in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")],
    "BSD-2-Clause": [head + _BSD_TWO + _BSD for head in ("", "BSD 2-Clause License\n")],
    "BSD-3-Clause": [head + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD for head in ("", "BSD 3-Clause License\n")],
    "Zlib": [f"{head}This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution." for head in ("", "zlib License\n", "The zlib License\n")],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"],
    "BSL-1.0": [head + _BOOST for head in ("", "Boost Software License - Version 1.0 - August 17th, 2003\n\n")],
}
# Digests of the canonical forms of further whole texts, some also without what follows their terms.
DIGESTS: dict[str, str] = {
    "2942bde0e95f2669b0b0ebf525ebea3a87111cbf8eba694c964ed1ea8ccacfab": "Apache-2.0",
    "9e5adffaf40d3885be16b02de26611ecd1a70a67e2fd51c37a95962d7992854c": "Apache-2.0",
    "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49": "Artistic-1.0-Perl",
    "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060": "BSD-3-Clause",
    "8e146d77002f0b0c280c594f9c222878202fea8dcd2d6b8d97c1e7a07f014d6c": "CC0-1.0",
    "ac575152269666040a46dae0d5d10e71541e20b1a2bc673129c13e709c15eee7": "GFDL-1.2",
    "d96165f6e404292af9837e2b84e69e80af02c6669bf09210c0ecb415baa01f61": "GFDL-1.3",
    "e6b4daef6bcd3066005a66730e642994b80ec0c9604efad03065360ae326efe8": "GPL-1.0",
    "fce03651b4548ae5ecd6f0ba4f8096c030ffd0b366e5f17dbd8e2b4fc5b4f78a": "GPL-1.0",
    "2d78477615f0021dd5650b0ae8e15a87729c41bb0ab17a8ed35eaa1e4bfb6461": "GPL-2.0",
    "d220657ea449f1e8a898adbe967453e672677dd248439bdcdfc901926b470c81": "GPL-2.0",
    "091e64ebe7842b9a50e6ca4881e352332a66f0b96a9a2037db420bc56d6075fa": "GPL-3.0",
    "5c1a24c00306ab78d17bec570ae20ada621eeaea2cd1cee3e8fcd7f068329630": "GPL-3.0",
    "1d422cd7fb8baabea585b0d15ac7f1e77555e6cc043e4c8f6e9fdff6334236ad": "LGPL-2.0",
    "4740eb92befec80ee290aafc818e8a15a3b5af4985d50c4fd393552d9867cabe": "LGPL-2.0",
    "3230d804e366c1b2087fbefa89364ce3ef284a227f57b51911f1632d08ebfacb": "LGPL-2.1",
    "d0c2d37cc5e4014c8812bbc014e7958ca4b03d27bbfed11bcd00f9ca0a4bbf06": "LGPL-2.1",
    "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0": "LGPL-3.0",
    "e384fcedb53f9861b07c3781aef68e594a7978817355df6bb0807e70348bffbb": "MPL-1.1",
    "12dc808a338b60ca91043861092c956c9acb3c4662e4d01410aa2e7bbd14cc0e": "MPL-2.0",
}
# Names in notices.
NAMES: dict[str, list[str]] = {
    "MIT": ["the MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
}
_SUBJECTS, _VERBS = ["", "This work is ", "This program is ", "This software is ", "This file is ", "This document is ", "This text is "], ["licensed under ", "released under ", "distributed under ", "published under ", "available under "]

# Spellings that count as one, in canonical forms, where a hyphen is a space.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("fulfil ", "fulfill "), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("non infring", "noninfring"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"),
    ("practise", "practice"), ("programme ", "program "), ("realis", "realiz"), ("recognis", "recogniz"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
    ("wilfull", "wilful"), ("willful", "wilful"), ("per cent ", "percent "), ("https", "http"),
]
# How licences begin, and placeholders of copyright statements in them.
_OPENERS = [
    "permission is hereby granted", "permission to use copy", "permission is granted to copy", "redistribution and use in source", "this software is provided", "everyone is permitted to copy",
    "this program is free software", "this library is free software", "this program comes with", "this is free and unencumbered", "licensed under the apache license", "boost software license",
]
_HOLDERS = ["year name of author", "19yy name of author", "year your name"]
_ADDRESSES = ["51 franklin st", "51 franklin street", "59 temple place", "675 mass ave"]
_REGENTS = "the regents of the university of california"

# Patterns mean the same in Java and in RE2. _GAP stands between words, whatever the wrapping and the marks of comments.
_GAP = "[^a-z0-9]+"
_spaced = lambda words: words.replace(" ", _GAP)
_FILLED = f"copyright{_GAP}c{_GAP}(?:" + "|".join(map(_spaced, _HOLDERS)) + f"|_{{3,}}[^a-z0-9]*)|" + _spaced("copyright yyyy name of copyright owner") + "|(?:all[^a-z0-9]+)?" + _spaced("rights reserved") + "|" + _spaced(_REGENTS) + "|(?:" + "|".join(map(_spaced, _ADDRESSES)) + ")[^\\x00]{0,60}?[^a-z0-9]usa"
#: A copyright statement before the start of a licence in one paragraph, on its line or not: only the statement goes.
_STATEMENT = "(?:copyright[^a-z0-9]+c[^a-z0-9]|copyright[^a-z0-9]{1,4}[0-9]|©|\\(c\\)[ \\t]*[0-9])[^\\n]{0,150}?(?:\\n[^a-z0-9\\n]*[a-z0-9][^\\n]{0,150}?){0,3}?(?:\\n[^a-z0-9\\n]*)?[^a-z0-9](" + "|".join(map(_spaced, _OPENERS)) + ")"
#: Lines that are statements: the word with a sign, a year, a placeholder or "by" behind it, or a name in capitals.
_LINE = "(?m)^[^a-z0-9\\n]{0,4}(?:copyright[ \\t:]*(?:\\(c\\)|©|[0-9<\\[{]|by )|(?:©|\\(c\\))[ \\t]*(?:copyright|[0-9<\\[{]))[^\\n]*$"
_NAMED = "(?m)^[^A-Za-z0-9\\n]{0,4}Copyright (?:[A-GJKMP-Z]|H[^o\\n]|N[^o\\n]|O[^w\\n]|L[^ai\\n]|I[^n\\n])[a-z][^\\n]*$"
_NOTICED = "(?i)^[^\\n]{0,4}(?:copyright|\\(c\\)|©)[^\\n]*?[^A-Za-z0-9\\x{80}-\\x{10FFFF}]((?:this [a-z]+ is )?(?:licensed|released|distributed|published|available) under [^\\n]*?)(?:[.;,]? *all rights reserved[^\\n]*)?$"
_X = "[^a-z0-9\\x{80}-\\x{10FFFF}]"
#: What becomes one space: all between words, with the numbers and letters of lists there.
_BETWEEN = f"(?:^|{_X}+)(?:(?:[0-9]{{1,2}}|[a-z])[.)]+(?:[ \\t\\r\\n]{_X}*|\\z))+|{_X}+"
#: The same for Java, whose stack a list of some 700 entries would fill: an entry matches in one way only, so none is ever given back.
_BETWEEN_JAVA = _BETWEEN.replace("))+|", "))++|")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The steps for texts that have a mark of copyright, and the marks; the words of texts whose spellings are made one.
_STATED, _MARKS = [(_FILLED, " "), (_STATEMENT, "{1}"), (_LINE, "")], ["copyright", "©", "(c)", "reserved"]
_LEGAL = ["licen", "permi", "warrant"]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _any(text: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def canonical(text: Column) -> Column:
    def stated(low: Column) -> Column:
        out = low
        for pattern, one in _STATED:
            out = F.regexp_replace(out, pattern, one.replace("{1}", "$1"))
        return F.when(_any(low, _MARKS), out).otherwise(low)

    def spelled(form: Column) -> Column:
        out = F.concat(form, F.lit(" "))
        for pattern, one in SPELLINGS:
            out = F.replace(out, F.lit(pattern), F.lit(one))
        return F.when(_any(form, _LEGAL), out).otherwise(form)

    low = F.translate(F.when(F.contains(text, F.lit("Copyright ")), F.regexp_replace(text, _NAMED, "")).otherwise(text), _UPPER, _LOWER)
    return F.trim(_with(F.regexp_replace(_with(low, stated), _BETWEEN_JAVA, " "), spelled))


def digest(text: Column) -> Column:
    form = canonical(text)
    return _with(form, lambda x: F.when(x != "", F.sha2(x, 256)))


def known_texts() -> list[tuple[str, str]]:
    return [(name, text) for name, texts in TEXTS.items() for text in texts]


def known_notices() -> list[tuple[str, str]]:
    return [(name, f"{subject}{verb}{alias}") for name, aliases in NAMES.items() for alias in aliases for subject in _SUBJECTS for verb in _VERBS]


def _digests(spark: SparkSession, known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    rows = spark.createDataFrame(known, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    return sorted({(r.digest, r.license) for r in rows.collect()})  # the fixed lists above


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null) and notices (of lines, sorted, comma-joined) of every row."""
    spark = docs.sparkSession
    texts = sorted(set(_digests(spark, known_texts())) | set(DIGESTS.items()))
    known = F.broadcast(spark.createDataFrame(texts, "digest string, license_id string"))  # the fixed lists above
    lines = F.filter(F.split("text", "\\n"), lambda x: F.lower(x).rlike("under[^a-z0-9\\x{80}-\\x{10FFFF}]"))  # as the canonical form would have "under "
    notices = _digests(spark, known_notices())
    listed = F.from_json(F.lit("{" + ",".join(f'"{d}":"{n}"' for d, n in notices) + "}"), "map<string,string>")
    found = F.array_intersect(F.transform(lines, lambda x: digest(F.regexp_replace(x, _NOTICED, "$1"))), F.array(*(F.lit(d) for d, _ in notices)))
    named = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.element_at(listed, d)))), ",")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(named, F.lit("")).alias("notices"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _canonical_sql(text: str) -> str:
    low = out = f"translate(regexp_replace({text}, '{_NAMED}', '', 'g'), '{_UPPER}', '{_LOWER}')"
    for pattern, one in _STATED:
        out = f"regexp_replace({out}, '{pattern}', '{one.replace('{1}', chr(92) + '1')}', 'g')"
    marked = " OR ".join(f"contains({low}, '{w}')" for w in _MARKS)
    form = f"regexp_replace(CASE WHEN {marked} THEN {out} ELSE {low} END, '{_BETWEEN}', ' ', 'g')"
    out = f"({form} || ' ')"
    for pattern, one in SPELLINGS:
        out = f"replace({out}, '{pattern}', '{one}')"
    legal = " OR ".join(f"contains({form}, '{w}')" for w in _LEGAL)
    return f"trim(CASE WHEN {legal} THEN {out} ELSE {form} END)"


def _values_sql(known: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known)


SCAN_SQL = f"""
WITH texts AS (SELECT license_id, sha256({_canonical_sql('t')}) AS digest FROM (VALUES {_values_sql(known_texts())}) k(license_id, t)
               UNION SELECT license_id, digest FROM (VALUES {_values_sql([(name, d) for d, name in DIGESTS.items()])}) k(license_id, digest)),
notes AS (SELECT DISTINCT license, sha256({_canonical_sql('t')}) AS digest FROM (VALUES {_values_sql(known_notices())}) k(license, t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_canonical_sql('text')} AS form FROM documents),
lines AS (SELECT rid, regexp_replace(line, '{_NOTICED}', '{chr(92)}1') AS line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(lower(line), 'under[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]')),
found AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT rid, license FROM lines JOIN notes ON sha256({_canonical_sql('line')}) = notes.digest) GROUP BY rid)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN texts ON form <> '' AND sha256(form) = texts.digest LEFT JOIN found USING (rid)
"""
