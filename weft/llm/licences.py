"""Licence recognition by sentences: normalised sentences become identifiers, identifier sequences meet ordered rules.

DataFrame functions only, row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room

#: How a licence is announced, and the names it goes by (versions and articles are normalised away).
LEADS = (
    "licensed under", "released under", "distributed under", "published under", "available under", "code released under", "dual licensed under",
    "this work is licensed under", "this software is licensed under", "this project is licensed under", "this file is licensed under", "this program is licensed under",
    "this work is released under", "this software is released under", "this project is released under", "this document is licensed under", "content is available under",
    "spdx license identifier", "license",
)
NAMES = {
    "MIT": ("MIT", "MIT License", "terms of the MIT License", "Expat License"),
    "Apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "terms of the Apache License, Version 2.0"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC", "ISC License"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "CC0"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
#: Sentences of licence texts and notices.
SENTENCES = {
    "reserved": ("All rights reserved.",),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-lead": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-name": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-law": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "gpl2-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "mpl2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl2-grant": ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",),
    "apache-copyright": ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",),
    "apache-redistribute": ("You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",),
    "gnu-copy": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",),
    "gpl2-preamble": ("The licenses for most software are designed to take away your freedom to share and change it.",),
    "gpl3-preamble": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "lgpl2-preamble": ("This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",),
    "lgpl3-terms": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    "lgpl2-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "agpl3-preamble": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "agpl3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "epl2-agreement": ('THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',),
    "epl2-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",),
    "cc0-waiver": ("To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action, whether now known or unknown (including existing as well as future claims and causes of action), in the Work.",),
    **{f"cc-{key}-legal": (f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License ("Public License").',) for key, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"))},
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "boost-grant": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
}
#: Ordered rules: licence and the identifiers that must follow one another.  What a longer match holds a shorter one does not claim.
TEXT_RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd-lead", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-lead", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("notice-Apache-2.0", "apache-comply", "apache-law")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl2-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("Apache-2.0", ("apache-copyright",)),
    ("Apache-2.0", ("apache-redistribute",)),
    ("GPL-2.0", ("gnu-copy", "gpl2-preamble")),
    ("GPL-2.0", ("gpl2-preamble",)),
    ("GPL-3.0", ("gnu-copy", "gpl3-preamble")),
    ("GPL-3.0", ("gpl3-preamble",)),
    ("LGPL-2.1", ("lgpl2-preamble",)),
    ("LGPL-3.0", ("gnu-copy", "lgpl3-terms")),
    ("LGPL-3.0", ("lgpl3-terms",)),
    ("AGPL-3.0", ("gnu-copy", "agpl3-preamble")),
    ("AGPL-3.0", ("agpl3-preamble",)),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2-grant",)),
    ("EPL-2.0", ("epl2-agreement",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC-BY-4.0", ("cc-by-legal",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-legal",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-legal",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-legal",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-legal",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense",)),
    ("proprietary", ("reserved",)),
]
RULES = [*TEXT_RULES, *((name, (f"notice-{name}",)) for name in NAMES)]

#: Each step of normalisation: pattern and replacement ({1} is the first group).
STEPS = [
    (r"licence", "license"),
    (r"[^a-z0-9.]+", " "),
    (r"\.+( |$)", "{1}"),
    (r" (?:version|v\.?) ?([0-9])", " {1}"),
    (r"(^| )the ", "{1}"),
    (r"([0-9])\.0( |$)", "{1}{2}"),
]
#: Every sentence of the catalogue holds one of these, in one line or wrapped.
KEYWORDS = "(?i)" + "|".join(
    k.replace(" ", "[^A-Za-z0-9]+")
    for k in ("licen[sc]", "released", "distributed", "published", "available", "rights reserved", "permission", "redistribut", "warrant", "spdx", "public domain", "in no event", "neither the name", "copyright", "free software", "compliance with", "derivative works")
)
#: Labels lose their colon, which would end a sentence.
LABEL = r"(?i)(identifier|licen[sc]e):"
#: A line of nothing but comment signs ends a sentence; other line breaks wrap it.
EMPTY_LINE = r"^[ \t*#/]*$"
#: A sentence ends after these marks before white space.
ENDS = r"(?<=[.!?;:])\s+"


def normalise(s: str) -> str:
    s = s.lower()
    for pattern, to in STEPS:
        s = re.sub(pattern, to.replace("{1}", r"\1").replace("{2}", r"\2"), s)
    return s.strip()


def normal(s: Column) -> Column:
    s = F.lower(s)
    for pattern, to in STEPS:
        s = F.regexp_replace(s, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return F.trim(s)


def _pieces(sentence: str) -> list[str]:
    return [x for x in (normalise(p) for p in re.split(ENDS, sentence)) if x]


def catalogue() -> dict[str, str]:
    """Normalised sentence and its identifier: announcements by lead and name, and the sentences of texts.

    A sentence of a text that itself holds an end mark is known by its longest part.
    """
    out = {normalise(f"{lead} {name}"): f"notice-{key}" for key, names in NAMES.items() for name in names for lead in LEADS}
    for key, forms in SENTENCES.items():
        for form in forms:
            out[max(_pieces(form), key=len)] = key
    return out


#: Marks that no text keeps: between runs of lines, and before the identifier of a sentence that is known already.
BREAK, KNOWN = "\x01", "\x02"


class _Catalogue:
    """Lookup of a sentence: set membership rules nearly all out, the place in the list names the rest."""

    def __init__(self):
        known = catalogue()
        self.texts, self.ids, self.keys = F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())), list(known)

    def identifier(self, unit: Column) -> Column:
        """Identifier of a known sentence, else null."""
        found = lambda n: F.when(n.isin(*self.keys), F.element_at(self.ids, F.array_position(self.texts, n).cast("int")))
        return F.when(unit.rlike(KEYWORDS), F.element_at(F.transform(F.array(normal(unit)), found), 1))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences in order.

    Each line is read by itself first.  What a line does not settle is read again with the lines around it
    as one run, for sentences that are wrapped; runs end at empty lines and at sentences that a line settled.
    """
    book = _Catalogue()
    text = F.translate(F.regexp_replace(text, LABEL, "$1"), BREAK + KNOWN, "  ")
    marked = lambda u: F.element_at(F.transform(F.array(book.identifier(u)), lambda k: F.when(k.isNotNull(), F.concat(F.lit(BREAK + KNOWN), k, F.lit(BREAK))).otherwise(u)), 1)
    line = lambda x: F.when(x.rlike(EMPTY_LINE), BREAK).otherwise(F.array_join(F.transform(F.split(x, ENDS), marked), " "))
    runs = F.split(F.array_join(F.transform(F.split(text, "\n"), line), " "), BREAK)
    wrapped = lambda x: F.filter(F.transform(F.split(x, ENDS), book.identifier), lambda k: k.isNotNull())
    ids = F.flatten(F.transform(runs, lambda x: F.when(x.startswith(KNOWN), F.array(F.substr(x, F.lit(2), F.length(x)))).otherwise(wrapped(x))))
    return F.when(text.rlike(KEYWORDS), ids).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """Licences whose rules match the identifier sequence, in the order of the rules."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f";{i}" for i in seq) + ";").alias("seq")) for name, seq in RULES))
    line = F.concat(F.lit(";"), F.array_join(ids, ";"), F.lit(";"))
    found = F.filter(rules, lambda r: F.contains(line, r["seq"]))
    whole = F.element_at(F.transform(F.array(found), lambda m: F.filter(m, lambda r: ~F.exists(m, lambda q: (q["seq"] != r["seq"]) & F.contains(q["seq"], r["seq"])))), 1)
    return F.when(F.size(ids) > 0, F.array_distinct(F.transform(whole, lambda r: r["name"]))).otherwise(F.array().cast("array<string>"))


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licences (arrays, empty where nothing is recognised).

    Columns of the input with one of these names become ``input_<name>``.

    * Null and empty texts have none; repeated sentences repeat in sentence_ids and count once in licences; repeated
      rows come out alike.  No rows give an empty result.  Other columns pass unread.
    * Work is by row, within a text of any length, and no rows move.
    """
    docs = make_room(docs, "sentence_ids", "licences")
    rows = docs.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("licences", matched(F.col("sentence_ids")))
