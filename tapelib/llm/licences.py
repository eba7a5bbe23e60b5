"""Licence scans by sentence rules, in SQL functions only: sentences are normalised, known ones become identifiers, and the
identifiers of a text, in order, are matched against ordered licence rules.  No row moves and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz "

# Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "mit-name": "Released under the MIT License",
    "mit-name-2": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-org": "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-owner": "Neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "library-free": "This library is free software",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "later-2": "either version 2 of the License, or (at your option) any later version",
    "only-2": "version 2 of the License",
    "later-21": "either version 2.1 of the License, or (at your option) any later version",
    "only-21": "version 2.1 of the License",
    "later-3": "either version 3 of the License, or (at your option) any later version",
    "only-3": "version 3 of the License",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl2-only-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "gpl3-only-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl2-only-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License",
    "gpl3-only-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mit-name-3": "Licensed under the MIT license (see LICENSE)",
    "mit-name-4": "This project is licensed under the MIT License",
    "mit-name-5": "Distributed under the MIT License",
    "apache-name-2": "This project is licensed under the Apache License, Version 2.0",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl-name": "Distributed under the Boost Software License, Version 1.0",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "cddl-terms": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "gpl1-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 1, or (at your option) any later version",
    "later-1": "either version 1, or (at your option) any later version",
    "lgpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "spdx": "SPDX-License-Identifier",
    **{f"spdx-{x}": x for x in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "EPL-2.0", "Zlib", "BSL-1.0", "CDDL-1.0", "CC0-1.0", "Unlicense")},
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
}

# Licence, and the sentences that say so when they follow one another (sentences not known may stand between).
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-2"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-as-is"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    *[("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", x]) for x in ("bsd-endorse-org", "bsd-endorse-owner", "bsd-endorse-university")],
    *[(f"GPL-{n}.0-or-later", ["gpl-free", "gpl-terms", f"later-{n}"]) for n in (2, 3)],
    *[(f"GPL-{n}.0-only", ["gpl-free", x]) for n in (2, 3) for x in (f"gpl{n}-only", f"gpl{n}-only-2", f"gpl{n}-only-3")],
    *[(f"GPL-{n}.0-only", ["gpl-free", "gpl-terms", f"only-{n}"]) for n in (2, 3)],
    *[(f"LGPL-{name}-or-later", [x, *ids]) for name, n in (("2.1", "21"), ("3.0", "3")) for x in ("library-free", "gpl-free") for ids in ([f"lgpl{n}-later"], ["lgpl-terms", f"later-{n}"])],
    *[(f"LGPL-{name}-only", [x, "lgpl-terms", f"only-{n}"]) for name, n in (("2.1", "21"), ("3.0", "3")) for x in ("library-free", "gpl-free")],
    *[("AGPL-3.0-or-later", ["gpl-free", *ids]) for ids in (["agpl3-later"], ["agpl-terms", "later-3"])],
    ("MPL-2.0", ["mpl-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl-form", "mpl2-copy-2"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant-2", "isc-as-is"]),
    *[("MIT", [x]) for x in ("mit-name-3", "mit-name-4", "mit-name-5")],
    ("Apache-2.0", ["apache-name-2"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("EPL-1.0", ["epl1"]),
    *[("EPL-2.0", [x]) for x in ("epl2", "epl2-2")],
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    *[("BSL-1.0", [x]) for x in ("bsl-name", "bsl-grant")],
    ("CDDL-1.0", ["cddl-terms"]),
    ("GPL-1.0-or-later", ["gpl-free", "gpl1-later"]),
    ("GPL-1.0-or-later", ["gpl-free", "gpl-terms", "later-1"]),
    ("LGPL-2.0-or-later", ["library-free", "lgpl2-terms", "later-2"]),
    *[(key.removeprefix("spdx-"), ["spdx", key]) for key in SENTENCES if key.startswith("spdx-")],
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
]
#: A licence that is not reported for sentences that are part of the other one.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}
#: A line that starts with a capital and a small letter or space may start a sentence, or go on with a wrapped one; marks before white space, and an empty line, end a sentence.
LINE, ENDS, OTHER = "\\n([A-Z][a-z ])", "[.;:!?]+([ \\t\\r\\n]|\\z)|\\n[ \\t\\r]*\\n", "[^a-z0-9|]+"
#: In normalised texts, a line that may start a sentence.
WRAP = "\x01"


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def normalised(text: Column) -> Column:
    """A text's words between ``|``, where a sentence ends, and ``WRAP``."""
    lines = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), WRAP, " "), LINE, "\n" + WRAP + "$1")
    marked = F.regexp_replace(F.translate(lines, UPPER, LOW), ENDS, "|")
    words = F.regexp_replace(marked, OTHER.replace("|", "|" + WRAP), " ")
    whole = F.concat(F.lit("|"), F.regexp_replace(words, f" *{WRAP}[ {WRAP}]*", WRAP), F.lit("|"))  # with the outer marks, so that spaces beside them go too
    return F.regexp_replace(whole, f"[ {WRAP}]*[|][ |{WRAP}]*", "|")


def scan(df: DataFrame, text_col: str = "text", known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, within: dict[str, str] = WITHIN) -> DataFrame:
    """Each row of ``df`` as the struct ``doc`` with ``n_sentences, sentence_ids`` (known ones, in order; they may be wrapped
    over lines) and ``licences`` (sorted).  Null and empty texts have no sentences and no licence; repeated rows get equal
    results."""
    plain = {_plain(s): key for key, s in known.items()}
    ids = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])
    one = "|".join(s.replace(" ", f"[ {WRAP}]") for s in sorted(plain, key=len, reverse=True))
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), normalised(F.col(text_col)).alias("t"))
    count = F.size(F.filter(F.split("t", f"[|{WRAP}]"), lambda s: F.trim(s) != ""))
    hits = F.regexp_extract_all("t", F.lit(f"(?<=[|{WRAP}])({one})(?=[|{WRAP}])"), F.lit(1))
    found = found.select("doc", count.cast("long").alias("n_sentences"), F.transform(hits, lambda s: F.element_at(ids, F.translate(s, WRAP, " "))).alias("sentence_ids"))
    run = lambda x: "," + ",,".join(x) + ","

    def says(name: str, x: list[str]) -> Column:
        line = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
        for other, longer in rules:
            if within.get(name) == other:
                line = F.replace(line, F.lit(run(longer)), F.lit("|"))
        return F.when(line.contains(run(x)), F.lit(name))

    licences = F.array_sort(F.array_distinct(F.filter(F.array(*[says(*r) for r in rules]), lambda x: x.isNotNull())))
    return found.select("doc", "n_sentences", "sentence_ids", licences.alias("licences"))
