"""Licences by their sentences: known sentences become identifiers, and rules are sequences of identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from factsheet.llm.common import map_text

# Sentences of public licences and notices, and the licences that their sequences stand for.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT).",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-comply": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
RULES: dict[str, list[tuple[str, ...]]] = {
    "MIT": [("mit-notice",), ("mit-licensed",), ("mit-grant", "mit-condition"), ("mit-title", "mit-grant", "mit-condition", "as-is-software"), ("mit-grant", "mit-condition", "as-is-software")],
    "Apache-2.0": [("apache2-notice",), ("apache2-header", "apache2-comply"), ("apache2-header", "apache2-comply", "apache2-copy")],
    "GPL-2.0": [("gpl2-notice",), ("gpl-free", "gpl2-terms")],
    "GPL-3.0": [("gpl3-notice",), ("gpl-free", "gpl3-terms")],
    "BSD-2-Clause": [("bsd-grant", "bsd-source", "bsd-binary")],
    "BSD-3-Clause": [("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")],
    "ISC": [("isc-grant",)],
}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        _name = f"CC-{_kind}-{_version}"
        SENTENCES[_name.lower()] = f"Licensed under CC {_kind} {_version}."
        RULES[_name] = [(_name.lower(),)]

#: Versions of the GNU licences: identifier, title, version as in notices, and its heading.
_GNU = (
    ("GPL-2.0", "GNU General Public License", "2", "Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "Version 3, 19 November 2007"),
)
for _name, _title, _version, _heading in _GNU:
    _lead = f"you can redistribute it and/or modify it under the terms of the {_title}"
    _forms = {
        "heading": f"{_title} {_heading}",
        "terms": f"{_lead} as published by the Free Software Foundation; either version {_version} of the License, or (at your option) any later version.",
        "only": f"{_lead} as published by the Free Software Foundation, version {_version} of the License.",
        "only-short": f"{_lead} as published by the Free Software Foundation, version {_version}.",
        "only-before": f"{_lead} version {_version} as published by the Free Software Foundation.",
        "only-plain": f"{_lead}, version {_version}.",
    }
    _short = _name.lower().removesuffix(".0").replace("-", "").replace(".", "")
    for _kind, _text in _forms.items():
        SENTENCES.setdefault(f"{_short}-{_kind}", _text)
        RULES.setdefault(_name, []).append((f"{_short}-{_kind}",))
        if _kind != "heading":
            for _free in ("gpl-free", "library-free", "software-free", "file-free"):
                if (_free, f"{_short}-{_kind}") not in RULES[_name]:
                    RULES[_name].append((_free, f"{_short}-{_kind}"))

#: Sentences that stand for a licence alone: of its text, so that one without title or appendix counts too, or of its notice.
ALONE: dict[str, tuple[str, str]] = {
    "apache2-grant": ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    "gpl2-applies": ("GPL-2.0", "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    "gpl3-refers": ("GPL-3.0", "\"This License\" refers to version 3 of the GNU General Public License."),
    "agpl3-refers": ("AGPL-3.0", "\"This License\" refers to version 3 of the GNU Affero General Public License."),
    "lgpl21-applies": ("LGPL-2.1", "This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called \"this License\")."),
    "lgpl3-incorporates": ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "mpl2-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "mpl2-heading": ("MPL-2.0", "Mozilla Public License Version 2.0"),
    "mpl2-means": ("MPL-2.0", "means Covered Software of a particular Contributor."),
    "mpl11-notice": ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");"),
    "mpl11-heading": ("MPL-1.1", "Mozilla Public License Version 1.1"),
    "epl1-heading": ("EPL-1.0", "Eclipse Public License - v 1.0"),
    "epl1-terms": ("EPL-1.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    "epl1-notice": ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "epl2-heading": ("EPL-2.0", "Eclipse Public License - v 2.0"),
    "epl2-notice": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    "cc0-heading": ("CC0-1.0", "CC0 1.0 Universal"),
    "cc0-laws": ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
    "unlicense-free": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "wtfpl-heading": ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    "bsl1-heading": ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "bsl1-grant": ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    "bsl1-notice": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
}
for _key, (_name, _text) in ALONE.items():
    SENTENCES[_key] = _text
    RULES.setdefault(_name, []).append((_key,))

SENTENCES |= {
    "library-free": "This library is free software;",
    "software-free": "This software is free software;",
    "file-free": "This file is free software;",
    "apache2-heading": "Apache License Version 2.0, January 2004",
    "apache2-heading-url": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache2-use": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsd-names-owner": "Neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-and-or": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}
_BSD = ("bsd-grant", "bsd-source", "bsd-binary")
RULES["Apache-2.0"] += [("apache2-heading",), ("apache2-heading", "apache2-use"), ("apache2-heading-url",), ("apache2-heading-url", "apache2-use")]
RULES["Zlib"] = [("zlib-grant",), ("zlib-liable", "zlib-grant"), ("zlib-warranty", "zlib-liable", "zlib-grant")]
RULES["BSD-3-Clause"] += [(*_BSD, "bsd-names-owner"), (*_BSD, "bsd-names-university")]
RULES["BSD-4-Clause"] = [(*_BSD, "bsd-ads"), *((*_BSD, "bsd-ads", x) for x in ("bsd-names", "bsd-names-owner", "bsd-names-university"))]
RULES["ISC"] += [("isc-and-or",)]
RULES["0BSD"] = [("0bsd-grant",)]

#: What one-line notices call a licence; "the" before and "license" after may be absent.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT/X11", "Expat", "MIT open source"],
    "Apache-2.0": ["Apache 2.0", "Apache 2", "Apache-2.0", "Apache License 2.0", "Apache License 2", "Apache License, Version 2.0", "Apache License, Version 2", "Apache License v2.0", "Apache License v2", "Apache v2", "ASL 2.0", "Apache Software License 2.0", "Apache Software License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "two-clause BSD", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "three-clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD 3-Clause New or Revised"],
    "BSD-4-Clause": ["BSD 4-Clause", "4-Clause BSD", "Original BSD"],
    "ISC": ["ISC"],
    "0BSD": ["0BSD", "Zero-Clause BSD", "BSD Zero Clause"],
    "Zlib": ["zlib", "zlib/libpng"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public"],
    "EPL-1.0": ["EPL 1.0", "EPL v1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["EPL 2.0", "EPL v2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"],
    "MPL-1.1": ["MPL 1.1", "MPL v1.1", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"],
    "MPL-2.0": ["MPL 2.0", "MPL v2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero 1.0", "Creative Commons CC0", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
}
for _name, _title, _version, _ in _GNU:
    _short = _name.partition("-")[0]
    for _shown in {_version, _version if "." in _version else _version + ".0"}:
        for _tail in ("", " or later", " or any later version", " or (at your option) any later version", "+", " only"):
            for _form in ("{} {}", "{} v{}", "{}v{}", "{}, version {}"):
                for _called in (_short, _title, f"GNU {_short}"):
                    NAMES.setdefault(_name, []).append(_form.format(_called, _shown) + _tail)
_PARTS = {"BY": ["Attribution"], "SA": ["ShareAlike", "Share Alike"], "NC": ["NonCommercial", "Non-Commercial"], "ND": ["NoDerivatives", "NoDerivs", "No Derivatives"]}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _spelled = [""]
    for _part in _kind.split("-"):
        _spelled = [f"{x} {y}" for x in _spelled for y in _PARTS[_part]]
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _name = f"CC-{_kind}-{_version}"
        for _called in (f"CC {_kind}", f"Creative Commons {_kind}", *(f"Creative Commons{x}" for x in _spelled)):
            NAMES.setdefault(_name, []).extend([f"{_called} {_version}", f"{_called} {_version} {_port}", f"{_called} {_version} {_port} Public"])
        if _version == "4.0":
            SENTENCES[f"{_name.lower()}-accept"] = f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons{_spelled[0]} 4.0 International Public License (\"Public License\")."
            RULES[_name].append((f"{_name.lower()}-accept",))
#: How such a notice begins.
_VERBS = ("licensed", "dual licensed", "released", "distributed", "available", "made available", "published", "provided")
LEADS = [f"{who} {verb} under{terms}{which}" for who in ("", *(f"{this} {x} is" for this in ("this", "the") for x in ("work", "project", "software", "program", "code", "source code", "file", "document", "documentation", "library", "package", "module", "repository", "dataset", "text", "article", "content"))) for verb in _VERBS for terms in ("", " the terms of") for which in ("", " both", " either", " either of")]
_HINT = re.compile(rf"(?:{'|'.join(_VERBS)})\W+under\b")

_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
_SPDX_PART = re.compile(r"[()]|[\w.+-]*\w\+?")
#: Identifiers in lower case; -only, -or-later and + are cut before.
_SPDX_NAMES = {x.lower(): x for x in (*RULES, *NAMES)}

_WORD = re.compile(r"[^\W_]+")
#: What may stand between two words: the end of a sentence, quotes and brackets closed after it, or a line.
_BOUNDARY = re.compile(r"[.!?:;][\"'\u201d\u2019\u00bb)\]}*]*(?=\s|$)|\n")


def declared(expression: str) -> list[tuple[str, int, int]]:
    """The covered licences of an SPDX expression, with their characters; what follows the expression is left alone."""
    out, ready = [], True
    for m in _SPDX_PART.finditer(expression):
        part = m[0].lower()
        if part in "()":
            continue
        if part in ("and", "or", "with"):
            ready = part if not ready else ready
            continue
        if not ready:
            break
        name = re.sub(r"(-only|-or-later|\+)$", "", part)
        if ready != "with" and name in _SPDX_NAMES:
            out.append((_SPDX_NAMES[name], m.start(), m.end()))
        ready = False
    return out


def normal(sentence: str) -> tuple[str, ...]:
    """A sentence as its words without case, so that marks, wrapping and spacing do not count."""
    return tuple(w.casefold() for w in _WORD.findall(sentence))


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    ends: str | None = None


class Scanner:
    """Known sentences as a tree of words, rules as a tree of their identifiers, and one-line notices as two trees.

    A notice is one of ``LEADS`` and one of ``names``, or several joined by "or" or "and". It, and each
    licence that an SPDX line declares, is a rule of its own.
    """

    def __init__(self, sentences: Mapping[str, str] = SENTENCES, rules: Mapping[str, Iterable[Sequence[str]]] = RULES, gap: int = 2, names: Mapping[str, Iterable[str]] = NAMES) -> None:
        self.gap, self.words, self.rules, self.leads, self.names = gap, Node(), Node(), Node(), Node()
        for lead in LEADS:
            self._add(self.leads, normal(lead), "lead")
        for licence, called in names.items():
            for name in called:
                for path in (normal(name), *(normal(f"{name} {x}") for x in ("License", "Licence"))):
                    self._add(self.names, path, licence)
        for licence in {*rules, *names}:
            self._add(self.rules, ("notice:" + licence,), licence)
            self._add(self.rules, ("spdx:" + licence,), licence)
        for name, text in sentences.items():
            self._add(self.words, normal(text), name)
        for licence, sequences in rules.items():
            for sequence in sequences:
                self._add(self.rules, sequence, licence)
        self.anchors = self._anchors([normal(t) for t in sentences.values()])

    @staticmethod
    def _add(root: Node, path: Iterable[str], end: str) -> None:
        for step in path:
            root = root.next.setdefault(step, Node())
        if root.ends is None:
            root.ends = end

    @staticmethod
    def _anchors(sentences: list[tuple[str, ...]]) -> list[str]:
        """Words, long ones first, of which every sentence has one: a text without any of them has no sentence."""
        chosen: list[str] = []
        left = [set(s) for s in sentences]
        while left:
            best = max({w for s in left for w in s}, key=lambda w: (sum(w in s for s in left) * min(len(w), 8), w))
            chosen.append(best)
            left = [s for s in left if best not in s]
        return chosen

    def sentences(self, text: str) -> list[tuple[str, int, int, int]]:
        """Known sentences in order: identifier, first and last character, and the number of the sentence.

        One begins after the end of a sentence or line, or at the start, and ends before one; it may run over
        lines. Of those that begin at a word, the longest counts.
        """
        folded = text.casefold()
        tagged = {}
        if "spdx" in folded:
            tagged = {m.start(): (m.end(), [(name, m.start(1) + a, m.start(1) + b) for name, a, b in declared(m[1])]) for m in _SPDX.finditer(text)}
        if not tagged and not any(a in folded for a in self.anchors) and not _HINT.search(folded):
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b].casefold() for a, b in spans]
        edges = [True, *(bool(_BOUNDARY.search(text, a, b + 1)) for (_, a), (b, _) in zip(spans, spans[1:])), True]
        found, i, number = [], 0, 0
        while i < len(words):
            number += edges[i]
            if spans[i][0] in tagged:
                stop, names = tagged[spans[i][0]]
                found.extend(("spdx:" + name, a, b, number) for name, a, b in names)
                i += 1
                while i < len(words) and spans[i][0] < stop:
                    number += edges[i]
                    i += 1
                continue
            node, j, end = self.words, i, None
            while edges[i] and j < len(words) and (node := node.next.get(words[j])) is not None:
                j += 1
                if node.ends is not None and edges[j]:
                    end = (j, node.ends)
            stop, named = self._notice(words, edges, i) if edges[i] else (i, [])
            if stop > (end[0] if end else i):
                found.extend(("notice:" + name, spans[i if k == 0 else a][0], spans[b - 1][1], number) for k, (name, a, b) in enumerate(named))
                i = stop
            elif end:
                found.append((end[1], spans[i][0], spans[end[0] - 1][1], number))
                i = end[0]
            else:
                i += 1
        return found

    def _notice(self, words: list[str], edges: list[bool], i: int) -> tuple[int, list[tuple[str, int, int]]]:
        """Where the notice that begins at word ``i`` ends, and its licences with their words; none if it is none."""
        node, j, begins = self.leads, i, []
        while j < len(words) and (node := node.next.get(words[j])) is not None:
            j += 1
            if node.ends:
                begins.append(j)
        for at in reversed(begins):
            named: list[tuple[str, int, int]] = []
            while True:
                at += at < len(words) and words[at] in ("the", "a", "an")
                node, j, end = self.names, at, None
                while j < len(words) and (node := node.next.get(words[j])) is not None:
                    j += 1
                    if node.ends is not None:
                        end = (j, node.ends)
                if end is None:
                    break
                named.append((end[1], at, end[0]))
                at = end[0]
                stop = at + 3 if words[at : at + 3] == ["at", "your", "option"] else at
                if edges[stop]:
                    return stop, named
                if words[at] not in ("or", "and"):
                    break
                at += 2 if words[at : at + 2] == ["and", "or"] else 1
        return i, []

    def licences(self, text: str | None) -> list[tuple[str, int, int]]:
        """Licence and characters of every match, in order; from each sentence the longest rule, then on behind it.

        The sentences of a rule follow one another with at most ``gap`` unknown ones between.
        """
        known, out, i = self.sentences(text or ""), [], 0
        while i < len(known):
            node, j, end = self.rules, i, None
            while j < len(known) and (j == i or known[j][3] - known[j - 1][3] <= self.gap + 1) and (node := node.next.get(known[j][0])) is not None:
                j += 1
                if node.ends is not None:
                    end = (j, node.ends)
            if end:
                out.append((end[1], known[i][1], known[end[0] - 1][2]))
                i = end[0]
            else:
                i += 1
        return out


def scan(documents: DataFrame, scanner: Scanner | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``licences``: an array of licence, ``begins`` and ``ends`` (characters) of every match.

    Whole texts are scanned; null and empty ones have an empty array. Repeated rows are scanned each; other
    columns play no part, and one named ``licences`` is replaced.
    """
    scanner = scanner or Scanner()

    def run(texts):
        return [[[{"licence": a, "begins": b, "ends": c} for a, b, c in scanner.licences(t)] for t in texts]]

    return map_text(documents, "licences array<struct<licence: string, begins: long, ends: long>>", run, keep)
