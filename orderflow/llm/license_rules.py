"""Licence recognition by sentence identifiers and ordered rules.

A text's sentences are normalised (lower case, words of letters and digits
only) and mapped to the identifiers of known licence sentences. A rule is a
licence with a sequence of identifiers; it matches where its identifiers
follow each other in order with at most ``max_gap`` other sentences between
two of them. Longer rules come first, and a sentence serves one match.

Sentences end at a full stop, exclamation or question mark before white
space, at a colon that closes a known sentence, and at line ends. In a gap,
bare list numbers don't count and the unknown lines of a sentence are one. A licence sentence may also run over several lines:
neighbouring lines are joined, however many, as long as a known sentence
begins with them. ``<...>`` in a known sentence stands for one to
``SLOT_WORDS`` words of any kind: holders' names, works. Known sentences are
walked through a tree of words, so a text takes time in proportion to its
length, and a rule's search ends at the gap.

Texts without any of the words that every known sentence has one of are
passed over before they reach Python; that filter is exact.

Defined cases: null and empty text has no match; repeated rows are scanned
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate, takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GAP, SLOT_WORDS = 3, 30

# Wording of public licences and notices, and the SPDX names they stand for.
SENTENCES = {
    "ref-mit": "Released under the MIT License.",
    "ref-mit-licensed": "Licensed under the MIT License.",
    "ref-mit-project": "This project is licensed under the MIT License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software.",
    "ref-apache-2": "Licensed under the Apache License, Version 2.0.",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                     "except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "ref-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
                    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ref-cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "ref-cc-by-4": "Licensed under CC BY 4.0.",
    "ref-cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of <the copyright holder> nor the names of <its> contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of <the author> may not be used to endorse or promote products derived from this "
                          "software without specific prior written permission.",
    "bsd-endorse-names": "The names of <its contributors> may not be used to endorse or promote products derived from "
                         "this software without specific prior written permission.",
    "gpl-2-free": "This <program> is free software; you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                  "or (at your option) any later version.",
    "gpl-2-only": "This <program> is free software; you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2-free": "This <library> is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                   "License, or (at your option) any later version.",
    "lgpl-3-free": "This <library> is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                   "License, or (at your option) any later version.",
    "agpl-3-free": "This <program> is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                   "License, or (at your option) any later version.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                 "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is "
                     "hereby granted, provided that the above copyright notice and this permission notice appear in all "
                     "copies.",
    "cc0-waiver": "To the extent possible under law, <the author> has waived all copyright and related or neighboring "
                  "rights to <this work>.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
                  "and to alter it and redistribute it freely, subject to the following restrictions:",
    "ref-bsl-1": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-2": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl-3": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl-3": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-mpl-2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsl": "SPDX-License-Identifier: BSL-1.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "rights-reserved": "All rights reserved.",
}
RULES = [
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("ref-mit",)), ("MIT", ("ref-mit-licensed",)), ("MIT", ("ref-mit-project",)), ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header",)), ("Apache-2.0", ("ref-apache-2",)), ("Apache-2.0", ("spdx-apache-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-3.0-only", ("ref-gpl-3",)), ("GPL-3.0-only", ("spdx-gpl-3",)),
    ("CC-BY-NC-4.0", ("ref-cc-by-nc-4",)), ("CC-BY-4.0", ("ref-cc-by-4",)), ("CC-BY-SA-4.0", ("ref-cc-by-sa-4",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")), ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse-author")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse-names")), ("BSD-2-Clause", ("bsd-redistribution",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)), ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-warranty")), ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-2.0-only", ("gpl-2-only", "gpl-warranty")), ("GPL-2.0-only", ("gpl-2-only",)), ("GPL-2.0-only", ("spdx-gpl-2",)),
    ("GPL-2.0-or-later", ("spdx-gpl-2-later",)), ("GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2-free",)), ("LGPL-2.1-or-later", ("spdx-lgpl-2",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)), ("LGPL-3.0-or-later", ("spdx-lgpl-3",)),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-warranty")), ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("AGPL-3.0-or-later", ("spdx-agpl-3",)), ("MPL-2.0", ("mpl-2-header",)), ("MPL-2.0", ("spdx-mpl-2",)),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-and",)), ("ISC", ("spdx-isc",)),
    ("CC0-1.0", ("cc0-waiver",)), ("CC0-1.0", ("spdx-cc0",)),
    ("Unlicense", ("unlicense-free",)), ("Unlicense", ("spdx-unlicense",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")), ("Zlib", ("zlib-grant",)), ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("bsl-title",)), ("BSL-1.0", ("ref-bsl-1",)), ("BSL-1.0", ("spdx-bsl",)),
    ("all-rights-reserved", ("rights-reserved",)),
]
#: Every known sentence has one of these words (asserted when rules are made ready).
TRIGGERS = ("license", "licensed", "permission", "warranty", "rights", "redistribution", "unencumbered")

_NOT_WORD = re.compile(r"[^a-z0-9]+")
_ENDS = re.compile(r"(?<=[.!?])\s+")
_COLON = re.compile(r"(?<=:)\s+")
_NUMBER = re.compile(r"[0-9]{1,3}")
_SLOT = re.compile(r"<[^>]*>")
#: Marks in the tree that no normalised word equals.
SLOT, END = "<>", "$"


def normalise(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


class Recogniser:
    def __init__(self, sentences: Mapping[str, str] = SENTENCES, rules: Sequence = RULES, max_gap: int = MAX_GAP):
        self.tree: dict = {}  # word or SLOT to the node after it; END to the identifier
        for name, sentence in sentences.items():
            words = [w for fixed in _SLOT.split(sentence) for w in (*normalise(fixed).split(), SLOT)][:-1]
            if not set(TRIGGERS) & set(words):
                raise ValueError(f"without any trigger word: {sentence}")
            if words[0] is SLOT:
                raise ValueError(f"begins with a variable part: {sentence}")
            node = self.tree
            for w in words:
                node = node.setdefault(w, {})
            node[END] = name
        self.before_colon = {name for name, s in sentences.items() if s.endswith(":")}
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.max_gap = max_gap

    @staticmethod
    def _step(states: list[tuple[dict, int]], word: str) -> list[tuple[dict, int]]:
        """The nodes that one more word leads to; with each, the words of a variable part so far (0: none is open)."""
        after = []
        for node, open_ in states:
            if word in node:
                after.append((node[word], 0))
            if 0 < open_ < SLOT_WORDS:
                after.append((node, open_ + 1))
            if not open_ and SLOT in node:
                after.append((node[SLOT], 1))
        return after

    def sentences(self, text: str) -> list[str]:
        """Normalised sentences in order, those that run over lines joined where they make a known one."""
        return [s for s, _, _ in self._counted(text)]

    def _counted(self, text: str) -> list[tuple[str, bool, str | None]]:
        """The sentences, whether each counts as one in a gap, and the identifiers of known ones."""
        parts = []  # words, goes on from a colon, starts a sentence, ends one
        starts = True
        for line in text.split("\n"):
            if not line.strip():
                starts = True
            for s in _ENDS.split(line):
                pieces = [p for x in _COLON.split(s) if (p := normalise(x))]
                ends = s.rstrip().endswith((".", "!", "?"))
                for n, p in enumerate(pieces):
                    parts.append((p, n > 0, starts, ends))
                    starts = ends and n == len(pieces) - 1
        out, k, after_known = [], 0, True
        while k < len(parts):
            used, name = 0, None
            states = [(self.tree, 0)]
            for n in range(1, len(parts) - k + 1):
                for word in parts[k + n - 1][0].split(" "):
                    states = self._step(states, word)
                if not states:
                    break
                here = next((node[END] for node, _ in states if END in node), None)
                if here and (k + n == len(parts) or not parts[k + n][1] or here in self.before_colon):
                    used, name = n, here
            known = used > 0
            if not known:
                used = next((n for n in range(1, len(parts) - k) if not parts[k + n][1]), len(parts) - k)
            words = " ".join(p[0] for p in parts[k:k + used])
            out.append((words, known or not _NUMBER.fullmatch(words) and (after_known or parts[k][2]), name))
            after_known = known or bool(_NUMBER.fullmatch(words))
            k += used
        return out

    def scan(self, text: str | None) -> list[tuple[str, int]]:
        """(licence, number of its first sentence), in order of the text."""
        counted = self._counted(text or "")
        place = list(accumulate(c for _, c, _ in counted))
        known = [(n, name) for n, (_, _, name) in enumerate(counted) if name]
        taken, found = set(), []
        for licence, rule in self.rules:
            for k, (first, name) in enumerate(known):
                if k in taken or name != rule[0]:
                    continue
                used, at = [k], first
                for wanted in rule[1:]:
                    near = takewhile(lambda j: place[known[j][0]] - place[at] <= self.max_gap + 1,  # noqa: B023
                                     range(used[-1] + 1, len(known)))
                    after = next((j for j in near if j not in taken and known[j][1] == wanted), None)
                    if after is None:
                        break
                    used.append(after)
                    at = known[after][0]
                if len(used) == len(rule):
                    taken.update(used)
                    found.append((licence, first))
        return sorted(found, key=lambda f: (f[1], f[0]))


def _scan(recogniser: Recogniser) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [recogniser.scan(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "licenses": [[x for x, _ in f] for f in found],
                                "sentences": [[n for _, n in f] for f in found]})

    return run


def scan_licenses(docs: DataFrame, recogniser: Recogniser | None = None, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, licenses, sentences) of every row: its matches in order and the numbers of their first sentences."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    low = F.lower("text")
    may = F.coalesce(F.greatest(*[low.contains(t) for t in TRIGGERS]), F.lit(False))
    return (rows.select("doc_id", F.when(may, F.col("text")).otherwise("").alias("text"))
            .mapInPandas(_scan(recogniser or Recogniser()),
                         "doc_id long, licenses array<string>, sentences array<int>"))
