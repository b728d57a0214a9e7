"""Whole standard licence texts, wrapped and on one line."""

import random
import textwrap
import time

import pytest

from orderflow.llm.license_rules import RULES, SENTENCES, SLOT_WORDS, Recogniser

DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
              "WARRANTIES ARE DISCLAIMED.")
BSD2 = ["Copyright (c) 2020, A. Writer", SENTENCES["bsd-redistribution"],
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."]
BSD3 = [*BSD2, "3. " + SENTENCES["bsd-endorse"]]
MIT = ["Copyright (c) 2020 A. Writer", SENTENCES["mit-grant"], SENTENCES["mit-notice"]]


@pytest.mark.parametrize("paragraphs, licence", [(BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (MIT, "MIT")])
@pytest.mark.parametrize("width", [60, 78, 200, None])
def test_standard_texts(paragraphs, licence, width):
    every = [*paragraphs, DISCLAIMER]
    text = " ".join(every) if width is None else "\n\n".join(textwrap.fill(p, width) for p in every)
    if width is None:  # the copyright line has no full stop of its own
        text = text.replace("Writer", "Writer.")
    assert [x for x, _ in Recogniser().scan(text)] == [licence]


def test_colon_cuts_only_where_it_closes_a_known_sentence():
    r = Recogniser()
    assert r.sentences("Note: this is: one. SPDX-License-Identifier: MIT") == ["note this is one", "spdx license identifier mit"]
    assert [x for x, _ in r.scan("SPDX-License-Identifier: MIT")] == ["MIT"]
    assert r.scan("Released under the MIT License: not so.") == []


def test_gap_still_ends():
    far = "\n".join(f"Sentence number {w} is here." for w in ("one", "two", "three", "four"))
    assert [x for x, _ in Recogniser().scan(f"{SENTENCES['bsd-redistribution']}\n{far}\n{SENTENCES['bsd-endorse']}")] \
        == ["BSD-2-Clause"]


@pytest.mark.parametrize("width", [1, 12])
def test_narrow_columns(width):
    for name, licence in (("mit-grant", "MIT"), ("gpl-free", "GPL-3.0-or-later")):
        text = SENTENCES[name] + (" " + SENTENCES["mit-notice"] if licence == "MIT" else "")
        assert [x for x, _ in Recogniser().scan(textwrap.fill(text, width, break_long_words=False))] == [licence]


def licences(text):
    return [x for x, _ in Recogniser().scan(text)]


@pytest.mark.parametrize("holder, whose", [("Google Inc.", "its"), ("Example Inc", "its"), ("the <organization>", "its"),
                                           ("the copyright holder", "its"), ("The Regents of the University of X", "the University's")])
@pytest.mark.parametrize("width", [60, None])
def test_bsd_3_of_any_holder(holder, whose, width):
    endorse = (f"3. Neither the name of {holder} nor the names of {whose} contributors may be used to endorse or promote "
               "products derived from this software without specific prior written permission.")
    every = [*BSD2[1:], endorse, DISCLAIMER]
    text = " ".join(every) if width is None else "\n\n".join(textwrap.fill(p, width) for p in every)
    assert licences(text) == ["BSD-3-Clause"]


def test_a_variable_part_has_a_bound():
    parts = SENTENCES["bsd-endorse"].replace("<its>", "its").split("<the copyright holder>")
    for n, want in ((SLOT_WORDS, ["BSD-3-Clause"]), (SLOT_WORDS + 1, ["BSD-2-Clause"])):
        assert licences(SENTENCES["bsd-redistribution"] + "\n" + (" b" * n).strip().join(parts)) == want


@pytest.mark.parametrize("names, licence", [(r, x) for x, r in RULES])
@pytest.mark.parametrize("width", [40, None])
def test_every_rule_alone(names, licence, width):
    every = [SENTENCES[n].replace("<", "").replace(">", "") for n in names]
    text = " ".join(s if s.endswith((".", ":")) else s + "\n" for s in every) if width is None \
        else "\n\n".join(textwrap.fill(s, width) for s in every)
    assert licences("Some words first.\n" + text + "\nAnd some words after.") == [licence]


def plain_scan(r, counted):
    """Every rule at every known sentence, longest rules first; the next wanted sentence is the first free one in the gap."""
    taken, found = set(), []
    for licence, rule in r.rules:
        for k, (_, _, name) in enumerate(counted):
            chain = [k]
            for wanted in rule[1:]:
                after = [j for j in range(chain[-1] + 1, len(counted)) if counted[j][2] == wanted and j not in taken
                         and sum(c for _, c, _ in counted[chain[-1] + 1:j + 1]) <= r.max_gap + 1]
                if not after:
                    break
                chain.append(after[0])
            if name == rule[0] and k not in taken and len(chain) == len(rule):
                taken |= set(chain)
                found.append((licence, k))
    return sorted(found, key=lambda f: (f[1], f[0]))


def test_rules_against_every_start_and_gap(monkeypatch):
    rules = [("x", ("a", "b", "c")), ("y", ("a", "b")), ("z", ("a",)), ("w", ("b", "a"))]
    r = Recogniser({n: f"license {n}" for n in "abc"}, rules, max_gap=2)
    rnd = random.Random(2)
    for _ in range(500):
        counted = [(n or "word", n is not None or rnd.random() < 0.8, n)
                   for n in (rnd.choice(["a", "b", "c", None, None]) for _ in range(rnd.randint(0, 25)))]
        monkeypatch.setattr(Recogniser, "_counted", lambda self, text: counted)  # noqa: B023
        assert r.scan("") == plain_scan(r, counted)


def test_repeated_head_lines_take_linear_time():
    took = []
    for n in (2000, 16000):
        text = (SENTENCES["bsd-redistribution"] + "\n") * n
        t = time.process_time()
        assert len(licences(text)) == n
        took.append(time.process_time() - t)
    assert took[1] < 24 * took[0]
