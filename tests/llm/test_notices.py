"""Licence notices in ordinary layouts."""

from __future__ import annotations

import textwrap

import pytest

from gridloom.llm import licences

TEMPLATES = licences.TEMPLATES
PROSE = "It rained on and on until the river came up to the doors of the lower houses"


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: f"{t[0]}-{len(t[1])}")
def test_wrapped_commented_and_inline_notices(template):
    name, notice = template
    scanner = licences.Scanner(TEMPLATES, licences.THRESHOLD)
    wrapped = textwrap.wrap(notice, 40)
    comment = "/*\n * Copyright 2020 Somebody Else\n *\n" + "".join(f" * {x}\n" for x in wrapped) + " *\n * " + PROSE + "\n */\nint main;"
    hashes = "# " + PROSE + "\n" + "".join(f"# {x}\n" for x in wrapped) + "# " + PROSE
    for text in (comment, hashes, f"{PROSE} {notice} {PROSE}", f"{PROSE} " + "\n".join(textwrap.wrap(notice, 20)) + f" {PROSE}"):
        hits = scanner.scan(text)
        assert hits and any(text[a:b].count(licences.words(notice)[-1]) or d >= 0.8 for _, a, b, d in hits)
        assert name in {h[0] for h in hits}
        for licence, a, b, d in hits:
            near = licences.bigrams(licences.words(text[a:b]))
            assert d == pytest.approx(max(licences.dice(near, licences.bigrams(licences.words(t))) for k, t in TEMPLATES if k == licence))
    assert scanner.scan(f"{PROSE} {PROSE}") == []


def test_whole_licences():
    whole = {name: text for name, text in licences.TEMPLATES if len(text) > 600}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"} <= set(whole)
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    for name, text in whole.items():
        words = text.split()
        wrapped = "/*\n" + "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n */\nint main() { return 0; }"
        found = scanner.scan("Copyright (c) 2020 Some One\n\n" + wrapped)
        assert max(found, key=lambda h: h[2] - h[1])[0] == name and max(h[3] for h in found) > 0.95


def test_many_notices_take_no_quadratic_time():
    import time

    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        assert len(scanner.scan("Released under the MIT License.\n" * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0]
