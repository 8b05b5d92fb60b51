"""Repeated and interrupted licenses."""

import pytest

from skeinwork.llm import op1_licenses


def test_licenses_in_a_row():
    scanner = op1_licenses.Scanner(op1_licenses.TEMPLATES, 0.8)
    for name in ("all-rights-reserved", "mit-notice", "cc-by-notice", "apache-notice", "gpl-notice", "mit", "bsd-2"):
        template = op1_licenses.TEMPLATES[name]
        size = len(op1_licenses.words_of(template))
        for n in (2, 3, 4, 7):
            got = scanner.scan(" ".join(["before", *[template] * n, "after"]))
            assert [(f["license"], f["start"], f["matched"]) for f in got] == [(name, 1 + size * k, size) for k in range(n)]


@pytest.mark.parametrize("places", [(43,), (20,), (70,), (30, 60)])
def test_license_with_text_inside(places):
    words = op1_licenses.TEMPLATES["mit"].split()
    for k, at in enumerate(sorted(places, reverse=True)):
        words[at:at] = [f"other{k}{i}" for i in range(40 // len(places))]
    got = op1_licenses.Scanner(op1_licenses.TEMPLATES, 0.8).scan("some text " + " ".join(words) + " more text")
    assert [f["license"] for f in got] == ["mit"] and got[0]["coverage"] > 0.95


def test_license_scan_of_one_word_many_times():
    assert op1_licenses.Scanner(op1_licenses.TEMPLATES, 0.8).scan("software rights documentation " * 1000) == []
