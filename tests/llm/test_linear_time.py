"""Texts made to be slow: deep nesting and runs of a keyword take time and memory in proportion to their length."""

import re
import time
import tracemalloc

import pytest

from tickloom.llm import html_text, secrets


@pytest.mark.parametrize(
    ("page", "length"),
    [
        ("<div>" * 200_000, 0),
        ("<div>word the of " * 200_000, 200_000 * 12 - 1),
        ("<div>" * 50_000 + "</p>" * 100_000, 0),
        ("<article>the of and " * 50_000, 50_000 * 11 - 1),
    ],
)
def test_deep_pages(page, length):
    began = time.process_time()
    assert len(html_text.main_text(page)) == length
    assert time.process_time() - began < 30
    tracemalloc.start()
    html_text.main_text(page[:200_000])
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_distance_counts_borders():
    """A short block between two areas follows the one that fewer borders part it from."""
    text, links = "the of and to a in is that it was on are as with " * 2, "<a>one</a> <a>two</a> <a>three four</a>"
    page = f"<div><p>{text}</p></div><div><div><p>short one</p></div><p>{links}</p></div>"
    found = html_text.blocks(page)
    assert [(b.depth, b.low) for b in found] == [(1, 0), (2, 0), (1, 1)]
    html_text.evidence(found)
    before, after = html_text.neighbours(found)
    assert before[1] == (0, 1 + 3 * 3) and after[1] == (2, 1 + 3 * 1)


@pytest.mark.parametrize("text", ["eyJ" * 1_700_000, "eyJa." * 600_000, "eyJhbGciOiJ9." * 200_000, "token " * 500_000, "AKIA" * 500_000])
def test_runs_of_keywords(text):
    began = time.process_time()
    found = secrets.Scanner()(text)
    assert time.process_time() - began < 40
    assert [s for s in found if s[1] == 1] == ([(0, 1, len(text))] if text.startswith("AKIA") else [])


def test_skipped_starts_lose_nothing():
    """Against a search at every place, leftmost and without overlap."""
    head = "eyJhbGciOiJIUzI1NiJ9"
    for text in (f"eyJeyJ{head}.a.b", f"{head}.x {head}.y.z", f"eyJ.{head}.q.r", f"{head}{head}.1.2.3 eyJ", f"eyJa.{head}.b", f"{head}.{head}.{head}"):
        want, at = [], 0
        for m in re.finditer("(?=eyJ)", text):
            if m.start() >= at and (f := secrets.JWT.match(text, m.start())):
                at = f.end()
                if secrets.jwt_holds(f.group()):
                    want.append((m.start(), 5, f.end()))
        assert [s for s in secrets.Scanner()(text) if s[1] == 5] == want
