"""N-best segmentation against every path of short strings."""

from __future__ import annotations

import numpy as np
import pytest

from barograph.llm.nbest_pieces import UNIT, Lattice


@pytest.fixture(scope="module")
def lattice() -> Lattice:
    return Lattice(n=6)


def every_path(lattice: Lattice, s: str) -> list[int]:
    edges, scores = lattice.edges(s), [[] for _ in range(len(s) + 1)]
    scores[0] = [0]
    for end in range(1, len(s) + 1):
        scores[end] = [x + sc for start, sc, _ in edges[end] for x in scores[start]]
    return sorted(scores[-1], reverse=True)


@pytest.mark.parametrize("text", ["the", " banking", "aaaa", "hello", "naïve", "漢字", "\U0001f600x", "zzzzzz"])
def test_the_best_of_a_link(lattice, text):
    got = lattice.search(text)
    assert [g[0] for g in got] == every_path(lattice, text)[:6]
    assert len({g[1] for g in got}) == len(got)
    assert all(b"".join(lattice.text[i] for i in np.frombuffer(g[1], "<u4")).decode() == text for g in got)


@pytest.mark.parametrize("text", ["the cat", "a b c", "to be\nor"])
def test_the_best_of_a_chain(lattice, text):
    got = [round(s * UNIT) for s, _ in lattice.encode(text)]
    links = [[0]]
    import itertools
    import re

    links = [every_path(lattice, m) for m in re.findall(r"\n| *[^ \n]+| +", " " + text)]
    assert got == sorted((sum(x) for x in itertools.product(*[c[:6] for c in links])), reverse=True)[:6]


def test_one_letter_without_end(lattice):
    got = lattice.encode("x" * 20_000)
    assert len(got) == 6 and all(lattice.decode(i) == "x" * 20_000 for _, i in got)


def test_the_small_table_against_a_plain_search():
    """N best scores of whole texts by keeping the N best of every prefix, with no chain and no estimates."""
    from tests.llm.conftest import SMALL, rows_of

    n = 4
    plain = Lattice(n=n)
    longest = max(map(len, plain.score))
    for d in rows_of(SMALL, "documents"):
        text = (d["text"] or "")[:500]
        got = [round(s * UNIT) for s, _ in plain.encode(text)]
        s = " " + text
        best = [[0]]
        for end in range(1, len(s) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                found = plain.score.get(s[start:end]) or (plain.as_bytes(s[start]) if start == end - 1 else None)
                if found:
                    here += [x + found[0] for x in best[start]]
            best.append(sorted(here, reverse=True)[:n])
        assert got == (best[-1] if text else [])
