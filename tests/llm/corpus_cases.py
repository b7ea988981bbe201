"""Rows and helpers that the tests of the corpus operators share."""

import os

import pytest

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)
needs_tables = pytest.mark.skipif(not HAVE, reason="test tables are not here")
PROSE = "the river ran past a quiet mill where seven people worked each day and none of them ever saw the sea before winter came back again".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that differs by seed."""
    return " ".join(PROSE[(seed * 7 + k * (seed % 5 + 1) + k * k % (seed + 3)) % len(PROSE)] for k in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id at all"), (4, "x"), (5, "déjà vu — naïve 日本語 🤪"), (6, "x"), (6, "x"), (7, "word " * 20_000)]
