"""Fixtures of odd rows that every operator must stand, and planted text."""

from __future__ import annotations

import random

WORDS = "the of and to in a is that it was for on are with as his they at be this from or had by not but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_documents(extra=()):
    """Null and empty texts, null ids, repeated rows, and columns that clash with names the operators use."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id has a text of its own"), (None, None), (4, "same row"), (4, "same row"), (5, "é😀 \u3000 ß"), *extra]
    return [(i, t, "en", None if i == 2 else "src", 0, "clash", "clash") for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, `key` string"
