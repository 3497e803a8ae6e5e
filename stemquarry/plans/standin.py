"""Stand-ins for a library that decodes papers: they read the HTML of ``pages`` as a paper of blocks.

A block (what stands between two tags) is a line of its page, forty lines to a page.  Items of lists
are rows of a table, each block has an image.  Papers in Spanish can't be read.
"""

from __future__ import annotations

import re

LINES = 40


def _blocks(raw: bytes) -> list[str]:
    text = raw.decode()
    if 'lang="es"' in text:
        raise ValueError("locked")
    return [b for b in (x.strip(" ") for x in re.split("<[^<>]*>", text)) if b]


def pages(raw: bytes) -> list[tuple]:
    blocks = _blocks(raw)
    return [(k // LINES, "\n".join(blocks[k : k + LINES])) for k in range(0, len(blocks), LINES)]


def words(raw: bytes) -> list[tuple]:
    return [(k // LINES, 10.0 * i, 12.0 * (k % LINES), w) for k, b in enumerate(_blocks(raw)) for i, w in enumerate(x for x in b.split(" ") if x)]


def glyphs(raw: bytes) -> list[tuple]:
    return [(k // LINES, 5.0 * i, 12.0 * (k % LINES), c, "bold" if c.isupper() else "plain", 12.0 * LINES) for k, b in enumerate(_blocks(raw)) for i, c in enumerate(b[:1])]


def tables(raw: bytes) -> list[tuple]:
    _blocks(raw)
    rows = re.findall("<li>(.*?)</li>", raw.decode(), re.S)
    return [(0, k, [re.sub("<[^<>]*>", "", r), str(len(r))]) for k, r in enumerate(rows)]


def images(raw: bytes) -> list[tuple]:
    return [(0, len(b), 60 + k, b.encode()) for k, b in enumerate(_blocks(raw))]
