"""The sequential merge on normalised postings, to check the distributed one on small data.

Normalised fields come from the engine, whose normalisation has golden rows and SQL twins of its own.
"""

from collections import namedtuple
from difflib import SequenceMatcher

Posting = namedtuple("Posting", "source url at company title salary level block")

#: score of a field by how many of its two values are unstated
UNSTATED = {2: 1.0, 1: 0.5}


def measures(a, b):
    """Token overlap and character ratio of two different texts."""
    common = {*a.split()} & {*b.split()}
    yield len(common) / len({*a.split(), *b.split()})
    yield SequenceMatcher(None, a, b).ratio()


def score(a, b, characters):
    missing = (a is None) + (b is None)
    if missing:
        return UNSTATED[missing]
    if a == b or not (a and b):
        return float(a == b)
    tokens, ratio = measures(a, b)
    return max(tokens, ratio if characters else 0.0)


def same(a, b, t, characters):
    """Company and title reach the threshold, and one of salary and level."""
    at_least = {f: score(getattr(a, f), getattr(b, f), characters) >= t for f in ("company", "title", "salary", "level")}
    return at_least["company"] and at_least["title"] and (at_least["salary"] or at_least["level"])


def scan(postings, sources, master=(), t=0.9, characters=True):
    """[(source, url, status, kept url)]: each posting against those kept before it in its block."""
    place = {s: i for i, s in enumerate(sources)}
    shelf, out = {}, []
    for p in sorted(master, key=lambda p: (p.at, p.url)):
        shelf.setdefault(p.block, []).append(p)
    for p in sorted(postings, key=lambda p: (place.get(p.source, len(place)), p.source, p.at, p.url)):
        kept = shelf.setdefault(p.block, [])
        hit = next((k for k in kept if (p.url and p.url == k.url) or same(p, k, t, characters)), None)
        if hit is None:
            kept.append(p)
        out.append((p.source, p.url, "kept" if hit is None else "duplicate", hit and hit.url))
    return out
