"""Removal of repeated passages by a distributed, prefix-aware merge sort of suffixes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document of smaller id,
or earlier in the same one) is removed.

Sorting all suffixes is not needed to find all repeated strings.  Each string of ``LENGTH`` bytes picks, by
its content alone, one place inside it (the smallest hash of a run of ``GRAM`` bytes), so equal strings pick
equal places and only the suffixes at picked places, about one in forty, have to be sorted:

1. **Places.**  Each task picks the places of its documents, with the range of strings that picked each.
   Hashes go to hash ranges as packed arrays, once per task; places whose hash occurs once are done.  What a
   task knows already goes along, so neither places nor runs are kept as tables beside their shuffles.
2. **Runs.**  The suffixes at the other places, with the bytes before them, are sorted in each task.
   Equal ones within a task are decided at once and only the earliest goes on, so a passage that a third
   of all documents share is sent once per task.  The sorted run is cut by hash range of the first bytes
   and front-coded: a suffix is the length of the prefix it shares with its predecessor, and its rest.
3. **Merge.**  For each range, a tree of losers merges the runs.  A candidate carries its common prefix
   with the last suffix put out: the one with more in common is the smaller, and only equals are compared,
   from that length on.  Bytes known to be equal are never compared again.  Suffixes of one range start with the
   same few grams.  A gram at more than ``HOT`` places (a line that stands in very many documents) would make one
   range without bound, so there each string goes alone, to the range of the hash of all its bytes: equal ones
   end in their runs, and a range gets no more of a string than there are runs.
4. **Strings.**  In merged order the common prefixes tell for every split of a string at its place which
   suffixes have an equal right part; hashes of the bytes before tell the left part.  All but the earliest of
   equal strings are removed.
5. **Documents.**  The removed stretches of a document are united, and the rest is put together.

Places, runs and texts cross their shuffles compressed.

Defined cases: null counts as empty; texts shorter than ``LENGTH`` bytes keep everything; a null id comes after
all others; rows that repeat id and text are one document and get the same result; rows that repeat only the
id are ordered by a hash of their text.  Left parts and texts are compared by 64-bit hashes.  Columns of
the input with the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from jobloom.llm.common import _power_tables, free_name, give_back_memory, mix, text_of
from jobloom.session import saved

LENGTH = 100
GRAM = 25
WIDTH = LENGTH - GRAM + 1      # places a string can pick from
CHUNK = 300_000                # bytes of one round of numpy calls
RUN_BYTES = 12_000_000         # texts held for one run
PIECE = 8_000_000              # longer texts are handled in overlapping pieces of so many bytes
RECORDS = 150_000              # places that a task holds
RUN_RECORDS = 60_000           # suffixes of one run
RANGE_ROWS = 4_000             # documents for each hash range
HOT = 2_000                    # places of a gram from which on its strings go alone
HOT_SHARE = 100_000            # a gram at fewer than one in so many places is not hot, so no more grams than that are
LAST_ID = (1 << 63) - 1
PLACE = np.dtype([("hash", "<u8"), ("id", "<i8"), ("print", "<i8"), ("at", "<u4"), ("least", "u1"), ("most", "u1"), ("count", "<u4")])
SPOT = np.dtype([("at", "<u4"), ("least", "u1"), ("most", "u1")])
RUN = np.dtype([("id", "<i8"), ("print", "<i8"), ("at", "<u4"), ("least", "u1"), ("most", "u1"), ("shared", "u1"), ("rest", "u1")])
STRETCH = "id long, print long, stretches binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


@F.pandas_udf(BinaryType())
def packed_text(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _packed(t.encode("utf-8")) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def unpacked_text(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _unpacked(t).decode("utf-8") for t in texts], dtype=object)


def _aside(ids: np.ndarray, prints: np.ndarray, ranges: int) -> np.ndarray:
    """Negative range numbers, for rows of documents that only pass by."""
    with np.errstate(over="ignore"):
        return -1 - _by_range(mix(ids.astype(np.int64).view(np.uint64) * _ODD + prints.astype(np.int64).view(np.uint64)), ranges)


# ---- 1. places ---------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * inverse[: len(data) - n + 1])


def picked(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, text, place, least, most): the picked places of texts of at least ``LENGTH`` bytes that lie in
    ``data``.  A place is picked by the strings that start ``least`` to ``most`` bytes before it."""
    h = _gram_hashes(data, GRAM)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)      # the leftmost of equal hashes
    span = 1
    while span * 2 <= WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span:])
    strings = length - LENGTH + 1
    owner = np.repeat(np.arange(len(begin)), strings)
    start = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + begin[owner]
    at = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], owner[first], at[first], at[first] - start[last], at[first] - start[first]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, pieces) in groups; long texts in pieces that overlap by ``LENGTH`` - 1."""
    numbers, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for off in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[off: off + PIECE + LENGTH - 1]
            if parts and size + len(part) > CHUNK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(i)
            offsets.append(off)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def _places_of(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    ids, prints = pdf["id"].to_numpy(np.int64), pdf["print"].to_numpy(np.int64)
    for numbers, offsets, parts in _pieces([t.encode("utf-8") for t in pdf["text"]]):
        length = np.array([len(p) for p in parts])
        begin = np.cumsum(length) - length
        h, own, at, least, most = picked(np.frombuffer(b"".join(parts), np.uint8), begin, length)
        out = np.empty(len(h), PLACE)
        row = np.array(numbers)[own]
        out["hash"], out["id"], out["print"] = h, ids[row], prints[row]
        out["at"], out["least"], out["most"], out["count"] = at - begin[own] + np.array(offsets)[own], least, most, 1
        yield out


def _by_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Places are picked by small hashes, so these are mixed again: else most places are in the first range."""
    with np.errstate(over="ignore"):
        again = mix(hashes + _ODD)
    return ((again >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_PICKED = ["id", "print", "spots", "part", "places"]


def _flat(places: np.ndarray) -> bytes:
    """Places by document, each byte of a field as a column of its own: most of these are alike."""
    places = places[np.lexsort((places["at"], places["print"], places["id"]))]
    return _packed(np.ascontiguousarray(places).view(np.uint8).reshape(len(places), PLACE.itemsize).T.tobytes())


def _unflat(data: bytes) -> np.ndarray:
    data = _unpacked(data)
    table = np.frombuffer(data, np.uint8).reshape(PLACE.itemsize, len(data) // PLACE.itemsize)
    return np.ascontiguousarray(table.T).view(PLACE).reshape(-1)


def _pick(ranges: int):
    """Places by hash range, one of each hash.  Those that repeat within the task are known to repeat: they come as
    rows of their documents besides."""

    def flush(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        places = np.concatenate(held)
        held.clear()
        places = places[np.argsort(places["hash"], kind="stable")]
        h = places["hash"]
        same = h[1:] == h[:-1]
        known = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        spots = _spots(places[known])
        yield spots.assign(part=_aside(spots["id"].to_numpy(), spots["print"].to_numpy(), ranges), places=None)[_PICKED]
        some = places[first]
        some["count"] = np.diff(np.append(np.flatnonzero(first), len(places)))
        del places, h, same, known
        part = _by_range(some["hash"], ranges)
        order = np.argsort(part, kind="stable")
        some, cut = some[order], np.searchsorted(part[order], np.arange(ranges + 1))
        for p in np.flatnonzero(np.diff(cut)):
            out = pd.DataFrame({"id": [None], "print": [None], "spots": [None], "part": [p], "places": [_flat(some[cut[p]: cut[p + 1]])]})
            yield out.astype({"id": "Int64", "print": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for places in _places_of(pdf):
                held.append(places)
                size += len(places)
                if size > RECORDS:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)
        give_back_memory()

    return run


def _spots(places: np.ndarray) -> pd.DataFrame:
    """Places as one row for each document."""
    places = places[np.lexsort((places["at"], places["print"], places["id"]))]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (places["id"][1:] != places["id"][:-1]) | (places["print"][1:] != places["print"][:-1])
    first = np.flatnonzero(new)
    cut = np.append(first, len(places))
    spots = places[["at", "least", "most"]].astype(SPOT)
    return pd.DataFrame({"id": places["id"][first], "print": places["print"][first],
                         "spots": [spots[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]})


_REPEATED = "id long, print long, spots binary, hash long, n long"


def _repeated(least: int):
    """Of the places of one range: those whose hash several tasks have.  Then, as rows without a document, the
    hashes of at least so many places with their numbers, and the number of all places.  Spots that a task has found
    stay as they are."""
    whole = {c: "Int64" for c in ("id", "print", "hash", "n")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf[["id", "print", "spots"]].assign(hash=None, n=None).astype(whole)
        places = np.concatenate([_unflat(d) for d in pdf["places"]])
        places = places[np.argsort(places["hash"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], places["hash"][1:] != places["hash"][:-1]]))
        tasks = np.diff(np.append(first, len(places)))
        n = np.add.reduceat(places["count"].astype(np.int64), first)
        many = n >= least
        found = _spots(places[np.repeat(tasks > 1, tasks)]).assign(hash=None, n=None)
        counts = pd.DataFrame({"hash": [*places["hash"][first[many]].view(np.int64).tolist(), None], "n": [*n[many].tolist(), int(n.sum())]})
        counts = counts.assign(id=None, print=None, spots=None)[list(found.columns)]
        return pd.concat([found.astype(whole), counts.astype(whole)], ignore_index=True)

    return run


def hot_grams(repeated: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the grams that stand at very many places, ``HOT_SHARE`` at most."""
    total = repeated.where("id IS NULL AND hash IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = repeated.where("hash IS NOT NULL").where(F.col("n") >= max(least, total // HOT_SHARE)).select("hash").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


# ---- 2. runs -----------------------------------------------------------------------------------

def _stretches(ids: np.ndarray, prints: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    """Removed stretches [low, high), united, as one row for each document."""
    order = np.lexsort((low, prints, ids))
    ids, prints, low, high = ids[order], prints[order], low[order], high[order]
    doc = np.zeros(len(ids), np.int64)
    doc[1:] = np.cumsum((ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1]))
    far = doc << 40        # documents one after the other on one line
    reach = np.maximum.accumulate(far + high)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (far + low)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    until = np.append(reach[first[1:] - 1], reach[-1:]) if len(first) else reach
    both = np.stack([low[first], until - far[first]], axis=1).astype("<i8")
    cut = np.append(np.flatnonzero(np.diff(doc[first], prepend=-1)), len(first))
    head = first[cut[:-1]] if len(first) else first
    return pd.DataFrame({"id": ids[head], "print": prints[head], "stretches": [both[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]})


def _sort_run(spots: np.ndarray, ids: np.ndarray, prints: np.ndarray, text: np.ndarray, place: np.ndarray,
              ranges: int, alone: bool = False) -> Iterator[tuple[int, bytes | None, pd.DataFrame | None]]:
    """Sorts suffixes, decides equal ones and front-codes the others by range.

    ``text`` holds the texts behind each other, ``place`` the index of each suffix in it.  With ``alone``, each
    suffix stands for one string, and its range is that of the whole string.
    """
    view = np.lib.stride_tricks.sliding_window_view
    right = view(np.concatenate([text, np.zeros(LENGTH, np.uint8)]), LENGTH)[place]
    right[np.arange(LENGTH) >= LENGTH - spots["least"].astype(np.int64)[:, None]] = 0
    left = view(np.concatenate([np.zeros(WIDTH - 1, np.uint8), text]), WIDTH - 1)[place][:, ::-1]
    left[np.arange(WIDTH - 1) >= spots["most"].astype(np.int64)[:, None]] = 0
    part = _by_range(_column_hashes(right, left, spots["least"]) if alone else _gram_at(text, place), ranges)
    whole = np.ascontiguousarray(np.concatenate([right, left, spots["least"][:, None], spots["most"][:, None]], axis=1))
    whole = whole.view(f"S{whole.shape[1]}").reshape(-1)
    order = np.lexsort((spots["at"], prints, ids))
    order = order[np.argsort(whole[order], kind="stable")]
    order = order[np.argsort(part[order], kind="stable")]
    spots, ids, prints, right, left, part = (x[order] for x in (spots, ids, prints, right, left, part))
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1) \
        & (spots["least"][1:] == spots["least"][:-1]) & (spots["most"][1:] == spots["most"][:-1])
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
    itself = (ids == ids[head]) & (prints == prints[head]) & (spots["at"] == spots["at"][head])
    gone = np.flatnonzero(equal & ~itself)
    if len(gone):
        at = spots["at"][gone].astype(np.int64)
        yield -1, None, _stretches(ids[gone], prints[gone], at - spots["most"][gone], at + LENGTH - spots["least"][gone])
    spots, ids, prints, right, left, part = (x[~equal] for x in (spots, ids, prints, right, left, part))
    shared = np.zeros(len(part), np.int64)
    shared[1:] = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(axis=1)
    shared[1:][part[1:] != part[:-1]] = 0
    size = np.maximum(LENGTH - spots["least"].astype(np.int64), shared)
    record = np.empty(len(part), RUN)
    record["id"], record["print"], record["at"] = ids, prints, spots["at"]
    record["least"], record["most"], record["shared"], record["rest"] = spots["least"], spots["most"], shared, size - shared
    cut = np.searchsorted(part, np.arange(ranges + 1))
    column = np.arange(LENGTH)
    for p in np.flatnonzero(np.diff(cut)):
        mine = slice(cut[p], cut[p + 1])
        kept = (column >= shared[mine, None]) & (column < size[mine, None])
        before = np.arange(WIDTH - 1) < spots["most"][mine].astype(np.int64)[:, None]
        n = cut[p + 1] - cut[p]
        yield int(p), b"".join([np.int64(n).tobytes(), record[mine].tobytes(), right[mine][kept].tobytes(), left[mine][before].tobytes()]), None


def _gram_at(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of ``_gram_hashes`` at some places only."""
    power, _ = _power_tables(GRAM)
    h = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h += (text[place + k].astype(np.uint64) + np.uint64(1)) * power[k]
    return mix(h)


def _column_hashes(right: np.ndarray, left: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of strings, given as the bytes from their place on and the ``before`` bytes before it."""
    h = before.astype(np.uint64)
    with np.errstate(over="ignore"):
        for side in (right, left):
            for k in range(side.shape[1]):
                h = mix(h + side[:, k].astype(np.uint64) * _ODD + np.uint64(k))
    return h


def _strings_alone(spots: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each spot once for each string that picked it."""
    out = np.repeat(spots, times)
    out["least"] += (np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint8)
    out["most"] = out["least"]
    return out


_RUNS = "part int, run binary, id long, print long, stretches binary"


def _make_runs(ranges: int, hot: np.ndarray, pack: bool):
    def sorted_runs(spots: np.ndarray, ids: np.ndarray, prints: np.ndarray, text: np.ndarray,
                    place: np.ndarray) -> Iterator[tuple[int, bytes | None, pd.DataFrame | None]]:
        crowded = np.isin(_gram_at(text, place), hot) if len(hot) else np.zeros(len(spots), dtype=bool)
        if not crowded.all():
            yield from _sort_run(*(x[~crowded] for x in (spots, ids, prints)), text, place[~crowded], ranges)
        rest = np.flatnonzero(crowded)
        for a in range(0, len(rest), RUN_RECORDS // WIDTH):
            some = rest[a: a + RUN_RECORDS // WIDTH]
            times = (spots["most"][some] - spots["least"][some]).astype(np.int64) + 1
            yield from _sort_run(_strings_alone(spots[some], times), *(np.repeat(x[some], times) for x in (ids, prints)), text,
                                 np.repeat(place[some], times), ranges, alone=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            spots, ids, prints, text, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for p, data, stretches in sorted_runs(spots, ids, prints, text, place):
                if stretches is None:
                    yield pd.DataFrame({"part": [p], "run": [_packed(data) if pack else data], "id": [None], "print": [None], "stretches": [None]}).astype(
                        {"id": "Int64", "print": "Int64"})
                else:
                    part = _aside(stretches["id"].to_numpy(), stretches["print"].to_numpy(), ranges)
                    yield stretches.assign(part=part, run=None)[["part", "run", "id", "print", "stretches"]]

        offset = 0
        for pdf in batches:
            for i, d, t, lists in zip(pdf["id"], pdf["print"], pdf["packed"], pdf["spots"]):
                spots = np.unique(np.frombuffer(b"".join(lists), SPOT))
                data = np.frombuffer(_unpacked(t), np.uint8)
                held.append((spots, np.full(len(spots), i, np.int64), np.full(len(spots), d, np.int64), data,
                             spots["at"].astype(np.int64) + offset))
                offset += len(data)
                size += len(spots)
                if size > RUN_RECORDS or offset > RUN_BYTES:
                    yield from flush()
                    size, offset = 0, 0
        if held:
            yield from flush()
        give_back_memory()

    return run


# ---- 3. merge ----------------------------------------------------------------------------------

class Run:
    """A front-coded run, read one suffix after the other."""

    __slots__ = ("n", "record", "left", "tails", "rest", "shared", "i", "at", "text")

    def __init__(self, data: bytes):
        self.n = int(np.frombuffer(data, "<i8", 1)[0])
        self.record = np.frombuffer(data, RUN, self.n, 8)
        self.shared, self.rest = self.record["shared"].tolist(), self.record["rest"].tolist()
        begin = 8 + self.record.nbytes
        end = begin + sum(self.rest)
        self.tails, self.left = data[begin:end], np.frombuffer(data, np.uint8, -1, end)
        self.i, self.at, self.text = -1, 0, b""

    def next(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            return False
        end = self.at + self.rest[self.i]
        # suffixes that end before LENGTH go on with zeros, in runs and between them
        self.text = (self.text[: self.shared[self.i]] + self.tails[self.at:end]).ljust(LENGTH, b"\0")
        self.at = end
        return True


def merge(runs: list[Run]) -> tuple[list[int], list[int]]:
    """(run, common prefix with the predecessor) of all suffixes in sorted order.

    ``common[r]`` is what run r's suffix shares with the last one put out.  A longer share with it
    means a smaller suffix; equal shares are compared beyond, and the loser's share with the winner is noted,
    which is its share with the next one put out.
    """
    k = 1
    while k < len(runs):
        k *= 2
    live = [r.next() for r in runs] + [False] * (k - len(runs))
    common = [0] * k
    tree = [0] * k        # losers; tree[0] is not used

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not live[b]:
            return a, b
        if not live[a]:
            return b, a
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        x, y = runs[a].text, runs[b].text
        while ca < LENGTH and x[ca] == y[ca]:
            ca += 1
        if ca == LENGTH or x[ca] < y[ca]:
            common[b] = ca
            return a, b
        common[a] = ca
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    order, shares = [], []
    while live[winner]:
        run = runs[winner]
        order.append(winner)
        shares.append(common[winner])
        live[winner] = run.next()
        if live[winner]:
            common[winner] = run.shared[run.i]
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return order, shares


# ---- 4. strings --------------------------------------------------------------------------------

def _merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Removed stretches from the runs of one range; those that a task has found stay as they are."""
    if pdf["part"].iloc[0] < 0:
        return pdf[["id", "print", "stretches"]]
    runs = [Run(_unpacked(d)) for d in pdf["run"]]
    order, shares = merge(runs)
    # the records in merged order: those of a run keep theirs
    at = np.empty(len(order), np.int64)
    at[np.argsort(np.array(order), kind="stable")] = np.arange(len(order))
    record = np.concatenate([r.record for r in runs])
    most = record["most"].astype(np.int64)
    left = np.zeros((len(record), WIDTH - 1), np.uint8)
    left[np.arange(WIDTH - 1) < most[:, None]] = np.concatenate([r.left for r in runs])
    record, left, most = record[at], left[at], most[at]
    least = record["least"].astype(np.int64)
    shares = np.array(shares, np.int64)
    rank = np.lexsort((record["at"], record["print"], record["id"]))
    sorted_ = record[rank]
    step = np.ones(len(record), np.int64)
    step[1:] = (sorted_["id"][1:] != sorted_["id"][:-1]) | (sorted_["print"][1:] != sorted_["print"][:-1]) | (sorted_["at"][1:] != sorted_["at"][:-1])
    place = np.empty(len(record), np.int64)
    place[rank] = np.cumsum(step)
    removed = np.zeros((len(record), WIDTH), dtype=bool)
    before = np.zeros(len(record), np.uint64)      # hash of the o bytes before the place
    with np.errstate(over="ignore"):
        for o in range(WIDTH):
            if o:
                before = mix(before + (left[:, o - 1].astype(np.uint64) + np.uint64(1)) * _ODD)
            has = np.flatnonzero((least <= o) & (o <= most))
            if len(has) < 2:
                continue
            same_right = np.cumsum(shares < LENGTH - o).astype(np.uint64)
            key = mix(before[has] + mix(same_right[has] * _ODD + np.uint64(o)))
            by = np.lexsort((place[has], key))
            key, who = key[by], has[by]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(by)), 0))
            late = place[who] > place[who[first]]
            removed[who[late], o] = True
    del left, before
    # neighbouring strings of a place are one stretch
    edge = np.diff(np.pad(removed, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low_o = np.nonzero(edge == 1)
    _, high_o = np.nonzero(edge == -1)
    where = record["at"][row].astype(np.int64)
    found = _stretches(record["id"][row], record["print"][row], where - (high_o - 1), where - low_o + LENGTH)
    give_back_memory()
    return found


# ---- 5. documents ------------------------------------------------------------------------------

def _kept(data: bytes, lists: list[bytes] | None) -> tuple[int, int, int, str, str]:
    pieces, removed, spans, at = [], 0, 0, 0
    if lists is not None and len(lists):
        parts = np.frombuffer(b"".join(lists), "<i8").reshape(-1, 2)
        parts = parts[np.argsort(parts[:, 0], kind="stable")]
        reach = np.maximum.accumulate(parts[:, 1])
        new = np.concatenate([[True], parts[1:, 0] > reach[:-1]])
        lows = parts[new, 0]
        highs = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
        for low, high in zip(lows.tolist(), highs.tolist()):
            pieces.append(data[at:low])
            removed += high - low
            spans += 1
            at = high
    pieces.append(data[at:])
    kept = b"".join(pieces)
    return len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")


def _dealt(df: DataFrame, ranges: int) -> DataFrame:
    """Rows by range, a few ranges a task: packed rows are large, and tasks joined to a common size hold too many."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(ranges, 8 * tasks), "part")


def repeat_runs(docs: DataFrame, ranges: int, hot_places: int = HOT, pack: bool = False) -> DataFrame:
    """Sorted, front-coded runs by range (``part``, ``run``, with ``pack`` compressed), and as rows with a negative ``part``
    the stretches that were decided within a task.  ``docs`` has ``id``, ``print`` and ``text``."""
    places = docs.mapInPandas(_pick(ranges), "id long, print long, spots binary, part int, places binary")
    repeated = saved(_dealt(places, ranges).groupBy("part").applyInPandas(_repeated(hot_places), _REPEATED))
    hot = hot_grams(repeated, hot_places)
    of_doc = repeated.where("id IS NOT NULL").groupBy("id", "print").agg(F.collect_list("spots").alias("spots"))
    return docs.select("id", "print", packed_text("text").alias("packed")).join(of_doc, ["id", "print"]) \
        .mapInPandas(_make_runs(ranges, hot, pack), _RUNS)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", texts: bool = True, hot_places: int = HOT) -> DataFrame:
    """The rows of ``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``texts``, the
    ``kept_text`` (its bytes as UTF-8; a character cut in two shows as the replacement character)."""
    ident: Column = F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("id")
    docs = df.select(ident, F.xxhash64(text_of(text)).alias("print"), text_of(text).alias("text"))
    id_, print_, lists, my_id, my_print, out = (free_name(df, n) for n in ("_id", "_print", "_lists", "_my_id", "_my_print", "_result"))
    packed = free_name(df, "_packed")
    ranges = max(32, df.select(key).count() // RANGE_ROWS)
    runs = repeat_runs(docs, ranges, hot_places, pack=True)
    stretches = _dealt(runs, ranges).groupBy("part").applyInPandas(_merge_range, STRETCH) \
        .groupBy(F.col("id").alias(id_), F.col("print").alias(print_)).agg(F.collect_list("stretches").alias(lists))

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def result(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for all_texts, all_lists in batches:
            rows = [_kept(b"" if t is None else _unpacked(t), s)[: len(names)] for t, s in zip(all_texts, all_lists)]
            yield pd.DataFrame(rows, columns=names)

    # the text crosses the join compressed only, and is unpacked again where a caller reads it
    joined = df.withColumns({my_id: ident, my_print: F.xxhash64(text_of(text)), packed: packed_text(text)}).drop(text) \
        .join(stretches, (F.col(my_id) == F.col(id_)) & (F.col(my_print) == F.col(print_)), "left")
    keep = [unpacked_text(packed).alias(c) if c.lower() == text.lower() else F.col(c) for c in df.columns if c.lower() not in names]
    return joined.withColumn(out, result(F.col(packed), F.col(lists))) \
        .select(*keep, *[F.col(f"{out}.{n}").alias(n) for n in names])
