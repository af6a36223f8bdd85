"""Exact passage dedup by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a WINDOW-byte string over it also starts in a document with a smaller id. Equal windows have equal
anchors: the least hash of the GRAM-byte grams inside, leftmost first. So windows are handled by their anchors.

1. Anchors' hashes of all texts meet by ranges of the hash, mixed anew (as least values they crowd at the low end).
   Within a run of documents each hash is sent once; what the run alone shows to be in two different texts is settled
   there. Only windows with an anchor in two texts go on; equal whole texts count once (the smallest id stands for
   all and the others lose everything).
2. Windows in a row with one anchor form an entry: the suffix from the anchor (at most WINDOW bytes), and the bytes
   to its left. Each run sorts its entries, cuts them at splitters and sends them front-coded (length of the prefix
   shared with the entry before, and the rest). Entries equal to one of a smaller id in the same run are settled
   there and not sent. Splitters come from a bounded sample of texts and order entries down to the id, so a suffix
   that fills a range is cut as any other.
3. Every range of suffixes merges its runs with a loser tree whose nodes keep the common prefix with the last winner:
   the longer one wins unread, and only ties look at bytes. The merged order and its common prefixes number the
   suffixes of every depth; with the order of the left bytes they name each window, and the smallest id of a name
   keeps it. A name whose suffix also begins a range's splitter may go on in the next range: what is left of it there
   meets by a 128-bit digest of the window, one id a range.

No step holds more than a run or one range. Hashes and runs are dealt in two steps where one would cut them into
more than FAN pieces, so pieces stay long at any size.

Defined results: null text is empty; null doc_ids are returned untouched and remove nothing; rows that repeat a doc_id
do not remove each other's bytes; equal rows get equal results; texts under WINDOW bytes stay whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, cut, give_back, text_chunks
from .words import mixed, powers, prefix_hash

WINDOW = 50
GRAM = 20
#: Anchors of a run, texts of about this many bytes to a hash range, entries of a run and (about) of a range of suffixes.
RUN_ANCHORS = 400_000
RANGE_BYTES = 8 << 20
RUN_ENTRIES = 100_000
RANGE_ENTRIES = 150_000
#: Documents (about) whose shared anchors are gathered at once.
BUCKET = 4096
#: Documents, and bytes of text, (about) whose removed spans are gathered at once: ranges send a row for each bucket, not for
#: each document, so rows do not grow with ranges times documents.
SPAN_DOCS = 32_768
SPAN_BYTES = 128 << 20
#: Most pieces that a run is cut into at once, and bytes of text that are sampled for splitters.
FAN = 4096
SAMPLE_BYTES = 32 << 20
#: Texts are read in overlapping segments whose arrays stay in the cache.
SEGMENT = 96 << 10
_PLACES = 24  # bits for a place in a segment beside the hash
#: Tasks of an exchange at most.
MOST_TASKS = 20_000
#: Keys of groups of copies, and of rows that lose something, that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Exact copies of one text from which a group is broadcast instead of joined.
HOT_COPIES = 10_000


def anchors(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of a run of bytes: its anchor's place and hash. Windows over two texts mean nothing."""
    n, w = len(flat), WINDOW - GRAM + 1
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, max(n - WINDOW + 1, 0), SEGMENT):
        part = flat[a : a + SEGMENT + WINDOW - 1]
        h = prefix_hash(part)
        _, down = powers(len(part) + 1)
        grams = mixed((h[GRAM:] - h[:-GRAM]) * down[: len(part) - GRAM + 1])
        least = grams >> np.uint64(_PLACES) << np.uint64(_PLACES) | np.arange(len(grams), dtype=np.uint64)
        wide = 1
        while wide * 2 <= w:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        least = np.minimum(least[: len(least) - (w - wide)], least[w - wide :]) if w > wide else least
        place = (least & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
        at.append(place + a)
        hashes.append(grams[place])
    return np.concatenate(at), np.concatenate(hashes)


def _valid(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which window starts lie with their whole window in one text."""
    ok = np.zeros(max(n, 1) + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - WINDOW + 1
    real = last > first
    np.add.at(ok, first[real], 1)
    np.add.at(ok, last[real], -1)
    return np.cumsum(ok)[: max(n - WINDOW + 1, 0)] > 0


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Anchors are the least of many hashes, so their own values would all fall into the first ranges."""
    return ((mixed(hashes + np.uint64(0xA5A5)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_ANCHORS = pa.schema([("range", pa.int64()), ("docs", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("shared", pa.binary())])
_ANCHORS_SQL = "range long, docs binary, texts binary, counts binary, hashes binary, shared binary"
#: Bytes of an anchor's hash that are sent; a false match only lets a window go on to the exact merge.
SENT = 6
_LOW = np.uint64((1 << 8 * SENT) - 1)


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(raw, np.uint8).reshape(-1, SENT)
    return out.view("<u8").ravel()


def _by_group(of: np.ndarray) -> np.ndarray:
    """Edges of the stretches of equal numbers."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)


class Anchors:
    """One entry a text and hash: document, text's hash, (low bytes of the) hash, and whether the document has been told."""

    def __init__(self, doc: np.ndarray, text: np.ndarray, h: np.ndarray, told: np.ndarray):
        self.doc, self.text, self.h, self.told = doc, text, h, told

    @staticmethod
    def read(rows: list[tuple[pa.RecordBatch, int]]) -> Anchors:
        raw = lambda batch, k, name: column(batch, name)[k].as_buffer()
        n = sum(raw(*r, "hashes").size for r in rows) // SENT
        out = Anchors(np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, bool))
        at = 0
        for r in rows:
            counts = np.frombuffer(raw(*r, "counts"), "<u4")
            end = at + int(counts.sum())
            out.doc[at:end] = np.repeat(np.frombuffer(raw(*r, "docs"), np.int64), counts)
            out.text[at:end] = np.repeat(np.frombuffer(raw(*r, "texts"), np.int64), counts)
            out.h[at:end] = _unpacked(raw(*r, "hashes"))
            out.told[at:end] = np.unpackbits(np.frombuffer(raw(*r, "shared"), np.uint8), count=end - at)
            at = end
        return out

    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorts by hash; places of the entries to tell (their hash is in two texts), and of one entry a hash. A hash that
        any document has been told of is shared; what stays of it counts as told."""
        order = np.lexsort((~self.told, self.h))
        self.doc, self.text, self.h, self.told = self.doc[order], self.text[order], self.h[order], self.told[order]
        first = np.flatnonzero(np.r_[True, self.h[1:] != self.h[:-1]]) if len(order) else np.zeros(0, np.int64)
        if not len(first):
            return first, first
        least, most = np.minimum.reduceat(self.text, first), np.maximum.reduceat(self.text, first)
        shared = (least != most) | self.told[first]
        several = np.repeat(shared, np.diff(np.r_[first, len(order)]))
        tell = np.flatnonzero(several & ~self.told)
        self.told[first] |= shared
        return tell, first

    def told_rows(self, i: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Bucket, documents, counts and hashes of what there is to tell at these places."""
        of = _buckets(self.doc[i], buckets)
        order = np.lexsort((self.doc[i], of))
        i, of = i[order], of[order]
        cuts = _by_group(of)
        for a, b in zip(cuts, cuts[1:], strict=False):
            ends = _by_group(self.doc[i[a:b]])
            yield int(of[a]), self.doc[i[a:b]][ends[:-1]].tobytes(), np.diff(ends).astype("<u4").tobytes(), _packed(self.h[i[a:b]])

    def dealt(self, n_ranges: int, buckets: int) -> pa.RecordBatch:
        """Rows of two kinds: one entry a hash by range, laid out by document; and what this run alone can tell."""
        tell, first = self.met()
        out: list[list] = [[] for _ in _ANCHORS]

        def add(*values) -> None:
            for c, v in zip(out, values, strict=True):
                c.append(v)

        rng = _ranges(self.h[first] & _LOW, n_ranges)
        # by range, then by document
        order = np.lexsort((self.text[first], self.doc[first], rng))
        first, rng = first[order], rng[order]
        cuts = _by_group(rng)
        for a, b in zip(cuts, cuts[1:], strict=False):
            i = first[a:b]
            ends = np.flatnonzero(np.r_[True, (self.doc[i][1:] != self.doc[i][:-1]) | (self.text[i][1:] != self.text[i][:-1]), True])
            own = i[ends[:-1]]
            add(int(rng[a]), self.doc[own].tobytes(), self.text[own].tobytes(), np.diff(ends).astype("<u4").tobytes(), _packed(self.h[i]), np.packbits(self.told[i]).tobytes())
        for bucket, docs, counts, hashes in self.told_rows(tell, buckets):
            add(-1 - bucket, docs, None, counts, hashes, None)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ANCHORS, strict=True)], schema=_ANCHORS)


def _anchor_runs(docs: DataFrame, n_ranges: int, buckets: int) -> DataFrame:
    """Anchors of runs of documents, dealt by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def joined() -> Anchors:
            return Anchors(*(np.concatenate(c) for c in zip(*parts, strict=True)))

        for batch in batches:
            for a, b, flat, offsets in text_chunks(batch):
                at, h = anchors(flat)
                ok = _valid(offsets, len(flat))
                change = ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1]] if len(at) else ok
                s = np.flatnonzero(change)
                row = np.searchsorted(offsets, s, "right") - 1
                # one entry for each hash of a text
                order = np.lexsort((h[s], row))
                s, row = s[order], row[order]
                keep = np.r_[True, (row[1:] != row[:-1]) | (h[s][1:] != h[s][:-1])] if len(s) else np.zeros(0, bool)
                ids, texts = (np.asarray(column(batch, c).slice(a, b - a)) for c in ("doc_id", "text_hash"))
                parts.append((ids[row[keep]], texts[row[keep]], h[s[keep]] & _LOW, np.zeros(int(keep.sum()), bool)))
                held += len(parts[-1][0])
                if held >= RUN_ANCHORS:
                    yield joined().dealt(n_ranges, buckets)
                    parts, held = [], 0
        if held:
            yield joined().dealt(n_ranges, buckets)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _ANCHORS_SQL)


def _dealt_again(runs: DataFrame, n_ranges: int, buckets: int) -> DataFrame:
    """Runs of few ranges, gathered by range and dealt into n_ranges (a multiple): pieces are as long as before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            aside = pc.less(column(batch, "range"), 0)
            if pc.any(aside).as_py():
                yield batch.filter(aside)
            for k in np.flatnonzero(~np.asarray(aside)):
                rows.append((batch, int(k)))
                held += column(batch, "hashes")[int(k)].as_buffer().size // SENT
                if held >= RUN_ANCHORS:
                    yield Anchors.read(rows).dealt(n_ranges, buckets)
                    rows, held = [], 0
        if held:
            yield Anchors.read(rows).dealt(n_ranges, buckets)

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(run, _ANCHORS_SQL)


def _buckets(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by(runs: DataFrame, key: str, groups: int) -> DataFrame:
    """runs grouped by key, in about as many tasks as there are groups, so that a task does not grow with the input."""
    return runs.repartition(min(max(2 * groups, 24), MOST_TASKS), key).groupBy(key)


def _shared_anchors(docs: DataFrame, n_ranges: int, fan: int, buckets: int) -> DataFrame:
    """(doc_id, hashes) of the anchors that two different texts hold, one row a document."""
    if n_ranges > fan:
        n_ranges = -(-n_ranges // fan) * fan
        runs = _dealt_again(_anchor_runs(docs, fan, buckets), n_ranges, buckets)
    else:
        runs = _anchor_runs(docs, n_ranges, buckets)
    told = "bucket long, docs binary, counts binary, hashes binary"

    def meet(t: pa.Table) -> pa.Table:
        if (at := t["range"][0].as_py()) < 0:
            return pa.table({"bucket": pa.array(np.full(t.num_rows, -1 - at, np.int64)), "docs": t["docs"], "counts": t["counts"], "hashes": t["hashes"]})
        found = Anchors.read([(batch, k) for batch in t.to_batches() for k in range(batch.num_rows)])
        tell, _ = found.met()
        rows = list(zip(*found.told_rows(tell, buckets), strict=True)) or [()] * 4
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "counts", "hashes"])

    def gather(t: pa.Table) -> pa.Table:
        raw = {c: b"".join(x.as_py() for chunk in t[c].chunks for x in chunk) for c in ("docs", "counts", "hashes")}
        doc, h = np.repeat(np.frombuffer(raw["docs"], np.int64), np.frombuffer(raw["counts"], "<u4")), _unpacked(raw["hashes"])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        ends = _by_group(doc)
        return pa.table({"doc_id": pa.array(doc[ends[:-1]], pa.int64()), "hashes": pa.array([_packed(h[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    return _by(_by(runs, "range", n_ranges + buckets).applyInArrow(meet, told), "bucket", buckets).applyInArrow(gather, "doc_id long, hashes binary")


_RUNS = pa.schema([("range", pa.int64()), *((c, pa.binary()) for c in ("low", "high", "shared", "size", "rest", "left_size", "left", "docs", "keys", "places")), ("doc_id", pa.int64()), ("key", pa.int64()), ("removed", pa.binary())])
_RUNS_SQL = "range long, low binary, high binary, shared binary, size binary, rest binary, left_size binary, left binary, docs binary, keys binary, places binary, doc_id long, key long, removed binary"
_SPAN = np.dtype([("place", "<i8"), ("mask", "<u4")])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def _by_row(doc: np.ndarray, key: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((key, doc))
    doc, key, spans = doc[order], key[order], spans[order]
    ends = _row_edges(doc, key)
    for a, b in zip(ends, ends[1:], strict=False):
        yield int(doc[a]), int(key[a]), spans[a:b].tobytes()


class Entries:
    """Entries of a run as arrays: right (WINDOW bytes from the anchor, zeros after size), left (bytes before, nearest
    first, zeros after left_size), document, row key and the anchor's place."""

    def __init__(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray, base: np.ndarray):
        reach = WINDOW - GRAM
        self.size, self.left_size = (last + WINDOW - at).astype(np.uint8), (at - first).astype(np.uint8)
        steps = np.arange(WINDOW)
        padded = np.concatenate([np.zeros(reach, np.uint8), flat, np.zeros(WINDOW, np.uint8)])
        self.right = np.where(steps < self.size[:, None], padded[at[:, None] + reach + steps], 0).astype(np.uint8)
        back = np.arange(reach)
        self.left = np.where(back < self.left_size[:, None], padded[at[:, None] + reach - 1 - back], 0).astype(np.uint8)
        self.doc, self.key, self.place = doc, key, at - base

    FIELDS = ("size", "left_size", "right", "left", "doc", "key", "place")

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        out = Entries.__new__(Entries)
        for f in Entries.FIELDS:
            setattr(out, f, np.concatenate([getattr(p, f) for p in parts]))
        return out

    def taken(self, i: np.ndarray) -> Entries:
        out = Entries.__new__(Entries)
        for f in Entries.FIELDS:
            setattr(out, f, getattr(self, f)[i])
        return out


def _as_words(m: np.ndarray) -> list[np.ndarray]:
    wide = -(-m.shape[1] // 8) * 8
    return list(np.ascontiguousarray(np.pad(m, ((0, 0), (0, wide - m.shape[1])))).view(">u8").astype(np.uint64).T)


#: Bytes of an entry's place in the order: right, size, left, left_size, document.
PLACE = WINDOW + 1 + WINDOW - GRAM + 1 + 8


def _places(e: Entries) -> np.ndarray:
    """Entries' places in the order, as strings of PLACE bytes."""
    doc = (e.doc.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([e.right, e.size[:, None], e.left, e.left_size[:, None], doc], 1)).view(f"S{PLACE}").ravel()


def _in_order(e: Entries) -> Entries:
    return e.taken(np.lexsort((e.doc, e.left_size, *_as_words(e.left)[::-1], e.size, *_as_words(e.right)[::-1])))


def _settled(e: Entries) -> tuple[Entries, list[tuple]]:
    """e, in order, without entries equal to one of a smaller id, and those as spans."""
    same = np.r_[False, (e.right[1:] == e.right[:-1]).all(1) & (e.left[1:] == e.left[:-1]).all(1) & (e.size[1:] == e.size[:-1]) & (e.left_size[1:] == e.left_size[:-1])]
    smallest = e.doc[np.flatnonzero(~same)][np.cumsum(~same) - 1]
    gone = e.doc > smallest
    if not gone.any():
        return e, []
    i = np.flatnonzero(gone)
    spans = np.zeros(len(i), _SPAN)
    spans["place"] = e.place[i]
    low = np.maximum(0, WINDOW - e.size[i].astype(np.int64))  # offsets (anchor - window start) low..left_size
    high = e.left_size[i].astype(np.int64)
    spans["mask"] = ((1 << (high + 1)) - (1 << low)).astype(np.uint32)
    return e.taken(~gone), list(_by_row(e.doc[i], e.key[i], spans))


def _cut_at(e: Entries, splitters: np.ndarray, base: int = 0, low: bytes = b"", high: bytes = b"") -> Iterator[tuple]:
    """Front-coded pieces of e, in order, each with the splitters around it."""
    cuts = np.r_[0, np.searchsorted(_places(e), splitters), len(e.doc)]
    steps, back = np.arange(WINDOW), np.arange(WINDOW - GRAM)
    whole = [x.ljust(PLACE, b"\0") for x in splitters.tolist()]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        p = e.taken(slice(cuts[k], cuts[k + 1]))
        lcp = np.r_[0, _common(p.right[1:], p.right[:-1])].astype(np.uint8)
        rest = p.right[(steps >= lcp[:, None]) & (steps < p.size[:, None])]
        left = p.left[back < p.left_size[:, None]]
        around = (whole[k - 1] if k else low, whole[k] if k < len(whole) else high)
        yield (base + k, *around, lcp.tobytes(), p.size.tobytes(), rest.tobytes(), p.left_size.tobytes(), left.tobytes(), p.doc.tobytes(), p.key.tobytes(), p.place.astype(np.int64).tobytes(), None, None, None)


def _aside(settled: list[tuple], n_ranges: int) -> Iterator[tuple]:
    """What a run has settled passes the exchange in groups of its own."""
    for doc, key, blob in settled:
        yield (-1 - key % n_ranges, *[None] * 10, doc, key, blob)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUNS, strict=True)], schema=_RUNS)


def _entries(texts: DataFrame, use, schema: str) -> DataFrame:
    """use(iterator of Entries) of every partition's texts: doc_id, key, text, hashes (of its shared anchors)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Entries]:
        for batch in batches:
            shared = column(batch, "hashes")
            ids, keys = np.asarray(column(batch, "doc_id")), np.asarray(column(batch, "key"))
            for a, b, flat, offsets in text_chunks(batch):
                at, h = anchors(flat)
                ok = _valid(offsets, len(flat))
                row = np.repeat(np.arange(b - a), np.diff(offsets))[: len(at)]
                for i in range(a, b):
                    x, y = offsets[i - a], min(offsets[i - a + 1], len(at))
                    if y > x:
                        ok[x:y] &= np.isin(h[x:y] & _LOW, _unpacked(shared[i].as_buffer()))
                if not ok.any():
                    continue
                starts = np.flatnonzero(ok & np.r_[True, ~ok[:-1] | (at[1:] != at[:-1])])
                stops = np.flatnonzero(ok & np.r_[~ok[1:] | (at[1:] != at[:-1]), True])
                r = row[starts]
                yield Entries(flat, starts, stops, at[starts], ids[a + r], keys[a + r], offsets[r])

    return texts.select("doc_id", "key", "text", "hashes").mapInArrow(lambda batches: use(found(batches)), schema)


def _at_grams(picked: np.ndarray) -> np.ndarray:
    """Splitters moved to the start of their anchor's gram, which no window crosses. Where several fall into one gram, that
    gram fills ranges of its own: its start, the splitters inside as they are, and its end."""
    out: list[bytes] = []
    whole = [x.ljust(PLACE, b"\0") for x in picked.tolist()]
    grams = [x[:GRAM] for x in whole]
    for k, (x, gram) in enumerate(zip(whole, grams, strict=True)):
        out.append(gram)
        if gram in (grams[k - 1] if k else None, grams[k + 1] if k + 1 < len(grams) else None):
            after = int.from_bytes(gram, "big") + 1
            out += [x, *([after.to_bytes(GRAM, "big")] if after >> 8 * GRAM == 0 else [])]
    return np.unique(np.array([x.ljust(PLACE, b"\0") for x in out], f"S{PLACE}"))


def _splitters(texts: DataFrame, total: int, fan: int, range_entries: int) -> tuple[np.ndarray, int]:
    """Places that cut the entries of texts (total bytes) into equal parts, at most `fan`, and how many ranges are wanted.
    Texts are sampled by the hash of their key, about SAMPLE_BYTES of them at any size."""
    part = min(1.0, SAMPLE_BYTES / max(total, 1))
    thin = max(1, int(total * part) >> 18)

    def use(found: Iterator[Entries]) -> Iterator[pa.RecordBatch]:
        for e in found:
            places = _places(e.taken(mixed(e.place.astype(np.uint64) ^ e.key.astype(np.uint64)) % np.uint64(thin) == 0))
            yield pa.RecordBatch.from_arrays([pa.array([x.ljust(PLACE, b"\0") for x in places.tolist()], pa.binary())], ["place"])

    drawn = texts.where(F.pmod(F.xxhash64("key", F.lit("splitters")), F.lit(1 << 20)) < max(1, int(part * (1 << 20))))
    got = np.sort(np.array([r[0] for r in _entries(drawn, use, "place binary").collect()], f"S{PLACE}"))
    wanted = max(1, round(len(got) * thin / part / range_entries))
    n = min(wanted, fan)
    return _at_grams(got[np.arange(1, n) * len(got) // n]) if n > 1 else got[:0], wanted


def _suffix_runs(texts: DataFrame, splitters: np.ndarray) -> DataFrame:
    def use(found: Iterator[Entries]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            kept, gone = _settled(_in_order(Entries.joined(parts)))
            yield _batch([*_cut_at(kept, splitters), *_aside(gone, len(splitters) + 1)])

        for e in found:
            parts.append(e)
            held += len(e.doc)
            if held >= RUN_ENTRIES:
                yield from flush()
                parts, held = [], 0
        if parts:
            yield from flush()

    return _entries(texts, use, _RUNS_SQL)


def _decoded(rows: dict[str, list[bytes]]) -> Entries:
    """Pieces laid end to end as entries; bytes that a front code leaves out come from the last entry that has them."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
    e = Entries.__new__(Entries)
    e.size, e.left_size, e.doc, e.key, e.place = get("size", np.uint8), get("left_size", np.uint8), get("docs", np.int64), get("keys", np.int64), get("places", np.int64)
    shared, steps = get("shared", np.uint8), np.arange(WINDOW)
    has = (steps >= shared[:, None]) & (steps < e.size[:, None])
    e.right = np.zeros((len(e.size), WINDOW), np.uint8)
    e.right[has] = get("rest", np.uint8)
    new = steps >= shared[:, None]  # zeros after the size count as own bytes
    of = np.arange(len(e.size))
    for j in range(WINDOW):
        last = np.maximum.accumulate(np.where(new[:, j], of, 0))
        e.right[:, j] = e.right[last, j]
    e.left = np.zeros((len(e.size), WINDOW - GRAM), np.uint8)
    e.left[np.arange(WINDOW - GRAM) < e.left_size[:, None]] = get("left", np.uint8)
    return e


def _runs_again(runs: DataFrame, fan: int, per: int) -> DataFrame:
    """Runs of few ranges: each range's pieces are merged into longer runs and cut at `per` splitters of its own, which
    its first run gives. Write the result before use: another attempt of a task may cut elsewhere."""
    names = ("shared", "size", "rest", "left_size", "left", "docs", "keys", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held, around, splitters = None, [], 0, (b"", b""), None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal splitters
            pieces = {n: [r[n] for r in rows] for n in names}
            order, _ = merge_runs([(np.frombuffer(r["shared"], np.uint8), np.frombuffer(r["size"], np.uint8), r["rest"]) for r in rows])
            # equal suffixes go on to be ordered by what is to their left
            kept, gone = _settled(_in_order(_decoded(pieces).taken(order)))
            if splitters is None:
                n = min(per, fan, len(kept.doc))
                splitters = _at_grams(_places(kept)[np.arange(1, n) * len(kept.doc) // n]) if n > 1 else _places(kept)[:0]
            yield _batch([*_cut_at(kept, splitters, now * 4 * fan, *around), *_aside(gone, per * 64)])

        for batch in batches:
            aside = pc.less(column(batch, "range"), 0)
            if pc.any(aside).as_py():
                yield batch.filter(aside)
            for r in batch.filter(pc.invert(aside)).to_pylist():
                if r["range"] != now or held >= RUN_ENTRIES:
                    if rows:
                        yield from flush()
                    rows, held = [], 0
                    if r["range"] != now:
                        now, around, splitters = r["range"], (r["low"], r["high"]), None
                rows.append(r)
                held += len(r["shared"])
        if rows:
            yield from flush()

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(run, _RUNS_SQL)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Loser tree over front-coded runs (shared, size, rest): the merged order as numbers into the runs laid end to end,
    and each entry's common prefix with the one before.

    An entry stands as a number of WINDOW bytes (zeros after its size, which shared prefixes count in). Where two heads share prefixes of different length with the last
    winner, the longer is the smaller without a look at its bytes; only equal lengths compare what follows."""
    k = len(runs)
    bases = np.cumsum([0, *(len(r[0]) for r in runs)])
    shared = [r[0].tolist() for r in runs]
    size = [r[1].tolist() for r in runs]
    total = int(bases[-1])
    order, common = [0] * total, [0] * total
    at, used, text = [-1] * k, [0] * k, [b""] * k
    value, known = [0] * k, [0] * k
    done = 1 << (8 * WINDOW + 16)

    def step(r: int) -> None:
        """The next entry of run r; its front code is its common prefix with the entry that has just won."""
        at[r] = i = at[r] + 1
        if i >= len(shared[r]):
            value[r], known[r] = done, -1
            return
        keep, n = shared[r][i], size[r][i]
        more = max(0, n - keep)
        text[r] = t = (text[r][:keep] + runs[r][2][used[r] : used[r] + more]).ljust(WINDOW, b"\0")
        used[r] += more
        value[r] = int.from_bytes(t, "big") << 8 | n
        known[r] = keep

    def beats(a: int, b: int) -> bool:
        """Does a's head come first? The loser's known prefix becomes that with the winner."""
        if known[a] != known[b]:
            return known[a] > known[b]
        x = value[a] ^ value[b]
        if not x:
            low, first = (WINDOW if known[a] >= 0 else -1), a < b
        else:
            low, first = WINDOW - (((x >> 8).bit_length() + 7) >> 3), value[a] < value[b]
        if known[a] >= 0:
            known[b if first else a] = low
        return first

    for r in range(k):
        step(r)
        if at[r] < len(shared[r]):
            known[r] = 0
    tree = [-1] * max(k, 1)
    winner = -1
    for r in range(k):  # each run plays up from its leaf; the first to reach an empty node waits there
        now, node = r, (r + k) >> 1
        while node:
            if tree[node] < 0:
                tree[node] = now
                now = -1
                break
            if beats(tree[node], now):
                tree[node], now = now, tree[node]
            node >>= 1
        if now >= 0:
            winner = now
    out = 0
    while out < total:
        r = winner
        order[out] = int(bases[r]) + at[r]
        common[out] = known[r]
        out += 1
        i, codes, sizes = at[r] + 1, shared[r], size[r]
        # equal entries of a run follow unplayed
        while i < len(codes) and codes[i] == WINDOW and sizes[i] == sizes[i - 1]:
            order[out], common[out] = int(bases[r]) + i, WINDOW
            out += 1
            i += 1
        at[r] = i - 1
        step(r)
        now, node = r, (r + k) >> 1
        while node:
            rival = tree[node]
            if known[rival] > known[now] or known[rival] == known[now] and beats(rival, now):
                tree[node], now = now, rival
            node >>= 1
        winner = now
    return np.array(order, np.int64), np.array(common, np.int64)


def _left_names(left: np.ndarray) -> Iterator[np.ndarray]:
    """For 0, 1, 2.. bytes: numbers that are equal where so many bytes of left are."""
    order = np.lexsort(_as_words(left)[::-1])
    common = np.r_[0, _common(left[order[1:]], left[order[:-1]])]
    name = np.empty(len(left), np.int64)
    for o in range(left.shape[1] + 1):
        name[order] = np.cumsum(common < o)
        yield name


def resolve(common: np.ndarray, size: np.ndarray, left_size: np.ndarray, left: np.ndarray, doc: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """For entries in merged order: bit o is set if the window that starts o bytes before the anchor is in a smaller id.
    Also, for each o, the entries that keep their window while the window's suffix reaches into another range (reach:
    an entry's common prefix with a splitter beside the range)."""
    mask = np.zeros(len(doc), np.uint32)
    going: list[tuple[int, np.ndarray]] = []
    for o, left_name in enumerate(_left_names(left)):
        depth = WINDOW - o
        i = np.flatnonzero((size >= depth) & (left_size >= o))
        if not len(i):
            continue
        name = np.cumsum(common < depth)[i] * np.int64(len(doc) + 1) + left_name[i]
        by = np.lexsort((doc[i], name))
        name, d = name[by], doc[i][by]
        new = np.r_[True, name[1:] != name[:-1]]
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[i[by[d > smallest]]] |= np.uint32(1 << o)
        if reach is not None:
            j = i[by[(d == smallest) & (reach[i[by]] >= depth)]]
            if len(j):
                going.append((o, j))
    return mask, going


def _digests(e: Entries, of: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the windows that start o bytes before the anchors."""
    both = []
    for salt in (0x9E37, 0x79B97F4A):
        h = np.full(len(of), salt + o, np.uint64)
        for m, n in ((e.right, WINDOW - o), (e.left, o)):
            for w in _as_words(m[of, :n]) if n else ():
                h = mixed((h ^ w) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(salt))
        both.append(h.view(np.int64))
    return both[0], both[1]


_SPANS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("docs", "keys", "counts", "removed")), *((c, pa.int64()) for c in ("doc_id", "key", "a", "b", "place")), ("o", pa.int32())])
_SPANS_SQL = "bucket long, docs binary, keys binary, counts binary, removed binary, doc_id long, key long, a long, b long, place long, o int"


def _row_edges(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), True]) if len(doc) else np.zeros(1, np.int64)


def _bundled(doc: np.ndarray, key: np.ndarray, spans: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Spans by bucket of their documents: bucket, documents, row keys, spans of each, and the spans."""
    of = _buckets(doc, buckets)
    order = np.lexsort((key, doc, of))
    of, doc, key, spans = of[order], doc[order], key[order], spans[order]
    cuts = _by_group(of)
    for a, b in zip(cuts, cuts[1:], strict=False):
        ends = _row_edges(doc[a:b], key[a:b])
        first = a + ends[:-1]
        yield int(of[a]), doc[first].tobytes(), key[first].tobytes(), np.diff(ends).astype("<u4").tobytes(), spans[a:b].tobytes()


def _merged(runs: DataFrame, n_ranges: int, buckets: int) -> DataFrame:
    """Of every range: for each bucket of documents the spans that a smaller id holds; and, with a bucket of null, windows
    that another range may hold too: doc_id, key, digest (a, b), place and o."""

    def table(columns: dict[str, pa.Array]) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SPANS], schema=_SPANS)

    def lost(doc: np.ndarray, key: np.ndarray, spans: np.ndarray) -> pa.Table:
        rows = list(zip(*_bundled(doc, key, spans, buckets), strict=True)) or [()] * 5
        return table({f.name: pa.array(c, f.type) for f, c in zip(_SPANS, rows, strict=False)})

    def meet(t: pa.Table) -> pa.Table:
        if t["range"][0].as_py() < 0:
            blobs = t["removed"].to_pylist()
            n = [len(x) // _SPAN.itemsize for x in blobs]
            return lost(np.repeat(np.asarray(t["doc_id"]), n), np.repeat(np.asarray(t["key"]), n), np.frombuffer(b"".join(blobs), _SPAN))
        rows = {name: [x.as_py() for c in t[name].chunks for x in c] for name in ("shared", "size", "rest", "left_size", "left", "docs", "keys", "places")}
        order, common = merge_runs([(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), c) for a, b, c in zip(rows["shared"], rows["size"], rows["rest"], strict=True)])
        e = _decoded(rows).taken(order)
        del rows
        size, left_size = e.size.astype(np.int64), e.left_size.astype(np.int64)
        reach = np.zeros(len(size), np.int64)
        for splitter, at, towards in ((t["low"][0].as_py(), 0, common), (t["high"][0].as_py(), -1, np.r_[common[1:], 0][::-1])):
            if splitter and (splitter[WINDOW] or at):  # no window begins before a gram's start and reaches over it
                ends = int(_common(np.frombuffer(splitter[:WINDOW], np.uint8)[None], e.right[at][None])[0])
                far = np.minimum.accumulate(np.r_[ends, towards[1:]])
                reach = np.maximum(reach, far if at == 0 else far[::-1])
        clipped = np.minimum(common, np.minimum(size, np.r_[0, size[:-1]]))
        mask, going = resolve(clipped, size, left_size, e.left, e.doc, reach if reach.any() else None)
        i = np.flatnonzero(mask)
        spans = np.zeros(len(i), _SPAN)
        spans["place"], spans["mask"] = e.place[i], mask[i]
        out = [lost(e.doc[i], e.key[i], spans)]
        for o, j in going:
            a, b = _digests(e, j, o)
            out.append(table({"doc_id": pa.array(e.doc[j]), "key": pa.array(e.key[j]), "a": pa.array(a), "b": pa.array(b), "place": pa.array(e.place[j]), "o": pa.array(np.full(len(j), o, np.int32))}))
        give_back()
        return pa.concat_tables(out)

    return _by(runs, "range", 2 * n_ranges).applyInArrow(meet, _SPANS_SQL)


def _gathered(merged: DataFrame, buckets: int) -> DataFrame:
    """doc_id, key, removed of the bundles of all ranges, one row a document."""

    def gather(t: pa.Table) -> pa.Table:
        raw = {c: b"".join(t[c].to_pylist()) for c in ("docs", "keys", "counts", "removed")}
        n = np.frombuffer(raw["counts"], "<u4")
        doc, key, spans = np.repeat(np.frombuffer(raw["docs"], np.int64), n), np.repeat(np.frombuffer(raw["keys"], np.int64), n), np.frombuffer(raw["removed"], _SPAN)
        rows = list(zip(*_by_row(doc, key, spans), strict=True)) or [()] * 3
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "key", "removed"])

    return _by(merged.where("bucket is not null").select("bucket", "docs", "keys", "counts", "removed"), "bucket", buckets).applyInArrow(gather, "doc_id long, key long, removed binary")


def _spans(merged: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, key, removed: list of spans) of every row that loses something; merged is read twice. A window that went on
    has one row a range and repeat, so its digests spread; equal ones are counted together before they move."""
    windows = merged.where("bucket is null").select("doc_id", "key", "a", "b", "place", "o")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    lost = windows.join(least, ["a", "b"]).where("doc_id > least")
    # a span as it lies in memory: the place in eight bytes and the mask in four, least byte first
    little = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * (n - k) - 1, 2) for k in range(n)]))
    one = F.concat(little(F.col("place"), 8), little(F.expr("shiftleft(1L, o)"), 4))
    both = _gathered(merged, buckets).unionByName(lost.select("doc_id", "key", one.alias("removed")))
    return both.groupBy("doc_id", "key").agg(F.collect_list("removed").alias("removed"))


def removed_spans(n: int, blobs: list[bytes]) -> np.ndarray:
    """Maximal removed runs as (start, end) rows."""
    spans = np.frombuffer(b"".join(blobs), _SPAN)
    i, o = np.nonzero(spans["mask"][:, None] >> np.arange(WINDOW - GRAM + 1, dtype=np.uint32) & np.uint32(1))
    first = spans["place"][i] - o
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + WINDOW, minlength=n + 1)
    inside = np.r_[False, np.cumsum(edge)[:n] > 0, False]
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def _cut_out(texts: DataFrame) -> DataFrame:
    """doc_id, key, spans, n_removed and kept_sha256 of texts with removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, blobs in zip(column(batch, "text"), column(batch, "removed").to_pylist(), strict=True):
                raw = text.as_py() or b""
                spans = removed_spans(len(raw), blobs)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for c, x in zip(out, (spans.ravel().tolist(), int(np.diff(spans).sum()), kept.hexdigest()), strict=True):
                    c.append(x)
            types = (pa.list_(pa.int64()), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "key"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "key", "spans", "n_removed", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, key long, spans array<long>, n_removed long, kept_sha256 string")


def row_key() -> Column:
    return F.xxhash64("doc_id", F.lit("row"), "text")


def _with_copies(whole: DataFrame, hot: int) -> DataFrame:
    """whole with `copy`: is an equal text under a smaller id? Groups of over `hot` copies, of which there are few, meet by
    a broadcast while their number is bounded; the rest are small groups of a join."""
    groups = cut(whole.where(f"doc_id is not null and n_bytes >= {WINDOW}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    large, rest = groups.where(F.col("n") > hot), groups
    if 0 < large.count() <= BROADCAST_IDS:
        whole = whole.join(F.broadcast(large.select("sha", F.col("first").alias("large"))), "sha", "left")
        rest = groups.where(F.col("n") <= hot)
    else:
        whole = whole.withColumn("large", F.lit(None).cast("long"))
    # rows of large groups get sums of their own here, so that they do not meet in one task
    at = F.when(F.col("large").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")))
    out = whole.withColumn("at", at).join(rest.select(F.col("sha").alias("at"), "first"), "at", "left")
    return out.select("doc_id", "key", "n_bytes", "sha", F.coalesce(F.col("doc_id") > F.coalesce("large", "first"), F.lit(False)).alias("copy"))


def deduplicate(docs: DataFrame, fan: int = FAN, range_bytes: int = RANGE_BYTES, range_entries: int = RANGE_ENTRIES, hot: int = HOT_COPIES) -> DataFrame:
    """doc_id, key, n_bytes, n_removed, kept_sha256 and spans (start, end, start, end.. in bytes) of every row of docs;
    key is row_key() of doc_id as long and text as string, null counting as empty."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumns({"key": row_key(), "text_hash": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("long")})
    with Scratch(spark) as scratch:
        whole = scratch.keep(docs.select("doc_id", "key", "n_bytes", F.sha2("text", 256).alias("sha")), "whole")
        whole = scratch.keep(_with_copies(whole, hot), "copies")
        n, total = whole.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()

        long = docs.where(f"doc_id is not null and n_bytes >= {WINDOW}")
        shared = scratch.keep(_shared_anchors(long, max(24, -(-total // range_bytes)), fan, -(-n // BUCKET) or 1), "shared")
        # one row a distinct text and id, without copies
        told = scratch.keep(whole.where("not copy").select("doc_id", "key", "n_bytes").distinct().join(shared, "doc_id"), "told")
        scratch.drop("shared")
        total = told.agg(F.sum("n_bytes")).first()[0] or 0
        texts = long.select("doc_id", "key", F.col("text").cast("binary").alias("text")).join(told.drop("n_bytes"), ["doc_id", "key"])
        texts = scratch.keep(texts, "texts")
        scratch.drop("told")
        splitters, wanted = _splitters(texts, total, fan, range_entries)
        n_ranges = len(splitters) + 1
        runs = _suffix_runs(texts, splitters)
        if wanted > fan:
            runs = scratch.keep(_runs_again(runs, fan, per := -(-2 * wanted // fan)), "runs")
            n_ranges *= per
        buckets = max(1, -(-n // SPAN_DOCS), -(-total // SPAN_BYTES))
        spans = _spans(scratch.keep(_merged(runs, n_ranges, buckets), "merged"), buckets)
        # equal rows share a key
        partly = scratch.keep(_cut_out(texts.select("doc_id", "key", "text").join(spans, ["doc_id", "key"])).dropDuplicates(["doc_id", "key"]), "partly")

        nothing = hashlib.sha256().hexdigest()
        out = whole.join(partly, ["doc_id", "key"], "left")
        empty = F.array().cast("array<long>")
        return cut(
            out.select(
                "doc_id",
                "key",
                "n_bytes",
                F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                F.when(F.col("copy"), F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", empty)).alias("spans"),
            )
        )


def without_repeats(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without the bytes that deduplicate() found (touched: its rows); characters that
    lose a part go whole, and n_chars follows. Rows that lose nothing are neither shuffled nor sent to Python."""
    schema = docs.schema
    at = ["__llm_doc", "__llm_key"]
    hit = cut(touched.where("n_removed > 0").groupBy(F.col("doc_id").alias("__llm_doc"), F.col("key").alias("__llm_key")).agg(F.first("spans").alias("__llm_spans")))
    keys = F.broadcast(hit.select(at)) if hit.count() <= BROADCAST_IDS else hit.select(at)
    doc = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__llm_doc": doc, "__llm_key": F.xxhash64(doc, F.lit("row"), F.coalesce(F.col("text"), F.lit("")))})
    clean = keyed.join(keys, at, "left_anti").select(docs.columns)
    partly = keyed.join(keys, at, "left_semi").join(hit, at).select(*docs.columns, "__llm_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(column(batch, "text"), column(batch, "__llm_spans").to_pylist(), strict=True):
                raw, kept, at = (text.as_py() or "").encode(), [], 0
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    kept.append(raw[at:a].decode("utf-8", "ignore"))
                    at = b
                kept.append(raw[at:].decode("utf-8", "ignore"))
                texts.append("".join(kept))
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__llm_spans"}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return clean.unionByName(partly.mapInArrow(run, schema))
