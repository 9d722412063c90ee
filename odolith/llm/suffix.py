"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix is ordered only through its first ``DEPTH`` bytes; suffixes that are then still equal are the repeated windows.
The digits are taken in an order that lets most suffixes fall out before they are moved:

1. An anchor in each window, the 64-byte digit with the least hash in it. Equal windows have equal anchors at equal places, so
   windows are grouped by one row per anchor (one in about 70 bytes), not one per suffix. An anchor met once ends here.
2. The whole context an anchor's windows can reach, as one digit, by its 128-bit BLAKE2 digest. Anchors with equal contexts have only repeated
   windows; so copies of documents and the inner parts of long passages end here, and stand in later passes by one of them.
3. What is left, the edges of repeated passages, sends its context bytes to its anchor's group, where 8-byte digits split the
   windows most significant first, by comparing bytes, until singles have fallen out and depth is reached. An anchor with more than ``HOT``
   edges has no task of its own: where its texts lie its windows are taken one by one and dealt by the 128-bit BLAKE2 digest of all their bytes.

So equal means equal bytes, or equal cryptographic digests of 128 bits; no other hash decides. Anchors that occur often within an Arrow
batch are combined there before any shuffle. Groups pass through tasks in sorted streams.

Null texts count as empty. Results depend only on texts: rows that repeat get equal results, each its own. Matches never cross
documents. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

DEPTH = 200
GRAM = 64
#: edges of an anchor beyond which its windows are dealt one by one
HOT = 8192
#: hot anchors that are broadcast, as rows of a long and a flag
SMALL = 1_000_000
#: contexts of one anchor in a batch beyond which they are not sent to be grouped
OFTEN = 8
#: rows that are decided at once, and rows of one anchor beyond which they stream through
SETTLE, STREAM = 50_000, 400_000
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.random.default_rng(12).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _pow2_hashes(b: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of length 1, 2, 4 .. upto."""
    h, out, n, k = _TABLE[b], {}, 1, 0
    out[1] = h
    while 2 * n <= upto and len(h) > n:
        h = h[:-n] * _ODD[k] + (h[n:] ^ (h[n:] >> np.uint64(29))) * _ODD[k + 8]
        h ^= h >> np.uint64(32)
        n, k = 2 * n, k + 1
        out[n] = h
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = op(x[:-n], x[n:])
        n *= 2
    return op(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(data: bytes, depth: int = DEPTH, gram: int = GRAM):
    """(p, lo, hi, h): anchor positions, the first and last start of the windows they stand for, and hashes of their digit."""
    n = len(data) - depth + 1
    if n <= 0:
        return None
    with np.errstate(over="ignore"):
        h = _pow2_hashes(np.frombuffer(data, np.uint8), gram)[gram]
    width = depth - gram + 1
    least = _slide(h, width, np.minimum)  # of each window
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    cand = np.flatnonzero(most == h)
    value = h[cand]
    k = np.searchsorted(cand, np.arange(n))  # the first candidate in each window ...
    wrong = np.flatnonzero(value[k] != least)
    while len(wrong):  # ... that has the window's least hash
        k[wrong] += 1
        wrong = wrong[value[k[wrong]] != least[wrong]]
    lo = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    hi = np.append(lo[1:], n) - 1
    used = k[lo]
    return cand[used], lo, hi, value[used]


def context_range(p: np.ndarray, size: int, depth: int = DEPTH, gram: int = GRAM):
    """Bounds of the bytes that windows around anchors at p can reach."""
    reach = depth - gram
    return np.maximum(p - reach, 0), np.minimum(p + gram + reach, size)


def _digest(data, salt: int = 0) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(4, "little")).digest()


def _context_digests(data: bytes, p: np.ndarray) -> np.ndarray:
    """Two longs for each anchor: the digest of its context, and of where the text clips it."""
    a, b = context_range(p, len(data))
    view = memoryview(data)
    return np.frombuffer(b"".join(_digest(view[x:y], z) for x, y, z in zip(a.tolist(), b.tolist(), (p - a).tolist(), strict=True)), np.int64).reshape(-1, 2)


ANCHOR = "kind int, h long, c long, d long, id long, crc int, p int, lo int, hi int"
_NAMES = [x.split()[0] for x in ANCHOR.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4]
# kinds of ANCHOR rows: to be grouped; all windows repeat; windows undecided; only tells that the anchor occurs elsewhere
OPEN, WHOLE, EDGE, MARK = 0, 1, 2, 3


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("data")).select("doc_id", F.coalesce("doc_id", F.xxhash64("data")).alias("id"), (F.crc32("data") - (1 << 31)).cast("int").alias("crc"), "data")


def _combine(h, c, d, limit):
    """kind for each row of a batch, and the indexes that stand for their classes in the shuffle."""
    order = np.lexsort((d, c, h))
    hs, cs, ds = h[order], c[order], d[order]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], (cs[1:] != cs[:-1]) | (ds[1:] != ds[:-1])])
    cls = np.cumsum(new_c) - 1
    size = np.bincount(cls)
    group = np.cumsum(new_h) - 1
    n_classes = np.bincount(group[new_c])
    kind = np.full(len(h), OPEN)
    first = np.zeros(len(h), bool)
    first[order] = new_c
    many, often = np.zeros(len(h), bool), np.zeros(len(h), bool)
    many[order] = size[cls] > 1
    often[order] = n_classes[group] > limit
    kind[many & ~first] = WHOLE
    kind[often & ~many] = EDGE
    mark = np.zeros(len(h), bool)
    mark[order] = new_h
    return kind, first & many, often, mark & often


def _find(limit, bits):
    def run(batches):
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            for doc, crc, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                got = anchors(data)
                if got is None:
                    continue
                p, lo, hi, h = got
                c = _context_digests(data, p)
                for col, v in zip(cols, ((h >> np.uint64(64 - bits)).view(np.int64), c[:, 0], c[:, 1], np.full(len(p), doc), np.full(len(p), crc), p, lo, hi), strict=True):
                    col.append(v)
            if not cols[0]:
                continue
            all_cols = [np.concatenate(x) for x in cols]
            kind, stands, often, mark = _combine(*all_cols[:3], limit)

            def out(sel, kinds, cols=all_cols):
                return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip([kinds, *(x[sel] for x in cols)], _TYPES, strict=True)], _NAMES)

            # of a class with several members one row is sent twice, so that it is seen to be one; anchors that occur in many contexts send a mark instead
            plain = (kind != OPEN) | ~stands
            yield out(plain, kind[plain])
            twice = stands & (kind == OPEN)
            yield out(np.repeat(np.flatnonzero(twice), 2), np.full(2 * twice.sum(), OPEN))
            yield out(mark, np.full(mark.sum(), MARK))

    return run


def _group(at_once, stream):
    """Rows sorted by (h, c, d, kind): decides each; an undecided row and one of each class whose group has other classes become EDGE."""

    def decide(r):
        h, c, d, kind = r["h"], r["c"], r["d"], r["kind"]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new_h) - 1
        real = kind == OPEN
        new_c = new_h | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (kind[1:] != kind[:-1])])
        cls = np.cumsum(new_c) - 1
        size = np.bincount(cls)[cls]
        varied = (np.bincount(group[new_c]) > 1)[group] | np.bincount(group, ~real).astype(bool)[group]
        whole = real & (size > 1)
        edge = real & varied & ((size == 1) | new_c)
        for mask, k in ((whole, WHOLE), (edge, EDGE)):
            if mask.any():
                cols = [np.full(mask.sum(), k), *(r[x][mask] for x in _NAMES[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(cols, _TYPES, strict=True)], _NAMES)

    def marked(r):
        r = {x: np.append(v, MARK if x == "kind" else v[-1]) for x, v in r.items()}
        order = np.lexsort((r["kind"], r["d"], r["c"], r["h"]))
        return {x: v[order] for x, v in r.items()}

    def run(batches):
        held = None
        for b in batches:
            r = {x: b.column(x).to_numpy(zero_copy_only=False) for x in _NAMES}
            held = r if held is None else {x: np.concatenate([held[x], r[x]]) for x in _NAMES}
            last = held["h"][-1] if len(held["h"]) else 0
            done = int(np.searchsorted(held["h"], last))
            if done >= at_once:
                yield from decide({x: v[:done] for x, v in held.items()})
                held = {x: v[done:] for x, v in held.items()}
            elif len(held["h"]) - done > stream:
                # a common anchor streams through: it is cut where its context changes, if it does, and a mark on both sides tells of the other
                change = np.flatnonzero(((held["c"][1:] != held["c"][:-1]) | (held["d"][1:] != held["d"][:-1])) & (held["h"][1:] == last)) + 1
                keep = int(change[-1]) if len(change) and change[-1] > done else len(held["h"]) - 2
                yield from decide(marked({x: v[:keep] for x, v in held.items()}))
                held = marked({x: v[keep:] for x, v in held.items()})
        if held is not None and len(held["h"]):
            yield from decide(held)

    return run


CONTEXT = "h long, id long, crc int, p int, lo int, hi int, at int, context binary"
_C_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]
_C_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary()]
REPEAT = "id long, crc int, lo int, hi int"
_R_NAMES = [x.split()[0] for x in REPEAT.split(", ")]
_R_TYPES = [pa.int64(), *[pa.int32()] * 3]


def _contexts(batches):
    """Texts with their undecided anchors (h, p, lo, hi, hot), to rows of ``CONTEXT``: of a hot anchor one for each window, with its digest for a context and no h."""
    for b in batches:
        rows: list[list] = [[] for _ in _C_NAMES]

        def put(*values, rows=rows):
            for col, v in zip(rows, values, strict=True):
                col.append(v)

        for doc, crc, data, edges in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            view = memoryview(data)
            for e in edges:
                if e["hot"]:
                    for s in range(e["lo"], e["hi"] + 1):
                        put(None, doc, crc, e["p"], s, s, s, _digest(view[s : s + DEPTH]))
                else:
                    put(e["h"], doc, crc, e["p"], e["lo"], e["hi"], e["lo"], data[e["lo"] : e["hi"] + DEPTH])
            if len(rows[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _C_TYPES, strict=True)], _C_NAMES)
                for col in rows:
                    col.clear()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _C_TYPES, strict=True)], _C_NAMES)


def radix_equal(group: np.ndarray, flat: np.ndarray, start: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which of the suffixes flat[start:] agree with another one of their group in their first ``depth`` bytes.

    Most significant digit first, eight bytes at a time; a suffix that is alone falls out of the later passes.
    """
    alive = np.arange(len(start))
    g = np.unique(group, return_inverse=True)[1]
    digits = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,)) if len(flat) >= 8 else np.zeros(1, np.uint64)
    at = [*range(0, depth - 8, 8), depth - 8] if depth >= 8 else []
    for k in at:
        d = digits[start[alive] + k]
        order = np.lexsort((d, g))
        gs, ds = g[order], d[order]
        new = np.concatenate([[True], (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])])
        cls = np.cumsum(new) - 1
        stays = (np.bincount(cls)[cls] > 1) if len(cls) else np.zeros(0, bool)
        alive, g = alive[order][stays], cls[stays]
        if not len(alive):
            break
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


def _repeat_rows(*cols):
    return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(cols, _R_TYPES, strict=True)], _R_NAMES)


def _runs(ids, crcs, s):
    """Starts, in order for each document, as ranges."""
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]) | (s[1:] != s[:-1] + 1)]))
    end = np.append(new[1:], len(s)) - 1
    return ids[new], crcs[new], s[new], s[end]


def _sort_windows(at_once):
    """Rows of ``CONTEXT`` sorted by h, at most ``HOT`` of one: ranges of starts whose windows repeat."""

    def settle(r):
        size = np.fromiter(map(len, r["context"]), np.int64, len(r["context"]))
        base = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(r["context"]), np.uint8)
        n = r["hi"] - r["lo"] + 1
        row = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + r["lo"][row]
        # windows of one anchor are comparable only where they hold it at the same place
        place = r["p"][row] - s
        new = np.unique(r["h"], return_inverse=True)[1][row].astype(np.int64) * DEPTH + place
        same = radix_equal(new, flat, base[row] + s - r["at"][row])
        if same.any():
            yield _repeat_rows(*_runs(r["id"][row][same], r["crc"][row][same], s[same]))

    def run(batches):
        held = None
        for b in batches:
            r = {x: np.array(b.column(x).to_pylist(), object) if x == "context" else b.column(x).to_numpy(zero_copy_only=False) for x in _C_NAMES}
            held = r if held is None else {x: np.concatenate([held[x], r[x]]) for x in _C_NAMES}
            done = int(np.searchsorted(held["h"], held["h"][-1])) if len(held["h"]) else 0
            if done >= at_once:
                yield from settle({x: v[:done] for x, v in held.items()})
                held = {x: v[done:] for x, v in held.items()}
        if held is not None and len(held["h"]):
            yield from settle(held)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def merged(ranges: list[tuple[int, int]], depth: int = DEPTH) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by windows that start in the ranges lo..hi."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + depth)
        else:
            out.append([lo, hi + depth])
    return [(a, b) for a, b in out]


def _strip(with_text: bool):
    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, data, ranges in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                runs = merged([(x["lo"], x["hi"]) for x in ranges or []])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                for col, v in zip(rows, (doc_id, len(data), len(data) - len(kept), len(runs), kept if with_text else hashlib.sha256(kept).digest()), strict=True):
                    col.append(v)
            types = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def repeated_ranges(docs: DataFrame, often: int = OFTEN, hot: int = HOT, settle: int = SETTLE, stream: int = STREAM, bits: int = 64) -> DataFrame:
    """(id, crc, lo, hi): ranges of starts of repeated windows, by the keys of ``_keyed``. ``bits`` is how much of an anchor's hash is used."""
    keyed = _keyed(docs)
    found = cut(keyed.where(F.length("data") >= DEPTH).mapInArrow(_find(often, bits), ANCHOR), "anchors")
    to_group = found.where(F.col("kind").isin(OPEN, MARK)).repartition("h").sortWithinPartitions("h", "c", "d", "kind")
    grouped = cut(to_group.mapInArrow(_group(settle, stream), ANCHOR).where(F.col("kind") != MARK), "grouped")
    decided = found.where(F.col("kind").isin(WHOLE, EDGE)).unionByName(grouped)
    undecided = decided.where(F.col("kind") == EDGE).select("h", "id", "crc", "p", "lo", "hi")
    crowded = cut(undecided.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("hot")), "crowded")
    undecided = undecided.join(F.broadcast(crowded) if crowded.count() <= SMALL else crowded, "h", "left")
    edges = undecided.groupBy("id", "crc").agg(F.collect_set(F.struct("h", "p", "lo", "hi", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("edges"))
    with_text = keyed.join(edges, ["id", "crc"]).select("id", "crc", "data", "edges")
    contexts = with_text.mapInArrow(_contexts, CONTEXT)
    parts = [decided.where(F.col("kind") == WHOLE).select("id", "crc", "lo", "hi")]
    if crowded.limit(1).count():
        contexts = cut(contexts, "contexts")
        windows = contexts.where("h is null")
        # a table of its own, so that the join sees two plain sides and a very common window can be split among tasks
        again = cut(windows.groupBy("context").agg(F.count("*").alias("n")).where("n > 1").select("context"), "again")
        parts.append(windows.join(again, "context", "left_semi").select("id", "crc", "lo", "hi"))
    sorted_ = contexts.where("h is not null").repartition("h").sortWithinPartitions("h", "id", "crc", "p")
    parts.append(cut(sorted_.mapInArrow(_sort_windows(settle // 10), REPEAT), "windows"))
    return reduce(DataFrame.unionByName, parts)


def remove_repeats(docs: DataFrame, with_text: bool = False, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text).

    ``kept`` holds the remaining bytes, or without ``with_text`` their SHA-256. ``limits`` as of ``repeated_ranges``; they change no result.
    """
    per_doc = repeated_ranges(docs, **limits).groupBy("id", "crc").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = _keyed(docs).join(cut(per_doc, "ranges"), ["id", "crc"], "left").select("doc_id", "data", "ranges")
    return joined.mapInArrow(_strip(with_text), RESULT)
