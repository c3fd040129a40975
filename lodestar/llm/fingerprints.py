"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by overlap."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import batched, buffers_of, mixed, stream, texts_of
from lodestar.session import settle

#: Bytes of a feature.
WINDOW = 32
#: Neighbouring windows of which the rarest is marked, and the marks that select it.
NEIGHBOURS, MARKS = 24, 6
#: Entropy (thousandths of the most a window can have) that running text has most often, and
#: the least that a feature needs: runs of a few letters say nothing.
TYPICAL, LEAST = 735, 100
#: Bits of a filter, features it takes before the next begins, and bits each feature sets.
BITS, FEATURES, HASHES = 1024, 96, 4
#: Text bytes fingerprinted together.
PIECE = 1 << 18
LANES = stream(11, WINDOW // 8)
#: c log2 c in whole numbers, so that running sums are exact.
WEIGHT = np.array([round(c * math.log2(c) * 65536) if c else 0 for c in range(WINDOW + 1)], np.int64)
GAIN = np.diff(WEIGHT)


def entropies(data: np.ndarray) -> np.ndarray:
    """Shannon entropy of every window of ``data``, in thousandths of the largest possible one."""
    n = len(data) - WINDOW + 1
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    counts = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = WEIGHT[counts].sum()
    total[1:] = GAIN[before[WINDOW:]] - GAIN[after[: n - 1]]  # one byte comes in, one goes out
    total = np.cumsum(total)
    top = round(math.log2(WINDOW) * WINDOW * 65536)
    return (top - total) * 1000 // top


def least_of_next(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each value and the ``span`` - 1 that follow it, of which the last are whole."""
    out, have = keys, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows in order, and the text each comes from."""
    ends, raw = buffers_of(texts)
    n = len(texts)
    length = np.diff(ends)
    pad = WINDOW + NEIGHBOURS  # what is selected in one text never depends on another
    place = ends[:-1] + pad * np.arange(n)
    data = np.zeros(len(raw) + pad * n + WINDOW, np.uint8)
    owner = np.repeat(np.arange(n), length)
    data[np.arange(len(raw)) + pad * owner] = raw
    windows = np.where(length > 0, np.maximum(1, length - WINDOW + 1), 0)  # a short text is one window
    own = np.repeat(np.arange(n), windows)
    at = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + place[own]
    rank = np.full(len(data) - WINDOW + 1, 2000, np.int64)
    entropy = entropies(data)[at]
    rank[at] = np.where(entropy < LEAST, 1000, 999 - np.abs(entropy - TYPICAL))
    keys = (rank << 40) + np.arange(len(rank))
    chosen = least_of_next(keys, NEIGHBOURS) & ((1 << 40) - 1)
    # neighbourhoods that lie within a text, or the only one of a text with fewer windows
    starts = np.where(windows > 0, np.maximum(1, windows - NEIGHBOURS + 1), 0)
    of = np.repeat(np.arange(n), starts)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + place[of]
    spots, first, marks = np.unique(chosen[begin], return_index=True, return_counts=True)
    keep = marks >= np.minimum(MARKS, starts[of[first]])
    spots, of = spots[keep], of[first[keep]]
    lanes = data[spots[:, None] + np.arange(WINDOW)].view(np.uint64)
    return mixed((mixed(lanes) * LANES).sum(axis=1)), of


def filters(texts: pa.Array) -> list[np.ndarray]:
    """For each text its chain of Bloom filters, as rows of packed bits."""
    hashes, of = features(texts)
    count = np.bincount(of, minlength=len(texts))
    chain = -(-count // FEATURES)
    first = np.cumsum(chain) - chain
    nth = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    bits = np.zeros((int(chain.sum()), BITS), bool)
    row = first[of] + nth // FEATURES
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(16 * k)).astype(np.int64) % BITS] = True
    packed = np.packbits(bits, axis=1)
    return [packed[f : f + c] for f, c in zip(first, chain, strict=True)]


def read(fingerprint: str) -> np.ndarray:
    """The chain that a fingerprint writes in hexadecimal digits."""
    return np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the shorter chain of the best overlap with a filter of the other, 0 to 1.

    An overlap counts from what chance may give filters so full (0, two deviations above its
    mean) to the most possible (1).
    Two empty chains are alike, an empty and another one are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    other = np.unpackbits(b, axis=1).astype(np.float32)
    set_b = other.sum(axis=1)
    best = []
    for at in range(0, len(a), 256):
        part = np.unpackbits(a[at : at + 256], axis=1).astype(np.float32)
        set_a = part.sum(axis=1)[:, None]
        mean, most = set_a * set_b / BITS, np.minimum(set_a, set_b)
        chance = mean + 2 * np.sqrt(mean * (1 - set_b / BITS))  # few bits often meet by chance
        best.append(((part @ other.T - chance) / np.maximum(most - chance, 1e-6)).max(axis=1))
    return float(np.clip(np.concatenate(best), 0, 1).mean())


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the start of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What is returned of each document.
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compared(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Result rows of texts and what follows each. Works in pieces of bounded size."""
    out = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        own = texts[at:end]
        new = [edited(t, f) for t, f in zip(own, following[at:end], strict=True)]
        last = following[at:end] if following[at : end - 1] != own[1:] else following[end - 1 : end]
        chains = filters(texts_of(pa.array(own + new + last, pa.large_string())))
        n = len(own)
        after = chains[2 * n :] if len(last) == n and n > 1 else [*chains[1:n], chains[-1]]
        for i in range(n):
            out.append(
                (
                    ids[at + i],
                    len(own[i]),
                    hashlib.sha256(new[i].encode()).hexdigest(),
                    chains[i].tobytes(),
                    chains[n + i].tobytes(),
                    likeness(chains[i], chains[n + i]),
                    likeness(chains[i], after[i]),
                )
            )
        at = end
    return out


NAMES = [f.split()[0] for f in RESULT.split(", ")]
ARROW = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def batch_of(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Finished rows, and (part, edge, doc_id, text) of the rows that still lack a neighbour."""
    full = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in NAMES]
    gap = [None] * len(edges)
    columns = [pa.array(c + ([e[2] for e in edges] if i == 0 else gap), t) for i, (c, t) in enumerate(zip(full, ARROW, strict=True))]
    none = [None] * len(rows)
    extra = [
        pa.array(none + [e[0] for e in edges], pa.int64()),
        pa.array(none + [e[1] for e in edges], pa.string()),
        pa.array(none + [e[3] for e in edges], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns + extra, names=[*NAMES, "part", "edge", "text"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how near they and the next are.

    The next document is the next by doc_id (ties by text, nulls first); after the last comes
    the first. Documents are put into ranges of doc_id, and a task streams a range in order;
    only the first and last document of each range meet afterwards. Null texts count as
    empty, empty texts have an empty fingerprint, alike to each other only; a text shorter
    than a window is one feature; repeated rows give repeated results; other columns are not
    read. A single document is its own next.
    """
    given = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        part, ids, texts, first = TaskContext.get().partitionId(), [], [], True
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            texts += batch.column("text").to_pylist()
            if first and ids:
                yield batch_of([], [(part, "first", ids[0], texts[0])])
                first = False
            if len(ids) > 1:
                yield batch_of(compared(ids[:-1], texts[:-1], texts[1:]), [])
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield batch_of([], [(part, "last", ids[0], texts[0])])

    ranged = given.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = settle(ranged.mapInArrow(run, f"{RESULT}, part long, edge string, text string"), "fingerprints")
    edges = found.filter("edge IS NOT NULL")
    order = Window.orderBy("part")  # one row for each range
    parts = edges.filter("edge = 'first'").select("part")
    start = parts.agg(F.min("part").alias("start"))
    following = parts.select("part", F.lead("part").over(order).alias("after")).join(F.broadcast(start)).select("part", F.coalesce("after", "start").alias("after"))
    heads = edges.filter("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    rest = edges.filter("edge = 'last'").join(following, "part").join(heads, "after").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            rows = compared(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))
            yield batch_of(rows, []).select(NAMES)

    every = found.filter("edge IS NULL").select(*NAMES).unionByName(rest.mapInArrow(finish, RESULT))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
