"""Near duplicates by Order MinHash beside sets of least hashes, candidates verified by a banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import batched, buffers_of, mixed, pieces, stream, texts_of, words_of
from lodestar.llm.components import components
from lodestar.session import settle

#: Words of a shingle.
WORDS = 5
#: Least similarity of a link, as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: Sketches of a text's occurrence-labelled runs, of whose ``MINIMA`` least hashes the text order is kept.
ORDERED_SKETCHES, MINIMA = 16, 4
#: Sketches of its distinct runs, whose order is left out.
SET_SKETCHES = 24
#: Runs up to which a text has more sketches, of fewer minima: four of few agree less often.
SHORT = 32
SHORT_ORDERED, SHORT_SETS, SHORT_MINIMA = 8, 16, 2
#: Sketches of what a text has beyond those it was compared with in a round, shared among its
#: pivots, ``LEAST_REST`` for each at least; a rest of more than ``REST_HALF`` of the text is
#: sketched with two minima, of less than ``REST_MOST`` with one.
REST_SKETCHES, LEAST_REST = 12, 3
REST_HALF, REST_MOST = 0.5, 0.6
#: Rows of a key within which all pairs may be compared, by round; the last holds from then
#: on. Texts' own keys come first; keys of rests grow fewer with each round.
SMALL = (32, 32, 128, 1024)
#: Places of the bitmap that a pivot has of its open members' keys (fixed value: those of Spark's bitmaps).
SIEVE_PLACES = 32768
#: Tasks that share a pivot's members.
SHARES = 64
#: Texts of a key that one task compares by signature with as many others.
BLOCK = 1024
#: Texts that one of a large key is held against at once, on average; where it would be more,
#: sketches of rests join groups first.
CROWD = 512
#: Bits of a signature for each run, and the least and most bits that one has.
SIGN_BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 16
FOLD = stream(7, WORDS)
SEEDS = stream(8, 32)
SET_SEEDS = SEEDS[:SET_SKETCHES]
REST_SEEDS = stream(9, REST_SKETCHES)
SHORT_SET_SEEDS = stream(10, SHORT_SETS)
ORDERED_SEEDS = stream(11, ORDERED_SKETCHES)
SHORT_ORDERED_SEEDS = stream(12, SHORT_ORDERED)
IN_ORDER = stream(13, MINIMA)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, in text order; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < WORDS:
        return mixed((hashes * FOLD[:n]).sum(keepdims=True) + np.uint64(n))
    out = hashes[: n - WORDS + 1] * FOLD[0]
    for i in range(1, WORDS):
        out = out + hashes[i : n - WORDS + 1 + i] * FOLD[i]
    return mixed(out)


def labelled(runs: np.ndarray) -> np.ndarray:
    """``runs`` with the first, second, ... occurrence of the same run told apart."""
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return runs
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
    out = np.empty_like(runs)
    out[order] = ranked + mixed(np.arange(len(runs), dtype=np.uint64) - start.astype(np.uint64) + np.uint64(1)) * (~fresh)
    return out


def sketches(marked: np.ndarray, seeds: np.ndarray = SEEDS, minima: int = MINIMA, ordered: bool = False) -> np.ndarray:
    """For each seed: a hash of the ``minima`` runs of least seeded hash.

    Of ``ordered`` ones their order in the text counts (Order MinHash); else they are a set,
    for texts that have the same runs in another order are similar too.
    """
    n, keep = len(marked), min(minima, len(marked))
    out = np.zeros(len(seeds), np.uint64)
    step = max(1, (1 << 16) // max(1, n))
    for at in range(0, len(seeds) if n else 0, step):
        seed = seeds[at : at + step, None]
        value = (marked[None, :] ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        if keep == 1:
            chosen = value.argmin(axis=1)[:, None]
        else:
            chosen = np.argpartition(value, keep - 1, axis=1)[:, :keep]
        if ordered:
            chosen.sort(axis=1)
            parts = mixed(marked[chosen]) * IN_ORDER[:keep]
        else:
            parts = mixed(marked[chosen])
        out[at : at + step] = mixed(parts.sum(axis=1) + seed[:, 0])
    return out


def text_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a text's labelled runs in text order, and of its distinct runs in no order.

    The former meet texts that align, with their repeats; the latter those that have the same
    runs in another order or another number of times.
    """
    runs = shingles(hashes)
    marked, distinct = labelled(runs), np.unique(runs)
    keys = [sketches(marked, ORDERED_SEEDS, ordered=True), sketches(distinct, SET_SEEDS)]
    if len(marked) <= SHORT:
        keys.append(sketches(marked, SHORT_ORDERED_SEEDS, SHORT_MINIMA, ordered=True))
    if len(distinct) <= SHORT:
        keys.append(sketches(distinct, SHORT_SET_SEEDS, SHORT_MINIMA))
    return np.unique(np.concatenate(keys))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words and the keys of every whole text.

    Texts of equal words have equal digests. Texts without a word are equal if they are the
    same string, and have no keys.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                texts = texts_of(part.column("text"))
                words, (ends, raw) = words_of(texts), buffers_of(texts)
                digests, keys = [], []
                for i in range(len(texts)):
                    hashes = words.hash[words.first[i] : words.first[i + 1]]
                    whole = hashes.tobytes() if len(hashes) else b"\0" + raw[ends[i] : ends[i + 1]].tobytes()
                    digests.append(hashlib.blake2b(whole, digest_size=16).digest())
                    keys.append(signed(text_keys(hashes)) if len(hashes) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, digest binary, keys array<long>")


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose pairs stay within ``band`` of the diagonal.

    Row by row over bits of a whole number; equal ends are taken off first.
    """
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b, m = a[head:], b[head:], m - head
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window, row = (1 << 2 * band + 1) - 1, full
    for i, x in enumerate(a):
        if match := places.get(x, 0) & (window << i >> band):
            row = (row + (row & match) | row & ~match) & full
    return head + tail + len(b) - row.bit_count()


def enough(shared: int, total: int) -> bool:
    """Whether ``shared`` of two texts' ``total`` runs make them similar: shared / union."""
    return shared * SIMILAR[1] >= (total - shared) * SIMILAR[0]


class Text:
    def __init__(self, hashes: np.ndarray):
        self.runs = shingles(hashes)
        self.marked = labelled(self.runs)
        self.sorted = np.sort(self.marked)
        self.distinct = np.unique(self.runs)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def compare(x: Text, y: Text) -> bool:
    """Whether two texts share four fifths of their runs of five words.

    The runs are shared in the order of an alignment, counted with their repeats; texts whose
    distinct runs alone are as similar count as well. Both are Jaccard similarities. The
    band is as wide as any alignment that reaches the similarity.
    """
    total = len(x.runs) + len(y.runs)
    if enough(common(x.sorted, y.sorted), total):  # else no alignment can
        least = -(-total * SIMILAR[0] // (SIMILAR[0] + SIMILAR[1]))
        if enough(aligned(x.runs, y.runs, max(len(x.runs), len(y.runs)) - least), total):
            return True
    return enough(common(x.distinct, y.distinct), len(x.distinct) + len(y.distinct))


def rest_keys(text: Text, pivot: Text, name: int, pivots: int = 1) -> np.ndarray:
    """Keys, under the pivot's name, of the runs that ``text`` has beyond ``pivot``, one of its ``pivots``.

    Similar texts have rests of like size. Large ones are mostly shared, so two minima find
    them and pass by what is common to many; in between both kinds of keys are made. Where
    runs repeat, the distinct ones have a rest of their own. A text that lies within the
    pivot has no rest; its own runs stand for it. The more pivots two texts share, the fewer
    sketches each needs for them to meet under one.
    """
    keys = []
    seeds = REST_SEEDS[: max(LEAST_REST, -(-REST_SKETCHES // pivots))]
    for own, others in ((text.marked, pivot.sorted), (text.distinct, pivot.distinct))[: 1 + (len(text.distinct) < len(text.runs))]:
        rest = own[~np.isin(own, others, kind="sort")]
        part = len(rest) / len(own)
        if 0 < part < REST_MOST:
            keys.append(sketches(rest, seeds, 1))
        if part > REST_HALF:
            keys.append(sketches(rest, ~seeds, 2))
        if not part:
            keys.append(sketches(own, ~seeds, 2))
    return np.unique(np.concatenate(keys)) ^ mixed(np.array([name], np.int64).view(np.uint64))


def in_sieve(sieve: str, key: Column) -> Column:
    """Whether a bitmap of 32,768 places may hold ``key``."""
    place = F.pmod(key, F.lit(SIEVE_PLACES)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(sieve), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(byte / F.pow(F.lit(2), place % 8), F.lit(2)).cast("int") == 1


def owed_keys(checked: DataFrame, groups: DataFrame) -> DataFrame:
    """doc, key, open: the rest keys that large keys ask for and that can still join two groups.

    A rest key is its pivot's alone and needs an open member, one that its comparison did not
    link. So a pivot with none is left out, and one whose members are all of one group; of the
    linked members only those keys are listed that an open one may hold, by a bitmap for each
    pivot, before rows are made of them.
    """
    asked = checked.filter("large").select("doc", "pivot", "similar", "keys").join(groups, "doc", "left").withColumn("group", F.coalesce("component", "doc"))
    pivots = asked.groupBy("pivot").agg(F.max(~F.col("similar")).alias("some"), (F.min("group") < F.max("group")).alias("split")).filter("some AND split").select("pivot")
    asked = settle(asked.join(pivots, "pivot", "left_semi").select("doc", "pivot", "similar", "keys"), "near-owed")
    loose = asked.filter(~F.col("similar")).select("doc", "pivot", F.explode("keys").alias("key"))
    sieves = loose.groupBy("pivot").agg(F.bitmap_construct_agg(F.pmod("key", F.lit(SIEVE_PLACES))).alias("sieve"))
    linked = asked.filter("similar").join(sieves, "pivot").select("doc", F.explode(F.filter("keys", lambda k: in_sieve("sieve", k))).alias("key"), F.lit(False).alias("open"))
    return loose.select("doc", "key", F.lit(True).alias("open")).unionByName(linked)


def live_keys(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """doc, key, group and n of the keys whose documents are not all linked already.

    ``members``: doc, key, open; ``groups``: the component of the documents linked so far. A
    key needs an open member too, one that its last comparison did not link.
    """
    placed = members.withColumn("group", F.col("doc"))
    if groups is not None:
        placed = members.join(groups, "doc", "left").withColumn("group", F.coalesce("component", "doc")).drop("component")
    shared = placed.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("some"), (F.min("group") < F.max("group")).alias("split"))
    return settle(placed.join(shared.filter("n > 1 AND some AND split"), "key").select("doc", "key", "group", "n"), "near-live")


def star_pairs(live: DataFrame, small: int) -> DataFrame:
    """(doc, pivot, large): within each key, every document with the most central one.

    Central is who shares its keys with the most rows; a group of edited copies thus meets
    its common original. ``large`` says that a key of more than ``small`` rows asks for it.
    """
    weight = live.groupBy("doc").agg(F.sum("n").alias("weight"))
    pivots = live.join(weight, "doc").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("low"), "group")).alias("top"))
    pivots = pivots.select("key", (-F.col("top.low")).alias("pivot"), F.col("top.group").alias("pivot_group"))
    return live.join(pivots, "key").filter("group <> pivot_group").select("doc", "pivot", (F.col("n") > small).alias("large"))


def small_pairs(live: DataFrame, small: int) -> DataFrame:
    """(doc, pivot, large): all pairs that are not linked within keys of at most ``small`` rows."""
    few = live.filter(F.col("n") <= small).select("doc", "key", "group")
    other = few.select(F.col("doc").alias("pivot"), "key", F.col("group").alias("pivot_group"))
    return few.join(other, "key").filter("doc < pivot AND group <> pivot_group").select("doc", "pivot", F.lit(False).alias("large"))


def fresh(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """``pairs`` without repeats and without those, either way round, that ``done`` (doc, pivot, large) holds.

    A pair that was compared for a small key is asked again where a large one wants its rest keys.
    ``pivots`` counts a document's large ones, of which it has no more than keys.
    """
    asked = pairs.select("doc", "pivot", "large", F.lit(-1).alias("had"))
    if done is not None:
        had = F.col("large").cast("int").alias("had")
        back = done.select(F.col("pivot").alias("doc"), F.col("doc").alias("pivot"), F.lit(None).cast("boolean").alias("large"), F.lit(0).alias("had"))
        asked = asked.unionByName(done.select("doc", "pivot", F.lit(None).cast("boolean").alias("large"), had)).unionByName(back)
    once = asked.groupBy("doc", "pivot").agg(F.max("large").alias("large"), F.max("had").alias("had"))
    new = once.filter(F.col("large").cast("int") > F.col("had")).select("doc", "pivot", "large")
    return settle(new.withColumn("pivots", F.count_if("large").over(Window.partitionBy("doc"))), "near-pairs")


def signature(runs: np.ndarray) -> bytes:
    """For each of a power of two of bits, whether it is odd how many of the distinct ``runs`` fall on it.

    Each run that two texts do not share changes one bit, so their signatures differ in as
    many bits as they have such runs, or fewer.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SIGN_BITS * len(runs) - 1).bit_length()))
    odd = np.bincount((runs % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def signatures(texts: DataFrame) -> DataFrame:
    """doc, sizes and signatures of its labelled and of its distinct runs; the latter's null if none repeat."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                words = words_of(texts_of(part.column("text")))
                out = []
                for i in range(part.num_rows):
                    runs = shingles(words.hash[words.first[i] : words.first[i + 1]])
                    distinct = np.unique(runs)
                    again = len(distinct) < len(runs)
                    out.append((len(runs), signature(labelled(runs)), len(distinct), signature(distinct) if again else None))
                n, marked, n_distinct, distinct = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n, pa.int64()), pa.array(marked, pa.binary()), pa.array(n_distinct, pa.int64()), pa.array(distinct, pa.binary())],
                    names=["doc", "n_marked", "marked", "n_distinct", "distinct"],
                )

    return settle(texts.select("doc", "text").mapInArrow(run, "doc long, n_marked long, marked binary, n_distinct long, distinct binary"), "near-signs")


def within_reach(n: np.ndarray, signs: list, m: np.ndarray, others: list) -> np.ndarray:
    """Whether each of ``signs``, of ``n`` runs, may be of a set similar to each of ``others``, of ``m`` runs.

    Similar sets differ in a ninth of their runs at most. Of signatures of different lengths
    the longer one is folded.
    """
    out = np.zeros((len(n), len(m)), bool)
    widths, lengths = (np.array([len(x) for x in side]) for side in (signs, others))
    for wide in np.unique(widths):
        own = np.flatnonzero(widths == wide)
        rows = np.frombuffer(b"".join(signs[i] for i in own), np.uint64).reshape(len(own), -1)
        for length in np.unique(lengths):
            far = np.flatnonzero(lengths == length)
            if 9 * max(0, n[own].min() - m[far].max(), m[far].min() - n[own].max()) > n[own].max() + m[far].max():
                continue
            past = np.frombuffer(b"".join(others[i] for i in far), np.uint64).reshape(len(far), -1)
            least = min(rows.shape[1], past.shape[1])
            one, two = (np.bitwise_xor.reduce(x.reshape(len(x), -1, least), axis=1) for x in (rows, past))
            for i, sign in zip(own, one, strict=True):
                total = n[i] + m[far]
                at = np.flatnonzero(9 * np.abs(n[i] - m[far]) <= total)
                differ = np.bitwise_count(two[at] ^ sign).sum(axis=1, dtype=np.int64)
                out[i, far[at[9 * differ <= total[at]]]] = True
    return out


def possible_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """doc, pivot: the pairs of a block's two sides, of different groups, whose texts may be similar."""
    one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if one.empty or two.empty:
        return pd.DataFrame({"doc": [], "pivot": []}).astype("int64")
    apart = one["group"].to_numpy()[:, None] != two["group"].to_numpy()[None, :]
    # pairs of two that stand on both sides are listed once
    apart &= ~two["minor"].to_numpy()[None, :] | (one["doc"].to_numpy()[:, None] < two["doc"].to_numpy()[None, :])
    near = within_reach(*(f(x) for x in (one, two) for f in (lambda x: x["n_marked"].to_numpy(), lambda x: list(x["marked"]))))
    if one["distinct"].notna().any() or two["distinct"].notna().any():
        sides = [(x["n_distinct"].to_numpy(), list(x["distinct"].where(x["distinct"].notna(), x["marked"]))) for x in (one, two)]
        near |= within_reach(*sides[0], *sides[1])
    i, j = np.nonzero(near & apart)
    return pd.DataFrame({"doc": two["doc"].to_numpy()[j], "pivot": one["doc"].to_numpy()[i]}).astype("int64")


def large_pairs(live: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, pivot, large): all pairs within the keys of ``live`` that are not linked and may be similar.

    Whoever is not of a key's most frequent group is held against all others of the key, in
    blocks, so a task holds two of them whatever the key's size. Nothing similar is left out:
    the bound on what two texts share is one of their whole sets of runs.
    """
    sizes = live.groupBy("key", "group").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("c", "group")).alias("top"), F.sum("c").alias("n"))
    tops = tops.select("key", F.col("top.group").alias("top"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).alias("minors"))
    ids = live.select("doc").distinct()
    signs = signatures(texts.join(ids, "doc", "left_semi"))
    placed = live.join(tops, "key").withColumn("minor", F.col("group") != F.col("top")).join(signs, "doc")

    def dealt(seed: int, count: str) -> Column:
        return F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = placed.filter("minor").withColumn("block", dealt(4, "minors")).withColumn("other", every("blocks")).withColumn("side", F.lit(0))
    right = placed.withColumn("other", dealt(5, "blocks")).withColumn("block", every("minors")).withColumn("side", F.lit(1))
    found = left.unionByName(right).groupBy("key", "block", "other").applyInPandas(possible_pairs, "doc long, pivot long")
    return found.withColumn("large", F.lit(False))


def crowded(live: DataFrame, small: int) -> bool:
    """Whether the pairs within large keys that are not linked are many for the keys' rows."""
    sizes = live.filter(F.col("n") > small).groupBy("key", "group").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("top"))
    rows, pairs = keys.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - F.col("top")))).first()
    return (pairs or 0) > CROWD * (rows or 0)


def joined_groups(groups: DataFrame, checked: DataFrame) -> DataFrame:
    """``groups`` (doc, component) after the similar pairs of ``checked`` have joined theirs."""
    links = groups.toDF("a", "b").unionByName(checked.filter("similar").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    return components(links).toDF("doc", "component")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, pivot, similar, large, and keys of what doc has beyond its pivot.

    A pivot's members are dealt to ``SHARES`` tasks, each of which has the pivot's text; a
    task streams the members past it and holds two texts at a time.
    """
    dealt = pairs.select("pivot", F.pmod(F.xxhash64("doc"), F.lit(SHARES)).alias("share"), F.lit(1).alias("side"), "doc", "large", "pivots")
    heads = dealt.select("pivot", "share").distinct().select("pivot", "share", F.lit(0).alias("side"), F.col("pivot").alias("doc"), F.lit(False).alias("large"), F.lit(0).cast("long").alias("pivots"))
    rows = dealt.unionByName(heads).join(texts, "doc").select("pivot", "share", "side", "doc", "large", "pivots", "text")

    def run(batches):
        pivot = None
        for batch in batches:
            for part in pieces(batch):
                words = words_of(texts_of(part.column("text")))
                out = []
                ids = zip(*(part.column(c).to_pylist() for c in ("pivot", "side", "doc", "large", "pivots")), strict=True)
                for i, (own, side, doc, large, pivots) in enumerate(ids):
                    text = Text(words.hash[words.first[i] : words.first[i + 1]])
                    if side == 0:
                        pivot = text
                        continue
                    keys = signed(rest_keys(text, pivot, own, pivots)) if large else np.zeros(0, np.int64)
                    out.append((doc, own, compare(text, pivot), large, keys))
                if out:
                    doc, own, similar, large, keys = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(similar), pa.array(large), pa.array(keys, pa.list_(pa.int64()))],
                        names=["doc", "pivot", "similar", "large", "keys"],
                    )

    placed = rows.repartition("pivot", "share").sortWithinPartitions("pivot", "share", "side")
    return settle(placed.mapInArrow(run, "doc long, pivot long, similar boolean, large boolean, keys array<long>"), "near-verified")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, rep_id, class_id and kept for every row of ``docs`` (doc_id, text).

    ``rep_id`` is the least id whose text has the same words, ``class_id`` the least id that
    links reach, ``kept`` whether the row is its class's one document.

    A document has 16 keys of its labelled runs in text order (Order MinHash) and 24 of its
    distinct runs as a set. Texts of similarity 0.8 agree in one with probability of about
    0.8 ** 4: texts that align miss all ordered ones once in 5,000 cases, and, if they share
    as many distinct runs, all of both kinds once in a thousand million; texts of the same
    runs in another order miss all of their keys once in 300,000. Texts of few runs, for which
    it is less, have more keys, of two minima.

    Within a key all texts are compared with one pivot; what that leaves apart is compared
    pair by pair in small keys. In large keys every pair that is of different groups still is
    held against a bound on the runs they can share, and compared unless the bound rules
    similarity out. Where those are many for the keys' rows, rounds come before in which the
    runs that a text has beyond its pivot are sketched anew, under the pivot, so that few
    comparisons join most groups. So any two texts that agree in a key are compared, linked
    by others, or cannot be similar.

    Words are runs of letters, digits and all code points past 127; A-Z count as a-z. Null
    and empty texts are equal to each other. A null doc_id is its own class (null) and kept.
    Rows that share an id are one document. An empty table gives no rows; other columns are
    not read.
    """
    given = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = given.filter(F.col("doc_id").isNotNull())
    drawn = settle(sketch(known), "near-sketch")
    reps = drawn.groupBy("digest").agg(F.min("doc_id").alias("rep_id"))
    own_keys = F.when(F.col("doc_id") == F.col("rep_id"), F.col("keys")).alias("keys")
    member = settle(drawn.join(reps, "digest").select("doc_id", "rep_id", own_keys), "near-members")
    members = member.select(F.col("doc_id").alias("doc"), F.explode("keys").alias("key"), F.lit(True).alias("open"))
    none = known.sparkSession.createDataFrame([], "doc long, component long")
    groups, texts, left, done, later, rounds = None, None, None, None, None, 0
    while True:
        live = live_keys(members, groups)
        if live.isEmpty():
            break
        if texts is None:
            ids = live.select("doc").distinct()
            texts = settle(known.withColumnRenamed("doc_id", "doc").join(ids, "doc", "left_semi"), "near-texts")
        # stars link most documents of all keys; only then are small keys' pairs worth listing
        small = SMALL[min(rounds, len(SMALL) - 1)]
        pairs = star_pairs(live, small) if not rounds else star_pairs(live.filter(F.col("n") > small), small).unionByName(small_pairs(live, small))
        checked = verify(fresh(pairs, done), texts)
        compared = checked.select("doc", "pivot", "large")
        done = compared if done is None else done.unionByName(compared)
        if rounds:  # few links come up now; they join their groups at the end
            later = checked if later is None else later.unionByName(checked)
            members = owed_keys(checked, groups)
        else:
            groups = joined_groups(none, checked)
            left = live_keys(live.select("doc", "key", F.lit(True).alias("open")), groups)
            if not crowded(left, small):
                break
            members = owed_keys(checked, groups).unionByName(live.filter(F.col("n") <= small).select("doc", "key", F.lit(True).alias("open")))
        rounds += 1
    if later is not None:
        if not later.filter("similar").isEmpty():
            groups = joined_groups(groups, later)
        left = live_keys(left.filter(F.col("n") > SMALL[0]).select("doc", "key", F.lit(True).alias("open")), groups)
    if left is not None and not left.isEmpty():
        pairs = small_pairs(left, SMALL[0]).unionByName(large_pairs(left.filter(F.col("n") > SMALL[0]), texts))
        checked = verify(fresh(pairs, done), texts)
        if not checked.filter("similar").isEmpty():
            groups = joined_groups(groups, checked)
    groups = none if groups is None else groups
    found = member.join(groups.withColumnRenamed("doc", "rep_id"), "rep_id", "left").select("doc_id", "rep_id", F.coalesce("component", "rep_id").alias("class_id"))
    unknown = given.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("rep_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
