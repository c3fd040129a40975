"""Alignment of two tokenizers' ids over the byte offsets at which tokens of both end."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.bpe import byte_letters
from lodestar.llm.common import batched, pieces, texts_of
from lodestar.session import settle

#: Fixed value: how byte-level vocabularies of this kind split text into words.
WORD_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these code points, whose classes no Unicode version changes, need not the library.
COMMON = re.compile(r"[\x00-ԯ]*")
#: A pair of ids in one number: the A id above these bits, the B id in them.
B_BITS = 32
B_MASK = (1 << B_BITS) - 1
#: Pairs a task counts at once before it adds them to its sums.
COUNTED_AT_ONCE = 1 << 20


class Alignment(NamedTuple):
    """Ids of a text, and where its groups end in them: the k-th holds ``a[a_cuts[k-1] : a_cuts[k]]``."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    def groups(self) -> list[tuple[list[int], list[int]]]:
        a, b, out, i, j = self.a.tolist(), self.b.tolist(), [], 0, 0
        for p, q in zip(self.a_cuts.tolist(), self.b_cuts.tolist(), strict=True):
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of the tokens that end together, slice by slice.

        Tokens have a byte at least, so in a slice only the last two end at its cut.
        """
        return self.a[self.a_cuts - 1], self.b[self.b_cuts - 1]


NOTHING = Alignment(*(np.zeros(0, np.int64) for _ in range(4)))


class ByteBpe:
    """A byte-level ``tokenizers`` file without added strings: ids, and the bytes of each.

    Common texts go through the same ranks in ``tiktoken``, about three times as fast; all
    others, and files whose ids do not follow their merges, through the library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        value = {letter: b for b, letter in byte_letters().items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {i: bytes(value[c] for c in t) for t, i in vocab.items() if t not in added}
        of |= {i: t.encode() for t, i in added.items()}
        self.bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.ranks = None
        split = spec["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and spec["normalizer"] is None
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"])
        made = [vocab[left + right] for left, right in pairs]
        if plain and made == sorted(made) and len(set(made)) == len(made):
            ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in added}
            self.ranks = tiktoken.Encoding("bytes", pat_str=WORD_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranks is not None and (text.isascii() or COMMON.fullmatch(text)):
            return self.ranks.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """A ``sentencepiece`` file: ids, and the bytes of each."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Encodes a text both ways and cuts the two lists where their tokens end together."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), PieceBpe(b_path)
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in side.bytes]) for side in (self.a, self.b))
        self.names = [f"{i}{mark}" for i in range(max(len(self.a.bytes), len(self.b.bytes))) for mark in ",|;"]

    def align(self, texts: list[str]) -> Iterator[Alignment]:
        """One alignment for each text.

        Nothing for an empty text, or one whose A or B tokens do not spell a space and the text.
        """
        for text, b in zip(texts, self.b.encode(texts), strict=True):
            yield self.aligned(" " + text, self.a.encode(" " + text), b) if text else NOTHING

    def aligned(self, whole: str, a: list[int], b: list[int]) -> Alignment:
        spelled = whole.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != spelled or b"".join(map(self.b.bytes.__getitem__, b)) != spelled:
            return NOTHING
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_at = dict(zip(self.a_lengths[a_ids].cumsum().tolist(), range(1, len(a) + 1), strict=True))
        b_at = dict(zip(self.b_lengths[b_ids].cumsum().tolist(), range(1, len(b) + 1), strict=True))
        ends = list(filter(a_at.__contains__, b_at))  # in order, as they were put in; the last is that of the text
        return Alignment(a_ids, b_ids, *(np.fromiter(map(at.__getitem__, ends), np.int64, len(ends)) for at in (a_at, b_at)))

    def written(self, found: Alignment) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``: each id with the mark that follows it, put in its place."""
        a, b, p, q = found
        a_marks, b_marks = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_marks[p - 1], b_marks[q - 1] = 1, 2
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.repeat(q - np.diff(q, prepend=0), np.diff(p, prepend=0))] = a * 3 + a_marks
        row[np.arange(len(b)) + np.repeat(p, np.diff(q, prepend=0))] = b * 3 + b_marks
        return "".join(map(self.names.__getitem__, row.tolist()))[:-1]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One instance for each worker and pair of files."""
    return Aligner(a_path, b_path)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together at all, whatever the corpus.

    Of two tokens that end at the same byte of a text, one is a suffix of the other; so the
    vocabularies bound the pairs, a few for each byte of each token.
    """

    def ids_of(tokens):
        out: dict[bytes, int] = {}
        for t in tokens:
            out[t] = out.get(t, 0) + 1
        return out

    a_ids, b_ids = ids_of(a), ids_of(b)
    longer_a = sum(b_ids.get(t[k:], 0) for t in a for k in range(len(t)))
    return longer_a + sum(a_ids.get(t[k:], 0) for t in b for k in range(1, len(t)))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups (a_ids, b_ids) of every whole text, in text order.

    A null or empty text, and one that the two do not spell alike, has no groups.
    """

    def run(batches):
        both = aligner(a_path, b_path)
        ids = pa.list_(pa.int32())
        kind = pa.list_(pa.struct([("a_ids", ids), ("b_ids", ids)]))
        for batch in batches:
            for part in pieces(batch):
                rows = [[{"a_ids": a, "b_ids": b} for a, b in found.groups()] for found in both.align(texts_of(part.column("text")).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "groups"])

    given = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, groups array<struct<a_ids: array<int>, b_ids: array<int>>>")


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Sizes and digest of each text's alignment, and its distinct linked pairs with how often each is linked."""

    def run(batches):
        both = aligner(a_path, b_path)
        for batch in batches:
            for part in pieces(batch):
                n_a, n_b, n_groups, n_links, digests, pairs, times = [], [], [], [], [], [], []
                for found in both.align(texts_of(part.column("text")).to_pylist()):
                    a_linked, b_linked = found.links()
                    codes, often = np.unique((a_linked << B_BITS) + b_linked, return_counts=True)
                    n_a.append(len(found.a))
                    n_b.append(len(found.b))
                    n_groups.append(len(found.a_cuts))
                    n_links.append(len(a_linked))
                    digests.append(hashlib.sha256(both.written(found).encode()).hexdigest() if len(found.a) else "")
                    pairs.append(codes)
                    times.append(often)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, long) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), pa.array(pairs, pa.list_(long)), pa.array(times, pa.list_(long))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    given = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its times."""
    distinct, at = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, times)
    return distinct, total


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold each id pair.

    A task sums its own rows first; its sums and the result hold ``most_pairs`` rows at most.
    """

    def run(batches):
        codes, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, held = [], 0
        for batch in batches:
            waiting.append((pc.list_flatten(batch.column("pairs")).to_numpy(zero_copy_only=False), pc.list_flatten(batch.column("times")).to_numpy(zero_copy_only=False)))
            held += len(waiting[-1][0])
            if held >= COUNTED_AT_ONCE:
                codes, total = summed(np.concatenate([codes, *(w[0] for w in waiting)]), np.concatenate([total, *(w[1] for w in waiting)]))
                waiting, held = [], 0
        codes, total = summed(np.concatenate([codes, *(w[0] for w in waiting)]), np.concatenate([total, *(w[1] for w in waiting)]))
        for at in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + (1 << 16)]), pa.array(total[at : at + (1 << 16)])], names=["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    The counts of id pairs cover all links of all rows. They go to every task, as two arrays
    whose length the vocabularies bound (``most_pairs``), not the corpus; texts and links
    are not shuffled.

    A text that is null, empty or not spelled alike by both has zeros and the digest ''.
    Each row stands for itself, so repeated rows and ids give repeated rows and their links
    count again. A null doc_id is kept. Ties for the highest count are all best. No rows give
    none; other columns are not read. A text of any length is encoded whole.
    """
    rows = settle(aligned_rows(docs, a_path, b_path), "aligned")
    counts = pair_counts(rows).toArrow().sort_by("pair")
    codes, total = counts["pair"].to_numpy(), counts["n"].to_numpy()
    highest = np.zeros(int((codes & B_MASK).max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, codes & B_MASK, total)
    known = rows.sparkSession.sparkContext.broadcast((codes, total, total == highest[codes & B_MASK]))

    def run(batches):
        codes, total, best = known.value
        for batch in batches:
            pairs, times = batch.column("pairs"), pc.list_flatten(batch.column("times")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(codes, pc.list_flatten(pairs).to_numpy(zero_copy_only=False))
            row = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False)
            n_best, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(n_best, row, times * best[at])
            np.add.at(count_sum, row, times * total[at])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_best), pa.array(count_sum), batch.column("groups_sha256")],
                names=[*names, "n_best", "count_sum", "groups_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
