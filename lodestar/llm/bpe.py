"""Byte-pair encoding and decoding with a public vocabulary file, merged over contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.common import batched, texts_of

#: No merge joins the two parts.
NEVER = 1 << 60
#: Words with more parts than this go over a heap instead of repeated scans.
SHORT_WORD = 128
#: Encoded words a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Fixed value: the split pattern that ``COMMON_WORDS`` restates.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same words, for texts of code points below ``COMMON`` only, whose classes no Unicode version changes.
COMMON_WORDS = re.compile(r"[^\W\d_²³¹¼½¾]+|'s|'t|'re|'ve|'m|'ll|'d|[\d²³¹¼½¾]|(?:[^\w\s]|[\x1c-\x1f_])+")
COMMON = re.compile(r"[\x00-\u052f]*")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file with word-end marks and no decoder section."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end_mark = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (vocab | added).items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + self.end_mark] for b in range(256)]
        self.bytes = {letter: b for b, letter in letters.items()}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.common = splits == [SPLIT_PATTERN]
        self.path, self.library = path, None
        self.added = added
        self.added_pattern = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        """Scan the rank array for its least entry, join there, refresh the two neighbours."""
        merges = self.merges
        none = (NEVER, 0)
        joined = [merges.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while joined:
            best = min(joined)
            if best[0] == NEVER:
                break
            at = joined.index(best)
            ids[at] = best[1]
            del ids[at + 1], joined[at]
            if at:
                joined[at - 1] = merges.get((ids[at - 1], ids[at]), none)
            if at < len(joined):
                joined[at] = merges.get((ids[at], ids[at + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same result in n log n: a heap of joins over a linked list of parts."""
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        alive = [True] * n
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = self.merges[left, right][1], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b]))
        return [x for x, kept in zip(ids, alive, strict=True) if kept]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self.merge_short(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids)

    def plain_words(self, text: str) -> list[str]:
        """Normalised words. Rarer scripts take the library's own character tables."""
        if self.common and COMMON.fullmatch(text):
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # a sigma is lower-cased by itself, whether or not it ends a word
            text = text.replace("Σ", "σ").lower()
            return COMMON_WORDS.findall(text)
        if self.library is None:  # many corpora never need it
            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in word).decode() for word, _ in found]

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Stretches of ordinary text, and added tokens that stand between them."""
        at = 0
        for m in self.added_pattern.finditer(text) if self.added_pattern and "<" in text else ():
            yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        yield False, text[at:]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for is_added, part in self.parts(text):
            if is_added:
                ids.append(self.added[part])
            else:
                for word in self.plain_words(part):
                    ids.extend(self.encode_word(word))
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)

    def remember(self, word: str) -> tuple[str, str, int]:
        ids = [self.added[word]] if word in self.added else self.encode_word(word)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        entry = self.known[word] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        return entry

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text, by remembered words."""
        get, remember = self.known.get, self.remember
        found = []
        for is_added, part in self.parts(text):
            words = [part] if is_added else self.plain_words(part)
            found += [get(word) or remember(word) for word in words]
        ids, names, counts = zip(*found, strict=True) if found else ((), (), ())
        return (
            sum(counts),
            hashlib.sha256(" ".join(ids).encode()).hexdigest(),
            hashlib.sha256(" ".join(names).encode()).hexdigest(),
        )


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBpe:
    """One instance for each worker and file."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of every whole text. A null or empty text has no ids."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch.column(text))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t.as_py()) for t in texts.slice(at, 256)]
                kept = [c for c in part.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    kept = docs.select(*(c for c in docs.columns if c != out))
    schema = kept.withColumn(out, F.lit(None).cast("array<int>")).schema
    return batched(kept).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; a null list gives the empty text."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            kept = [c for c in batch.schema.names if c != out]
            texts = [bpe.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    kept = encoded.select(*(c for c in encoded.columns if c != out))
    return batched(kept).mapInArrow(run, kept.withColumn(out, F.lit(None).cast("string")).schema)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts count 0 tokens and have the digests of the empty string; each row
    stands for itself, so repeated rows and ids give repeated results; other columns are not
    read. A word of any length is encoded whole (in n log n beyond ``SHORT_WORD`` parts).
    """

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            rows = [bpe.digest(t.as_py()) for t in texts_of(batch.column("text"))]
            counts, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
