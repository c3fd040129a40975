"""Secret scan: fixed patterns, and strings that a public vocabulary cannot shorten."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batched, pieces, texts_of

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Stretches that may be random strings; no shorter one is weighed.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Characters per token below which a stretch counts as random.
LEAST_PER_TOKEN = 2.2
#: Lengths of the hex digests in common use (MD5, SHA-1, SHA-2).
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of an identifier, as capitals and marks part them. One counts as written by somebody if
#: it has ``LEAST_WORD`` letters and one token, or is long and its tokens are; an identifier is a
#: string with ``LEAST_WRITTEN`` of its letters in such words.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LEAST_WORD, LEAST_WRITTEN = 3, 0.4
#: (letters, letters per token) from which a word of several tokens counts.
LONG_WORDS = ((6, 3), (12, 2.1))
#: A string of so few different characters is a pattern or a sequence, no key.
MOST_REPEATED = 5
MASK = "[SECRET]"


class Span(NamedTuple):
    start: int
    end: int
    kind: str


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found += [Span(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [Span(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in RUN.finditer(text):  # a hex string of this length lies within such a stretch
        found += [Span(run.start() + m.start(), run.start() + m.end(), "hex") for m in HEX.finditer(run[0]) if m.end() - m.start() >= LEAST_HEX]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def is_written(word: str, vocabulary: tiktoken.Encoding) -> bool:
    """Whether ``word`` is one of the vocabulary, in any case, or a long one of few tokens."""
    if len(word) < LEAST_WORD:
        return False
    tokens = min(len(vocabulary.encode_ordinary(space + w)) for w in {word, word.lower()} for space in ("", " "))
    return tokens == 1 or any(len(word) >= n and len(word) >= each * tokens for n, each in LONG_WORDS)


def is_random(run: str, vocabulary: tiktoken.Encoding) -> bool:
    """Whether the vocabulary needs so many tokens that nobody would have written ``run``.

    Digests, UUIDs, numbers, repetitions and strings that words make up are not random; no
    mixture of letters and digits alone keeps a string out.
    """
    core = run.strip("=+/_-")
    if UUID.fullmatch(core) or DIGEST.fullmatch(core) and len(core) in DIGEST_LENGTHS:
        return False
    if len(run) >= LEAST_PER_TOKEN * len(vocabulary.encode_ordinary(run)):
        return False
    parts = PART.findall(core)
    if not parts or len(set(core.lower())) <= MOST_REPEATED:
        return False
    return sum(len(p) for p in parts if is_written(p, vocabulary)) < LEAST_WRITTEN * sum(map(len, parts))


def spans_of(text: str, vocabulary: tiktoken.Encoding) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: a random string adds one where no base span lies.

    Both lists are in order, so one pass over them tells which stretches base spans touch.
    """
    base = base_spans(text)
    added, i, furthest = [], 0, 0
    for run in RUN.finditer(text):
        while i < len(base) and base[i].start < run.end():
            furthest = max(furthest, base[i].end)
            i += 1
        if furthest <= run.start() and is_random(run[0], vocabulary):
            added.append(Span(*run.span(), "token"))
    return base, ordered(base + added)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch that spans cover put as one mask."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], MASK]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Secrets of every whole text of ``docs`` (doc_id, text); ``path``: the vocabulary's ranks.

    Returns doc_id, n_assign, n_access, n_hex, n_token, base_sha256 and spans. A null or empty
    text has none and the digest of the empty string; rows stand for themselves, so repeated
    ones give repeated results; an empty table gives no rows; other columns are not read. A
    text of any length is scanned whole, in time that grows with its length. Spans that start
    together are listed by kind.
    """

    def run(batches):
        vocabulary = encoding(path, pattern)
        for batch in batches:
            rows = [spans_of(t.as_py(), vocabulary) for t in texts_of(batch.column("text"))]
            kinds = [[s.kind for s in spans] for _, spans in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([k.count(kind) for k in kinds], pa.int64()) for kind in KINDS),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([joined(spans) for _, spans in rows], pa.string()),
                ],
                names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with every secret in ``text`` masked; texts without one, and nulls, stay as they are.

    Spans that overlap or start together share one mask; an empty table stays empty.
    """

    def run(batches):
        vocabulary = encoding(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                spans = [spans_of(t, vocabulary)[1] if t else [] for t in texts]
                if any(spans):
                    texts = [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return batched(docs).mapInArrow(run, docs.schema)
