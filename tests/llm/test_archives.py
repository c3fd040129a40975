"""Token alignment, manifests and web archives against plain restatements, and with odd rows."""

import base64
import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import alignment, manifest, warc
from lodestar.llm.bpe import byte_letters
from lodestar.llm.queries import ORACLES, QUERIES
from tests.compare import compare, oracle
from tests.llm.test_documents import ODD

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- alignment ---


def plain_alignments(texts):
    """Every token's byte range by itself, every A-B pair of occurrences tried."""
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    value = {letter: b for b, letter in byte_letters().items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a = library.encode(" " + text, add_special_tokens=False)
        b = model.encode(text)
        a_bytes = [bytes(value[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append(None)
            continue
        a_ends, b_ends = ([len(b"".join(x[: i + 1])) for i in range(len(x))] for x in (a_bytes, b_bytes))
        links = [(i, j) for i, p in zip(a.ids, a_ends, strict=True) for j, q in zip(b, b_ends, strict=True) if p == q]
        cuts = [0, *sorted(set(a_ends) & set(b_ends))]
        groups = ";".join(
            ",".join(str(i) for i, p in zip(a.ids, a_ends, strict=True) if low < p <= high) + "|" + ",".join(str(j) for j, q in zip(b, b_ends, strict=True) if low < q <= high)
            for low, high in itertools.pairwise(cuts)
        )
        out.append((len(a.ids), len(b), len(cuts) - 1, links, groups))
    count = Counter(pair for x in out if x for pair in x[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (x[0], x[1], x[2], len(x[3]), sum(count[i, j] == best[j] for i, j in x[3]), sum(count[p] for p in x[3]), sha(x[4])) if x else (0, 0, 0, 0, 0, 0, "")
        for x in out
    ]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [t if t is None or len(t) < 1000 else t[:400] for t in ODD] + ["<s> a </s> <unk> <|endoftext|>", "<0x41> x▁y", "naïve 🙂 tests\r\n\r\n", " lead", "tail ", "a  b   c"]


def test_alignment_matches_all_pairs(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab c'sé\n1中🙂.") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["the same text"] * 3
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(3, "again", None, 1), (3, "again", None, 1), (None, "no id", None, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs int").repartition(3)
    want = Counter(zip((r[0] for r in rows), plain_alignments([r[1] for r in rows]), strict=True))
    got = Counter((r.doc_id, tuple(r[c] for c in ALIGNED)) for r in alignment.alignment_digests(frame, BYTES, PIECES).collect())
    assert got == want
    assert alignment.alignment_digests(frame.limit(0), BYTES, PIECES).count() == 0
    groups = alignment.align_documents(frame.filter("doc_id = 2"), BYTES, PIECES).first().groups
    own = [x for x in alignment.aligner(BYTES, PIECES).align([texts[2]])][0]
    assert [(g.a_ids, g.b_ids) for g in groups] == own.groups()


def test_alignment_of_long_texts():
    both = alignment.aligner(BYTES, PIECES)
    found = next(iter(both.align(["x" * 3000 + " " + "word é " * 60000])))
    assert sum(len(a) for a, _ in found.groups()) == len(found.a) > 60000
    assert len(found.links()[0]) == len(found.a_cuts) == both.written(found).count(";") + 1


def test_common_texts_have_the_ids_of_the_library():
    encoder = alignment.ByteBpe(BYTES)
    assert encoder.ranks is not None
    rng = random.Random(5)
    blanks = [*" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0'"]
    for _ in range(3000):
        text = "".join(rng.choice(blanks) if rng.random() < 0.4 else chr(rng.randrange(0x530)) for _ in range(rng.randrange(1, 30)))
        assert encoder.encode(text) == encoder.library.encode(text, add_special_tokens=False).ids


def test_pairs_stay_within_what_the_vocabularies_allow(spark):
    a, b = [b"a", b"ba", b"c"], [b"a", b"a", b"cba"]
    assert alignment.most_pairs(a, b) == 2 + 2 + 2  # a with both a; ba with both; cba with a and ba
    both = alignment.aligner(BYTES, PIECES)
    most = alignment.most_pairs(both.a.bytes, both.b.bytes)
    rows = alignment.aligned_rows(spark.read.parquet(f"{SF}/documents.parquet"), BYTES, PIECES)
    counts = alignment.pair_counts(rows)
    assert 0 < counts.count() <= most
    assert counts.agg(F.sum("n")).first()[0] == rows.agg(F.sum("n_links")).first()[0]


# --- manifest ---


def plain_tree(nodes):
    """Root of a list of digests, and the path of each to it."""
    level, paths, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place - place % 3
            paths[i].append((level[start:place], level[place + 1 : start + 3]))
            at[i] = place // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> the query's rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row, row[4]), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, tops = plain_tree([inner[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(trees[s], key=lambda x: x[:3]), inner[s][1], strict=True):
            steps = path + top
            text, node = row[4], leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = plain_leaf(row, text if text is None else text.replace("\n", ""))
            for before, after in steps:
                node = sha("".join([*before, node, *after]))
            out.append((row[0], leaf, inner[s][0], root, sha("".join(x for b, a in steps for x in b + a)), node, node == root))
    return Counter(out)


PROVED = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("every", [5, 1, 2])
def test_manifest(spark, every):
    texts = ["one\ntwo", "é\n\n", "", None, "plain", "same\n"]
    # sizes about powers of three, one leaf alone, a null source, one of 300 leaves
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "ü": 27, "": 28, None: 82, "big": 300}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 1000, source, None if n % 5 == 0 else "en", None if n % 3 == 0 else n, texts[n % 6]))
            n += 1
    rows += [(5, "f", "en", 1, "twice\n")] * 3 + [(5, "f", None, 1, "twice\n"), (None, "f", None, None, None), (-4, "f", None, None, "\n")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    frame = frame.withColumn("tree", F.lit("x")).withColumn("place", F.lit(1)).withColumn("digest", F.lit(None).cast("string"))
    got = Counter(tuple(r[c] for c in PROVED) for r in manifest.manifest_digests(frame, every).collect())
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, None, None, None, "x\n")]
    got = [tuple(r[c] for c in PROVED) for r in manifest.manifest_digests(spark.createDataFrame(rows, schema)).collect()]
    assert Counter(got) == plain_manifest(rows)
    assert got[0][4] == sha("")  # no siblings


def test_manifest_stores_every_fifth_level(spark):
    rows = spark.range(2000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    made = manifest.Manifest(rows, "id")
    assert [level.count() for level in made.levels] == [2000, 9, 1]  # 2000 / 243, then the root
    longest = made.proofs().select(F.size("steps").alias("n"), F.size(F.expr("filter(steps, s -> size(s.before) + size(s.after) > 2)")).alias("wide")).distinct().collect()
    assert [(r.n, r.wide) for r in longest] == [(7, 0)]


# --- archives ---


def plain_pages(rows):
    head = {}
    for i, _, html in rows:
        if i is not None:
            head[html or ""] = max(head.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = head.get(html or "")
        revisit = top is not None and (i is None or i < top)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


KEPT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_give_the_pages_back(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{i % 9}.example/{i}", f"<p>{'word ' * (i % 50)}{i % 40}</p>\r\n\r\nWARC/1.1\r\n") for i in range(400)]
    rows += [(1000 + i, None, None if i % 2 else "") for i in range(6)] + [(2000 + i, "http://copy.example/", "same é 中") for i in range(300)]
    rows += [(2299, "http://twice.example/", "same é 中"), (None, "odd url\r\nX: 1", "same é 中"), (None, "u", "alone"), (None, "u", "alone"), (3000, "u", rng.randbytes(300000).hex())]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("response", F.lit(4)).withColumn("record_type", F.lit("x"))
    assert Counter(tuple(r[c] for c in KEPT) for r in warc.archived_pages(frame).collect()) == plain_pages(rows)
    assert warc.archived_pages(frame.limit(0)).count() == 0

    # small archives; whole payloads, and every revisit meets its response
    archives = warc.write_archives(warc.with_responses(frame), archive_bytes=4000, sample_bytes=2000)
    assert archives.count() > 5
    records = warc.read_archives(archives)
    assert records.filter("fault IS NOT NULL").count() == 0
    assert warc.unmet_revisits(records).count() == 0
    assert warc.unmet_revisits(records.filter("record_id <> '<urn:page:2299>'")).count() == 1
    known = {f"<urn:page:{i}>": (html or "").encode() for i, _, html in rows if i is not None}
    for r in records.filter("record_type = 'response' AND record_id <> '<urn:page:>'").collect():
        assert r.payload == known[r.record_id] and "\r" not in r.target_uri and " " not in r.target_uri

    # payloads under a length are not looked up
    few = warc.with_responses(frame, least_bytes=10)
    assert few.filter("response IS NOT NULL AND coalesce(octet_length(html), 0) < 10").count() == 0
    assert few.filter("response = 2299").count() == 300


def test_query_matches_sql(spark):
    con = oracle(SF)
    for name in ("op12_merkle_manifest", "op13_warc"):
        assert compare(con, QUERIES[name](spark, SF), ORACLES[name]) is None


def archive_of(texts, sample_bytes=1 << 20):
    archive = warc.Archive(sample_bytes)
    for i, t in enumerate(texts):
        archive.add(warc.record(warc.Page(i, f"http://x/{i}", t.encode(), None)))
    return archive.done()


TRAINING = [f"<html><head><title>page {i}</title></head><body>{'shared boilerplate ' * 30}{i * 7919}</body></html>" for i in range(400)]


def test_dictionary_stands_in_the_leading_frame():
    content = archive_of(TRAINING)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    words = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    assert words[:4] == bytes.fromhex("37a430ec")  # a trained dictionary
    assert [warc.parse(raw).payload.decode() for raw, fault in warc.frames(content) if not fault] == TRAINING
    # the dictionary may as well stand there as it is, and other frames be passed by
    plain = struct.pack("<II", 0x184D2A5D, len(words)) + words + struct.pack("<II", 0x184D2A50, 3) + b"abc" + content[8 + size :]
    assert [warc.parse(raw).payload.decode() for raw, _ in warc.frames(plain)] == TRAINING
    with_none = archive_of(["", ""], 1)
    assert [warc.parse(raw).fault for raw, _ in warc.frames(with_none)] == [None, None]
    # without it no record can be read
    assert all(fault for _, fault in warc.frames(content[8 + size :]))


def test_frames_of_every_kind_of_block():
    rng = random.Random(4)
    payloads = [b"", b"a", b"\0" * 500000, rng.randbytes(400000), b"text " * 100000 + rng.randbytes(50)]
    content = b"".join(zstandard.ZstdCompressor(write_checksum=c, write_content_size=s).compress(p) for p in payloads for c in (False, True) for s in (False, True))
    assert [raw for raw, fault in warc.frames(content) if fault is None] == [p for p in payloads for _ in range(4)]


def test_broken_archives_say_what_is_wrong():
    content = archive_of(TRAINING[:30])
    whole = list(warc.frames(content))
    cut = list(warc.frames(content[:-5]))
    assert cut[:-1] == whole[:-1] and cut[-1][1].endswith("is cut off")
    spoilt = bytearray(content)
    spoilt[-2] ^= 1  # the last frame's checksum
    assert [f for _, f in warc.frames(bytes(spoilt))][:-1] == [None] * 29 and list(warc.frames(bytes(spoilt)))[-1][1]
    assert [f for _, f in warc.frames(content[:20])] == ["the dictionary is cut off"]
    assert list(warc.frames(b"")) == []
    assert len(list(warc.frames(b"no archive at all"))) == 1


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.1", 1), "no WARC record"),
        (lambda r: r.replace(b"WARC-Date: ", b"X-Date: ", 1), "without warc-date"),
        (lambda r: r.replace(b"WARC-Type: ", b"WARC-Date: x\r\nWARC-Type: ", 1), "header twice: WARC-Date"),
        (lambda r: r.replace(b"application/http", b"application/http\r\nno colon", 1), "no header: 'no colon"),
        (lambda r: r[:-4] + b"more\r\n\r\n", "length"),
        (lambda r: r[:-4], "length"),
        (lambda r: r.replace(b"body", b"bODy"), "block digest"),
        (lambda r: r.replace(b"WARC-Block-Digest", b"X-Block-Digest").replace(b"body", b"bODy"), "payload digest"),
        (lambda r: r.replace(b"WARC-Block-Digest", b"X-Block-Digest").replace(b"\r\nContent-Length: 4\r\n\r\nb", b"\r\nContent-Length: 5\r\n\r\nb"), "payload length 5, but 4 bytes"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "a revisit of nothing"),
    ],
)
def test_faults_of_records(change, fault):
    raw = warc.record(warc.Page(1, "http://x/", b"body", None))
    assert warc.parse(raw).fault is None
    assert (warc.parse(change(raw)).fault or "").startswith(fault)


def test_a_fault_stops_the_query(spark):
    whole = archive_of(TRAINING[:5])
    frame = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:-3])), ("c", None), ("d", bytearray())], "archive string, content binary")
    rows = warc.read_archives(frame).collect()
    assert Counter((r.archive, r.fault is None) for r in rows) == {("a", True): 5, ("b", True): 4, ("b", False): 1, ("c", False): 1}
    assert [r.place for r in rows if r.archive == "a"] == [0, 1, 2, 3, 4]
    folded = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nX: a\r\n  b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert warc.parse(folded).payload == b"hi"
