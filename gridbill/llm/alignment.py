"""Cross-tokenizer alignment with exact-text deduplication (operator 11).

Two tokenizers cut the same bytes into tokens. Byte offsets where tokens of both end
cut a text into groups; a token of one and a token of the other are linked where their
byte ranges overlap. Documents are shuffled by full text, so each distinct text is
encoded and aligned once; its pair counts are weighted by its number of copies, and its
measures are joined back to the documents by the text's SHA-256.

As both token sequences cover the same bytes, each link is one piece between two
neighbouring offsets at which any token ends. So links are the merged ends of both, and
all steps of an alignment are numpy operations over a batch of texts at once.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common
from gridbill.llm.chunks import as_runs, byte_characters, cut, gather, runs
from gridbill.llm.records import plain_encoder
from gridbill.operators.common import key_join

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and what a worker may remember of encoded stretches.
BATCH_BYTES, MEMORY_BYTES = 4 << 20, 96 << 20
#: Rows up to which the table of pair counts is broadcast (17 bytes of data each); beyond it is joined by shuffle.
BROADCAST_PAIRS = 1_000_000


@dataclass
class Tokens:
    """A tokenizer: stretches of texts (words that stand for a blank and the word; others as they are, beginning
    with a blank) to the packed ids of each, and the bytes of each id."""

    encode: Callable[[list[str], list[str]], list[bytes]]
    entries: list[bytes]

    def __post_init__(self):
        self.table = runs(self.entries)
        self.sizes = np.fromiter(map(len, self.entries), np.int64, len(self.entries))


def byte_level(path: str, pattern: str) -> Tokens:
    """A byte-level BPE of the ``tokenizers`` library; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    plain, _ = plain_encoder(path, pattern, most_bytes=MEMORY_BYTES)
    back = {c: b for b, c in enumerate(byte_characters())}
    t = Tokenizer.from_file(path)
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    entries = [special[i] if i in special else bytes(back[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]
    return Tokens(lambda words, others: plain.blank_led(words) + plain.special(others), entries)


def pieces(path: str) -> Tokens:
    """A sentencepiece BPE model that puts the blank before a text itself.

    Its merges never cross a cut before a blank, as no piece holds a blank after another character, and
    its normaliser changes nothing (both checked); so stretches are encoded on their own.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = proto.ModelProto()
    model.ParseFromString(sp.serialized_model_proto())
    said, kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size())], model.normalizer_spec
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or kept.name != "identity" or kept.remove_extra_whitespaces or not kept.add_dummy_prefix:
        raise ValueError("a BPE model with identity normalisation and a blank put first is asked for")
    if any("▁" in p.lstrip("▁") for p in said):
        raise ValueError("a piece holds a blank after another character")
    entries = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(said)]

    def encode(words: list[str], others: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in sp.encode(words + [s[1:] for s in others], num_threads=1)]

    return Tokens(encode, entries)


def _spelled(t: Tokens, ids: np.ndarray, ends: np.ndarray, expected: list[bytes]) -> np.ndarray:
    """Per stretch: whether the bytes of its ids are the expected ones."""
    data, token_ends = gather(t.table, ids, "u1")
    data = data.tobytes()
    if data == b"".join(expected) and np.array_equal(np.concatenate([[0], token_ends])[ends], np.cumsum(np.fromiter(map(len, expected), np.int64, len(expected)))):
        return np.ones(len(expected), bool)
    stops = np.concatenate([[0], token_ends])[np.concatenate([[0], ends])].tolist()
    return np.fromiter((data[stops[i] : stops[i + 1]] == e for i, e in enumerate(expected)), bool, len(expected))


def _flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids as ids and where each stretch's ids end."""
    return np.frombuffer(b"".join(packed), "<u4"), np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)


def _only(ids: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ends with no ids left for what is not kept."""
    n = np.diff(ends, prepend=0)
    return ids[np.repeat(keep, n)], np.cumsum(np.where(keep, n, 0))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end before ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


@dataclass
class Aligned:
    """A batch of aligned texts. ``groups``: bytes of all group lists end to end, each text's ending at ``group_ends``.
    ``pairs``: distinct id pairs (a * size of B + b) of each text, ``times`` its links that have that pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: np.ndarray
    group_ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    pair_ends: np.ndarray


class Aligner:
    """Aligns batches of texts under two tokenizers.

    Tokens of both end wherever a text is cut into stretches, so a stretch's groups and
    links are its own. Each distinct stretch of a batch is aligned once and texts gather them.
    """

    def __init__(self, a: Tokens, b: Tokens):
        if min(a.sizes.min(), b.sizes.min()) < 1:
            raise ValueError("a token without bytes cannot be aligned")
        self.a, self.b = a, b
        # what an id is followed by: "," inside a run, "|" after the last of A, ";" after the last of B
        kinds = [(a, b","), (a, b"|"), (b, b","), (b, b";")]
        self.said = runs([b"%d" % i + mark for t, mark in kinds for i in range(len(t.entries))])
        self.first = np.cumsum([0, *(len(t.entries) for t, _ in kinds)])

    def stretches(self, words: list[str], others: list[str]) -> tuple[np.ndarray, ...]:
        """Of each stretch: whether its tokens spell it, counts of A, B and groups, runs of its group list and of its link codes."""
        expected = [b" " + x.encode() for x in words] + [x.encode() for x in others]
        (ids_a, ends_a), (ids_b, ends_b) = _flat(self.a.encode(words, others)), _flat(self.b.encode(words, others))
        keep = _spelled(self.a, ids_a, ends_a, expected) & _spelled(self.b, ids_b, ends_b, expected)
        (ids_a, ends_a), (ids_b, ends_b) = _only(ids_a, ends_a, keep), _only(ids_b, ends_b, keep)
        stops_a, stops_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])

        # tokens after which a group ends, and the links
        last_a, last_b = np.isin(stops_a, stops_b, assume_unique=True), np.isin(stops_b, stops_a, assume_unique=True)
        stops = np.union1d(stops_a, stops_b)
        of_a = np.searchsorted(stops_a, stops)
        codes = ids_a[of_a].astype(np.int64) * len(self.b.entries) + ids_b[np.searchsorted(stops_b, stops)]
        code_ends = np.searchsorted(stops, np.concatenate([[0], stops_a])[ends_a], "right")

        # group lists: the ids of A of a group, then those of B
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], end_b])[group_a]] = self.first[np.where(last_a, 1, 0)] + ids_a
        order[np.arange(len(ids_b)) + (end_a[group_b] if len(end_a) else 0)] = self.first[np.where(last_b, 3, 2)] + ids_b
        groups, said_ends = gather(self.said, order, "u1")
        group_ends = np.concatenate([[0], said_ends])[ends_a + ends_b]
        return keep, np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0), _sums(last_a, ends_a), groups, group_ends, codes, code_ends

    def __call__(self, texts: list[str]) -> Aligned:
        """A text that is empty, or whose tokens of A or B do not spell a blank and the text, has no tokens."""
        n_texts = len(texts)
        words, others, which, last = cut(pa.array([" " + x for x in texts], pa.string()))
        keep, n_a, n_b, n_groups, groups, group_ends, codes, code_ends = self.stretches(words, others)
        good = np.fromiter(map(bool, texts), bool, n_texts) & (_sums(~keep[which], last + 1) == 0)
        if not good.all():
            n = np.diff(last, prepend=-1)
            which, last = which[np.repeat(good, n)], np.cumsum(np.where(good, n, 0)) - 1
        ends = last + 1
        said, said_ends = gather(as_runs(groups, group_ends), which, "u1")
        links, link_ends = gather(as_runs(codes, code_ends), which, "<i8")
        n_links = np.diff(np.concatenate([[0], link_ends])[ends], prepend=0)
        span = len(self.a.entries) * len(self.b.entries)
        each, times = np.unique(np.repeat(np.arange(n_texts) * span, n_links) + links, return_counts=True)
        pair_ends = np.cumsum(np.bincount(each // span, minlength=n_texts))
        return Aligned(_sums(n_a[which], ends), _sums(n_b[which], ends), _sums(n_groups[which], ends), n_links,
                       said, np.concatenate([[0], said_ends])[ends], each % span, times, pair_ends)


ALIGNED = "key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"


def texts_aligned(docs: DataFrame, make: Callable[[], Aligner], text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per distinct text that is neither null nor empty: (key, copies, n_a, n_b, n_groups, n_links, groups,
    groups_sha256, pairs, times).

    ``key``: SHA-256 of the text; ``copies``: rows that have it; ``groups``: ``a1,a2|b1;a3|b2,b3``
    with decimal ids (null unless ``with_groups``), ``groups_sha256``: its digest ('' without
    tokens); ``pairs``, ``times``: distinct linked id pairs (a * size of B + b) and the text's links of each.
    """

    def run(make_one: Callable[[], Aligner]):
        align = make_one()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            got = align(b.column("text").to_pylist())
            data, ends = got.groups.tobytes(), got.group_ends.tolist()
            lists = [data[i : j - 1] for i, j in zip([0, *ends], ends, strict=False)]
            offsets = pa.array(np.concatenate([[0], got.pair_ends]).astype(np.int32))
            return pa.RecordBatch.from_arrays([
                b.column("key"), b.column("copies"), *(pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)),
                pa.array([x.decode() if with_groups else None for x in lists], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lists], pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(got.pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(got.times, pa.int32())),
            ], names)

        return one

    names = [c.split()[0] for c in ALIGNED.split(", ")]
    texts = docs.select(F.col(text_col).alias("text")).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return common.map_batches(texts.select(F.sha2("text", 256).alias("key"), "copies", "text"), "text", lambda: run(make), ALIGNED, BATCH_BYTES)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each id pair over all documents, and whether no pair with the same id of B has more."""
    one = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = common.stored(one.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("count")), "pairs")
    counts = counts.withColumn("b", F.col("pair") % size_b)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # one row per id of B
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def text_measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of each text with links: its links by how often their pairs are linked in the corpus.

    A text's pairs meet their counts and are summed where the text lies. The count table is broadcast only while it has
    at most ``BROADCAST_PAIRS`` rows; beyond, the pairs that make up most links (at
    most so many, by rank of count) are, and only the others are shuffled.
    """
    one = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), "p.times")
    sums = [F.sum(F.col("times").cast("long") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    if counts.count() <= BROADCAST_PAIRS:
        return one.join(F.broadcast(counts), "pair").groupBy("key").agg(*sums)
    least = counts.approxQuantile("count", [max(0.0, 1 - 0.8 * BROADCAST_PAIRS / counts.count())], 0.1 * BROADCAST_PAIRS / counts.count())[0]
    frequent = counts.where(F.col("count") > least)
    if frequent.count() > BROADCAST_PAIRS:
        return one.join(counts, "pair").groupBy("key").agg(*sums)
    both = one.join(F.broadcast(frequent), "pair").groupBy("key").agg(*sums)
    rest = one.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(counts.where(F.col("count") <= least), "pair").groupBy("key").agg(*sums)
    return both.unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def measured(docs: DataFrame, make: Callable[[], Aligner], size_b: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    Null and empty texts, and texts whose tokens do not spell them, have zeros and ''. One
    row out for each row in, with null and repeated ids kept; other columns are ignored. A
    text that a third of all documents share is one row until the last join, which spreads it.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aligned = common.stored(texts_aligned(docs, make), "aligned")
    sums = text_measures(aligned, common.stored(pair_counts(aligned, size_b), "pair-counts"))
    light = aligned.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    by_key = common.stored(light.join(sums, "key", "left"), "measures")
    keyed = docs.select("id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("key"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return key_join(keyed, by_key, "key", "left").select(F.col("id").alias(id_col), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def public_aligner() -> Aligner:
    """The aligner of the two public vocabularies, kept by a worker process."""
    import public_tokenizers as P

    def build() -> Aligner:
        return Aligner(byte_level(P.path(VOCABULARY_A), P.PATTERN), pieces(P.path(VOCABULARY_B)))

    return common.held("alignment", build)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of both vocabularies, groups, links, and how common its links are in the corpus."""
    import public_tokenizers as P
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=P.path(VOCABULARY_B)).get_piece_size()
    return measured(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_aligner, size_b)
