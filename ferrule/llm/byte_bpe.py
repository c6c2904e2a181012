"""Byte-level BPE encoding in overlapping chunks, and decoding, by the ranks of a public vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of a chunk, and those of the next chunk that it also holds.
CHUNK, OVERLAP = 16_384, 1_024
#: Code points after the start of a pre-token that may decide where it ends: the longest fixed alternative of a pattern, as in ``'re``.
AHEAD = 3
#: White space in one run from which on it is encoded apart: the library's own splitter gives up on runs of some 10^5.
RUN = 10_000
#: Character classes that patterns are made of, and for each a sign that any version of Unicode puts in it; last, one that is in none.
CLASSES, SIGNS = (r"\p{L}", r"\p{N}", r"\s"), "é² ¤"

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, and the pattern that splits text before they merge; the pattern must not look behind."""

    ranks: dict[bytes, int]
    pattern: str


def load(path: str, pattern: str) -> Vocabulary:
    """Read a rank file, lines of a base64 token and its rank, on the driver; tasks get the vocabulary, some megabytes, by broadcast."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


class Codec:
    """A vocabulary in use within a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.encoding = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self._runs = regex.compile(rf"\s{{{RUN},}}")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that stands for itself."""
        if len(text) < RUN:
            return self.encoding.encode_to_numpy(text)
        parts, at = [], 0
        for run in self._runs.finditer(text):
            # Of white space before a word, the last character belongs to the word; the rest is one pre-token.
            end = run.end() - (run.end() < len(text))
            blank = self.encoding._encode_single_piece(text[run.start() : end])  # the library's call for a pre-token that is known
            parts += [self.encoding.encode_to_numpy(text[at : run.start()]), np.array(blank, np.uint32)]
            at = end
        return np.concatenate([*parts, self.encoding.encode_to_numpy(text[at:])])

    @cached_property
    def _tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.vocabulary.ranks.items()}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids.tolist()))

    @cached_property
    def _plain(self) -> dict[int, str]:
        """Characters on whose class the two pattern engines differ, each with a sign of the class that the encoder puts it in."""
        every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
        letters = {bytes([b]): b for b in range(256)}
        held = []
        for name in CLASSES:
            finder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=letters, special_tokens={})
            held.append((set(bytes(finder.encode_ordinary(every)).decode()), set(regex.findall(name, every))))
        disputed = set().union(*[theirs ^ ours for theirs, ours in held])
        return {ord(c): next((sign for sign, (theirs, _) in zip(SIGNS, held) if c in theirs), SIGNS[-1]) for c in disputed}

    @cached_property
    def _split(self) -> regex.Pattern:
        return regex.compile(self.vocabulary.pattern)

    def ends(self, text: str, last: bool) -> Iterator[int]:
        """Where pre-tokens of ``text``, read from its start, end, as far as no text after it can change that and a cut there changes no id.

        Only white space is split by what comes after it, so no cut stands after white space. ``last``: no text follows.
        """
        n = len(text)
        for found in self._split.finditer(text if text.isascii() else text.translate(self._plain)):
            start, end = found.span()
            sure = last or (start + AHEAD <= n and end + 1 <= n)
            if sure and end < n and not text[end - 1].isspace():
                yield end


def _packed(ids: list[np.ndarray]) -> bytes:
    return np.concatenate([np.empty(0, np.uint32), *ids]).astype("<u4").tobytes()


def _whole(shared) -> Callable[[Batches], Batches]:
    """Encode rows (doc_id, text) one by one."""

    def run(batches: Batches) -> Batches:
        codec = Codec(shared.value)
        for batch in batches:
            ids = [_packed([codec.encode(t.as_py() or "")]) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    """Cut rows (key, doc_id, text) into chunks, a batch for each so that they are never all held."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                row = batch.slice(i, 1).select(["key", "doc_id"])
                for k, at in enumerate(range(0, len(text), chunk)):
                    columns = [pa.array([k], pa.int32()), pa.array([at + chunk >= len(text)], pa.bool_()), pa.array([text[at : at + chunk + overlap]], pa.string())]
                    yield pa.RecordBatch.from_arrays([*row.columns, *columns], ["key", "doc_id", "k", "last", "text"])

    return run


def _boundaries(shared, chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    """Where pre-tokens end in the two overlaps of a chunk: ``head`` with the chunk before, ``tail`` with the one after."""

    def run(batches: Batches) -> Batches:
        codec = Codec(shared.value)
        for batch in batches:
            heads, tails = [], []
            for value, last in zip(batch.column("text"), batch.column("last").to_pylist(), strict=True):
                text = value.as_py()
                ends = list(codec.ends(text, last or len(text) < chunk + overlap))
                heads.append([e for e in ends if e < overlap])
                tails.append([e - chunk for e in ends if e > chunk])
            columns = [batch.column("key"), batch.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "k", "head", "tail"])

    return run


def _encode_pieces(shared) -> Callable[[Batches], Batches]:
    """Encode pieces that one chunk holds; segments of longer ones are passed on."""

    def run(batches: Batches) -> Batches:
        codec = Codec(shared.value)
        for batch in batches:
            parts, texts = batch.column("parts").to_pylist(), batch.column("segment")
            ids = [_packed([codec.encode(t.as_py())]) if n == 1 else None for n, t in zip(parts, texts, strict=True)]
            rest = [None if n == 1 else t.as_py() for n, t in zip(parts, texts, strict=True)]
            kept = [batch.column(c) for c in ("key", "doc_id", "copies", "k", "piece")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(rest, pa.string())], ["key", "doc_id", "copies", "k", "piece", "ids", "segment"])

    return run


def _gather(shared) -> Callable[[Batches], Batches]:
    """Join the ids of each key's pieces, which come sorted by (key, k); a piece over several chunks is encoded here, whole."""

    def run(batches: Batches) -> Batches:
        codec = Codec(shared.value)
        key, row, parts, piece, open_ = None, None, [], None, []

        def close() -> None:
            if open_:
                parts.append(_packed([codec.encode("".join(open_))]))
                open_.clear()

        def finish() -> Batches:
            close()
            if row is not None:
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([b"".join(parts)], pa.binary())], ["doc_id", "copies", "ids"])
                parts.clear()

        for batch in batches:
            for i, (k, p) in enumerate(zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
                if k != key:
                    yield from finish()
                    key, row, piece = k, batch.slice(i, 1).select(["doc_id", "copies"]), p
                if p != piece:
                    close()
                    piece = p
                ids = batch.column("ids")[i].as_py()
                if ids is None:
                    open_.append(batch.column("segment")[i].as_py())
                else:
                    parts.append(ids)
        yield from finish()

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ids of every whole text, as the library would encode it without special tokens: doc_id, ids.

    ``ids`` are packed as little-endian unsigned 32-bit integers, the form that trainers map into memory. A text of up to
    ``chunk`` code points is one chunk and is encoded where it lies. A longer one is cut into chunks that reach ``overlap``
    code points into the next, dealt over the cluster by (text, chunk). Each is pre-tokenised from its start, which may lie
    within a word; where a pre-token ends at the same place in both readings of an overlap, they agree from there on, as the
    pattern does not look behind, and the text is cut there: the pieces are what the library would split at, too, and are
    encoded in parallel. Where two readings never meet, as within a run of one letter, the chunks are one piece, which is
    encoded whole. Only places, not texts, pass through the window that orders the chunks of a text; ids of a text are
    joined as a stream sorted by chunk, so a task holds one text's ids, of the length of its row.

    A null text is an empty one; null and repeated ids are rows like others (equal rows of long text are encoded once and
    repeated); an empty table gives no rows; other columns are ignored.
    """
    if not AHEAD < overlap <= chunk:
        raise ValueError("an overlap must be longer than what a pattern looks ahead, and no longer than a chunk")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", "text")
    long_ = F.coalesce(F.length("text") > chunk, F.lit(False))
    id_ = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    key, k, copies, ids = T.StructField("key", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("copies", T.LongType()), T.StructField("ids", T.BinaryType())
    text = T.StructField("text", T.StringType())
    short = rows.where(~long_).mapInArrow(_whole(shared), T.StructType([id_, ids]))

    keyed = rows.where(long_).withColumn("key", F.sha2(F.concat(F.to_json(F.struct("doc_id")), "text"), 256))
    cut = keyed.mapInArrow(_cut(chunk, overlap), T.StructType([key, id_, k, T.StructField("last", T.BooleanType()), text]))
    chunks = cut.groupBy("key", "k").agg(F.first("doc_id").alias("doc_id"), F.first("last").alias("last"), F.first("text").alias("text"), F.count("*").alias("copies"))
    places = T.ArrayType(T.IntegerType())
    ends = chunks.select("key", "k", "last", "text").mapInArrow(_boundaries(shared, chunk, overlap), T.StructType([key, k, T.StructField("head", places), T.StructField("tail", places)]))
    order = Window.partitionBy("key").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    stitched = ends.select("key", "k", met.alias("met"))
    first = F.last(F.when((F.col("k") == 0) | F.col("met").isNotNull(), F.col("k")), ignorenulls=True).over(order)
    stitched = stitched.withColumns({"piece": first, "until": F.lead("met").over(order)})
    stitched = stitched.withColumn("parts", F.count("*").over(Window.partitionBy("key", "piece")))

    # Chunk k gives what lies between the cut in its head and the cut in its tail; where there is none, up to the next chunk.
    a = F.coalesce("met", F.lit(0))
    b = F.when(F.col("last"), F.length("text")).otherwise(chunk + F.coalesce("until", F.lit(0)))
    segments = chunks.join(stitched, ["key", "k"]).select("key", "doc_id", "copies", "k", "piece", "parts", F.substring("text", a + 1, b - a).alias("segment"))
    encoded = segments.mapInArrow(_encode_pieces(shared), T.StructType([key, id_, copies, k, T.StructField("piece", T.IntegerType()), ids, T.StructField("segment", T.StringType())]))
    sorted_ = encoded.repartition("key").sortWithinPartitions("key", "k")
    whole = sorted_.mapInArrow(_gather(shared), T.StructType([id_, copies, ids]))
    again = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return short.unionByName(again.select("doc_id", "ids"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``decoded``, the raw bytes of the packed ``ids`` end to end, which need not be valid UTF-8, to all other columns; null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    encoded = encoded.drop("decoded")

    def run(batches: Batches) -> Batches:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if (ids := i.as_py()) is None else codec.decode(np.frombuffer(ids, "<u4")) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
