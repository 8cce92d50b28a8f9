"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become ids of a public byte-level BPE vocabulary, with id 0 after each. Longer ones than a sequence are
cut into full pieces, the first taking what is left over. Pieces are packed by bounded-space online best fit: a
fixed number of bins stays open, a bitset keyed by free space finds the fullest bin that still takes a piece, and
when all bins are open and none fits, the fullest closes.

Tokens are made in one pass over the texts. Only lengths (about 40 bytes a piece) are staged and shuffled; they
are dealt by a hash into groups of at most about ``group_tokens`` tokens, each packed by one task, and so the space
lost to bins left open at the end of a group stays below ``open_bins`` sequences for each ``group_tokens``.

Cases: null and empty texts are the id 0 alone. Repeated rows are packed each. Null ids stay null. Empty table: no
rows. A very long text, or a run of one character of any length, is cut; nothing is dropped. Other columns, whatever
their names, are left out of the result.

The ids equal those of the tokenizers library with the vocabulary's JSON file; tiktoken reads the same vocabulary
as ranks and makes them several times faster. The end-of-text string in a text becomes its special id, in both.
tiktoken's matcher keeps one place on its stack for each character of a run of white space and fails near a million;
all its other patterns take one place a match. So texts with ``SPACES`` white-space characters in a row go to the
tokenizers library itself, which has no such stack: texts of any length and kind get their ids.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, map_arrow, quoted, stage, table

LENGTH, OPEN_BINS, GROUP_TOKENS, SPACES = 2048, 4096, 2_000_000_000, 1000
_encoders: dict = {}
_spaces = re.compile(r"\s{%d}" % SPACES)  # what Python holds for white space includes all that the matcher does


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_encoder(path: str):
    """The tokenizers library's own encoder of a JSON file, read once in each worker that needs it."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def encoder(path: str):
    """The encoder of a rank file, read once in each worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _encoders[path]


def ids_of(s: str, ranks: str, json: str) -> list[int]:
    if _spaces.search(s):
        return plain_encoder(json).encode(s, add_special_tokens=False).ids
    enc = encoder(ranks)
    return enc.encode(s, allowed_special="all") if "<|" in s else enc.encode_ordinary(s)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all but the first are full."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((x, length) for x in range(first, n, length))]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ranks: str | None = None, json: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row per piece: key, piece, start, length, crc32 of the ids and, if asked for, the ids."""

    def tokenise(b: pa.RecordBatch) -> dict:
        # The vocabulary is a file of the installed package on every machine, so its place is looked up there.
        paths = ranks or vocabulary("byte_bpe_50k.tiktoken"), json or vocabulary("byte_bpe_50k.json")
        out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
        for row, raw in enumerate(as_bytes(b.column(1))):
            ids = np.array([*ids_of(raw.decode(), *paths), 0], dtype="<u4")
            for k, (at, n) in enumerate(cut(len(ids), length)):
                part = ids[at : at + n].tobytes()
                for name, x in zip(out, (row, k, at, n, zlib.crc32(part), part if with_ids else None), strict=True):
                    out[name].append(x)
        return out | {"key": b.column(0).take(pa.array(out["row"], pa.int64()))}

    kind = docs.schema[key].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    return map_arrow(docs.select(quoted(key), quoted(text)), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}", tokenise).withColumnRenamed("key", key)


class BestFit:
    """Online best fit with a fixed number of open bins; bit f of the bitset says that a bin with f free is open."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.open_bins, self.free, self.n_open, self.made = length, open_bins, 0, 0, 0
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def _take(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        if not self.bins[room]:
            self.free ^= 1 << room
        return got

    def place(self, n: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of n ids."""
        fits = self.free >> n
        if fits:
            sequence, used = self._take(room := n + (fits & -fits).bit_length() - 1)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.n_open -= 1
            sequence, used, room = self.made, 0, self.length
            self.made += 1
            self.n_open += 1
        if room == n:
            self.n_open -= 1
        else:
            self.bins[room - n].append((sequence, used + n))
            self.free |= 1 << (room - n)
        return sequence, used


def pack(found: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. Give it a staged table: it is read twice."""
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.lit(5), *found.columns), F.lit(groups)).cast("long"))
    dealt = dealt.repartition("_group").sortWithinPartitions("_group", F.xxhash64(F.lit(6), *found.columns), *found.columns)
    names = found.columns

    def run(batches):
        group, bins = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            seq, off = [], []
            for g, n in zip(b.column("_group").to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, BestFit(length, open_bins)
                s, o = bins.place(n)
                seq.append(g << 40 | s)
                off.append(o)
            t = t.select(names).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))
            yield from t.to_batches()

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField(f.name, f.dataType) for f in found.schema] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(stage(pieces(docs, key, text, length, with_ids=False), "pieces"), length, open_bins)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
