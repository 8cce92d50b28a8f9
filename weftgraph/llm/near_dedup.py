"""Near-duplicate documents by MinHash: one-permutation hashing, banded buckets and star-shaped candidates.

One pass hashes each text's shingles once; bin i of the signature holds the smallest hash that falls into it, and an
empty bin takes the value of a bin drawn by a seeded walk until one is filled (optimal densification). ``bands`` of
``rows`` bins are hashed into buckets: at similarity 0.8 a pair shares no bucket with probability under 1e-4.

Documents with equal shingle sets are one class from the start, so thousands of copies cost one candidate. In each
bucket the members are compared with the bucket's centre only (a star: as many pairs as members). Connected
components follow. Documents of buckets whose members then lie in more than one component get an exact second look
by prefixes: each keeps its rarest shingles, as many as two similar sets must share one of, and documents of
different components that share such a shingle are compared. A passage that many documents hold is common, so it is
in no prefix and makes no pairs; copies lie in one component by then. So stars bound the pairs of groups of near
copies, and no pair that shares a bucket goes undecided. What bounds the second look is that the largest component of a
token meets the others only, so its pairs grow with documents that lie in small components, share a rare shingle and
are of like size; a token of many documents is dealt over several tasks.

Every link is confirmed on the full shingle sets: a centre and up to ``salt`` members travel to one task as texts,
where the sets are rebuilt; a centre with more members is sent once per ``salt`` of them. Components are found by
alternating stars on tables; nothing is collected but counts. Tables that several steps read are staged in the
shared folder.

Cases: texts without words, and null texts, have no shingles and are linked with nothing. Fewer words than a shingle:
the whole sequence is the one shingle. Rows without an id are returned without a component and kept. Equal rows
share a component; an id that repeats with other texts may lie in the component of any of them. Ids must be whole
numbers. Empty table: no rows. Very long texts are taken whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, map_arrow, quoted, stage, table, unstage, whole_numbers

BANDS, ROWS, SALT, WAY = 26, 5, 64, 256
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    m = max(n - width + 1, 1)
    out = np.full(m, n if n < width else width, np.uint64)
    for j in range(min(width, n)):
        out = (out ^ h[j : j + m]) * _M
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


class Signature:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = (np.arange(1, self.bins, dtype=object) * 2**64 // self.bins).astype(np.uint64)
        rng = np.random.default_rng(seed)
        self.walk = rng.integers(0, self.bins, (4096, self.bins))
        self.mix = (rng.integers(0, 2**63, self.bands, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.searchsorted(s, self.edges), [len(s)]])
        filled = at[1:] > at[:-1]
        value = s[np.minimum(at[:-1], len(s) - 1)].copy()
        empty = np.nonzero(~filled)[0]
        for step in self.walk:
            if not len(empty):
                break
            to = step[empty]
            ok = filled[to]
            value[empty[ok]] = value[to[ok]]
            empty = empty[~ok]
        for i in empty:  # none of 4096 draws met a filled bin
            value[i] = s[0]
        out = self.mix.copy()
        for j in range(self.rows):
            out = (out ^ value[j :: self.rows]) * _M
            out ^= out >> np.uint64(31)
        return out.astype(np.int64)


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, print, bands): print is a digest of the shingle set; null without shingles."""
    sign = Signature()

    def run(b: pa.RecordBatch) -> dict:
        n, prints, bands = [], [], []
        for raw in as_bytes(b.column(1)):
            s = shingle_set(raw, width)
            n.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(sign(s) if len(s) else None)
        return {"id": b.column(0), "n_shingles": n, "print": prints, "bands": bands}

    return map_arrow(docs.select(quoted(key).cast("long"), quoted(text)), "id bigint, n_shingles bigint, print binary, bands array<bigint>", run)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, key: str, text: str, percent: int = 80, salt: int = SALT) -> DataFrame:
    """Of the pairs (centre, member) those whose sets share at least percent of their union."""
    size = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(salt)).cast("int").alias("parts"))
    dealt = pairs.join(size, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    needs = dealt.select(F.col("member").alias("need"), "centre", "salt", F.lit(1).alias("role"))
    needs = needs.union(size.select(F.col("centre").alias("need"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0)))
    texts = docs.select(quoted(key).cast("long").alias("need"), quoted(text).alias("text"))
    rows = texts.join(needs.hint("shuffle_hash"), "need").select("centre", "salt", "role", "need", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role", "need")

    def run(batches):
        at, sets = None, []
        for b in batches:
            a, c = [], []
            for centre, part, role, need, raw in zip(*(b.column(n).to_pylist() for n in ("centre", "salt", "role", "need")), as_bytes(b.column("text")), strict=True):
                if (centre, part) != at:
                    at, sets = (centre, part), []
                s = shingle_set(raw, width)
                if role == 0:
                    sets.append(s)  # an id that is repeated with other texts has several
                    continue
                for t in sets:
                    both = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) else 0
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        a.append(centre)
                        c.append(need)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id on an edge: the smallest id that is reachable, by large and small stars in turn."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stage(ends, "stars")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", "m"))
        after = stage(small.where("u <> v").distinct(), "stars")
        unstage(now)
        now, was = after, state
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))


def prefixes(ids: DataFrame, docs: DataFrame, width: int, key: str, text: str, percent: int) -> DataFrame:
    """(token, id, label, n, rest): the rarest shingles of each document, as many as any two that are similar enough must
    share one of, each with the number of the document's shingles from it on. Rarity is counted over the given
    documents, all of them."""

    def run(b: pa.RecordBatch) -> dict:
        sets = [shingle_set(raw, width) for raw in as_bytes(b.column(2))]
        return {"id": b.column(0), "label": b.column(1), "n": [len(x) for x in sets], "tokens": [x.astype(np.int64) for x in sets]}

    texts = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text")).join(ids.hint("shuffle_hash"), "id").select("id", "label", "text")
    sets = stage(map_arrow(texts, "id bigint, label bigint, n bigint, tokens array<bigint>", run), "sets")
    each = sets.select("id", "label", "n", F.explode("tokens").alias("token"))
    counted = each.join(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token", "left")
    # A token of one document only is rarest and matches nothing: it takes a place and goes.
    own = counted.groupBy("id", "label", "n").agg(F.count_if(F.col("df").isNull()).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "token")))).alias("tokens"))
    places = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - F.col("alone")).cast("int")
    own = own.select("id", "label", "n", "alone", F.posexplode(F.slice("tokens", F.lit(1), places)).alias("place", "x"))
    return own.select("x.token", "id", "label", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("rest"))


def residual(members: DataFrame, labels: DataFrame, docs: DataFrame, width: int, key: str, text: str, percent: int) -> DataFrame:
    """Candidates that stars have missed: pairs of different components that share a bucket of mixed components are
    among the pairs of different components that share a token of their prefixes; here are those."""
    known = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("bucket")
    ids = stage(known.join(mixed, "bucket", "left_semi").select("id", "label").distinct(), "mixed")
    found = stage(prefixes(ids, docs, width, key, text, percent), "prefixes")
    sizes = found.groupBy("token", "label").agg(F.count("*").alias("size"))
    # A token of many documents is dealt into several ways of WAY of them, each with all of its small components.
    ways = F.ceil(F.sum("size") / F.lit(WAY)).cast("int").alias("ways")
    most = sizes.groupBy("token").agg(F.max(F.struct("size", "label"))["label"].alias("most"), F.count("*").alias("labels"), ways).where("labels > 1").select("token", "most", "ways")
    most = stage(most, "shared-tokens")  # a join of two tables as they lie is split where a token is frequent
    held = stage(found.join(most, "token"), "tokens")
    # All but the largest component of a token meet the others: as few pairs as there are small components.
    few = held.where("label <> most").select("token", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.col("id").alias("x"), F.col("label").alias("xl"), F.col("n").alias("xn"), F.col("rest").alias("xrest"))
    # At the first token that two share, no more than the shorter rest can be common.
    enough = (100 + percent) * F.least("rest", "xrest") >= percent * (F.col("n") + F.col("xn"))
    met = held.withColumn("way", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")).join(few, ["token", "way"]).where("label <> xl and (label = most or id < x)").where(_near("n", "xn", percent) & enough)
    pairs = met.select(F.least("id", "x").alias("centre"), F.greatest("id", "x").alias("member")).distinct()
    return stage(pairs, "pairs")


def _near(a: str, b: str, percent: int):
    """Sizes that leave the similarity possible."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(key, n_shingles, component) of every row."""
    whole_numbers(docs, key)
    signed = stage(signatures(docs, width, key, text), "signatures")
    classes = signed.where("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes, "classes")
    spread = classes.select(F.col("rep").alias("id"), "n", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "id", "n")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(spread.join(sizes, "bucket"), "buckets")
    # The centre of a bucket is its member with the most company over all buckets: an original rather than a copy of it.
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    centres = members.join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("low"), "n")).alias("c"))
    members = stage(members.join(centres.select("bucket", (-F.col("c.low")).alias("centre"), F.col("c.n").alias("centre_n")), "bucket"), "stars-of")
    pairs = members.where((F.col("id") != F.col("centre")) & _near("n", "centre_n", percent)).select("centre", F.col("id").alias("member")).distinct()
    edges = stage(confirm(stage(pairs, "pairs"), docs, width, key, text, percent), "edges")
    labels = components(edges)
    missed = residual(members, labels, docs, width, key, text, percent)
    if not missed.isEmpty():
        found = stage(confirm(missed, docs, width, key, text, percent), "edges")
        if not found.isEmpty():
            labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(found))
    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select("print", F.coalesce("label", "rep").alias("component"))
    linked = signed.select("id", "n_shingles", "print").join(named, "print", "left")
    return linked.select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on shingles of four words."""
    out = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) x
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS root, doc_id AS here FROM documents UNION SELECT r.root, e.y FROM r JOIN e ON r.here = e.x
), m AS (
  SELECT root, min(here) AS component_id FROM r GROUP BY root
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.root = d.doc_id
"""
