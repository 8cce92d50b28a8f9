"""Benchmark decontamination: token windows of documents against a hash set of benchmark n-grams.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). Every window of m
words holds, at each stride of s = (m + 1) // 2 words, one run of m - s + 1 words; so a document is scanned at
every s-th word only, against the hash set of those runs, and the windows around each hit are then compared word
for word. Nothing is lost by the stride. Only DataFrame functions run.

The hash set goes to executors as literals when counted to have at most ``literal_runs`` members; a larger one is
joined, by broadcast up to ``broadcast_runs`` members and else by a shuffle. One scan of the texts keeps the words
of documents with hits only; what follows is as large as the hits.

Cases: null or empty text: no words, not contaminated. Items without words have no windows; items without an id
contaminate but are not listed. Repeated rows are judged one by one. Very long texts are scanned to their end. Other
columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower, free_name, quoted, stage, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, LITERAL_RUNS, BROADCAST_RUNS = 13, 50_000, 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def gram(words: Column, start: Column, m: int) -> Column:
    return F.array_join(F.slice(words, start + 1, F.lit(m)), " ")


def run_hash(words: Column, start: Column, m: int, g: int) -> Column:
    return F.xxhash64(F.lit(m), F.slice(words, start + 1, F.lit(g)))


def upto(last: Column, step: int = 1) -> Column:
    """0, step, 2 step ... up to last; empty where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def benchmark_windows(bench: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, m, gram, run hashes) of all windows."""
    words = bench.select(quoted(item).cast("string").alias("item"), words_of(quoted(text)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("m", F.least(F.size("words"), F.lit(width)))
    return words.select("item", "m", F.explode(F.transform(upto(F.size("words") - F.col("m")), lambda i: F.slice("words", i + 1, F.col("m")))).alias("window")).distinct()


def names(docs: DataFrame) -> tuple[str, str, str]:
    """What hits() calls its columns on this table."""
    return free_name(docs, "_n_words"), free_name(docs, "_hit"), free_name(docs, "_items")


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", width: int = WIDTH, literal_runs: int = LITERAL_RUNS, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """Every row of docs without its text, with the number of words, the sorted positions of those inside windows, and
    the sorted ids of items; see names()."""
    windows = stage(benchmark_windows(bench, width), "bench-windows")
    sizes = [r["m"] for r in windows.select("m").distinct().orderBy("m").collect()]
    runs = None
    for m in sizes:
        s = (m + 1) // 2
        found = windows.where(F.col("m") == m).select(F.lit(m).alias("m"), F.explode(F.transform(upto(F.lit(s - 1)), lambda i: run_hash(F.col("window"), i, m, m - s + 1))).alias("run"))  # noqa: B023
        runs = found if runs is None else runs.union(found)
    n_runs = runs.distinct().count() if sizes else 0

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*([quoted(c) for c in docs.columns if c != text] or [F.lit(0)])).alias("record"), words_of(quoted(text)).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    places = {m: upto(F.col("n") - (m // 2 + 1), (m + 1) // 2) for m in sizes}
    if n_runs <= literal_runs:
        members = {m: [r["run"] for r in runs.where(F.col("m") == m).select("run").distinct().collect()] for m in sizes}
        starts = {m: F.filter(places[m], lambda p: run_hash(F.col("words"), p, m, m // 2 + 1).isin(members[m])) for m in sizes}  # noqa: B023
        rows = rows.select("*", *[starts[m].alias(f"at_{m}") for m in sizes])
    else:
        rows = stage(rows, "bench-words")
        known = runs.distinct()
        known = F.broadcast(known) if n_runs <= broadcast_runs else known
        # All sizes are probed in one pass and come back in one join, so the words travel once at most.
        each = [F.transform(places[m], lambda p: F.struct(F.lit(m).alias("m"), p.alias("p"), run_hash(F.col("words"), p, m, m // 2 + 1).alias("run"))) for m in sizes]  # noqa: B023
        probe = rows.select("rid", F.explode(F.flatten(F.array(*each))).alias("x")).select("rid", "x.*")
        met = probe.join(known, ["m", "run"], "left_semi")
        rows = rows.join(met.groupBy("rid").agg(*[F.collect_list(F.when(F.col("m") == m, F.col("p"))).alias(f"at_{m}") for m in sizes]), "rid", "left")
    some = F.lit(False)
    for m in sizes:
        some = some | (F.size(F.coalesce(f"at_{m}", F.expr("cast(array() as array<int>)"))) > 0)
    light = [c for c in docs.columns if c != text]
    scanned = rows.select("rid", "record", F.col("n").alias("_n_words"), F.when(some, F.col("words")).alias("words"), *[F.when(some, F.col(f"at_{m}")).alias(f"at_{m}") for m in sizes])
    scanned = stage(scanned, "bench-scan")

    found = None
    for m in sizes:
        s, n = (m + 1) // 2, F.size("words")
        near = F.flatten(F.transform(f"at_{m}", lambda p: F.filter(F.sequence(p - (s - 1), p), lambda i: (i >= 0) & (i <= n - m))))  # noqa: B023
        each = scanned.where(F.size(f"at_{m}") > 0).select("rid", F.explode(F.transform(near, lambda i: F.struct(i.alias("start"), gram(F.col("words"), i, m).alias("gram")))).alias("x"))  # noqa: B023
        each = each.select("rid", F.lit(m).alias("m"), "x.start", "x.gram")
        found = each if found is None else found.union(each)
    keyed = windows.select("item", "m", F.array_join("window", " ").alias("gram"))
    if found is None:
        per = scanned.select("rid").limit(0).select("rid", F.expr("cast(array() as array<int>)").alias("_hit"), F.expr("cast(array() as array<string>)").alias("_items"))
    else:
        found = found.join(keyed.select("m", "gram").distinct(), ["m", "gram"], "left_semi")
        found = stage(found, "bench-hits")
        spans = found.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + m - 1)"))))).alias("_hit"))
        items = found.select("rid", "m", "gram").distinct().join(keyed, ["m", "gram"]).groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("_items"))
        per = spans.join(items, "rid", "left")
    out = scanned.select("rid", "record", "_n_words").join(per, "rid", "left")
    lists = [F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c) for c, kind in (("_hit", "int"), ("_items", "string"))]
    return out.select(*[F.col("record")[c].alias(c) for c in light], *[c.alias(n) for c, n in zip((F.col("_n_words"), *lists), names(docs), strict=True)])


def contaminated(n_words: str = "_n_words", hit: str = "_hit") -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.size(hit) > 0) & (20 * F.size(hit) >= F.col(n_words))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, text): a document is known by its key and the digest of its text."""
    digest = F.sha2(F.coalesce(quoted(text), F.lit("")).cast("binary"), 256)
    return docs.select(quoted(key).alias("id"), digest.alias("digest"), quoted(text).alias("text"))


def _same(docs: DataFrame, found: DataFrame, key: str, text: str) -> Column:
    digest = F.sha2(F.coalesce(quoted(text), F.lit("")).cast("binary"), 256)
    return digest.eqNullSafe(F.col(found.columns[1])) & quoted(key).eqNullSafe(F.col(found.columns[0]))


def drop_documents(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, unchanged. A document is known by its key and the digest of its text."""
    bad = hits(_keyed(docs, key, text), bench).where(contaminated()).select(F.col("id").alias(free_name(docs, "_id")), F.col("digest").alias(free_name(docs, "_digest"))).distinct()
    return docs.join(bad, _same(docs, bad, key, text), "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents; words inside benchmark windows go, with the separators before them."""
    at, at_digest, cut = free_name(docs, "_id"), free_name(docs, "_digest"), free_name(docs, "_cut")
    spans = hits(_keyed(docs, key, text), bench).where(F.size("_hit") > 0)
    spans = spans.groupBy(F.col("id").alias(at), F.col("digest").alias(at_digest)).agg(F.first("_hit").alias(cut))
    low = ascii_lower(quoted(text))
    pieces = F.regexp_extract_all(quoted(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*$", 0)
    kept = F.concat(F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col(cut), i)), ""), tail)
    out = docs.join(spans, _same(docs, spans, key, text), "left")
    return out.select(*[F.when(F.col(cut).isNotNull(), kept).otherwise(quoted(c)).alias(c) if c == text else quoted(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words hit, items met and the verdict for every document."""
    out = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").cast("long").alias("n_words"),
        F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 13) AS m FROM b WHERE len(w) > 0) x) y
), s AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) k) y
), h AS (
  SELECT s.rid, s.m, s.i, g.item_id FROM s JOIN g ON s.m = g.m AND s.gram = g.gram
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM h) x GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) x GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN t ON d.rid = t.rid
"""
