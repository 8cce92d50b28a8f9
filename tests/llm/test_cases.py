"""Clashing columns, long runs, bounds, and queries against plain versions."""

import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, labelled, licenses, packing, quality, sharding, toxicity, url_filter

ODD = ["_score", "_hit", "_items", "_n_words", "_text_key", "_slot", "_shard", "_grown", "_cut", "_id", "_digest", "_bad", "a.b", "record", "rid", "row", "n", "words", "shard", "bucket", "size", "label", "text_"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns named like those that operators use."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = d.union(d.limit(2)).union(d.limit(1).select(F.lit(None).cast("bigint"), F.lit(None).cast("string"), *d.columns[2:]))
    return d.select("*", *[F.concat(F.lit(c), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string")).alias(c) for c in ODD])


def rows_of(df, columns):
    return sorted(map(str, (tuple(r) for r in df.select([f"`{c}`" for c in columns]).collect())))


def test_odd_columns_stay(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = rows_of(odd, odd.columns)
    for out in (quality.score(odd, quality.train(odd, labels)), toxicity.score(odd, toxicity.train(odd, labels)), sharding.shard(odd), licenses.scan(odd)):
        assert rows_of(out, odd.columns) == want
    light = [c for c in odd.columns if c != "text"]
    assert rows_of(decontaminate.hits(odd, bench), light) == rows_of(odd, light)
    for out in (decontaminate.drop_documents(odd, bench), decontaminate.remove_spans(odd, bench)):
        assert out.columns == odd.columns and set(rows_of(out, light)) <= set(rows_of(odd, light))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50).select("*", *[F.lit(c).alias(c) for c in ("host", "path", "_host", "rest", "authority", "labels", "best", "a.b", "record")])
    for most in (16, 0):
        assert rows_of(url_filter.judge(pages, url_filter.rules_frame(spark), most_shapes=most), pages.columns) == rows_of(pages, pages.columns)


def test_odd_columns_pass_the_pipeline(spark, odd):
    import corpus_pipeline

    d, want = odd, set(rows_of(odd, odd.columns))
    for name, f in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.stage(f(spark, d, "/root/testdata/sf0.001"), name)
        assert d.columns == odd.columns
        left = rows_of(d, odd.columns)
        assert left and set(left) <= want
    assert corpus_pipeline.packed(spark, d, "").count() >= d.count()


@pytest.mark.parametrize("text", [" " * 10**6 + "x", "\n" * 10**6, "a" * 10**6, "7" * 10**6, "\u3000\u00a0" * 5000 + "y", "!" * 10**5 + "<|endoftext|>" + "\t" * 1000])
def test_runs_have_the_ids_of_tokenizers(text):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    assert packing.ids_of(text, p.path("byte_bpe_50k.tiktoken"), p.path("byte_bpe_50k.json")) == Tokenizer.from_file(p.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_long_runs_pass_the_operators(spark):
    d = spark.createDataFrame([(1, " " * 10**6 + "x"), (2, "a" * 10**6), (3, "a " * 300_000), (4, "\n" * 10**6), (5, "mit license " * 100_000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a " * 20), (2, "x")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id bigint, quality int, toxic int")
    assert packing.pack_documents(d).agg(F.sum("length")).first()[0] > 10**5
    assert sharding.shard(d, bucket_bytes=1000).count() == 5
    assert quality.score(d, quality.train(d, labels)).count() == toxicity.score(d, toxicity.train(d, labels)).count() == 5
    got = {r.doc_id: (r["_n_words"], len(r["_hit"])) for r in decontaminate.hits(d, bench).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (300_000, 300_000), 4: (0, 0), 5: (200_000, 0)}
    assert {r.doc_id: r["_n_words"] for r in licenses.scan(d).collect()}[5] == 200_000


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    d = spark.createDataFrame([(i, f"text {i} {j % 2}") for i in range(60) for j in range(4)], "doc_id bigint, text string")
    got = labelled.training_rows(d, labels, "toxic", 3, 1).collect()
    assert len(got) == 3 and len({r.doc_id for r in got}) == 3
    wide = spark.createDataFrame([(i, "x" * (100 if i % 10 else 5000)) for i in range(60)], "doc_id bigint, text string")
    got = labelled.training_rows(wide, labels, "toxic", 1000, 1, most_bytes=64 * 100).collect()
    assert 0 < len(got) <= 64 and all(len(r.text) == 100 for r in got)
    assert labelled.training_rows(wide, labels, "toxic", 1000, 1, most_bytes=64 * 10).count() == 0


def test_shards_against_a_plain_version(spark):
    """The query over a whole table: the record moved, its size and crc32, the law, and slots."""
    sf = "/root/testdata/sf0.001"
    got = sharding.op2_shards(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key") for r in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert [f.dataType.simpleString() for f in sharding.op2_shards(spark, sf).schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]


def test_shards_are_the_same_again_and_spread_a_hot_key(spark):
    d = spark.createDataFrame([(1 if i % 3 else i, f"row {i}") for i in range(3000)], "doc_id bigint, text string")
    first = sharding.shard(d, bucket_bytes=500).collect()
    hot = next(r["_shard"] for r in first if r.doc_id == 1)
    own = sorted(r["_slot"] for r in first if r["_shard"] == hot)
    assert own == list(range(len(own))) and len(own) >= 2000
    in_order = [r.text for r in sorted((r for r in first if r["_shard"] == hot), key=lambda r: r["_slot"])]
    assert in_order != sorted(in_order, key=lambda t: int(t.split()[1]))
    assert {(r.text, r["_shard"], r["_slot"]) for r in sharding.shard(d, bucket_bytes=500).collect()} == {(r.text, r["_shard"], r["_slot"]) for r in first}


@pytest.mark.parametrize("most", [16, 0])
def test_long_hosts_and_many_shapes(spark, most):
    import time

    urls = ["http://" + "a." * 20_000 + "example.org/en/1x", "http://" + "b" * 10**6 + "/es/", "http://x.com" + "/de/" * 10**5]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    began = time.time()
    got = {r.page_id: (r["_rule"], r["_verdict"]) for r in url_filter.judge(df, url_filter.rules_frame(spark), most_shapes=most).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: (None, "allow"), 2: ("com/de/", "block")} and time.time() - began < 20


def test_licences_are_whole_texts(spark):
    s = licenses.Scanner()
    mit = licenses.TEMPLATES["mit"][2].replace("{12}", "the authors").replace("[[", "").replace("]]", "")
    assert s.scan(mit.encode())[2] == {"mit": len(licenses.words_of(mit.encode()).split())}
    assert s.scan(mit.replace("sublicense", "sell").encode())[2] == {}
    three = licenses.TEMPLATES["bsd-3-clause"][0].replace("{12}", "the holder").replace("[[", "").replace("]]", "")
    assert set(s.scan(three.encode())[2]) == {"bsd", "bsd-3-clause"}
    out = {r.doc_id: r for r in licenses.op10_licenses(spark, "/root/testdata/sf0.001").collect()}
    plain = {r.doc_id: licenses.words_of((r.text or "").encode()).decode().split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert set(out) == set(plain)
    for i, words in plain.items():
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = out[i]
        at = sorted(k for k, _ in places)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_shards_move_records_once_whatever_joins_cost(spark):
    """Where no table is small enough for a broadcast by its size, the places of buckets still are, and records stay."""
    d = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding.shard(d, bucket_bytes=500)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("REPARTITION_BY") <= 1 and "BroadcastHashJoin" in plan
