import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.oracle import both, connect
from vellichor.llm import boilerplate, bpe, canonical, catalog, encoding, mixing, neardup, pii, residue

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, ids string, title string, k string"
VERSIONS = "version_id string, content_blob string, document_id string, line_no string, h string"
ANCHORS = "anchor_id string, created_version string, exact string, body string"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join(rng.choice(["bridge", "ledger", "café", "harbour", "12"]) for _ in range(60_000))


@pytest.fixture(scope="module")
def documents(spark, long_text):
    rows = [(1, "hello world", "a", "x", "t", "k"), (1, "hello world", "a", "x", "t", "k"), (2, None, None, None, None, None), (3, "", "b", None, "", None), (None, "  ", "b", None, "x", None), (4, long_text, "a", None, "x", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def versions(spark, long_text):
    rows = [("v1", "Home · News · Search\n\nA line of text.", "d", None, None)] * 2 + [("v2", None, None, None, None), ("v3", "", "d", None, None), (None, "\n", "d", None, None), ("v4", long_text, "d", None, None)]
    return spark.createDataFrame(rows, VERSIONS)


def test_odd_rows(spark, documents, versions):
    ids = {(r.doc_id, len(r.ids)) for r in bpe.encode_texts(documents).collect()}
    assert (2, 0) in ids and (3, 0) in ids and (1, 2) in ids and any(k is None and n > 0 for k, n in ids)
    assert bpe.encode_texts(documents).count() == 6
    assert [(r.version_id, r.line_no) for r in boilerplate.furniture(versions).collect()] == [("v1", 0)]
    assert residue.residue_versions(versions).count() == 0
    assert encoding.garbled_records(documents, versions).count() == 0
    assert neardup.near_duplicates(versions).count() == 0
    assert pii.find_personal(documents).count() == 0
    assert {(r.doc_id, r.text) for r in pii.redact_texts(documents).collect() if r.doc_id in (1, 2, 3)} == {(1, "hello world"), (2, None), (3, "")}
    with pytest.raises(ValueError):
        bpe.count_tokens(documents.withColumn("n_tokens", F.lit(1)))


def test_empty_tables(spark):
    docs, vers, anchors = spark.createDataFrame([], DOCS), spark.createDataFrame([], VERSIONS), spark.createDataFrame([], ANCHORS)
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    for df in (bpe.encode_texts(docs), boilerplate.furniture(vers), residue.residue_versions(vers), encoding.garbled_records(docs, vers), neardup.near_duplicates(vers), pii.find_personal(docs), canonical.disguised_quotes(anchors, vers), *mixing.mix_sources(docs, targets)):
        assert df.count() == 0


def test_disguised_quotes(spark):
    body = "The ﬁrst harbour ｌｅｄｇｅｒ of 1901 — a café² quay"
    vers = spark.createDataFrame([("v", body, "d", None, None)] * 2, VERSIONS)
    quotes = {"a": "first harbour", "b": "harbour ledger", "c": "hаrbоur", "d": "café²", "e": "The ﬁrst", "f": "cafe²", "g": "café2", "h": "Harbour", "i": "har​bour", "j": "of 1901", "k": "missing", "l": "", "m": None}
    anchors = spark.createDataFrame([(k, "v", q, "x") for k, q in quotes.items()] + [("z", "none", "q", None)], ANCHORS)
    assert {r.anchor_id for r in canonical.disguised_quotes(anchors, vers).collect()} == set("abcdij")


def test_mix_reaches_shares(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), None, None, None) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 16), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, targets)
    shares = {r.source: r for r in report.collect()}
    assert all(abs(shares[s].reached_tokens - shares[s].wanted_tokens) <= 60 for s in "abc") and shares["none"].reached_tokens == 0
    counted = {r.source: r.n for r in bpe.count_tokens(mix.select("source", "text")).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert counted == {s: shares[s].reached_tokens for s in "abc"}
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 16
    assert mix.groupBy("doc_id", "copy_no").count().filter("count > 1").count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = {}
    for f in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(90, 220))]
        texts[f"{f}-0"] = " ".join(base)
        for k in range(1, 4):
            new = list(base)
            for _ in range(rng.randrange(0, 14)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts[f"{f}-{k}"] = "  ".join(new) if k == 3 else " ".join(new)
    rows = [(k, t, "d", None, None) for k, t in texts.items()] + [("0-1", texts["0-1"], "d", None, None), ("s", "short", "d", None, None)]
    sets = {k: {(u := " ".join(t.split()))[i : i + 8] for i in range(len(" ".join(t.split())) - 7)} for k, t in texts.items()}
    wanted = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {(r.version_id_a, r.version_id_b) for r in neardup.near_duplicates(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert got == wanted


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, wanted = both(spark, connect(FOLDER), catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert got == wanted and got


def test_near_duplicates_with_scattered_edits(spark):
    rng = random.Random(10)
    texts = {}
    for f in range(60):
        base = [rng.choice("abcdefghijklmnop") for _ in range(rng.choice((420, 900)))]
        texts[f"{f}-0"] = "".join(base)
        for i in range(rng.randrange(33), len(base), 34):
            base[i] = rng.choice("QRST")
        texts[f"{f}-1"] = "".join(base)
    sets = {k: {t[i : i + 8] for i in range(len(t) - 7)} for k, t in texts.items()}
    wanted = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    rows = [(k, t, "d", None, None) for k, t in texts.items()]
    got = {(r.version_id_a, r.version_id_b) for r in neardup.near_duplicates(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert len(wanted) > 40 and got == wanted


def test_mix_of_whole_corpus(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "a" if i else "b", None, None, None) for i in range(200)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    _, report = mixing.mix_sources(docs, targets, whole=True)
    shares = {r.source: r for r in report.collect()}
    assert shares["b"].reached_tokens == 3 * shares["b"].available_tokens < shares["b"].wanted_tokens
    assert abs(shares["a"].reached_tokens - shares["a"].wanted_tokens) <= 60


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_near_duplicates_equal_brute_force(spark):
    versions = spark.read.parquet(f"{FOLDER}/versions.parquet")
    texts = {r.version_id: r.content_blob for r in versions.filter("version_id is not null and length(content_blob) >= 400").collect()}
    sets = {}
    for k, t in texts.items():
        plain = " ".join(x for x in re.split(r"[ \t\r\n]+", t) if x)
        sets[k] = {plain[i : i + 8] for i in range(len(plain) - 7)}
    wanted = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r.version_id_a, r.version_id_b) for r in neardup.near_duplicates(versions).collect()} == wanted and wanted
    members = neardup.near_duplicate_members(versions).collect()
    assert sorted(r.version_id for r in members) == sorted(k for k, s in sets.items() if s)
    # within classes and across them, members and links say as many pairs as there are
    size = {r.class_id: r.copies for r in members}
    assert sum(r.links for r in members) > 0 and len(wanted) >= sum(n * (n - 1) // 2 for n in size.values())


def test_blocks_of_near_duplicates(spark, monkeypatch):
    """Many small blocks, also several for one size, give the same pairs as one."""
    versions = spark.read.parquet(f"{FOLDER}/versions.parquet")
    one = set(map(tuple, neardup.near_duplicates(versions).collect()))
    monkeypatch.setattr(neardup, "BLOCK_ENTRIES", 1500)
    assert set(map(tuple, neardup.near_duplicates(versions).collect())) == one


def test_sample_of_the_residue_model_is_bounded(spark, monkeypatch):
    """Rows without an id and repeated rows are drawn like others."""
    monkeypatch.setattr(residue, "FIT_TRUSTED", 5)
    monkeypatch.setattr(residue, "FIT_UNLABELLED", 7)
    got = []
    monkeypatch.setattr(residue, "fit_bodies", lambda bodies: got.extend(bodies))
    rows = spark.range(20_000).select(F.lit(None).cast("string").alias("version_id"), F.concat(F.lit("404 not found "), F.col("id") % 9000).alias("content_blob"))
    residue.fit(rows)
    assert 0 < len(got) <= 12
