from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from vellichor import __main__ as command
from vellichor.config import Config, load_config
from vellichor.functions import formats, matching
from vellichor.operators import identity, observe, policy, verify

BEFORE, AFTER = "The clerk of the north mill wrote this down in May: ", " Nobody has seen the book since that winter."
QUOTE = "the second wheel was rebuilt with 48 oak paddles in 1907"


def test_verdicts_of_places_with_and_without_surroundings():
    changed = QUOTE.replace("48", "47")
    hint = len(BEFORE)
    judge = lambda text: matching.judge(text, QUOTE, BEFORE, AFTER, hint)
    assert judge(BEFORE + changed + AFTER).state == "ALTERED" and judge(BEFORE + changed + AFTER).distance == 1
    # something like it elsewhere may be another's
    assert judge("Quite another page. " * 30 + changed + " and so on. " * 30).state == "UNRESOLVED"
    # unrelated text between the old surroundings isn't the quote
    assert judge(BEFORE + "all fish of the pond were sold to a trader from the coast" + AFTER).state == "MISSING"
    # of several places between the surroundings the closest counts
    far, near = QUOTE.replace("second wheel", "secund whele"), QUOTE.replace("1907", "1908")
    verdict = judge("x" * 900 + BEFORE + far + AFTER + BEFORE + near + AFTER)
    assert verdict.state == "ALTERED" and verdict.found == near and verdict.distance == 1
    # a supported place counts, also behind an unsupported one that is nearer
    verdict = judge(near + " ... " + BEFORE + far + " Then it rained.")
    assert verdict.state == "ALTERED" and verdict.found == far
    assert matching.judge(BEFORE + changed + AFTER, QUOTE, BEFORE, AFTER, hint, cells=10).state == "UNRESOLVED"


def test_whole_texts_are_searched():
    text = "word " * 700_000 + BEFORE + QUOTE.replace("oak", "elm") + AFTER
    assert matching.judge(text, QUOTE, BEFORE, AFTER, 0).state == "ALTERED"


def test_formats():
    assert formats.iso_duration("P1DT2H30M") == timedelta(days=1, hours=2, minutes=30) and formats.iso_duration("p2w") == timedelta(weeks=2)
    for bad in ("P1Y", "1D", "P", "PT", "P-1D", ""):
        with pytest.raises(ValueError):
            formats.iso_duration(bad)
    assert formats.decode_bytes("é".encode()) == "é" and formats.decode_bytes(None) is None and formats.decode_bytes(b"") == ""
    assert formats.decode_bytes('<meta charset="iso-8859-2">ł'.encode("iso-8859-2")) == '<meta charset="iso-8859-2">ł'
    assert formats.decode_bytes("é".encode("utf-16")) == "é" and formats.decode_bytes(b"a\xff") == "a�"


def test_percents(spark):
    rows = spark.createDataFrame([(1.0,), (0.804,), (0.01,), (0.0057,), (0.00057,), (0.0,), (None,)], "r double")
    assert [r.p for r in rows.select(formats.percent(F.col("r")).alias("p")).collect()] == ["100%", "80%", "1%", "0.57%", "0.057%", "0%", None]


def test_settings(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text("[retention]\nkeep_versions = 5\n[speed]\nrate = 2.5\nspeling = 1\n")
    with pytest.warns(UserWarning, match="speling"):
        got = load_config(str(path), {"VELLICHOR_KEEP_VERSIONS": "7", "OTHER": "x"})
    assert (got.keep_versions, got.rate, got.burst) == (7, 2.5, Config().burst)
    for wrong in ({"VELLICHOR_KEEP_VERSIONS": "0"}, {"VELLICHOR_RATE": "fast"}, {"VELLICHOR_LOG_DAYS": "-1"}):
        with pytest.raises(ValueError):
            load_config(None, wrong)


def test_version_references(spark):
    versions = spark.createDataFrame([("v1", "d", 1), ("v2", "d", 2), ("v3", "e", 1)], "version_id string, document_id string, last_observed_seq bigint")
    named = lambda r: {(x.document_id, x.version_id) for x in identity.version_reference(versions, r).collect()}
    assert named("latest") == {("d", "v2"), ("e", "v3")} and named("latest~1") == {("d", "v1")} and named("v3") == {("e", "v3")} and named("v9") == set()
    for bad in ("latest~", "latest~-1", "latest~²", "latest~x", ""):
        with pytest.raises(ValueError):
            named(bad)


def test_renames_are_refused_where_they_collide(spark):
    documents = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "x"), ("5", "y"), ("6", "r")], "document_id string, url string")
    redirects = spark.createDataFrame([("a", "a2"), ("a2", "a3"), ("b", "c"), ("x", "z"), ("y", "z"), ("r", "s"), ("s", "r")], "url string, target string")
    got = {r.document_id: (r.url, r.renamed, r.refused) for r in identity.rename_urls(documents, redirects).collect()}
    assert got == {"1": ("a3", True, False), "2": ("b", False, True), "3": ("c", False, False), "4": ("x", False, True), "5": ("y", False, True), "6": ("r", False, False)}


def test_long_redirect_chains(spark):
    links = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(70)], "url string, target string")
    assert {r.target for r in observe.terminal_urls(links).collect()} == {"u70"}


def test_waits(spark):
    rows = spark.createDataFrame([(0, None), (3, None), (7, None), (0, 30.0), (0, 90.0), (0, 0.0)], "attempt int, server double")
    assert [r.w for r in rows.select(policy.retry_wait(F.col("attempt"), F.col("server")).alias("w")).collect()] == [1.0, 8.0, None, 30.0, None, 1.0]


def test_titles_are_kept_when_none_is_said(spark):
    documents = spark.createDataFrame([("a", "old", "live"), ("b", "old", "live"), ("c", "old", "live")], "document_id string, title string, status string").withColumn("last_checked_at", F.lit(None).cast("timestamp"))
    titles = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2025-01-01', 'new'), ('a', TIMESTAMP '2025-01-02', NULL), ('b', TIMESTAMP '2025-01-01', NULL) AS t(document_id, checked_at, title)")
    log = spark.sql("SELECT 'c' AS document_id, TIMESTAMP '2025-01-03' AS requested_at, 1L AS seq, 'error' AS outcome, 404 AS http_status")
    got = {r.document_id: (r.title, r.status) for r in policy.checked_metadata(documents, log, titles).collect()}
    assert got == {"a": ("new", "live"), "b": ("old", "live"), "c": ("old", "gone")}


def test_a_text_travels_once_for_many_quotes(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("anchor_id"), F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("document_id"))
    texts = spark.createDataFrame([("hot", "v", "text of the hot one"), ("d1", "w", "another")], "document_id string, version_id string, body string")
    beside = verify.beside_texts(rows, texts, "anchor_id")
    assert beside.count() == 2000 and beside.filter("body is not null").select("document_id").distinct().count() == 2
    parts = beside.filter("document_id = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_command_lists_queries(capsys):
    assert command.main(["list"]) == 0 and "cache_stats" in capsys.readouterr().out


def test_a_block_is_found_behind_many_like_it():
    from vellichor.functions import html

    head = "the same sixteen letters begin every paragraph of this page"
    body = "\n\n".join(f"{head} and this one tells of mill number {i} by the weir" for i in range(150))
    page = f"<p>{head} and this one tells of mill number 149 by the weir</p>"
    found = html.measure(page, body)
    assert found["captured_chars"] == found["prose_chars"] > 0 and found["dropped"] == {}
