"""Merges by key: NULL against empty, duplicates, hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.operators import fulltext, merge

HIT_COLUMNS = "run_id string, page_no int, page_id long, position int, id long, PMID string"
DETAIL = (
    "page_id long, PMID string, PMCID string, doi string, abstract string, "
    "keyword string, affiliations string"
)


def hits(spark, rows):
    frame = spark.createDataFrame(rows, HIT_COLUMNS)
    others = {c: F.lit("x") for c in ("doctitle", "full_author", "short_author", "full_journal",
                                      "short_journal", "freemark")}
    return frame.withColumns(others).withColumn("reviewmark", F.lit(True))


def detail(page, pmid, tag):
    return (page, pmid, f"PMC{tag}", f"d{tag}", f"a{tag}", f"k{tag}", "")


def test_merge_details(spark):
    found = hits(spark, [("r", 1, 1, 1, 1, "7"), ("r", 1, 1, 2, 2, "7"), ("r", 1, 1, 3, 3, "8"),
                         ("r", 1, 1, 4, 4, ""), ("s", 1, 2, 1, 1, "9"), ("s", 1, 2, 2, 2, None)])
    details = spark.createDataFrame(
        [detail(1, "7", "old"), detail(5, "7", "new"), detail(2, None, "none"),
         detail(3, "", "blank"), (4, "9", "", "", "", "", "")], DETAIL)
    rows = {(r.run_id, r.id): r for r in merge.merge_details(found, details).collect()}
    assert len(rows) == 6
    assert rows["r", 1].doi == rows["r", 2].doi == "dnew"
    for key in (("r", 3), ("r", 4), ("s", 2)):
        assert [rows[key][c] for c in merge.DETAIL_FIELDS] == [None] * 5
    assert [rows["s", 1][c] for c in merge.DETAIL_FIELDS] == [""] * 5
    assert rows["r", 1].savepath is None
    assert merge.merge_details(found, details).columns == S.PUBLICATION.names


def test_apply_details_keeps_what_no_detail_touches(spark):
    found = hits(spark, [("r", 1, 1, 1, 1, "7"), ("r", 1, 1, 2, 2, "8")])
    first = merge.merge_details(found, spark.createDataFrame([detail(1, "7", "a")], DETAIL))
    later = spark.createDataFrame([(2, "8", "", "", "", "", "")], DETAIL)
    rows = {r.PMID: r for r in merge.apply_details(first, later).collect()}
    assert rows["7"].doi == "da" and rows["8"].doi == ""


def publications(spark, rows):
    """rows: run_id, id, PMCID, savepath"""
    frame = spark.createDataFrame(rows, "run_id string, id long, PMCID string, savepath string")
    rest = {f.name: F.lit(None).cast(f.dataType) for f in S.PUBLICATION.fields
            if f.name not in frame.columns}
    return frame.withColumns(rest).select(*S.PUBLICATION.names)


def test_mark_saved(spark):
    pubs = publications(spark, [("r", 1, "P1", None), ("r", 2, "P1", "old"), ("r", 3, "P2", "old"),
                                ("r", 4, "", None), ("r", 5, None, None), ("s", 1, "P1", None)])
    saved = spark.createDataFrame(
        [("r", 2, "P1", "b"), ("r", 1, "P1", "a"), ("r", 4, "", "c")],
        "run_id string, id long, PMCID string, savepath string")
    got = {(r.run_id, r.id): r.savepath for r in merge.mark_saved(pubs, saved).collect()}
    assert got == {("r", 1): "b", ("r", 2): "b", ("r", 3): "old", ("r", 4): None, ("r", 5): None,
                   ("s", 1): None}


def test_saved_and_targets_part_the_eligible(spark):
    rows = [("r", i, f"P{i % 7}" if i % 3 else ("" if i % 2 else None), None) for i in range(60)]
    pubs = publications(spark, rows).withColumn(
        "doctitle", F.concat(F.lit('A <b>/c\\d|e:f"g*h?'), (F.col("id") % 5).cast("string")))
    paths = fulltext.fulltext_paths(pubs, "/d")
    assert paths.first().savepath.startswith("/d/A  b  c d e f g h ")
    files = spark.createDataFrame(
        [("file:/d/A  b  c d e f g h 1.pdf", 1), ("file:/d/other.pdf", 2)],
        "path string, length long")
    done = fulltext.already_saved(paths, files)
    todo = fulltext.fulltext_targets(paths, files)
    assert done.count() > 0 and todo.count() > 0
    both = done.unionByName(todo)
    assert both.count() == paths.count() == fulltext.fulltext_eligible(pubs).count()
    assert both.exceptAll(paths.select(*both.columns)).isEmpty()
    top = fulltext.fulltext_targets(paths, files, limit=4)
    assert [r.id for r in top.collect()] == sorted(r.id for r in todo.collect())[:4]


def test_path_collisions(spark):
    rows = [("r", 1, "/d/a.pdf"), ("r", 2, "/d/a.pdf"), ("s", 3, "/d/a.pdf"), ("r", 4, "/d/b.pdf")]
    paths = spark.createDataFrame(rows, "run_id string, id long, savepath string")
    got = [tuple(r) for r in fulltext.path_collisions(paths).collect()]
    assert got == [("r", "/d/a.pdf", 2, 1)]


def test_fetch_outcomes(spark):
    targets = spark.createDataFrame(
        [("r", i, f"P{i}", "1", "t", "/d/t.pdf", "u") for i in range(4)],
        "run_id string, id long, PMCID string, PMID string, doctitle string, savepath string, "
        "url string")
    fetched = spark.createDataFrame(
        [("P0", bytearray(b"x")), ("P1", None), ("P2", None), ("P2", bytearray(b""))],
        "PMCID string, content binary")
    got = {r.PMCID: r.status for r in fulltext.fetch_outcomes(targets, fetched).collect()}
    assert got == {"P0": "saved", "P1": "failed", "P2": "saved", "P3": "failed"}


def test_new_articles(spark):
    details = spark.createDataFrame([detail(1, "7", "a"), detail(2, "8", "b"),
                                     detail(3, None, "c")], DETAIL)
    known = spark.createDataFrame([("7",), ("",), (None,)], "PMID string")
    assert [r.PMID for r in merge.new_articles(details, known).collect()] == ["8"]


# ---- hot keys ------------------------------------------------------------------


@pytest.fixture
def small_partitions(settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__coalescePartitions__enabled="false",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="10KB",
    )


def final_plan(frame):
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString()


def hot_hits(spark, n=60000):
    """A third of the hits on one article, a third without an identifier."""
    kind = "case when id % 3 = 0 then '7' when id % 3 = 1 then '' else cast(id as string) end"
    frame = spark.range(0, n, 1, 8).selectExpr(
        "'r' as run_id", "cast(id div 50 as int) as page_no", "id div 50 as page_id",
        "cast(id % 50 + 1 as int) as position", "id", f"{kind} as PMID")
    names = ("doctitle", "full_author", "short_author", "full_journal", "short_journal", "freemark")
    return frame.withColumns(
        {c: F.concat(F.lit(c), F.col("id").cast("string")) for c in names}
    ).withColumn("reviewmark", F.lit(False))


def hot_details(spark, n=60000):
    return spark.range(0, n, 1, 8).selectExpr(
        "id as page_id", "case when id % 3 = 0 then '7' else cast(id as string) end as PMID",
        "concat('PMC', id) as PMCID", "'d' as doi", "repeat('z', 50) as abstract",
        "'k' as keyword", "'f' as affiliations")


def test_hot_article_is_split(spark, small_partitions):
    merged = merge.merge_details(hot_hits(spark), hot_details(spark))
    totals = merged.agg(
        F.count(F.lit(1)), F.sum("id"), F.count("PMCID"),
        F.count_if((F.col("PMID") == "7") & (F.col("PMCID") == "PMC59997")),
        F.count_distinct("doctitle"))
    rows, plan = final_plan(totals)
    assert tuple(rows[0]) == (60000, 60000 * 59999 // 2, 40000, 20000, 60000)
    assert "skew=true" in plan


def test_rows_without_key_are_spread(spark, small_partitions):
    key = merge.spread_key(F.col("PMID"), "page_id", "position")
    per_task = hot_hits(spark).where("PMID = ''").repartition(8, key).groupBy(
        F.spark_partition_id()).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 5000


def test_hot_path_is_split(spark, small_partitions):
    pubs = hot_hits(spark).withColumn("doctitle", F.when(F.col("id") % 3 == 0, "same")
                                      .otherwise(F.col("doctitle")))
    pubs = pubs.withColumns({"PMCID": F.concat(F.lit("P"), F.col("id").cast("string"))})
    paths = fulltext.fulltext_paths(pubs, "/d")
    files = spark.range(0, 30000, 1, 8).selectExpr(
        "concat('file:/d/', if(id % 2 = 0, 'same', cast(id as string)), '.pdf') as path",
        "id as length")
    totals = F.count(F.lit(1)), F.sum(F.hash("id", "url", "PMCID"))  # keeps rows wide
    rows, plan = final_plan(fulltext.fulltext_targets(paths, files).agg(*totals))
    assert rows[0][0] == 40000 and "skew=true" in plan
    rows, plan = final_plan(fulltext.already_saved(paths, files).agg(*totals))
    assert rows[0][0] == 20000 and "skew=true" in plan


def test_hot_saved_article_is_split(spark, small_partitions):
    rnd = random.Random(0)
    pubs = hot_hits(spark).withColumn("PMCID", F.col("PMID"))
    rest = {c: F.lit(None).cast("string") for c in S.PUBLICATION.names if c not in pubs.columns}
    pubs = pubs.withColumns(rest)
    saved = spark.createDataFrame(
        [("r", rnd.randint(1, 99), "7", "/a"), ("r", 100, "7", "/b")],
        "run_id string, id long, PMCID string, savepath string")
    marked = merge.mark_saved(pubs, saved)
    rows, plan = final_plan(marked.agg(F.count(F.lit(1)), F.count("savepath"), F.max("savepath"),
                                       F.min("savepath"), F.sum(F.hash("doctitle", "full_author"))))
    assert tuple(rows[0])[:4] == (60000, 20000, "/b", "/b") and "skew=true" in plan


def test_details_are_parsed_once(spark):
    """No filter on a parsed field reaches the scan: each page is cleaned once."""
    from litframe.operators.details import extract_details, flat_details

    pages = spark.createDataFrame([(1, "<p></p>")], "page_id long, html string")
    merged = merge.merge_details(hot_hits(spark, 10), flat_details(extract_details(pages)))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(html") == 1


OUTCOME = "run_id string, id long, PMCID string, PMID string, doctitle string, savepath string, url string"


def test_an_outcome_belongs_to_its_own_request(spark):
    targets = spark.createDataFrame(
        [("r1", 1, "P1", "1", "a", "/d/a.pdf", "u"), ("r1", 2, "P1", "1", "b", "/d/b.pdf", "u"),
         ("r2", 1, "P1", "1", "a", "/d/a.pdf", "u")], OUTCOME)
    by_path = spark.createDataFrame(
        [("r1", "P1", "/d/a.pdf", bytearray(b"x")), ("r1", "P1", "/d/b.pdf", None), ("r2", "P1", "/d/a.pdf", None)],
        "run_id string, PMCID string, savepath string, content binary")
    by_id = spark.createDataFrame(
        [("r1", 1, bytearray(b"x")), ("r1", 2, None)], "run_id string, id long, content binary")
    for fetched in (by_path, by_id):
        got = {(r.run_id, r.id): r.status for r in fulltext.fetch_outcomes(targets, fetched).collect()}
        assert got == {("r1", 1): "saved", ("r1", 2): "failed", ("r2", 1): "failed"}
    plain = spark.createDataFrame([("P1", bytearray(b"x"))], "PMCID string, content binary")
    assert {r.status for r in fulltext.fetch_outcomes(targets, plain).collect()} == {"saved"}


def test_limits_hold_for_each_run(spark):
    rows = [(run, i * 7, f"P{i}", "1", f"{run}{i}", f"/d/{run}{i}.pdf", "u") for run in "abc" for i in range(9)]
    paths = spark.createDataFrame(rows, OUTCOME)
    files = spark.createDataFrame([("/d/a0.pdf", 1)], "path string, length long")
    got = fulltext.fulltext_targets(paths, files, limit=2)
    assert sorted((r.run_id, r.id) for r in got.collect()) == [("a", 7), ("a", 14), ("b", 0), ("b", 7), ("c", 0), ("c", 7)]
    limits = spark.createDataFrame([("a", 1), ("b", None)], "run_id string, download_limit int")
    got = fulltext.fulltext_targets(paths, files, limit=limits).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"a": 1, "b": 9, "c": 9}


def test_equal_captures_are_told_apart_by_their_values(spark):
    details = [detail(1, "7", "x"), detail(1, "7", "y"), (None, "7", None, None, None, None, None)]
    found = hits(spark, [("r", 1, 1, 1, 1, "7")])
    got = {
        merge.merge_details(found, spark.createDataFrame(rows, DETAIL)).first().doi
        for rows in (details, details[::-1], [details[2], *details[:2]])
    }
    assert len(got) == 1 and got <= {"dx", "dy"}
