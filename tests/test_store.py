"""The run store, exports, files on disk, the whole workflow, the feed."""

import csv
import glob
import json
from hashlib import md5

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from checks import inputs
from litframe import exports
from litframe import schemas as S
from litframe.operators.details import extract_details, flat_details
from litframe.operators.hits import extract_hits
from litframe.operators.merge import DETAIL_FIELDS as S_DETAIL
from litframe.operators.merge import apply_details, pick_last, ranked
from litframe.operators import fulltext
from litframe.plans import workflow
from litframe.sources import captures, files, manifest, scratch
from litframe.sources import store as store_module
from litframe.sources.store import RunStore
from litframe.streaming import key_index
from litframe.streaming import new_articles as feed

ARTICLE = "page_id long, url string, html string"


@pytest.fixture
def store(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path)))}"
    yield RunStore(spark, f"{name}.runs").create(str(tmp_path / "db"))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def search_page(*pmids):
    hits = "".join(
        f'<div class="docsum-content"><a class="docsum-title">Title {p}</a>'
        f'<span class="docsum-pmid">{p}</span></div>' for p in pmids)
    return f"<html><body>{hits}</body></html>"


def article_page(pmid, pmcid=None):
    pmc = f'<span class="identifier pmc"><a class="id-link">{pmcid}</a></span>' if pmcid else ""
    return (f'<html><body><ul id="full-view-identifiers"><strong class="current-id">{pmid}</strong>'
            f"{pmc}</ul></body></html>")


def search_captures(spark, run_id, *pages):
    rows = [(run_id, i, i, f"u?page={i}", html) for i, html in enumerate(pages, 1)]
    return spark.createDataFrame(rows, S.CAPTURES)


def rows(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).orderBy(*columns).collect()]


def test_append_read_list_drop(spark, store):
    for run in ("20240102000000", "20240101000000"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page(1, 2), None,
                                                       search_page(3))))
    assert [r.run_id for r in store.runs().collect()] == ["20240101000000", "20240102000000"]
    want = [(1, "1", None), (2, "2", None), (3, "3", None)]
    assert rows(store.publications("20240101000000"), "id", "PMID", "PMCID") == want
    assert store.publications().columns == S.PUBLICATION.names
    assert store.keys().columns == ["run_id", "PMCID", "PMID", "doctitle"]
    assert store.drop_run("20240101000000") is True
    assert store.drop_run("20240101000000") is False
    assert store.publications().count() == 3


def test_a_run_is_inserted_once(spark, store):
    hits = extract_hits(search_captures(spark, "r1", search_page(1)))
    store.append_hits(hits)
    with pytest.raises(ValueError):
        store.append_hits(hits)
    assert store.publications().count() == 1


def test_staged_copies_go_away_unless_the_write_fails(spark, tmp_path):
    paths = []
    frame = spark.range(3)
    with scratch.staged(frame, "t") as rows_:
        paths.append(rows_.inputFiles()[0].rsplit("/", 1)[0])
        assert rows_.count() == 3
    with pytest.raises(ValueError) as caught:
        with scratch.staged(frame, "t") as rows_:
            paths.append(rows_.inputFiles()[0].rsplit("/", 1)[0])
            raise ValueError("broken off")
    gone, kept = (p.removeprefix("file://") for p in paths)
    assert not glob.glob(gone) and glob.glob(kept)
    assert kept in caught.value.__notes__[0]


@pytest.mark.parametrize("name", ["x' OR '1'='1", "2024:x", "a b", ""])
def test_run_names_are_checked_where_they_are_written(spark, store, name):
    hits = extract_hits(search_captures(spark, name, search_page(1)))
    with pytest.raises(ValueError):
        store.append_hits(hits)
    assert store.drop_run(name) is False
    assert store.publications().isEmpty()


def test_names_that_others_wrote_are_listed_and_dropped(spark, store):
    store.append_hits(extract_hits(search_captures(spark, "r1", search_page(1))))
    odd = store.publications().withColumn("run_id", F.lit("2024:x'y"))
    odd.write.insertInto(store.table)
    assert [r.run_id for r in store.runs().collect()] == ["2024:x'y", "r1"]
    assert store.retain_runs(keep_last=1) == ["2024:x'y"]


def test_an_append_reads_no_stored_file(spark, store):
    store.append_hits(extract_hits(search_captures(spark, "r1", search_page(1))))
    for path in store.publications().inputFiles():
        open(path.removeprefix("file://"), "wb").close()  # no footer left to read
    store.append_hits(extract_hits(search_captures(spark, "r2", search_page(2))))
    assert rows(store.publications("r2"), "PMID") == [("2",)]


def test_replacing_a_run_leaves_the_session_alone(spark, store):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    for run in ("r1", "r2"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page(1))))
    store.replace_run(store.publications("r1"))
    assert spark.conf.get(key) == before
    assert rows(store.publications(), "run_id") == [("r1",), ("r2",)]


def test_replace_run_changes_that_run_alone_and_twice_is_once(spark, store):
    for run in ("r1", "r2"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page(1, 2))))
    pages = spark.createDataFrame([(9, None, article_page(1, "PMC1"))], ARTICLE)
    details = flat_details(extract_details(pages))
    after = None
    for _ in range(2):
        store.replace_run(apply_details(store.publications("r1"), details))
        now = rows(store.publications(), "run_id", "id", "PMID", "PMCID")
        assert after in (None, now)
        after = now
    assert after == [("r1", 1, "1", "PMC1"), ("r1", 2, "2", None), ("r2", 1, "1", None),
                     ("r2", 2, "2", None)]


def test_retain_runs(spark, store):
    for run in ("r3", "r1", "r2"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page(1))))
    kept = store_module.retain_runs(store.publications(), 2)
    assert rows(kept, "run_id") == [("r2",), ("r3",)]
    assert store_module.retain_runs(store.publications(), 0).isEmpty()
    assert store_module.without_run(store.publications(), "r1").count() == 2
    assert store.retain_runs(keep_last=1) == ["r2", "r1"]
    assert [r.run_id for r in store.runs().collect()] == ["r3"]
    assert store.retain_runs() == ["r3"] and store.publications().isEmpty()


def test_one_run_reads_one_partition(spark, store):
    for run in ("r1", "r2"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page(1))))
    plan = store.publications("r1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_scan_sql(spark, store):
    store.append_hits(extract_hits(search_captures(spark, "r1", search_page(1, 2))))
    got = store_module.scan_sql(
        spark, "select PMID from {t} where id = :id", {"id": 2}, t=store.publications())
    assert [r.PMID for r in got.collect()] == ["2"]
    with pytest.raises((AnalysisException, ParseException)):
        store_module.scan_sql(spark, "select nothing from nowhere").collect()


def test_run_names(spark):
    row = spark.range(1).select(
        store_module.run_id_of(F.to_timestamp(F.lit("2024-12-01 02:03:04"))).alias("run"),
        store_module.run_of_table(F.lit("runs20241201020304"), "runs").alias("cut"),
    ).first()
    assert row.run == row.cut == "20241201020304"


# ---- exports -------------------------------------------------------------------


def publication(spark, **values):
    cells = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
             for f in S.PUBLICATION.fields]
    return spark.range(1).coalesce(1).select(*cells)


def test_text_lines(spark, tmp_path):
    page = ('<div class="docsum-content"><a class="docsum-title">T</a>'
            '<span class="docsum-pmid">5</span></div>')
    hits = extract_hits(search_captures(spark, "r", page)).withColumn("id", F.lit(1))
    assert exports.hit_lines(hits).first().value == "T     5 None False"
    path = str(tmp_path / "lines")
    exports.write_text(hits, path)
    with pytest.raises(AnalysisException):
        exports.write_text(hits, path)
    exports.write_text(hits, path, override=True)
    assert spark.read.text(path).count() == 1


def test_text_lines_follow_the_order_of_rows(spark, tmp_path, sf_dir):
    from litframe.operators.ordering import with_run_order

    numbered = with_run_order(inputs.hits(spark, sf_dir))
    path = str(tmp_path / "lines")
    exports.write_text(numbered, path)
    lines = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        lines += open(part, encoding="utf-8").read().splitlines()
    want = exports.hit_lines(numbered.orderBy("run_id", "id")).collect()
    assert lines == [r.value for r in want]


def test_report(spark, tmp_path):
    row = publication(spark, id=1, doctitle='A "q"', abstract="x\ny", reviewmark=True, PMCID="")
    frame = exports.report(row)
    assert frame.columns == list(S.REPORT_HEADINGS.values())
    assert frame.first()["是否是review"] == 1
    path = str(tmp_path / "report")
    exports.write_report(row, path)
    (part,) = glob.glob(f"{path}/part-*.csv")
    heading, line = csv.reader(open(part, encoding="utf-8", newline=""))
    assert heading == frame.columns and line[1] == 'A "q"' and line[9] == "x\ny"


def test_records(spark):
    row = publication(spark, id=1, doctitle="T", PMID="5", reviewmark=False)
    record = json.loads(exports.records(row).first().json)
    assert list(record) == list(S.RECORD_KEYS)
    assert record["pmid"] == "5" and record["savepath"] is None and record["reviewmark"] is False


# ---- files ---------------------------------------------------------------------


def test_saved_files(spark, tmp_path):
    (tmp_path / "A  b.pdf").write_bytes(b"123")
    (tmp_path / "c.txt").write_text("no")
    got = files.saved_files(spark, str(tmp_path)).collect()
    assert [(r.path, r.length) for r in got] == [(f"file:{tmp_path}/A  b.pdf", 3)]
    from litframe.operators.fulltext import file_paths

    assert file_paths(files.saved_files(spark, str(tmp_path))).first()[0] == f"{tmp_path}/A  b.pdf"


def test_html_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>\nx</p>\n", encoding="utf-8")
    row = captures.read_html_dir(spark, str(tmp_path)).first()
    assert row.html == "<p>\nx</p>\n" and row.path.endswith("/p.html")
    (tmp_path / "s.html").write_text(search_page(7), encoding="utf-8")
    saved = captures.with_page_no(captures.with_run(captures.read_html_dir(spark, str(tmp_path)), "r"))
    assert rows(extract_hits(saved), "run_id", "PMID") == [("r", "7")]
    (tmp_path / "a.html").write_text(article_page(8), encoding="utf-8")
    details = flat_details(extract_details(captures.read_html_dir(spark, str(tmp_path))))
    assert "8" in [r.PMID for r in details.collect()]


def test_stored_fulltexts(spark, tmp_path):
    fetched = spark.createDataFrame(
        [("P1", "/d/a.pdf", bytearray(b"abc")), ("P2", "/d/b.pdf", None)],
        "PMCID string, savepath string, content binary")
    path = str(tmp_path / "store")
    files.store_fulltext(fetched, path)
    inventory = files.stored_files(spark, path)
    assert [tuple(r) for r in inventory.collect()] == [("/d/a.pdf", 3)]
    plan = inventory._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<savepath:string,length:bigint>" in plan


def test_read_captures(spark, tmp_path):
    path = str(tmp_path / "captures")
    frame = spark.createDataFrame(
        [(1, "u?term=x&page=12", "<p>"), (2, "u", "<p>"), (3, "u?page=1", None)], ARTICLE)
    frame.write.parquet(path)
    got = captures.read_captures(spark, path)
    assert rows(got, "page_id", "page_no") == [(1, 12), (2, None)]
    assert captures.spread_captures(got) is got
    assert captures.spread_captures(got, 7).rdd.getNumPartitions() == 7


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("__", "."): v for k, v in values.items()})

    for master in ("spark://x:1", "local[2]"):
        with pytest.raises(RuntimeError):
            scratch.scratch_dir(Session(spark__master=master), "a")
    named = scratch.scratch_dir(
        Session(spark__master="spark://x:1", spark__checkpoint__dir="hdfs://h/c/"), "a")
    assert named.startswith("hdfs://h/c/litframe-a-")
    shared = scratch.scratch_dir(Session(spark__sql__warehouse__dir="hdfs://h/w"), "a")
    assert shared.startswith("hdfs://h/w/_scratch/litframe-a-")


# ---- the whole of a run --------------------------------------------------------


def test_workflow(spark, store, tmp_path):
    run = "20241201000000"
    pages = [(1, "u?page=1", search_page(1, 2, 3)), (2, "u?page=2", None),
             (3, "u?page=3", search_page(4, 5))]
    workflow.search_run(store, spark.createDataFrame(pages, ARTICLE), run)
    articles = [(i, None, article_page(i, f"PMC{i}" if i != 2 else None)) for i in (1, 2, 3, 4)]
    workflow.enrich_run(store, spark.createDataFrame(articles, ARTICLE), run)
    assert rows(store.publications(run), "id", "PMCID") == [
        (1, "PMC1"), (2, ""), (3, "PMC3"), (4, "PMC4"), (5, None)]

    folder = tmp_path / "pdf"
    folder.mkdir()
    (folder / "Title 1.pdf").write_bytes(b"x")
    found = files.saved_files(spark, str(folder))
    targets = workflow.plan_fulltexts(store, found, run, directory=str(folder))
    assert rows(targets, "PMCID") == [("PMC3",), ("PMC4",)]
    fetched = spark.createDataFrame(
        [("PMC3", bytearray(b"y")), ("PMC4", None)], "PMCID string, content binary")
    outcomes = workflow.record_fetches(store, targets, fetched, run)
    assert rows(outcomes, "PMCID", "status") == [("PMC3", "saved"), ("PMC4", "failed")]
    assert rows(store.publications(run), "id", "savepath") == [
        (1, f"{folder}/Title 1.pdf"), (2, None), (3, f"{folder}/Title 3.pdf"), (4, None), (5, None)]


def test_steps_count_what_they_see(spark, store, tmp_path):
    run, other = "20241201000000", "20241202000000"
    pages = [(1, "u?page=1", search_page(1, 2, 3)), (2, "u?page=2", None), (3, "u?page=3", search_page(4, 5))]
    spark.createDataFrame(pages, ARTICLE).write.parquet(f"{tmp_path}/search")
    seen = captures.read_captures(spark, f"{tmp_path}/search", failed=True)
    workflow.search_run(store, seen, run)
    workflow.search_run(store, seen.where("page_id = 2"), other)
    articles = [(1, None, article_page(1, "PMC1")), (2, None, None), (3, None, None), (4, None, "<p></p>")]
    for _ in range(2):
        workflow.enrich_run(store, spark.createDataFrame(articles, ARTICLE), run)
    assert rows(store.run_counts(), "run_id", *S.RUN_COUNTS) == [(run, 3, 1, 5, 8, 4), (other, 1, 1, 0, 0, 0)]
    store.drop_run(run)
    assert rows(store.run_counts(), "run_id") == [(other,)]


def test_pages_are_read_once_while_they_are_counted(spark, store, tmp_path):
    spark.createDataFrame([(1, "u?page=1", search_page(1, 2))], ARTICLE).write.parquet(f"{tmp_path}/in")
    seen = captures.read_captures(spark, f"{tmp_path}/in", failed=True)
    counted, _ = workflow._counted(seen, "pages", "pages_failed")
    hits = extract_hits(captures.usable(captures.with_run(counted, "r")))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("CollectMetrics") == 1 and "Exchange" not in plan


# ---- paths beside the records ----------------------------------------------------


def publications(spark, keys):
    return store_module.as_publications(spark.createDataFrame(keys, "run_id string, id long, PMCID string"))


def files_of(frame):
    return sorted(frame.inputFiles())


def test_recorded_paths_leave_the_records_alone(spark, store):
    pubs = publications(spark, [("a", 1, "PMC1"), ("a", 2, "PMC1"), ("a", 3, ""), ("a", 4, None), ("b", 1, "PMC1"), ("b", 2, "PMC2")])
    store.replace_run(pubs)
    before = files_of(spark.table(store.table))
    saved = spark.createDataFrame(
        [("a", 1, "PMC1", "old"), ("a", 2, "PMC1", "new"), ("a", 3, "", "x"), ("a", 4, None, "y"), ("b", 2, "PMC2", None)],
        "run_id string, id long, PMCID string, savepath string",
    )
    store.record_paths(saved)
    store.record_paths(saved.limit(0))
    want = [("a", 1, "new"), ("a", 2, "new"), ("a", 3, None), ("a", 4, None), ("b", 1, None), ("b", 2, None)]
    assert rows(store.publications(), "run_id", "id", "savepath") == want
    assert files_of(spark.table(store.table)) == before
    assert set(spark.table(store.paths).columns) == {"PMCID", "savepath", "recorded", "run_id"}
    # a later call wins; a run without paths is read without a join
    store.record_paths(spark.createDataFrame([("a", 1, "PMC1", "last")], saved.schema))
    assert rows(store.publications("a").where("id < 3"), "savepath") == [("last",), ("last",)]
    assert "Join" not in store.publications("b")._jdf.queryExecution().optimizedPlan().toString()
    assert "savepath" not in store.keys("a").columns
    assert "Join" not in store.keys("a")._jdf.queryExecution().optimizedPlan().toString()


def test_recorded_paths_are_folded_and_forgotten(spark, store):
    store.replace_run(publications(spark, [("a", 1, "PMC1"), ("b", 1, "PMC1")]))
    one = spark.createDataFrame(
        [("a", 1, "PMC1", "p"), ("b", 1, "PMC1", "q")], "run_id string, id long, PMCID string, savepath string")
    store.record_paths(one)
    store.fold_paths("a")
    assert rows(spark.table(store.table), "run_id", "savepath") == [("a", "p"), ("b", None)]
    assert rows(store.publications(), "run_id", "savepath") == [("a", "p"), ("b", "q")]
    assert rows(spark.table(store.paths), "run_id") == [("b",)]
    # new contents of a run mean what they say
    store.replace_run(publications(spark, [("b", 1, "PMC1")]))
    assert rows(store.publications("b"), "savepath") == [(None,)]
    store.record_paths(one.where("run_id = 'b'"))
    assert store.drop_run("b")
    store.replace_run(publications(spark, [("b", 1, "PMC1")]))
    assert rows(store.publications("b"), "savepath") == [(None,)]
    with pytest.raises(ValueError):
        store.record_paths(spark.createDataFrame([("a/b", 1, "PMC1", "p")], one.schema))


# ---- records in buckets ----------------------------------------------------------

HOT_DETAIL = "page_id long, PMID string, PMCID string, doi string, abstract string, keyword string, affiliations string"


@pytest.fixture
def bucketed(spark, tmp_path):
    name = f"bk_{abs(hash(str(tmp_path)))}"
    yield RunStore(spark, f"{name}.runs", buckets=6, rows_per_slot=40).create(str(tmp_path / "buckets"))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def hot_records(spark, n=900):
    """A third of the records name one article, a third none, in two runs."""
    key = "case when id % 3 = 0 then '7' when id % 6 = 1 then '' when id % 3 = 1 then null else cast(id as string) end"
    found = spark.range(n).selectExpr("if(id % 2 = 0, 'a', 'b') as run_id", "id", f"{key} as PMID", "concat('t', id) as doctitle")
    return store_module.as_publications(found)


def hot_details(spark):
    last = [(i, str(i), f"PMC{i}", "d", "a", "k", "f") for i in range(2, 900, 6)]
    return spark.createDataFrame([(3, "7", "PMCold", "", "", "", ""), (9000, "7", "PMC7", "d7", "", "", ""),
                                  (1, None, "none", "", "", "", ""), (1, "", "blank", "", "", "", ""), *last], HOT_DETAIL)


def test_details_reach_records_in_buckets(spark, bucketed, store):
    for one in (bucketed, store):
        one.replace_run(hot_records(spark))
        one.record_paths(spark.createDataFrame([("a", 1, "PMC7", "/p")], "run_id string, id long, PMCID string, savepath string"))
    bucketed.apply_details(hot_details(spark), "a")
    assert bucketed.publications("b").where("PMCID is not null").isEmpty()
    assert bucketed.publications("a").where("savepath = '/p'").count() == 150
    bucketed.apply_details(hot_details(spark))
    bucketed.apply_details(hot_details(spark).limit(0))
    store.replace_run(apply_details(store.publications(), hot_details(spark)))
    names = [c for c in S.PUBLICATION.names if c != "savepath"]
    assert rows(bucketed.publications(), *names) == rows(store.publications(), *names)
    assert rows(bucketed.publications().where("PMID = '7'").distinct(), "PMCID")[0] == ("PMC7",)
    assert RunStore(spark, bucketed.table).buckets == 6 and store.buckets == 0
    assert not [t.name for t in spark.catalog.listTables(bucketed.table.split(".")[0]) if t.name.startswith("copy_")]


def test_records_in_buckets_are_not_exchanged(spark, bucketed, settings):
    settings(autoBroadcastJoinThreshold="-1")
    bucketed.replace_run(hot_records(spark))
    latest = hot_details(spark).where("page_id > 9").select("PMID", *S_DETAIL)
    over = bucketed.overlaid(latest)
    over.collect()
    plan = over._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0] if "Initial Plan" in plan else plan
    left = final.split("SortMergeJoin", 1)[1].splitlines()
    # what is read for the left side of the join, up to its scan
    scan = next(i for i, line in enumerate(left) if "FileScan" in line)
    assert "Bucketed: true" in left[scan] and not [line for line in left[:scan] if "Exchange" in line]
    # one article on a third of the records, and none on another third, lie in many buckets
    per = spark.table(bucketed.table).groupBy("_key", "_slot").count().agg(F.max("count")).first()[0]
    assert per <= 80
    hot = spark.table(bucketed.table).where("PMID = '7'").select("_slot").distinct().count()
    assert hot == 8


def test_a_late_pick_sorts_no_abstracts(spark, tmp_path):
    columns = ("PMCID", "abstract")
    details = hot_details(spark).unionByName(spark.createDataFrame(
        [(None, "7", "PMCnull", "", "", "", ""), (9000, "7", "PMCtie", "", "", "", ""), (None, "5001", "x", "", "", "", ""),
         (-4, "5002", "neg", "", "", "", ""), (None, "5002", "null", "", "", "", ""),
         (2**63 - 1, "5003", "top", "", "", "", ""), (2**63 - 2, "5003", "below", "", "", "", "")], HOT_DETAIL))
    ranked(details, "page_id", *columns).write.parquet(f"{tmp_path}/d")
    picked = pick_last(spark.read.parquet(f"{tmp_path}/d"), "PMID", *columns)
    got = {r.PMID: r.PMCID for r in picked.collect()}
    assert len(got) == picked.count() == details.where("PMID is not null").select("PMID").distinct().count()
    assert got["7"] in ("PMC7", "PMCtie") and (got["5001"], got["5002"], got["5003"]) == ("x", "neg", "top")
    again = ranked(details.orderBy(F.desc("PMCID")), "page_id", *columns)
    again.write.parquet(f"{tmp_path}/again")
    assert {r.PMID: r.PMCID for r in pick_last(spark.read.parquet(f"{tmp_path}/again"), "PMID", *columns).collect()} == got
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


# ---- the feed ------------------------------------------------------------------


def test_feed(spark, tmp_path):
    def arrive(n, *articles):
        pages = [(p, None, article_page(q) if q else "<p></p>") for p, q in articles]
        frame = spark.createDataFrame(pages, ARTICLE)
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    known = spark.createDataFrame([("1",)], "PMID string")

    def run(files_per_trigger=1000):
        stream = feed.read_capture_stream(spark, f"{tmp_path}/in/*", files_per_trigger)
        query = feed.start_feed(stream, known, f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"), "PMID", "page_id")

    arrive(1, (1, 1), (2, 2), (3, 2))
    assert run() == [("2", 3)]
    arrive(2, (4, 2), (5, 3))
    arrive(3, (6, 3), (7, 4))
    arrive(4, (8, None))
    got = run(files_per_trigger=1)
    assert [p for p, _ in got] == ["2", "3", "4"] and got[0] == ("2", 3)
    assert run() == got
    # a second feed into the same folder adds to it and repeats nothing
    stream = feed.read_capture_stream(spark, f"{tmp_path}/in/*")
    arrive(5, (9, 4), (10, 5))
    feed.start_feed(stream, known, f"{tmp_path}/out", f"{tmp_path}/other").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "PMID", "page_id") == [*got, ("5", 10)]


def test_index_reads_a_bounded_number_of_files(spark, tmp_path):
    index = key_index.KeyIndex(spark, f"{tmp_path}/keys", prefixes=4)
    assert not index.exists() and index.read([0, 1, 2, 3]) is None
    schema = "PMID string, feed string, batch long"
    for batch in range(2 * key_index.MOST_FILES + 3):
        index.add(spark.createDataFrame([(str(batch * 10 + i), "f", batch) for i in range(10)] + [(None, "f", batch)], schema))
        assert all(len(index._files(p)) <= key_index.MOST_FILES for p in range(4))
    keys = spark.createDataFrame([("7",), ("nothing",), (None,)], "PMID string")
    touched = index.touched(keys)
    found = index.read(touched)
    assert len(found.inputFiles()) <= len(touched) * key_index.MOST_FILES
    assert rows(found.where("PMID = '7'"), "PMID", "batch") == [("7", 0)]
    every = rows(index.read([0, 1, 2, 3]), "PMID")
    assert len(every) == 10 * (2 * key_index.MOST_FILES + 3) == len(set(every))
    # rows that a broken write left twice are made one, and nothing else changes
    index._append(index.read([0, 1, 2, 3]))
    assert set(rows(index.read([0, 1, 2, 3]), "PMID")) == set(every)


def test_a_feed_without_index_gets_one(spark, tmp_path):
    known = spark.createDataFrame([], "PMID string")
    old = spark.createDataFrame([("2", "x", 0)], "PMID string, feed string, batch long")
    old.write.partitionBy("feed", "batch").parquet(f"{tmp_path}/out")
    pages = spark.createDataFrame([(1, None, article_page(2)), (2, None, article_page(3))], ARTICLE)
    pages.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = feed.read_capture_stream(spark, f"{tmp_path}/in/*")
    feed.start_feed(stream, known, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert rows(spark.read.schema("PMID string").parquet(f"{tmp_path}/out"), "PMID") == [("2",), ("3",)]
    index = key_index.KeyIndex(spark, f"{tmp_path}/out_keys")
    assert rows(index.read(range(key_index.PREFIXES)), "PMID") == [("2",), ("3",)]


def test_state_feed(spark, tmp_path):
    def arrive(n, *articles):
        pages = [(p, None, article_page(q) if q else "<p></p>") for p, q in articles]
        spark.createDataFrame(pages, ARTICLE).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    known = spark.createDataFrame([("1",)], "PMID string")

    def fed():
        return rows(spark.read.parquet(f"{tmp_path}/out"), "PMID")

    def start(**how):
        stream = feed.read_capture_stream(spark, f"{tmp_path}/in/*", 1)
        return feed.start_state_feed(stream, known, f"{tmp_path}/out", f"{tmp_path}/check", **how)

    arrive(1, (1, 1), (2, 2), (3, 2), (4, None))
    start().awaitTermination()
    assert fed() == [("2",)]
    # late copies, and a feed that goes on after a restart
    arrive(2, (5, 2), (6, 3))
    arrive(3, (7, 3), (8, 4))
    query = start(every="1 second")
    query.processAllAvailable()
    arrive(4, (9, 4), (10, 5), (11, 1))
    query.processAllAvailable()
    query.stop()
    assert fed() == [("2",), ("3",), ("4",), ("5",)]
    start().awaitTermination()
    assert len(fed()) == 4


# ---- very many files ---------------------------------------------------------------


def test_manifest_takes_in_new_files(spark, tmp_path):
    def write(*names):
        inputs.write_library(spark.createDataFrame([(n,) for n in names], "name string"), f"{tmp_path}/lib", 1)

    kept = manifest.FileManifest(spark, f"{tmp_path}/lib", f"{tmp_path}/manifest", 1)
    kept.refresh()
    assert kept.files().isEmpty()
    titles = [f"Title {i}" for i in range(40)] + ["Ünï=1 %2F#"]
    write(*[f"{t}.pdf" for t in titles], "Title 1.txt")
    (tmp_path / "lib" / "elsewhere").mkdir()
    (tmp_path / "lib" / "elsewhere" / "x.pdf").write_bytes(b"x")
    kept.refresh(tasks=3)
    first = files_of(kept.files())
    assert kept.files().count() == 41 and kept.files().where("length = 11").count() == 10
    kept.refresh()
    write("Title 40.pdf")
    kept.refresh()
    assert kept.files().count() == 42 and set(first) <= set(files_of(kept.files()))

    pubs = spark.createDataFrame([("a", i, f"PMC{i}", "1", t) for i, t in enumerate([*titles, "Title 50"])],
                                 "run_id string, id long, PMCID string, PMID string, doctitle string")
    paths = fulltext.fulltext_paths(pubs, f"{tmp_path}/lib", digits=1)
    assert fulltext.already_saved(paths, kept.files()).count() == 41
    assert rows(fulltext.fulltext_targets(paths, kept.files()), "doctitle") == [("Title 50",)]


def test_a_manifest_is_read_without_listing(spark, tmp_path):
    inputs.write_library(spark.createDataFrame([("a.pdf",)], "name string"), f"{tmp_path}/lib", 2)
    kept = manifest.FileManifest(spark, f"file:{tmp_path}/lib", f"{tmp_path}/manifest")
    kept.refresh()
    plan = kept.files()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and str(tmp_path / "lib") not in plan
    assert rows(fulltext.file_paths(kept.files()), "savepath") == [(f"{tmp_path}/lib/{md5(b'a.pdf').hexdigest()[:2]}/a.pdf",)]
    # folders are dealt out over tasks
    assert kept.listed(16).rdd.getNumPartitions() == 16


def test_pages_are_parsed_once_for_several_runs(spark, store, monkeypatch):
    for run in ("a", "b", "c"):
        store.append_hits(extract_hits(search_captures(spark, run, search_page("1", "2"))))
    parsed = []
    monkeypatch.setattr(workflow, "extract_details", lambda p: parsed.append(p) or extract_details(p))
    pages = spark.createDataFrame([(1, "u", article_page("1", "PMC1")), (2, "u", None)], ARTICLE)
    workflow.enrich_runs(store, pages, ["a", "b"])
    assert len(parsed) == 1
    assert rows(store.publications().where("PMCID is not null"), "run_id", "PMID", "PMCID") == [
        ("a", "1", "PMC1"), ("b", "1", "PMC1")]
    assert rows(store.run_counts(), "run_id", "detail_pages", "detail_pages_failed") == [("a", 2, 1), ("b", 2, 1)]


def test_a_file_for_each_row_is_written_over_when_done_again(spark, tmp_path):
    texts = spark.createDataFrame([("één\nzwei",), (None,), ("x",)], "value string").repartition(2)
    for _ in range(2):
        inputs.write_files(texts, f"file:{tmp_path}/files", ".txt")
    assert files.saved_files(spark, f"{tmp_path}/files", "*.txt").count() == 3
    assert rows(captures.read_html_dir(spark, f"{tmp_path}/files"), "html") == [("\n",), ("x\n",), ("één\nzwei\n",)]


def test_pages_are_dealt_to_tasks_by_cores(spark, sf_dir):
    from checks import inputs

    cores = spark.sparkContext.defaultParallelism
    assert captures.parse_tasks(spark, 4 * cores + 1) == 4 * cores + 1
    pages = inputs.spread(spark.range(100).toDF("page_id"))
    assert pages.rdd.getNumPartitions() == max(inputs.SPREAD, 4 * cores)
