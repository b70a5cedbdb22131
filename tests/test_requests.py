"""Request planning, row by row."""

from litframe.plans import requests as R

SCHEMA = "request_id long, keyword string, year int, page_limit int, result_num int"
ROWS = [
    (1, "headache", 5, 5, 1234),
    (2, "headache AND toothache", None, 10, 120),
    (3, "a*b~c é+/", 1, 10, 50),
    (4, "rare", None, 10, 0),
    (5, "   ", None, 10, 0),
    (6, "12345", None, 10, 9),
    (7, "x", 7, 10, 9),
    (8, "", None, None, 9),
    (9, None, 10, 2, 51),
    (10, "　\xa0", None, 10, 9),
    (11, "１２³½", None, 10, 9),
    (12, "12\n", None, 10, 9),
    (13, "many", None, 10, None),
]


def requests(spark):
    return R.valid_requests(spark.createDataFrame(ROWS, SCHEMA))


def test_validity_and_defaults(spark):
    rows = {r.request_id: r for r in requests(spark).collect()}
    reasons = {i: r.reason for i, r in rows.items() if not r.valid}
    assert reasons == {5: "whitespace", 6: "numeric", 7: "year", 10: "whitespace", 11: "numeric"}
    assert rows[8].page_limit == 10 and rows[1].page_limit == 5
    assert {r.download_limit for r in rows.values()} == {10}


def test_parameters(spark):
    got = {r.request_id: r.params for r in R.request_params(requests(spark)).collect()}
    assert got[1] == "term=headache&filter=datesearch.y_5&size=50"
    assert got[2] == "term=headache+AND+toothache&size=50"
    assert got[3] == "term=a%2Ab~c+%C3%A9%2B%2F&filter=datesearch.y_1&size=50"
    assert got[8] == "size=50"
    assert got[9] == "filter=datesearch.y_10&size=50"


def test_parameters_equal_the_standard_encoder(spark):
    from urllib.parse import urlencode

    words = ["".join(map(chr, range(32, 127))), "ü 中文 \n\t", "a&b=c", "~*-_."]
    frame = spark.createDataFrame([(i, w, None, 1, 1) for i, w in enumerate(words)], SCHEMA)
    for row in R.request_params(R.valid_requests(frame)).collect():
        assert row.params == urlencode({"term": row.keyword, "size": 50})


def test_pages(spark):
    rows = R.plan_pages(requests(spark)).orderBy("request_id", "page_no").collect()
    counts = {}
    for row in rows:
        counts[row.request_id] = counts.get(row.request_id, 0) + 1
    assert counts == {1: 5, 2: 3, 3: 1, 8: 1, 9: 2, 12: 1}
    assert rows[1].url == (
        "https://pubmed.ncbi.nlm.nih.gov/?term=headache&filter=datesearch.y_5&size=50&page=2"
    )


def test_detail_requests(spark):
    hits = spark.createDataFrame([("r", 1, "77")], "run_id string, id long, PMID string")
    assert R.detail_requests(hits).first().url == "https://pubmed.ncbi.nlm.nih.gov/77"
