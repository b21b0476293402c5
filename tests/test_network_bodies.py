"""Network findings judge whole bodies."""

from webloom.operators import traffic as N


def test_message_after_a_long_body(spark):
    pad = '{"trace": "' + "x, " * 150 + '", '
    bodies = [pad + '"message": "No results found"}', '{"message": "No results found"}', pad + '"code": 7}']
    rows = [("p", i, f"https://a.com/{i}", 404, "GET", "xhr", b) for i, b in enumerate(bodies)]
    bad = spark.createDataFrame(rows, "page_url string, seq long, url string, status int, method string, resource_type string, body string")
    got = N.network_findings(bad).select("evidence", "severity", "detail").collect()
    by = {r.evidence["request_url"][-1]: r for r in got}
    assert [by[str(i)].severity for i in range(3)] == ["low", "low", "high"]
    assert by["0"].detail == "No results found"
    assert all(len(r.evidence["response"]) <= 300 for r in got)
