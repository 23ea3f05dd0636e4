"""Path templates of hosts with many children."""

import pytest

from tessera.llm import urls


@pytest.mark.parametrize("n", [40, 60])
def test_labels_do_not_spread_over_many_segments(spark, n):
    """The ruled pages of one segment say nothing of the other segments, however many there are."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03}")
    paths = [f"/de/{name(i)}" for i in range(10)] + [f"/{name(i)}/{name(100 + i)}" for i in range(n)]
    pages = spark.createDataFrame([(i, f"https://example.com{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert {got[i]["verdict"] for i in range(10)} == {"block"}
    assert {got[i]["verdict"] for i in range(10, 10 + n)} == {"allow"}
    assert {got[10 + i]["template"] for i in range(n)} == ({"/*/*"} if n > urls.MAX_CHILDREN else {f"/{name(i)}/{name(100 + i)}" for i in range(n)})
