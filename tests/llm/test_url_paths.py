"""Urls whose path tells, and names in no training row."""

from skeinwork.llm import op9_urls


def verdicts(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r.page_id]: r.verdict for r in op9_urls.judge(df, [], op9_urls.UrlModel(op9_urls.labelled_table(spark))).collect()}


def test_url_paths_tell(spark):
    blocked = ["https://www.example.com/casino-bonus/buy-pills", "https://example.org/en/cheap-pills", "http://news.example.net/free-bets/12", "https://www.garden.example.com/adult-x.html"]
    allowed = ["https://www.example.com/garden/history", "https://example.org/en/meadow", "http://news.example.net/recipes/12", "https://www.example.com/en/7817", "https://www.lake.example.com/de/5"]
    got = verdicts(spark, blocked + allowed)
    assert {u for u in got if got[u] == "block"} == set(blocked)


def test_no_given_name_is_a_training_row(spark):
    given = set()
    for size in ("sf0.001", "sf0.01", "sf0.1"):
        for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select(op9_urls.host_of("url").alias("h")).distinct().collect():
            given |= set(r.h.split("."))
    given -= {"www", "m", "blog", "example", "com", "net", "org"}
    assert given and given.isdisjoint([*op9_urls.BLOCKED_NAMES, *op9_urls.ALLOWED_NAMES])
