from pagelens.operators import duplicates


def test_near_duplicates_of_every_crawl(spark):
    words = [f"w{k}" for k in range(120)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(crawl, f"{crawl}/{k}", t) for crawl in ("c1", "c2") for k, t in enumerate((a, b, a))]
    df = spark.createDataFrame(rows, "crawl_id string, url string, t string")
    got = {(r.a, r.b) for r in duplicates.near_duplicate_pairs(df, "url", "t", 0.9, by=("crawl_id",)).collect()}
    assert got == {(f"{c}/0", f"{c}/{k}") for c in ("c1", "c2") for k in (1, 2)}
