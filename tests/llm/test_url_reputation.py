from otindex.llm.url_reputation import Rule, filter_urls

RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]

PAGES = "page_id bigint, url string, html string, bad string"


def judge(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(urls)], PAGES)
    outcomes = spark.createDataFrame(list(labels), "page_id bigint, bad boolean")
    out = filter_urls(pages, outcomes, RULES).collect()
    return {r["page_id"]: r for r in out}


def test_rules_and_parsing(spark):
    urls = [
        "http://A.Example.org/es/1?x", "http://example.org/en/12", "http://org/", "http://xorg/", "https://m.b.com/de/",
        "http://b.com/fr/x#y", "http://b.com/fr?/fr/", None, "no scheme", "http://a.org", "x://h?u://b.com/de/", "://h.org/p#f", "",
    ]
    out = judge(spark, urls)
    assert [out[i]["rule"] for i in range(13)] == [
        "example.org/es/", "example.org/en/1", "org/", None, "com/de/", "com/fr/", None, None, None, None, None, "org/", None,
    ]
    assert [(out[i]["host"], out[i]["path"]) for i in (0, 7, 8, 9, 10, 11)] == [
        ("a.example.org", "/es/1"), ("", ""), ("", ""), ("a.org", ""), ("h", ""), ("h.org", "/p"),
    ]
    assert out[0]["verdict"] == out[4]["verdict"] == "block" and out[2]["verdict"] == out[5]["verdict"] == "allow"


def test_reputation_needs_evidence_and_is_shared_within_a_domain(spark):
    urls = [f"http://bad.x.net/{i}" for i in range(60)] + [f"http://good{i % 6}.y.net/{i}" for i in range(60)]
    urls += ["http://new.x.net/", "http://once.y.net/"]
    labels = [(i, i < 60) for i in range(120)] + [(121, True), (0, True), (None, True), (5, None)]
    out = judge(spark, urls, labels)
    assert all(out[i]["verdict"] == "block" and out[i]["method"] == "reputation" for i in range(60))
    assert all(out[i]["verdict"] == "allow" for i in range(60, 120))
    assert out[121]["verdict"] == "allow"  # one bad page is not enough


def test_empty_tables(spark):
    assert judge(spark, []) == {}
    assert judge(spark, ["http://a.net/"])[0]["verdict"] == "allow"
