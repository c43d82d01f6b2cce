from foliant.llm import warc


def test_urls_beyond_a_megabyte(spark):
    url = "http://a/" + "x" * (3 << 20)
    frame = spark.createDataFrame([(1, url, "page"), (2, "u", "other")], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.payload_bytes) for r in warc.read_archives(warc.write(frame)).collect()}
    assert got == {1: (url, 4), 2: ("u", 5)}
