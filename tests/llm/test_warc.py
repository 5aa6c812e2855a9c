import hashlib

from ledgerlake.llm import warc


def test_archive(spark, tmp_path):
    long = "<p>" + "x" * 200 + "é</p>"
    made = [(5, "http://a/\r\n1", long, "k"), (3, None, long, "k"), (9, "u", long, "k"), (1, "u", "tiny", "k"), (2, "u", "tiny", "k"), (4, "u", None, "k"), (None, "u", long, "k"), (3, None, long, "k")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/a"
    recs = warc.archive(pages, path)
    got = sorted((tuple(r) for r in warc.report(recs).collect()), key=str)
    want = []
    for page, _, html, _ in made:
        b = (html or "").encode()
        revisit = len(b) >= 100 and page != 3
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    one = recs.where("page_id = 5").first()
    head, _, rest = bytes(one["record"]).partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    assert fields[b"WARC-Type"] == b"revisit" and int(fields[b"Content-Length"]) == len(rest) - 4 and bytes(one["payload"]) == long.encode()
    first = recs.where("page_id = 1").first()
    head, _, rest = bytes(first["record"]).partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    assert rest.endswith(b"tiny\r\n\r\n") and int(fields[b"Content-Length"]) == len(rest) - 4


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(warc.archive(pages)).count() == 0
