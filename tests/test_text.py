import hashlib
import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.functions import ids, text, urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def brute_clean(raw):
    """Line-by-line restatement of the cleaning rules."""
    out, seen, last = [], set(), None
    for line in (x.strip() for x in re.sub("\r\n?", "\n", raw or "").strip().split("\n")):
        if re.match(r"(?i)(pdf\s*page|page\s+\d+\s*(of\s*\d+)?)\b", line):
            continue
        if line and len(line) <= 80 and re.search(text.HEADER_HINT, line):
            if line.lower() in seen:
                continue
            seen.add(line.lower())
        if line and line == last:
            continue
        out.append(line)
        last = line or last
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", "\n".join(out))).strip()


LINES = ["", " ", "Page 3 of 9", "pdf page", "Page 7 rules", "Confidential", "CONFIDENTIAL", "a  b", "a  b", "x\ty", "\xa0z", "all rights reserved " + "q" * 90]


def test_clean_text_equals_line_rules(spark):
    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.sampled_from(LINES), max_size=14), min_size=20, max_size=20), st.sampled_from(["\n", "\r\n", "\r"]))
    def check(docs, sep):
        raws = [sep.join(d) for d in docs]
        assert many(spark, raws, text.clean_text) == [brute_clean(r) for r in raws]

    check()


def test_clean_text_null_and_empty(spark):
    assert many(spark, [None, "", " \n\t "], text.clean_text) == ["", "", ""]


def test_chunks_join_to_the_whole_text(spark):
    raws = ["", "ab", "é" * 4000, "x" * 4001, "𝒳y" * 5000]
    for raw, parts in zip(raws, many(spark, raws, text.chunks)):
        assert "".join(p.text for p in parts) == raw
        assert [p.start_offset for p in parts] == list(range(0, max(len(raw), 1), 4000))
        assert parts[-1].end_offset == len(raw)
        assert parts[0].section_path == ("chunk-1" if raw else "main")


def test_snippet_and_excerpt(spark):
    assert one(spark, "  a\nb ", text.snippet) == "a b"
    assert one(spark, "w " * 200, text.snippet) == ("w " * 140).rstrip() + "..."
    assert one(spark, "v" * 700, text.excerpt) == "v" * 600 + "…"


def test_uuid5_and_hashes(spark):
    space = "11111111-2222-3333-4444-555555555555"
    assert one(spark, "policy/AC é", lambda c: ids.uuid5(space, c)) == str(uuid.uuid5(uuid.UUID(space), "policy/AC é"))
    assert one(spark, "ä", ids.sha256_hex) == hashlib.sha256("ä".encode()).hexdigest()
    assert one(spark, None, ids.section_key) == hashlib.sha256(b"").hexdigest()[:16]


def test_metadata_hash_ignores_key_order_and_folds_url_keys(spark):
    a, b, c = many(spark, ['{"b":1,"url":"u"}', '{"url":"u","source_url":"u","b":1}', '{"b":1}'], ids.metadata_hash)
    assert a == b != c


def test_external_id(spark):
    df = spark.createDataFrame([("http://x/y", "The  Title!"), ("http://x/y", "§")], "u string, t string")
    sha = hashlib.sha1(b"http://x/y").hexdigest()[:12]
    assert [r.x for r in df.select(ids.external_id(F.col("u"), F.col("t")).alias("x")).collect()] == [f"the-title-{sha}", f"document-{sha}"]


def test_slug_title_and_date_of_files(spark):
    assert many(spark, ["a_b%20c", "HR_28x_29+y", "--"], urls.slug) == ["a-b-c", "hr-x-y", ""]
    assert one(spark, "/in/leave_policy-2024-01-05.txt", urls.title_of_file) == "Leave Policy 2024 01 05"
    assert str(one(spark, "/in/leave-2024-01-05.txt", urls.date_of_file)) == "2024-01-05"
    assert one(spark, "/in/leave-2024-13-05.txt", urls.date_of_file) is None


def test_html_to_text(spark):
    page = "<p>pay attention</p><script>var t='</p>';</script>a<br/>b &amp; c<style>p{}</style>"
    assert one(spark, page, urls.html_to_text) == "pay attention\n\n a\nb & c"


def test_url_rejection(spark):
    bad = {
        "ftp://a.b/c": "scheme", "http://127.0.0.1/x": "loopback", "http://10.1.2.3": "private", "http://169.254.169.254/": "link_local",
        "https://[::1]/": "loopback", "http://[::ffff:10.0.0.1]/": "private", "http://240.0.0.1": "reserved", "http://224.0.0.1": "multicast",
        "https://example.org:8443/a": None, "http://8.8.8.8": None, "http://172.32.0.1": None, "http://": "host",
    }
    assert many(spark, list(bad), urls.url_rejection) == list(bad.values())


def test_resolve_url(spark):
    df = spark.createDataFrame([("http://h/a/b?q", "../c#f"), ("http://h/a", "//k/x"), ("http://h/a", " /p ")], "b string, h string")
    assert [r.x for r in df.select(urls.resolve_url("b", "h").alias("x")).collect()] == ["http://h/c#f", "http://k/x", "http://h/p"]
