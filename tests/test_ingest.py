import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexgrove.operators import audit, catalog, downloads, embedding, evaluation, pages, register
from lexgrove.plans import ingest
from lexgrove.sources import commits, files, sinks
from lexgrove.streaming import ingest_stream

VID = ["%08d-0000-4000-8000-000000000000" % i for i in range(6)]


def message(i, **more):
    return json.dumps({"type": ingest.REQUESTED, "data": {"policy_version_id": VID[i]}, "created_at": "2024-01-01T00:00:00Z", **more})


def test_message_guard(spark):
    flat, wrong, no_id = json.dumps({"policy_version_id": VID[1]}), message(2, type="other"), json.dumps({"type": "x"})
    good, bad = ingest.parse_messages(spark.createDataFrame([(v,) for v in (message(0), flat, wrong, no_id, "[1]", "{oops")], "value string"))
    assert rows(good, "policy_version_id") == [(VID[0],), (VID[1],)]
    assert rows(bad, "error") == [("Invalid JSON payload",)] * 2 + [("Invalid UUID for policy_version_id",), ("Unexpected message type: other",)]


def corpus(spark):
    v = spark.createDataFrame([("t", f"p{i % 2}", VID[i], "pending" if i else "ready") for i in range(4)], "tenant_id string, policy_id string, policy_version_id string, parse_status string")
    t = spark.createDataFrame([(VID[0], "old", None), (VID[1], "See Section 2. " + "a" * 4100, None), (VID[2], None, "broken"), (VID[3], "", None)], "policy_version_id string, text string, error string")
    p = spark.createDataFrame([("t", f"p{i}", f"Name {i}", "general", "all", 1) for i in range(2)], "tenant_id string, policy_id string, name string, policy_type string, department_scope string, authority_level int")
    return v, t, p


def test_process_versions(spark):
    out = ingest.process_versions(*corpus(spark), embedder=embedding.hashing_embedder(8))
    assert rows(out["sections"], "policy_version_id", "section_path") == [(VID[1], "chunk-1"), (VID[1], "chunk-2"), (VID[3], "main")]
    assert rows(out["status"], "policy_version_id", "parse_status", "error_message") == [(VID[0], "ready", None), (VID[1], "ready", None), (VID[2], "failed", "broken"), (VID[3], "ready", None)]
    assert rows(out["references"], "matched_text", "target_section_id") == [("Section 2", f"{VID[1]}:1")]
    assert out["embeddings"].count() == 3


def test_process_versions_cuts_texts_once(spark, monkeypatch):
    v, t, p = corpus(spark)
    outs = [ingest.process_versions(v, t, p)]
    monkeypatch.setattr(ingest, "SENT_IDS", 0)
    outs.append(ingest.process_versions(v, t, p))
    for name in ("sections", "status", "references", "current"):
        assert rows(outs[0][name], *outs[0][name].columns) == rows(outs[1][name], *outs[0][name].columns)
    # The sections were written, and whatever needs them reads them; the status takes no text through a join.
    assert "FileScan parquet" in outs[1]["sections"]._jdf.queryExecution().executedPlan().toString()
    for line in outs[1]["status"]._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Join" not in line or " text#" not in line
    nothing = ingest.process_versions(v.where("parse_status = 'ready'"), t, p)
    assert nothing["sections"].count() == 0 and rows(nothing["status"], "parse_status") == [("ready",)]


def test_stream_is_idempotent_and_keeps_going_after_bad_messages(spark, tmp_path):
    v, t, p = corpus(spark)
    box = tmp_path / "messages"
    box.mkdir()
    (box / "a.txt").write_text("\n".join([message(1), message(1), "garbage", message(3)]))

    def go(state):
        ingest_stream.start_ingest_stream(spark, str(box), v, t, p, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
        return rows(commits.read(spark, str(tmp_path / "out/sections")), "section_id")

    want = rows(ingest.process_versions(v.where(F.col("policy_version_id").isin(VID[1], VID[3])), t, p)["sections"], "section_id")
    assert go("s1") == want
    (box / "b.txt").write_text(message(1))
    assert go("s1") == want and go("s2") == want
    ingest_stream.start_dead_letters(spark, str(box), str(tmp_path / "dead"), str(tmp_path / "s3")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "dead")), "value") == [("garbage",)]


def test_replace_versions_removes_rows_of_emptied_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "policy_version_id string, x int")
    sinks.replace_versions(df, df, path, buckets=2)
    sinks.replace_versions(df.where("false"), df.where("x = 1"), path, buckets=2)
    assert rows(sinks.read_table(spark, path, spark.read.parquet(path)), "policy_version_id", "x") == [("b", 3)]


def test_commits(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "policy_version_id string, x int"
    table = lambda *data: spark.createDataFrame(list(data), schema)
    now = lambda: sorted(map(tuple, commits.read(spark, path).collect()), key=str)
    assert commits.read(spark, path) is None and commits.live(spark, path) == [] and commits.obsolete(spark, path) == []
    assert commits.replace(table(("a", 1), ("a", 2), ("b", 3), (None, 9)), table(("a", 0), ("b", 0), (None, 0)), path, "first")
    assert now() == [("a", 1), ("a", 2), ("b", 3)]
    commits.write_batch(table(("a", 7)), table(("a", 7)), path)  # dies before its record
    assert now() == [("a", 1), ("a", 2), ("b", 3)] and len(commits.obsolete(spark, path)) == 1
    held = commits.read(spark, path)
    assert commits.replace(table(("a", 7)), table(("a", 0)), path, "second") and not commits.replace(table(("a", 8)), table(("a", 0)), path, "second")
    assert commits.replace(table(), table(("b", 0), ("c", 0)), path, "third")
    assert now() == [("a", 7)] and held.count() == 3
    wider = table(("d", 1)).withColumn("y", F.lit("new"))
    assert commits.replace(wider, wider, path, "fourth", compact_after=3)
    # The fourth made a new base; what came before is still there by number.
    assert [c.kind for c in commits.live(spark, path)] == ["base"] and now() == [("a", 7, None), ("d", 1, "new")]
    assert sorted(map(tuple, commits.as_of(spark, path, 1).collect())) == [("a", 7), ("b", 3)]
    assert commits.replace(table(("a", 5)), table(("a", 0)), path, "fifth") and now() == [("a", 5, None), ("d", 1, "new")]
    written = sum(spark.read.parquet(str(d / "rows")).count() for d in (tmp_path / "t/batches").iterdir())
    assert written == 3 + 1 + 1 + 0 + 1 + 2 + 1  # each batch once, the base once


def test_append_new_ignores_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, x int")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df, path, ["k"])
    assert rows(spark.read.parquet(path), "k", "x") == [("a", 1), ("b", 2)]


def test_embedding_text_and_backfill(spark):
    none = F.lit(None).cast("string")
    df = spark.range(1).select(embedding.embedding_text(none, F.lit(""), F.lit(None).cast("int"), none, F.lit("body")).alias("t"))
    assert df.first().t == "Policy Type: unknown\nDepartment Scope: all\nAuthority Level: 0\nSection Title: Untitled\n\nbody"
    s = spark.createDataFrame(
        [(f"s{i}", "v", "p", "t", "general", "all", 1, "T", f"text {i}", "ready", True) for i in range(40)],
        "section_id string, policy_version_id string, policy_id string, tenant_id string, policy_type string, department_scope string, authority_level int, title string, text string, parse_status string, is_current boolean",
    )
    none = spark.createDataFrame([], "section_id string, embedding_model string")
    first = embedding.embed_missing(s, none, embedding.hashing_embedder(), "m").cache()
    assert first.count() == 40 and embedding.embed_missing(s, first, embedding.hashing_embedder(), "m").count() == 0
    with pytest.raises(Exception, match="returned 1 vectors"):
        embedding.embed_missing(s, none, lambda texts: [[1.0]], "m").collect()


def docx(lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_file_sources_and_plan(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/leave_policy-2024-01-05.txt").write_bytes(b"ok \xff")
    (tmp_path / "in/leave_policy-2024-01-05.json").write_text('{"source_url": " http://x/side "}')
    (tmp_path / "in/sub/HR%20guide__ab12.txt").write_text("b")
    (tmp_path / "in/c.docx").write_bytes(docx(["one", " ", "two"]))
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    root = str(tmp_path / "in")
    scan = files.scan_documents(spark, root)
    assert scan.count() == 3 and files.scan_documents(spark, root, max_files=1).count() == 1
    texts = {r.path.split("/")[-1]: (r.text, bool(r.error)) for r in files.read_texts(files.scan_documents(spark, root, pattern="*.{txt,docx,pdf}")).collect()}
    assert texts["leave_policy-2024-01-05.txt"] == ("ok �", False) and texts["c.docx"] == ("one\ntwo", False)
    assert texts["bad.docx"][1] and texts["d.pdf"] == (None, True)
    (tmp_path / "links.json").write_text('["http://x/p/other", "http://x/p/hr-guide", "http://x/q/HR-guide"]')
    sided = files.with_sidecar(scan, files.scan_documents(spark, root, pattern="*.json"))
    plan = downloads.plan_files(sided, root, "src", "DEMO", "S1", {"policy_type": "external"}, links=files.read_link_list(spark, str(tmp_path / "links.json")))
    got = {r.source_file: r for r in plan.collect()}
    one = got["leave_policy-2024-01-05.txt"]
    assert one.source_url == "http://x/side" and one.policy_name == "Leave Policy 2024 01 05" and one.content_type == "text/plain"
    assert one.blob_path == f"external/demo/{one.policy_external_id}/S1-leave_policy-2024-01-05.txt" and one.version_label == f"v1-S1-{one.file_sha256[:8]}"
    assert got["sub/HR%20guide__ab12.txt"].source_url == "http://x/p/hr-guide"


def test_slug_match_equals_pairwise_rules(spark):
    names = ["ab", "abc-def", "zz", "q", "def", "", "leave-policy-2"]
    links = ["http://x/abc", "http://x/leave-policy", "http://x/zzz-def", "http://x/a-b", "http://x/leave-policy-22"]
    slugs = [u.rsplit("/", 1)[-1] for u in links]
    want = {n: next((u for s, u in zip(slugs, links) if s == n), None) or next((u for s, u in zip(slugs, links) if n in s or s in n), None) for n in names}
    f = spark.createDataFrame([(f"/in/{n}__x.txt",) for n in names], "path string")
    table = spark.createDataFrame(list(enumerate(links)), "pos int, url string")
    assert {r.file_slug: r.source_url for r in downloads.match_slugs(f, table).collect()} == want


def test_links_and_manifest(spark):
    html = (
        "<a href='/p/one.pdf#x'>One <b>file</b></a><a class=k href=\"/p/one.pdf?q\">again</a><!-- <a href='/no.pdf'>n</a> --><a href='mailto:a@b'>m</a>"
        "<div data-url='/d'></div><i onclick=\"go('http://o/z')\"></i><a href=http://else/x.pdf>e</a>"
    )
    p = spark.createDataFrame([(1, "http://h.org/base/", html)], "page_id int, url string, html string")
    m = pages.link_manifest(p, pages.LinkRules("A", hosts=("h.org",)))
    assert rows(m, "source_url", "title", "doc_type") == [("http://h.org/p/one.pdf", "One file", "pdf")]
    assert {r.link for r in pages.all_links(p).collect()} == {"http://h.org/p/one.pdf", "http://h.org/p/one.pdf?q", "mailto:a@b", "http://h.org/d", "http://o/z", "http://else/x.pdf"}


CATALOG = {
    "catalog": {"groups": [{"id": "ac", "title": "Access", "controls": [
        {"id": "ac-1", "title": "Policy", "props": [{"name": "label", "value": "AC-01", "class": "zero-padded"}, {"name": "label", "value": "AC-1"}],
         "params": [{"id": "p1", "select": {"how-many": "one-or-more", "choice": ["a {{ insert: param, p2 }}", "b"]}}, {"id": "p2", "label": "time"}],
         "parts": [{"name": "statement", "prose": "Do {{ insert: param, p1 }} in {{insert: param, p2}} or {{ insert: param, nope }}:", "parts": [
             {"name": "item", "props": [{"name": "label", "value": "a."}], "prose": "first", "parts": [{"name": "item", "prose": "deep"}]},
             {"name": "objective", "prose": "hidden", "parts": [{"name": "item", "prose": "hidden too"}]}]},
             {"name": "guidance", "prose": "Think."}]},
        {"id": "ac-2", "title": "Gone", "props": [{"name": "status", "value": "withdrawn"}], "controls": [{"id": "ac-2.1", "title": "Child", "parts": []}]},
    ]}]}
}


def test_catalog_text_and_order(spark):
    top = catalog.top_controls(spark.createDataFrame([(json.dumps(CATALOG),)], "json string"))
    profile = {"category": "C", "authority_level": 5, "policy_type": "k", "effective_date": "2023-10-12", "model": "m"}
    out = catalog.flatten_catalog(top, "t", "Std", profile, "http://u?e=")
    s = out["sections"].orderBy("section_index").collect()
    assert [(r.section_index, r.section_path) for r in s] == [(0, "AC-1"), (1, "AC-2.1")]
    assert s[0].text == (
        "AC-1 Policy\n\nControl:\nDo [Selection (one-or-more): a {{ insert: param, p2 }}; b] in [Assignment: organization-defined time] or "
        "[organization-defined parameter]:\n  a. first\n    deep\n\nDiscussion:\nThink."
    )
    assert s[1].text == "AC-2.1 Child" and rows(out["policies"], "name", "external_id") == [("Std — Access (AC)", "ac")]
    assert rows(out["embeddings"], "public_url") == [("http://u?e=AC-1",), ("http://u?e=AC-2.1",)]


def test_audit_is_tenant_scoped_and_replays(spark):
    a = spark.createDataFrame([("q1", "t1", "Why?", "x", 0.5), ("q2", "t2", "How?", "y", 0.6)], "question_id string, tenant_id string, question string, answer string, confidence double")
    log = audit.audit_rows(a, "r1")
    assert rows(log, "audit_id") == rows(audit.audit_rows(a, "r1"), "audit_id")
    aid = log.where("tenant_id = 't1'").first().audit_id
    assert audit.get_audit(log, "t1", aid).count() == 1 and audit.get_audit(log, "t2", aid).count() == 0
    again = audit.replay(log, lambda q: q.select("question_id", "tenant_id", "question", F.lit("x").alias("answer"), F.lit(0.5).alias("confidence")), "r2")
    assert rows(audit.replay_diff(log, again), "question_id", "same") == [("q1", True), ("q2", False)]
    body = spark.createDataFrame([('{"tenantId":"T","question":"q","scope":{"onlyCurrent":false},"user":{"department":"d"}}',), ('{"query":"z"}',)], "p string")
    assert rows(body.select(audit.normalize_request(F.col("p")).alias("r")), "r.tenant_id", "r.question", "r.department", "r.only_current") == [("T", "q", "d", False), ("local", "z", None, True)]


def test_evaluation(spark):
    item = "array<struct<section_path:string>>"
    a = spark.createDataFrame([("1", "text", 0.7, [("p",)] * 5), ("2", "Sorry. insufficient evidence in available policy sections.", 0.0, [])], f"question_id string, answer string, confidence double, citation_items {item}")
    e = spark.createDataFrame([("1", "A", "ground"), ("2", "B", "refuse"), ("3", "B", "ground")], "question_id string, category string, expectation string")
    v = evaluation.evaluate(a, e)
    assert rows(v, "status", "ok") == [("ANSWERED", True), ("ERROR", False), ("REFUSED", True)]
    assert rows(evaluation.pass_report(v), "category", "passed", "total") == [("A", 1, 1), ("B", 1, 2), (None, 2, 3)]
    assert [len(r.cites) for r in evaluation.samples(v, ["A"]).collect()] == [4]


def test_download_index_and_metadata_defaults(spark):
    d = spark.createDataFrame([("u", "ok", "h2", "text/html", "html", "A", "e")], "source_url string, status string, sha256 string, content_type string, doc_type string, agency string, external_id string")
    i = spark.createDataFrame([("u", "h1", "old", {"h1": "old"}), ("w", "h", "k", {"h": "k"})], "source_url string, current_sha256 string, current_path string, sha_to_path map<string,string>")
    got = {r.source_url: r for r in downloads.merge_index(i, d).collect()}
    assert got["u"].sha_to_path == {"h1": "old", "h2": "external/a/e/h2.html"} and got["u"].current_sha256 == "h2" and got["w"].current_path == "k"
    df = spark.createDataFrame([('{"a":"1"}',)], "m string")
    out = df.select(downloads.with_default_keys(F.col("m"), {"a": F.lit("9"), "b": F.lit("2")}).alias("m")).first().m
    assert json.loads(out) == {"a": "1", "b": "2"}
    assert register.ID_SPACE
