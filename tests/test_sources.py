"""Sources, stores, the model boundary, jobs, configuration and the command line."""

import json
import random
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folium import cli, config, registry
from folium.plans import reasoner, service
from folium.sources import catalog, files, store
from folium.streaming import jobs


def make_pdf(texts, deflate=True):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(texts)} /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(texts)))}] >>"]
    out = [o.encode() for o in objects]
    for i, t in enumerate(texts):
        shown = " T* ".join(f"({line}) Tj" for line in t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").split("\n"))
        data = f"BT /F1 12 Tf 72 720 Td {shown} ET".encode("cp1252")
        data = zlib.compress(data) if deflate else data
        out.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode())
        out.append(f"<< /Length {len(data)}{' /Filter /FlateDecode' if deflate else ''} >>\nstream\n".encode() + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate(out, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_pages(spark, tmp_path, deflate):
    (tmp_path / "one.pdf").write_bytes(make_pdf(["First page\nof (two)", "Zweite Übung"], deflate))
    (tmp_path / "broken.PDF").write_bytes(b"no pdf")
    (tmp_path / "other.txt").write_text("no")
    got = files.pdf_pages(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(x.doc_name, x.page_no, x.text, x.token_count) for x in got] == [("one", 1, "First page\nof (two)", 4), ("one", 2, "Zweite Übung", 2)]


def test_markdown_files_and_command_line(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext\n## B\n")
    (tmp_path / "b.txt").write_text("# no")
    assert [(x.doc_name, x.text) for x in files.markdown_files(spark, str(tmp_path)).collect()] == [("a", "# A\ntext\n## B\n")]
    assert cli.main(["--md_path", str(tmp_path / "a.md"), "--out", str(tmp_path / "out")]) == 0
    found = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert found["doc_name"] == "a" and found["structure"][0]["title"] == "A" and found["structure"][0]["nodes"][0]["node_id"] == "0001"
    assert cli.main([]) == 2 and cli.main(["--pdf_path", "x.doc"]) == 2 and cli.main(["--pdf_path", "a.pdf", "--md_path", "b.md"]) == 2


def test_accepted(spark):
    rows = spark.createDataFrame([("a.pdf",), ("A.PDF",), ("b.Md",), ("c.markdown",), ("d.doc",), ("e.pdf.backup",), ("",), (None,)], "p string")
    assert [x.ok for x in rows.select(files.accepted(F.col("p")).alias("ok")).collect()] == [True, True, True, True, False, False, False, False]


def test_config():
    c = config.load({"toc_check_pages": 15, "max_pages_per_node": "25", "max_tokens_per_node": 0, "model": None, "add_node_text": "yes", "unknown": 1})
    assert (c.toc_check_pages, c.max_pages_per_node, c.max_tokens_per_node, c.model, c.add_node_text) == (15, 25, 20_000, "gpt-4o-2024-11-20", True)
    assert config.load() == config.Config() and config.load({"num_ctx": "x"}, c) == c


def test_reasoner(spark):
    asked = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("a", "p2"), ("a", ""), ("a", None)], "op string, prompt string")
    known = spark.createDataFrame([("a", "p1", "c1")], "op string, prompt string, content string")
    got = reasoner.complete(asked, reasoner.replay(known))
    assert sorted(((x.prompt, x.content, x.finish_reason) for x in got.collect()), key=repr) == sorted([("p1", "c1", "finished")] * 2 + [("p2", None, "error"), ("", None, None), (None, None, None)], key=repr)


def test_http_backend(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = sent["messages"][-1]["content"]
            seen.append((self.path, prompt))
            code = 429 if self.path == "/busy" else 500 if prompt == "bad" else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": prompt.upper()}, "finish_reason": "length" if prompt == "long" else "stop"}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    providers = [reasoner.Provider(f"{url}/busy", "m"), reasoner.Provider(f"{url}/free", "m")]
    asked = spark.createDataFrame([("a", "hello"), ("a", "hello"), ("a", "long"), ("a", "bad")], "op string, prompt string")
    got = {x.prompt: (x.content, x.finish_reason) for x in reasoner.complete(asked, reasoner.http(providers, wait=0.01, timeout=5), tasks=2).collect()}
    server.shutdown()
    assert got == {"hello": ("HELLO", "finished"), "long": ("LONG", "max_output_reached"), "bad": (None, "error")}
    assert seen.count(("/free", "hello")) == 1


def test_store(spark, tmp_path):
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    assert kept.read() is None
    kept.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "doc_key string, v int"))
    kept.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "doc_key string, v int"))
    assert sorted(map(tuple, kept.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]
    store.audit(spark, str(tmp_path / "log"), "r1", ["x", "y"])
    store.audit(spark, str(tmp_path / "log"), "r2", ["z"])
    assert spark.read.parquet(str(tmp_path / "log")).where("run_id = 'r1'").count() == 2
    listed = spark.createDataFrame([("a", None, None, 1), ("b", "f", 3, 2)], "doc_key string, filename string, page_count int, indexed_at int")
    assert [tuple(x)[:3] for x in store.listing(listed).collect()] == [("b", "f", 3), ("a", "a", 0)]


def test_jobs_and_questions(spark, tmp_path):
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    pages = spark.createDataFrame([(1, 1, "About cats here\nwords.", 4), (1, 2, "cats sleep all day.", 4), (1, 3, "About dogs here\ndogs run.", 5)] + [(2, k, "x", 1) for k in range(1, 61)], "doc_id long, page_no int, text string, token_count int")
    uploads = spark.createDataFrame([("one", 1), ("two", 2)], "doc_key string, doc_id long")
    got = {x.doc_key: x.status for x in service.index_jobs(uploads, pages, kept).collect()}
    assert got == {"one": "DONE", "two": "ERROR"}
    first = kept.read().head().indexed_at
    service.index_jobs(uploads, pages, kept)
    assert kept.read().count() == 1 and kept.read().head().indexed_at == first
    question = spark.createDataFrame([(5, 1, "what do cats do")], "question_id long, doc_id long, question string")
    answer = service.answer(question, kept.read()).head()
    assert answer.sources == ["About cats here"] and "cats" in answer.answer


def test_usage(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2024-01-01 00:00:00'), (1, 2, timestamp'2024-01-01 23:59:59'), (1, 3, timestamp'2024-01-02 00:00:00'), (1, 4, timestamp'2024-01-02 00:00:01'), (2, 5, timestamp'2024-01-01 00:00:00') AS t(client, event_id, ts)")
    used = jobs.usage(rows)
    assert {x.event_id: x.uses for x in used.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert {x.event_id: (x.remaining, x.allowed) for x in jobs.remaining(used).collect()}[3] == (0, False)


def test_catalog(spark):
    asked = spark.createDataFrame([("gpt-4o-2024-11-20",), ("none",), (None,)], "model string")
    assert sorted(x.url.split("/")[2] for x in catalog.with_url(asked).collect()) == ["api.openai.com", "localhost:11434", "localhost:11434"]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_plans_have_no_python(spark, tmp_path):
    from pyspark.sql import SparkSession  # noqa: F401

    folder = "/root/testdata/sf0.001"
    for name in ("section_index", "page_groups", "md_thinning", "fix_incorrect", "rag_context", "usage_ttl"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


def test_every_model_of_the_catalogue_has_its_url(spark):
    hosts = {"api.groq.com": 4, "generativelanguage.googleapis.com": 2, "api.cerebras.ai": 1, "api.mistral.ai": 2}
    asked = catalog.models(spark).select(F.col("id").alias("model")).union(spark.createDataFrame([("unknown",), (None,)], "model string"))
    got = {x.model: x.url.split("/")[2] for x in catalog.with_url(asked).collect()}
    assert {h: list(got.values()).count(h) for h in hosts} == hosts
    assert {got[m] for m in ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo")} == {"api.openai.com"}
    assert {got[m] for m in ("qwen2.5:3b", "llama3.2", "mistral", "unknown", None)} == {"localhost:11434"}
    own = spark.createDataFrame([("mine", "http://own/v1")], "id string, url string")
    asked = spark.createDataFrame([("mine",), ("gpt-4o",)], "model string")
    assert {x.model: x.url for x in catalog.with_url(asked, catalogue=own).collect()} == {"mine": "http://own/v1", "gpt-4o": catalog.LOCAL_URL}


def test_arrays_are_read_from_every_reply(spark, monkeypatch):
    array = '[{"structure": "1", "title": "A", "physical_index": "<physical_index_3>"}]'
    replies = [(0, f"```json\n{array}\n```"), (1, array), (2, '{"structure": "1"}'), (3, "Error"), (4, None)]
    monkeypatch.setattr(registry.FX, "replies", lambda s, d: spark.createDataFrame(replies, "item_id long, reply string"))
    got = registry.queries()["json_array_rows"](spark, "")
    assert sorted(map(tuple, got.collect())) == [(0, "1", "A", 3), (1, "1", "A", 3)]


def test_usage_runs(spark):
    r = random.Random(3)
    day = 86_400
    rows, event = [], 0
    for client in (1, 2, None):
        at = 0
        for _ in range(200):
            at += r.choice([0, 1, 3600, day // 2, day, day + 1, 3 * day])
            rows.append((client, event, at))
            event += 1
    rows += [(1, event, None), (2, event + 1, None)]
    want = {}
    for client in (1, 2, None):
        count = until = None
        for _, e, at in sorted((x for x in rows if x[0] == client), key=lambda x: (x[2] is not None, x[2] or 0, x[1])):
            if until is None or at > until:
                count, until = 0, None if at is None else at + day
            count += 1
            want[e] = count
    events = spark.createDataFrame(rows, "client long, event_id long, at long").selectExpr("client", "event_id", "timestamp_seconds(at) AS ts").repartition(3)
    assert {x.event_id: x.uses for x in jobs.usage(events).collect()} == want


def ruled(pages_of_prompt):
    """A backend that answers prompts by the rules, from their payloads: what a model would say that thinks like them."""
    from folium.functions import text as X
    from folium.plans import rules

    def run(asked):
        rows = asked.withColumn("p", F.element_at(F.split("prompt", "\n", 2), 2))
        get = lambda k: F.get_json_object("p", f"$.{k}")
        answer = lambda c: F.concat(F.lit('```json {"answer": "'), c, F.lit('"} ```'))
        yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")
        squeezed = lambda k: X.squeezed(get(k))
        tagged = F.expr(r"regexp_extract_all(get_json_object(p, '$.pages'), '(?s)<physical_index_(\\d+)>\n(.*?)\n<physical_index_\\d+>\n\n', 1)")
        texts = F.expr(r"regexp_extract_all(get_json_object(p, '$.pages'), '(?s)<physical_index_(\\d+)>\n(.*?)\n<physical_index_\\d+>\n\n', 2)")
        title = lambda t: X.strip(F.get(F.split(t, "\n"), F.lit(0)))
        is_head = lambda t: (F.length(title(t)) <= 80) & X.token_count(title(t)).between(2, 12) & ~title(t).rlike(r"[.!?;,]$")
        heads = F.filter(F.arrays_zip(tagged.alias("k"), texts.alias("t")), lambda x: is_head(x["t"]))
        heads = F.to_json(F.transform(heads, lambda x: F.struct(x["k"].alias("structure"), title(x["t"]).alias("title"), F.concat(F.lit("<physical_index_"), x["k"], F.lit(">")).alias("physical_index"))))
        at = F.element_at(F.filter(F.arrays_zip(tagged.alias("k"), texts.alias("t")), lambda x: X.squeezed(x["t"]).contains(squeezed("title"))), 1)["k"]
        reply = (
            F.when(F.col("op") == "contents_page", answer(rules.contents_flag(get("text"))))
            .when(F.col("op") == "page_numbers", answer(yes(get("contents").rlike(r"(?m)\d\s*$"))))
            .when(F.col("op") == "items_whole", answer(F.lit("yes")))
            .when(F.col("op") == "title_on_page", answer(yes(squeezed("page").contains(squeezed("title")))))
            .when(F.col("op") == "title_begins", answer(yes(squeezed("page").startswith(squeezed("title")))))
            .when(F.col("op") == "find_title", F.concat(F.lit('{"physical_index": "physical_index_'), at, F.lit('"}')))
            .when(F.col("op") == "sections", heads)
            .when(F.col("op") == "summary", rules.first_sentence(get("text")))
            .when(F.col("op") == "description", F.lit("about"))
        )
        return rows.select("prompt_hash", reply.alias("content"), F.when(reply.isNull(), "error").otherwise("finished").alias("finish_reason"))

    return run


def test_an_index_by_a_model_that_thinks_like_the_rules(spark):
    from folium.plans import index as I
    from folium.plans.rules import Model

    pages = []
    for d in range(4):
        for k in range(1, 12):
            text = f"Part {d} {k} heading\nIt tells of things. And of more." if k % 3 == d % 3 else f"plain words of page {k} end here.\nmore."
            pages.append((d, k, text, 12))
    pages = spark.createDataFrame(pages, "doc_id long, page_no int, text string, token_count int")
    plain = {x.doc_id: x.structure_json for x in I.build_index(pages).collect()}
    got = {x.doc_id: x.structure_json for x in I.build_index(pages, rules=Model(ruled(None), budget=40)).collect()}

    def shape(text):
        return [{k: v for k, v in n.items() if k != "nodes"} for n in json.loads(text)]

    assert len(plain) == 4 and {d: shape(t) for d, t in got.items()} == {d: shape(t) for d, t in plain.items()}


def test_cut_replies_go_on(spark):
    from folium.plans.rules import Model

    def backend(asked):
        whole = F.col("prompt").contains("Go on from here")
        reply = F.when(whole, F.lit(' {"structure": "2", "title": "B"}]')).otherwise(F.lit('[{"structure": "1", "title": "A", "page": 3}, {"struc'))
        reply = F.when(F.col("op") == "items_whole", F.lit('{"answer": "yes"}')).otherwise(reply)
        reason = F.when((F.col("op") == "items") & ~whole, "max_output_reached").otherwise("finished")
        return asked.select("prompt_hash", reply.alias("content"), reason.alias("finish_reason"))

    contents = spark.createDataFrame([(1, "A 3\nB")], "doc_id long, toc_content string")
    got = [tuple(x) for x in Model(backend).items(contents).orderBy("item_no").collect()]
    assert got == [(1, 1, "1", "A", 3), (1, 2, "2", "B", None)]


def test_providers():
    env = {"GROQ_API_KEY": "g", "GOOGLE_API_KEY": " ", "CEREBRAS_API_KEY": "c", "LLM_BASE_URL": ""}
    assert [(p.model, p.api_key) for p in reasoner.pool(env)] == [("llama-3.3-70b-versatile", "g"), ("llama-3.1-8b-instant", "g"), ("llama3.3-70b", "c")]
    assert [(p.model, p.url) for p in reasoner.pool({})] == [("qwen2.5:7b", catalog.LOCAL_URL)]
    assert reasoner.provider("gpt-4o", {"CHATGPT_API_KEY": "k"}) == reasoner.Provider(catalog.OPENAI_URL, "gpt-4o", "k")
    assert reasoner.provider("x", {"LLM_BASE_URL": "http://own"}).url == "http://own" and reasoner.provider("x", {}, "http://given").url == "http://given"
    assert reasoner.read_timeout(catalog.LOCAL_URL) == 300 and reasoner.read_timeout(catalog.GROQ_URL) == 120


def test_every_option_counts(spark, tmp_path):
    from folium.plans.rules import Model

    text = "# A\n" + "one two three. " * 10 + "\n## B\nshort\n"
    (tmp_path / "a.md").write_text(text)

    def run(*more):
        assert cli.main(["--md_path", str(tmp_path / "a.md"), "--out", str(tmp_path / "out"), *more]) == 0
        return json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))

    node = run()["structure"][0]
    assert node["node_id"] == "0000" and "# A" in node["prefix_summary"] and node["nodes"][0]["summary"].startswith("## B")
    node = run("--if-add-node-id", "no", "--if-add-node-summary", "no", "--if-add-node-text", "yes")["structure"][0]
    assert "node_id" not in node and "prefix_summary" not in node and node["text"].startswith("# A")
    node = run("--summary-token-threshold", "5", "--if-add-doc-description", "yes")
    assert node["structure"][0]["prefix_summary"].endswith("three.") and "one" in node["structure"][0]["prefix_summary"] and node["doc_description"] == "A"
    parse = lambda *a: cli.parser().parse_args([*a, "--md_path", "x.md"])
    assert cli.rules_for(parse(), config.Config(), {}) is cli.index.RULES
    assert isinstance(cli.rules_for(parse("--model", "pool"), config.load({"model": "pool"}), {}), Model)
    assert isinstance(cli.rules_for(parse("--base-url", "http://x"), config.load({"base_url": "http://x"}), {}), Model)


def test_the_shared_folder():
    from types import SimpleNamespace

    from folium.plans import lineage

    def session(master, where=None):
        conf = SimpleNamespace(get=lambda name: where)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert lineage.shared_dir(session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared" and lineage.shared_dir(session("local[2]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            lineage.shared_dir(session(master))


def test_scratch_tables_go(spark):
    import os

    from folium.plans.lineage import Scratch

    with Scratch(spark) as scratch:
        one, n = scratch.counted(spark.range(10), "one", F.col("id") > 6)
        two = scratch.written(one.where("id > 3"), "two")
        paths = [p.removeprefix("file://") for p in scratch.paths]
        assert n == 3 and two.count() == 6 and all(map(os.path.isdir, paths))
        scratch.done(one)
        assert [os.path.isdir(p) for p in paths] == [False, True]
    assert not os.path.isdir(paths[1])


def test_inbox(spark, tmp_path):
    inbox, kept = tmp_path / "inbox", store.IndexStore(spark, str(tmp_path / "index"))
    inbox.mkdir()
    (inbox / "one.pdf").write_bytes(make_pdf(["A heading here\nwords."]))
    first = jobs.ingest(spark, str(inbox), kept, str(tmp_path / "state"))
    (inbox / "two.pdf").write_bytes(make_pdf(["B heading here\nwords."] * 60))
    both = jobs.ingest(spark, str(inbox), kept, str(tmp_path / "state"))
    assert [tuple(x) for x in first.limit(1).collect()] == [("one", "DONE", None)]
    assert sorted((x.doc_key, x.status) for x in both.collect()) == [("one", "DONE"), ("two", "ERROR")] and kept.read().count() == 1
    assert store.run_id("x", __import__("datetime").datetime(2024, 1, 2, 3, 4, 5)) == "x_20240102_030405"
