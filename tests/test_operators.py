"""Operators on small literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from folium.operators import markdown as M
from folium.operators import pages as P
from folium.operators import retrieval as R
from folium.operators import toc, tree, verify
from folium.plans import index as I


def pages(spark, texts, doc_id=1):
    rows = [(doc_id, i + 1, t, len((t or "").split())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, text string, token_count int")


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, item_no int, structure string, title string, physical_index int")


@pytest.mark.parametrize("tokens, budget, want", [
    ([200] * 8, 500, [(k, k + 1) for k in range(1, 8)]), ([900, 50, 50, 300], 500, [None, (1, 1), (1, 2), (2, 4)]), ([10, 20], 500, [(1, 2)]), ([0, 0], 5, [(1, 2)]),
])
def test_groups(spark, tokens, budget, want):
    rows = spark.createDataFrame([(1, i + 1, "", n) for i, n in enumerate(tokens)], "doc_id long, page_no int, text string, token_count int")
    got = {r.group_no: (r.first_page, r.last_page) for r in P.groups(rows, budget, drop_empty=False).collect()}
    assert [got[k] if got[k][0] else None for k in range(len(got))] == want
    assert P.groups(rows, budget).count() == len([w for w in want if w])


def test_markdown(spark):
    text = "intro\n# Header 1\n```\n# not one\n```\n## Header 2\nSome\n\n  ### indented\n#### Deep\n# Last"
    files = spark.createDataFrame([(1, text), (2, ""), (3, "a\nb\nc"), (4, None)], "doc_id long, text string")
    rows = M.lines(files)
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == {1: 11, 2: 1, 3: 3}
    nodes = M.tree(M.sections(rows)).orderBy("seq").collect()
    assert [(n.title, n.level, n.line_no, n.parent_seq, n.depth) for n in nodes] == [("Header 1", 1, 2, None, 0), ("Header 2", 2, 6, 1, 1), ("Deep", 4, 10, 2, 2), ("Last", 1, 11, None, 0)]
    assert nodes[1].text == "## Header 2\nSome\n\n  ### indented"


def plain_thinning(levels, own, least):
    n, gone = len(levels), set()
    end = [next((j for j in range(i + 1, n) if levels[j] <= levels[i]), n) for i in range(n)]
    for i in reversed(range(n)):
        if i not in gone and sum(own[i : end[i]]) < least:
            gone |= set(range(i + 1, end[i]))
    return [i for i in range(n) if i not in gone]


def test_thinning(spark):
    r = random.Random(6)
    rows, want = [], {}
    for doc in range(40):
        levels = [r.randint(1, 6) for _ in range(r.randint(1, 25))]
        own = [r.randint(1, 30) for _ in levels]
        rows += [(doc, i + 1, i + 1, lv, f"t{i}", " ".join(["w"] * n)) for i, (lv, n) in enumerate(zip(levels, own))]
        want[doc] = plain_thinning(levels, own, 40)
    nodes = spark.createDataFrame(rows, "doc_id long, seq int, line_no int, level int, title string, text string")
    got = {}
    for x in M.thinned(M.subtree_tokens(nodes), 40).collect():
        got.setdefault(x.doc_id, []).append(x.seq - 1)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_tree(spark):
    rows = items(spark, [(1, 1, "1", "A", 1), (1, 2, "1.1", "B", 2), (1, 3, "3.1", "orphan", 3), (1, 4, "1", "A again", 4), (1, 5, "1.1", "C", 5), (1, 6, "1.1.1", None, 6)])
    got = tree.preorder(tree.paths(tree.code_parents(rows))).orderBy("seq")
    assert [(x.item_no, x.parent_item, x.depth, x.node_id) for x in got.collect()] == [(1, None, 0, "0000"), (2, 1, 1, "0001"), (3, None, 0, "0002"), (4, None, 0, "0003"), (5, 4, 1, "0004"), (6, 5, 2, "0005")]
    assert tree.outline(got).head().outline == "- A\n  - B\n- orphan\n- A again\n  - C\n    - Untitled\n"
    assert tree.nested_json(got, ["title"]).head().structure_json == '[{"title":"A","nodes":[{"title":"B"}]},{"title":"orphan"},{"title":"A again","nodes":[{"title":"C","nodes":[{}]}]}]'
    assert {(x.item_no, x.below) for x in tree.subtree_counts(got).collect()} == {(1, 1), (2, 0), (3, 0), (4, 2), (5, 1), (6, 0)}


def test_preface_and_ends(spark):
    rows = items(spark, [(1, 1, "1", "A", 3), (1, 2, "2", "B", 5), (2, 1, "1", "A", 1)]).withColumn("appear_start", F.when(F.col("item_no") == 2, "yes").otherwise("no"))
    counts = spark.createDataFrame([(1, 9), (2, 2)], "doc_id long, n_pages int")
    got = tree.end_pages(tree.with_preface(rows), counts).orderBy("doc_id", "item_no").collect()
    assert [(x.title, x.start_index, x.end_index) for x in got] == [("Preface", 1, 3), ("A", 3, 4), ("B", 5, 9), ("A", 1, 2)]


def test_contents(spark):
    flags = spark.createDataFrame([(1, i + 1, f) for i, f in enumerate(["no", "yes", "yes", "no", "yes", "no"])] + [(2, 1, "no")], "doc_id long, page_no int, toc_detected string")
    assert [tuple(x) for x in toc.runs(flags, 20).orderBy("run_no").collect()] == [(1, 1, 2, 3), (1, 2, 5, 5)]
    assert [tuple(x) for x in toc.first_run(flags, 2).collect()] == [(1, 2, 3)] and toc.runs(flags, 1).count() == 0
    content = spark.createDataFrame([(1, "1 Intro: 3\n1.1 Aim of it ..... 4\nAppendix\n\n2. End   9")], "doc_id long, toc_content string")
    assert [tuple(x)[2:] for x in toc.parse_lines(content).orderBy("item_no").collect()] == [("1", "Intro", 3), ("1.1", "Aim of it", 4), (None, "Appendix", None), ("2", "End", 9)]
    pairs = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 2, 4), (1, "c", 2, 5), (1, "d", 3, 6), (1, "e", -1, 9), (2, "a", None, 3)], "doc_id long, title string, page int, physical_index int")
    assert [tuple(x) for x in toc.page_offset(pairs).collect()] == [(1, 2)]


def test_verify_and_repair(spark):
    p = pages(spark, ["x", "Alpha one", "b", "Beta two", "Gamma three", "z"])
    rows = items(spark, [(1, 1, "1", "alpha one", 2), (1, 2, "2", "Beta  two", 3), (1, 3, "3", "gammaTHREE", 5), (1, 4, "4", "nowhere", 99), (1, 5, "5", "none", None)])
    counts = P.page_count(p)
    answers = verify.checked(rows, p)
    assert [x.answer for x in answers.orderBy("item_no").collect()] == ["yes", "no", "yes", "no", "no"]
    assert tuple(verify.accuracy(answers, counts).head()) == (1, 4, 2, 0.5)
    assert verify.decisions(verify.accuracy(answers, counts)).head().decision == "fix"
    fixed = {x.item_no: x.physical_index for x in verify.repaired(rows, p, counts).collect()}
    assert fixed == {1: 2, 2: 4, 3: 5, 4: 99, 5: None}
    assert [x.physical_index for x in verify.truncated(rows, counts).orderBy("item_no").collect()] == [2, 3, 5, None, None]


def test_section_tokens_and_texts(spark):
    p = pages(spark, ["a", "b b", "c c c", "d"])
    s = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 9), (1, 3, 3, 2), (1, 4, 4, 4)], "doc_id long, item_no int, start_index int, end_index int")
    assert [x.tokens for x in P.section_tokens(s, p).orderBy("item_no").collect()] == [3, 6, 0, 1]
    assert {x.item_no: x.text for x in P.section_text(s, p).collect()} == {1: "ab b", 2: "b bc c cd", 4: "d"}


def test_retrieval(spark):
    p = pages(spark, ["intro", "cats are here\nand more", "dogs run", "end"])
    s = spark.createDataFrame([(1, 0, 0, "About cats", 2, 2), (1, 1, 0, "About dogs", 3, 3), (1, 2, 1, "Cats and dogs", 2, 3)], "doc_id long, seq int, depth int, title string, start_index int, end_index int")
    q = spark.createDataFrame([(7, 1, "where are cats"), (8, 1, "unrelated")], "question_id long, doc_id long, question string")
    chosen = R.select_sections(q, s)
    assert [(x.question_id, x["rank"], x.title) for x in chosen.orderBy("rank").collect()] == [(7, 1, "About cats"), (7, 2, "Cats and dogs")]
    context = R.contexts(R.match_sections(chosen, s), p, q, s)
    got = {x.question_id: x for x in context.collect()}
    assert got[7].context.startswith("=== About cats ===\ncats are here\nand more\n\n") and got[7].sources == ["About cats", "Cats and dogs"]
    assert got[8].context.startswith("- About cats (pages 2-2)\n") and got[8].sources == []
    assert {x.question_id: x.answer for x in R.answers(context, q).collect()}[7] == "cats are here"


def test_build_index(spark):
    body = ["Contents\n1 First part ..... 1\n2 Second part ..... 3\n3 Third part ..... 4", "First part\nwords here.", "more.", "Second part\nof it.", "Third part\nthe end."]
    plain = ["Opening words of this\nlots", "text that ends.", "Closing words of this\nlots"]
    p = pages(spark, body, 1).unionByName(pages(spark, plain, 2))
    got = {x.doc_id: x for x in I.build_index(p, with_description=True).collect()}
    assert got[1].doc_description == "Preface; First part; Second part; Third part"
    assert '"title":"Second part","start_index":4,"end_index":4' in got[1].structure_json
    assert '"title":"Opening words of this","start_index":1' in got[2].structure_json


def test_split_large(spark):
    p = pages(spark, ["Whole book title"] + [f"Chapter number {k}\n" + "w " * 50 if k % 5 == 0 else "w " * 50 + "." for k in range(1, 30)])
    start = items(spark, [(1, 1, "1", "Whole book title", 1)])
    got = I.split_large(start, p, 10, 100, 3).orderBy("item_no").collect()
    assert [x.structure for x in got] == ["1"] + [f"1.{k}" for k in range(2, 7)] and got[1].title == "Chapter number 5"


def test_paths_of_any_depth(spark):
    chain = [(1, k + 1, ".".join(["1"] * (k + 1)), f"t{k}") for k in range(40)] + [(2, 1, "7", "a"), (2, 2, "7.1", "b"), (2, 3, "7", "c"), (2, 4, "7.1", "d"), (2, 5, "7.1.1", "e"), (2, 6, None, "f")]
    rows = spark.createDataFrame(chain, "doc_id long, item_no int, structure string, title string").repartition(3)
    got = {(x.doc_id, x.item_no): (x.parent_item, x.depth, x.path) for x in tree.paths(tree.code_parents(rows)).collect()}
    assert all(got[1, k + 1] == (k or None, k, list(range(1, k + 2))) for k in range(40))
    assert [got[2, k][2] for k in range(1, 7)] == [[1], [1, 2], [3], [3, 4], [3, 4, 5], [6]]
    nodes = tree.nested_json(tree.preorder(tree.paths(tree.code_parents(rows))), ["title"]).where("doc_id = 1").head().structure_json
    assert nodes.count("nodes") == 39


def test_contents_runs_of_any_length(spark):
    text = lambda k: "A one ..... 1\nB two ..... 2\nC three ..... 3" if 10 <= k < 120 else "plain text"
    pages = spark.createDataFrame([(d, k, text(k) if d == 1 else text(k) if k < 15 else "plain", 3) for d in (1, 2) for k in range(1, 200)], "doc_id long, page_no int, text string, token_count int")
    got = {x.doc_id: (x.first_page, x.last_page) for x in toc.runs(I.detected(pages, 20), 20).collect()}
    assert got == {1: (10, 119), 2: (10, 14)}


def test_encoded_token_counts(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    from folium import cli

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = ["", None, "Hello, world!", "Größe 12345 <|endoftext|>  two\n\nlines ", "x" * 500]
    pages = spark.createDataFrame([(1, k, t, -1) for k, t in enumerate(texts)], "doc_id long, page_no int, text string, token_count int")
    for pattern in (public.PATTERN, cli.PATTERN):
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        got = {x.page_no: x.token_count for x in P.with_token_counts(pages, public.path("byte_bpe_50k.tiktoken"), pattern).collect()}
        assert got == {k: len(encoder.encode_ordinary(t or "")) for k, t in enumerate(texts)}
