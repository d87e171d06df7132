"""python -m folium.cli --pdf_path FILE | --md_path FILE [--out FOLDER] ...: the section index of files as JSON.

With --model, --base-url or LLM_BASE_URL a model decides about texts ("pool" as the model: the free endpoints whose keys the environment
has); without them rules do."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators.pages import with_token_counts
from .plans import index, reasoner
from .plans.rules import Model, Rules
from .sources import files, store

#: Fixed value: the public split pattern of the 100k vocabulary.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folium", description=__doc__)
    p.add_argument("--pdf_path")
    p.add_argument("--md_path")
    p.add_argument("--out", default="results")
    p.add_argument("--model")
    p.add_argument("--base-url", dest="base_url")
    p.add_argument("--num-ctx", dest="num_ctx")
    p.add_argument("--toc-check-pages", dest="toc_check_pages")
    p.add_argument("--max-pages-per-node", dest="max_pages_per_node")
    p.add_argument("--max-tokens-per-node", dest="max_tokens_per_node")
    p.add_argument("--if-add-node-id", dest="add_node_id")
    p.add_argument("--if-add-node-summary", dest="add_node_summary")
    p.add_argument("--if-add-doc-description", dest="add_doc_description")
    p.add_argument("--if-add-node-text", dest="add_node_text")
    p.add_argument("--if-thinning", dest="thinning", default="no")
    p.add_argument("--thinning-threshold", dest="thinning_threshold", type=int, default=5000)
    p.add_argument("--summary-token-threshold", dest="summary_token_threshold")
    p.add_argument("--token-ranks", dest="token_ranks", help="count tokens of pages by this file of BPE ranks")
    p.add_argument("--token-pattern", dest="token_pattern", default=PATTERN)
    return p


def rules_for(args: argparse.Namespace, c: config.Config, env: Mapping[str, str]) -> Rules:
    """Rules, or the model that the options or the environment name."""
    if not (args.model or args.base_url or env.get("LLM_BASE_URL", "").strip()):
        return index.RULES
    providers = reasoner.pool(env) if c.model == "pool" else [reasoner.provider(c.model, env, c.base_url)]
    return Model(reasoner.http(providers, num_ctx=c.num_ctx))


def main(argv: list[str] | None = None) -> int:
    args, _ = parser().parse_known_args(argv)
    if bool(args.pdf_path) == bool(args.md_path):
        print("one of --pdf_path and --md_path is needed", file=sys.stderr)
        return 2
    kinds = files.PDF if args.pdf_path else files.MARKDOWN
    if not (args.pdf_path or args.md_path).lower().endswith(kinds):
        print(f"the file must end in {' or '.join(kinds)}", file=sys.stderr)
        return 2
    c = config.load(vars(args))
    spark = SparkSession.builder.getOrCreate()
    rules = rules_for(args, c, os.environ)
    if args.md_path:
        docs = files.markdown_files(spark, args.md_path)
        thinning = args.thinning_threshold if config._flag(args.thinning) else None
        found = index.build_markdown_index(docs, thinning, c.add_node_text, c.add_node_id, c.add_node_summary, c.summary_token_threshold, c.add_node_summary and c.add_doc_description, rules)
        names = docs.select("doc_id", "doc_name")
    else:
        pages = files.pdf_pages(spark, args.pdf_path)
        if args.token_ranks:
            pages = with_token_counts(pages, args.token_ranks, args.token_pattern)
        names = pages.select("doc_id", "doc_name").distinct()
        found = index.build_index(pages.drop("doc_name"), c.max_pages_per_node, c.max_tokens_per_node, c.add_node_text, c.add_node_summary, c.add_doc_description, c.add_node_id, c.toc_check_pages, rules)
    store.write_results(found.join(names, "doc_id").orderBy(F.col("doc_name")), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
