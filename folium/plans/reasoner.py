"""The boundary to a language model: prompts in, completions out.

Prompts are rows (op, prompt).  Equal prompts are asked once, prompts in the cache not at all; what is left is dealt to a set
number of tasks before the backend, so that paid calls neither repeat nor crowd.  Rules that need no model are columns in
the operators; the backends here are ``replay`` (completions from a table) and ``http`` (a chat endpoint).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import catalog
from .lineage import cut

COMPLETION = "prompt_hash string, content string, finish_reason string"
Backend = Callable[[DataFrame], DataFrame]


def hashed(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_hash", F.sha2(F.concat_ws("\n", "op", "prompt"), 256))


def complete(prompts: DataFrame, backend: Backend, cache: DataFrame | None = None, tasks: int = 8) -> DataFrame:
    """prompts with ``content`` and ``finish_reason``; null and blank prompts meet no model and get no content."""
    rows = hashed(prompts)
    asked = rows.where(F.length(F.trim("prompt")) > 0).select("prompt_hash", "op", "prompt").dropDuplicates(["prompt_hash"])
    if cache is not None:
        asked = asked.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")
    fresh = cut(backend(asked.repartition(tasks)), "completions")
    known = fresh if cache is None else fresh.unionByName(cache.select("prompt_hash", "content", "finish_reason"))
    return rows.join(known, "prompt_hash", "left")


def replay(completions: DataFrame) -> Backend:
    """Completions from rows (op, prompt, content); other prompts fail."""
    known = hashed(completions).select("prompt_hash", "content")

    def run(asked: DataFrame) -> DataFrame:
        rows = asked.join(known, "prompt_hash", "left")
        return rows.select("prompt_hash", "content", F.when(F.col("content").isNull(), "error").otherwise("finished").alias("finish_reason"))

    return run


@dataclass(frozen=True)
class Provider:
    url: str
    model: str
    api_key: str = "local"


def provider(model: str, env: Mapping[str, str], base_url: str | None = None) -> Provider:
    """Where to ask a model: the given address, else that of LLM_BASE_URL, else the catalogue's."""
    url = (base_url or "").strip() or env.get("LLM_BASE_URL", "").strip() or catalog.url_of(model)
    return Provider(url, catalog.api_id(model), catalog.key_of(url, env))


def pool(env: Mapping[str, str]) -> list[Provider]:
    """The free endpoints whose keys the environment has, a local one if it has none."""
    found = [provider(m, {k: v for k, v in env.items() if k != "LLM_BASE_URL"}) for m in catalog.POOL]
    return [p for p in found if p.api_key != catalog.NO_KEY] or [Provider(catalog.LOCAL_URL, catalog.LOCAL_MODEL)]


def read_timeout(url: str) -> float:
    """Local endpoints take their time."""
    return 300.0 if ":11434" in url else 120.0


def body(provider: Provider, prompt: str, num_ctx: int | None = None, history: list[dict] = ()) -> dict:
    found = {"model": provider.model, "temperature": 0, "messages": [*history, {"role": "user", "content": prompt}]}
    if num_ctx and ":11434" in provider.url:
        found["options"] = {"num_ctx": num_ctx}
    return found


def post(provider: Provider, prompt: str, timeout: float, num_ctx: int | None = None) -> tuple[str, str]:
    request = urllib.request.Request(provider.url, json.dumps(body(provider, prompt, num_ctx)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {provider.api_key}"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        choice = json.load(reply)["choices"][0]
    return choice["message"]["content"], "max_output_reached" if choice.get("finish_reason") == "length" else "finished"


def http(providers: list[Provider], tries: int = 3, wait: float = 1.0, timeout: float | None = None, num_ctx: int | None = None) -> Backend:
    """Asks chat endpoints in turn: each task starts with another provider, a busy one (429) passes on to the next, other failures are
    tried again after a wait; at the end content is null and the reason "error"."""

    def run(asked: DataFrame) -> DataFrame:
        import pyarrow as pa

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at = TaskContext.get().partitionId()
            for batch in batches:
                out = []
                for prompt in batch.column(1).to_pylist():
                    content, reason, failed, busy = None, "error", 0, 0
                    while failed < tries and busy < len(providers):
                        try:
                            to = providers[at % len(providers)]
                            content, reason = post(to, prompt, timeout or read_timeout(to.url), num_ctx)
                            break
                        except urllib.error.HTTPError as e:
                            if e.code == 429:
                                busy += 1
                                at += 1
                                continue
                            failed += 1
                        except (OSError, ValueError, KeyError, IndexError):
                            failed += 1
                        time.sleep(wait)
                    at += 1
                    out.append((content, reason))
                yield pa.RecordBatch.from_pydict({"prompt_hash": batch.column(0), "content": pa.array([c for c, _ in out], pa.string()), "finish_reason": pa.array([r for _, r in out], pa.string())})

        return asked.select("prompt_hash", "prompt").mapInArrow(ask, COMPLETION)

    return run
