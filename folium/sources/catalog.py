"""Static tables: the models that answers may come from, and where they are served."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_URL = "http://localhost:11434/v1/chat/completions"
OPENAI_URL = "https://api.openai.com/v1/chat/completions"
GROQ_URL = "https://api.groq.com/openai/v1/chat/completions"
GEMINI_URL = "https://generativelanguage.googleapis.com/v1beta/openai/chat/completions"
CEREBRAS_URL = "https://api.cerebras.ai/v1/chat/completions"
MISTRAL_URL = "https://api.mistral.ai/v1/chat/completions"
#: (tier, id, name, description, url): the served models, and below them two of ours; a catalogue of one's own is a table of the same columns.
MODELS = [
    ("free", "gemma3:1b", "Gemma 3 1B", "Ultra-fast · ~1 GB RAM", LOCAL_URL),
    ("free", "qwen2.5:3b", "Qwen 2.5 3B", "Balanced speed & quality · ~2 GB RAM", LOCAL_URL),
    ("free", "qwen2.5:7b", "Qwen 2.5 7B", "Strong reasoning · ~5 GB RAM", LOCAL_URL),
    ("free", "llama3.2", "Llama 3.2", "Meta's open-weight model", LOCAL_URL),
    ("free", "mistral", "Mistral 7B", "Efficient instruction-following", LOCAL_URL),
    ("free-cloud", "llama-3.3-70b-versatile", "Llama 3.3 70B (Groq)", "Fastest free inference · groq.com", GROQ_URL),
    ("free-cloud", "gemma2-9b-it", "Gemma 2 9B (Groq)", "Google model via Groq · groq.com", GROQ_URL),
    ("free-cloud", "mixtral-8x7b-32768", "Mixtral 8x7B (Groq)", "Large context · groq.com", GROQ_URL),
    ("free-cloud", "llama-3.1-8b-instant", "Llama 3.1 8B (Groq)", "Ultra-fast small model · groq.com", GROQ_URL),
    ("free-cloud", "gemini-2.0-flash", "Gemini 2.0 Flash", "Google's fastest · aistudio.google.com", GEMINI_URL),
    ("free-cloud", "gemini-1.5-flash", "Gemini 1.5 Flash", "Google's reliable · aistudio.google.com", GEMINI_URL),
    ("free-cloud", "cerebras-llama-3.3-70b", "Llama 3.3 70B (Cerebras)", "Very fast inference · cerebras.ai", CEREBRAS_URL),
    ("free-cloud", "mistral-small-latest", "Mistral Small", "Efficient · console.mistral.ai", MISTRAL_URL),
    ("free-cloud", "open-mistral-nemo", "Mistral Nemo", "12B open model · console.mistral.ai", MISTRAL_URL),
    ("paid", "gpt-4o-mini", "GPT-4o Mini", "Fast · cost-effective", OPENAI_URL),
    ("paid", "gpt-4o", "GPT-4o", "High capability", OPENAI_URL),
    ("paid", "gpt-4-turbo", "GPT-4 Turbo", "Most capable GPT-4", OPENAI_URL),
    ("paid", "gpt-4o-2024-11-20", "GPT-4o", "Hosted, general purpose", OPENAI_URL),
    ("free", "llama3.1:8b", "Llama 3.1 8B", "Local, 16 GB of memory", LOCAL_URL),
]
#: What a provider calls a model of the catalogue, where that is another name.
API_IDS = {"cerebras-llama-3.3-70b": "llama3.3-70b"}
#: Which variable of the environment has the key of an endpoint, told by a part of its address; another endpoint takes the last.
KEYS = {"groq.com": "GROQ_API_KEY", "googleapis.com": "GOOGLE_API_KEY", "cerebras.ai": "CEREBRAS_API_KEY", "mistral.ai": "MISTRAL_API_KEY", "openrouter.ai": "OPENROUTER_API_KEY", "": "CHATGPT_API_KEY"}
#: The models of a pool of free endpoints.
POOL = ("llama-3.3-70b-versatile", "llama-3.1-8b-instant", "cerebras-llama-3.3-70b", "mistral-small-latest", "gemini-2.0-flash")
LOCAL_MODEL, NO_KEY = "qwen2.5:7b", "local"


def url_of(model: str | None) -> str:
    """Where a model is served; unknown ones are local."""
    return {m[1]: m[4] for m in MODELS}.get(model, LOCAL_URL)


def api_id(model: str) -> str:
    return API_IDS.get(model, model)


def key_of(url: str, env: Mapping[str, str]) -> str:
    """The key of an endpoint, or ``NO_KEY`` where the environment has none."""
    name = next(name for part, name in KEYS.items() if part in url)
    return env.get(name, "").strip() or NO_KEY


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "tier string, id string, name string, description string, url string")


def with_api_id(requests: DataFrame, model: str = "model") -> DataFrame:
    """Requests with ``api_id``: what the provider of their model calls it."""
    names = F.create_map(*[F.lit(x) for pair in API_IDS.items() for x in pair])
    return requests.withColumn("api_id", F.coalesce(F.try_element_at(names, F.col(model)), F.col(model)))


def with_url(requests: DataFrame, model: str = "model", catalogue: DataFrame | None = None) -> DataFrame:
    """Requests with the ``url`` of their model in a catalogue (``models`` unless given); unknown models are local.  A catalogue has
    a row a model, so Spark broadcasts it where it finds it small."""
    urls = models(requests.sparkSession) if catalogue is None else catalogue
    urls = urls.select(F.col("id").alias(model), "url")
    return requests.join(F.broadcast(urls) if catalogue is None else urls, model, "left").withColumn("url", F.coalesce("url", F.lit(LOCAL_URL)))
