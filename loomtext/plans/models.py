"""The model boundary: prompts in, cached answers out, cleaning after the cache.

A model call is opaque and may differ from run to run, so its answer is written to a cache
table, keyed by a hash of stage, model and prompt, before anything reads it. Parsing and
cleaning are pure expressions over the cached rows.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import api_url
from ..functions.text import content_key
from ..sources.sinks import exists


class Extractor(Protocol):
    """Answers prompts; name keys the cache. Must pickle, for it runs on executors."""

    name: str

    def answer(self, stage: str, prompts: list[str]) -> list[str | None]: ...


_CUES = {
    "say": r"\b(said|asked|told|replied|sagte|dit|dijo)\b|说|道",
    "see": r"\b(saw|looked|watched|sah|vit|vio)\b|看",
    "hear": r"\b(heard|listened|hörte)\b|听",
    "feel": r"\b(felt|sensed|fühlte)\b|感",
    "recall": r"\b(remembered|recalled)\b|想起",
    "reason": r"\b(thought|concluded|dachte)\b|推断",
}


@dataclass(frozen=True)
class Offline:
    """A deterministic extractor without any model: capitalised names, channels by cue words."""

    name: str = "offline"
    max_names: int = 12

    def names(self, text: str) -> list[str]:
        found = re.findall(r"(?<![.!?]\s)(?<!^)\b([A-Z][\w'-]{2,})\b", text)
        return sorted(dict.fromkeys(found), key=lambda n: (-found.count(n), found.index(n)))[: self.max_names]

    def one(self, stage: str, prompt: str) -> str:
        names = self.names(prompt)
        if stage in ("registry", "settings", "knowledge"):
            return json.dumps([{"name": n, "canonical": n, "aliases": [], "category": "人物", "definition": ""} for n in names], ensure_ascii=False)
        if stage == "scene":
            acts = []
            for s in re.split(r"(?<=[.!?。！？])\s*", prompt):
                who = next((n for n in names if n in s), None)
                if who:
                    channel = next((c for c, rx in _CUES.items() if re.search(rx, s)), "do")
                    acts.append({"type": "act", "channel": channel, "who": who, "content": s[:80], "scope": ["*"]})
            people = [{"name": n, "role": "主事" if i == 0 else "参与"} for i, n in enumerate(names)]
            return json.dumps({"who": people, "where": "", "actinfo": acts[:12], "notes": ""}, ensure_ascii=False)
        if stage == "bounds":
            return json.dumps({"starts": [int(i) for i in re.findall(r"^\[(\d+)\]", prompt, re.M)[10::10]]})
        if stage == "direct-settings":
            return json.dumps({"settings": [{"name": n, "type": "", "description": "", "related": []} for n in names]}, ensure_ascii=False)
        if stage in ("record", "round1", "round2"):
            first = (re.findall(r"^\[\d+\] (.*)", prompt, re.M) or [prompt])[0]
            people = [{"name": n, "role": "主事" if i == 0 else "参与"} for i, n in enumerate(names)]
            return json.dumps({"who": people, "what": first[:80], "summary": first[:120], "keywords": names, "beats": [{"anchor": first, "content": first[:80]}]}, ensure_ascii=False)
        return json.dumps({"summary": prompt[:120], "names": names}, ensure_ascii=False)

    def answer(self, stage: str, prompts: list[str]) -> list[str | None]:
        return [self.one(stage, p) for p in prompts]


@dataclass(frozen=True)
class Http:
    """A chat end point in one of four protocols, with retries and growing pauses."""

    name: str
    base: str
    protocol: str = "openai"  # openai, ollama, anthropic or google
    key: str = field(default="", repr=False)
    timeout: float = 120
    retries: int = 6
    system: str = "Answer with JSON only."

    def request(self, prompt: str) -> tuple[str, dict, dict]:
        """(url, headers, body) of one call."""
        chat = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        if self.protocol == "ollama":
            return f"{self.base.rstrip('/')}/api/chat", {}, {"model": self.name, "messages": chat, "stream": False, "format": "json"}
        if self.protocol == "anthropic":
            head = {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
            return f"{self.base.rstrip('/')}/v1/messages", head, {"model": self.name, "system": self.system, "max_tokens": 2048, "messages": chat[1:]}
        if self.protocol == "google":
            url = f"{self.base.rstrip('/')}/v1beta/models/{self.name}:generateContent"
            return url, {"x-goog-api-key": self.key}, {"contents": [{"parts": [{"text": prompt}]}], "systemInstruction": {"parts": [{"text": self.system}]}}
        return api_url(self.base), {"Authorization": f"Bearer {self.key}"}, {"model": self.name, "messages": chat}

    def text(self, body: dict) -> str | None:
        try:
            if self.protocol == "ollama":
                return body["message"]["content"]
            if self.protocol == "anthropic":
                return body["content"][0]["text"]
            if self.protocol == "google":
                return body["candidates"][0]["content"]["parts"][0]["text"]
            return body["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            return None

    def answer(self, stage: str, prompts: list[str], send: Callable | None = None, wait: Callable[[float], None] = time.sleep) -> list[str | None]:
        return [self._one(p, send or self._send, wait) for p in prompts]

    def _send(self, url: str, headers: dict, body: dict) -> dict:
        data = json.dumps(body).encode()
        call = urllib.request.Request(url, data, {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(call, timeout=self.timeout) as r:
            return json.load(r)

    def _one(self, prompt: str, send: Callable, wait: Callable[[float], None]) -> str | None:
        url, headers, body = self.request(prompt)
        for attempt in range(self.retries):
            try:
                return self.text(send(url, headers, body))
            except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
                if attempt + 1 < self.retries:
                    wait(min(60, 2**attempt))
        return None


CACHE_SCHEMA = "key string, model string, answer string"


def answers(spark: SparkSession, prompts: DataFrame, stage: str, model: Extractor, cache: str, *, parallel: int = 4, batch: int = 64) -> DataFrame:
    """prompts (id, prompt) with answer, read back from the cache table.

    Only prompts without a cached answer are sent, each distinct one once, by at most
    `parallel` tasks. Failed calls stay out of the cache and are tried again next time.

    Each stage has a folder of its own: writers that append to one folder at once would
    delete each other's unfinished files, and a plan that reads one folder before and after
    a write could take the first reading for both.
    """
    cache = f"{cache}/stage={stage}"
    keyed = prompts.withColumn("key", content_key(F.lit(f"{stage}\x1f{model.name}"), F.col("prompt")))
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    todo = keyed.select("key", "prompt").dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti")
    name = model.name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = model.answer(stage, part["prompt"].tolist())
                out = pd.DataFrame({"key": part["key"].tolist(), "model": name, "answer": got})
                yield out[out["answer"].notna()]

    todo.repartition(parallel).mapInPandas(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return keyed.join(spark.read.schema(CACHE_SCHEMA).parquet(cache).select("key", "answer").dropDuplicates(["key"]), "key", "left").drop("key")
