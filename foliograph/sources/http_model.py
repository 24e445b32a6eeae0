"""A model behind HTTP chat-completion and embedding endpoints, usable wherever ``OfflineModel`` is."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from foliograph.operators.models import ContextOverflow


def post_json(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.loads(response.read())


class EmbeddingUnavailable(Exception):
    """The embedding service failed or gave no vector."""


@dataclass(frozen=True)
class HttpModel:
    """Client settings; picklable, so every task calls the service on its own.

    A refused request (400) means the input does not fit. Server errors are retried after 3, 6,
    ... seconds. ``post`` sends one request and can be replaced.
    """

    chat_url: str
    embed_url: str = ""
    model: str = "default"
    embed_model: str = "default"
    timeout: float = 300.0
    retries: int = 2
    wait_seconds: float = 3.0
    post: Callable[[str, dict, float], dict] = post_json

    def chat(self, prompt: str, system: str = "", max_tokens: int = 4096, temperature: float = 0.3, keep_thinking: bool = False) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        for attempt in range(self.retries + 1):
            try:
                reply = self.post(f"{self.chat_url}/v1/chat/completions", body, self.timeout)
            except urllib.error.HTTPError as e:
                if e.code == 400:
                    raise ContextOverflow from None
                if attempt == self.retries:
                    raise
                time.sleep(self.wait_seconds * (attempt + 1))
                continue
            text = reply["choices"][0]["message"]["content"]
            if keep_thinking:
                return text
            return re.sub(r"<think>[\s\S]*?(?:</think>|$)", "", text).strip()
        raise AssertionError("unreachable")

    def extract(self, text: str, chunk: int, total: int) -> str:
        return self.chat(
            f"Section {chunk} of {total} of a document follows. Answer with one JSON object only, with the keys title, "
            "summary, key_claims (list of strings with their numbers), entities and concepts (lists of objects with name, "
            "type and a one-sentence description). Entity types: person, organization, tool, dataset, model, benchmark. "
            "Concept types: method, theory, framework, pattern, metric, technique, algorithm, architecture. "
            f"List everything that is named.\n\n{text}",
            max_tokens=2048, temperature=0.2,
        )

    def judge(self, name_a: str, type_a: str, desc_a: str, name_b: str, type_b: str, desc_b: str) -> str:
        return self.chat(
            "Do these two entries mean the same real thing? Answer with one word: same, different or unsure.\n"
            f"1: {name_a} ({type_a}): {desc_a}\n2: {name_b} ({type_b}): {desc_b}",
            max_tokens=16, temperature=0.0,
        )

    def rewrite(self, title: str, name: str, type_: str, description: str, context: str) -> str:
        return self.chat(
            f'In "{title}", {name} ({type_}) is described only as: {description}\nSay in one concrete sentence what it is, '
            f"using the text below, or answer unknown.\n\n{context}",
            max_tokens=120, temperature=0.1,
        )

    def overview(self, title: str, summaries: list[str], entities: list[str], concepts: list[str]) -> str:
        parts = "\n\n".join(f"Part {i}: {s}" for i, s in enumerate(summaries, 1))
        return self.chat(
            f'Write a coherent overview of "{title}" in three or four paragraphs from these part summaries.\n\n{parts}\n\n'
            f"Entities: {', '.join(entities)}\nConcepts: {', '.join(concepts)}",
            max_tokens=2048, temperature=0.4,
        )

    def route(self, question: str, context: str) -> str:
        return self.chat(
            f"{context}Question: {question}", max_tokens=200, temperature=0.0, keep_thinking=True,
            system="Choose how to answer: RETRIEVE (from the wiki), DIRECT (general knowledge), HYBRID (both) or REFUSE. "
            "Answer with the label only.",
        )

    def answer(self, question: str, context: str, history: str, route: str) -> str:
        rule = {
            "RETRIEVE": "Answer from the pages below only, cite pages as [[name]], and say so if they do not hold the answer.",
            "HYBRID": "Answer from the pages below, cited as [[name]], and mark what you add as '[General knowledge]'.",
        }.get(route, "Answer clearly and briefly.")
        pages = f"\n\n{context}" if context else ""
        return self.chat(f"{rule}{pages}\n\n{history}Question: {question}", max_tokens=8192, temperature=0.4)

    def embed(self, text: str) -> list[float]:
        for attempt in range(self.retries + 1):
            try:
                reply = self.post(f"{self.embed_url}/v1/embeddings", {"model": self.embed_model, "input": text}, self.timeout)
            except Exception as e:
                if attempt == self.retries:
                    raise EmbeddingUnavailable(str(e)) from e
                time.sleep(0.5 * (attempt + 1))
                continue
            listed = reply.get("data") or [{}]
            vector = listed[0].get("embedding") or reply.get("embedding")
            if not vector:
                raise EmbeddingUnavailable("no vector in the reply")
            return vector
        raise AssertionError("unreachable")
