"""Deterministic stand-ins for the models."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np

from loomdex.plans.models import Completion, ModelError


@dataclass
class StubClient:
    """Answers by the words of the prompt; see the tests for the cases."""

    agent_name: str
    model: str = "stub"

    def complete(self, agent, prompt, timeout_s):
        answer = getattr(self, "on_" + agent.name.lower())(prompt)
        return Completion(answer, len(prompt), len(answer))

    def on_cardgenerator(self, prompt):
        if "TRANSPORT" in prompt:
            raise ModelError("no connection", status=400)
        ids = re.findall(r"(?m)^\[([a-z0-9]+) \|", prompt)
        card = {
            "title": "Родник 45 — садовый насос 540 Вт",
            "description": "Насос для полива.",
            "characteristics": {"Мощность": "540 Вт"},
            "benefits": ["тихий"],
            "sources": [{"chunk_id": i, "page": 1} for i in ids[:1]],
            "confidence": 0.9,
        }
        if "FABRICATE" in prompt:
            card["sources"] = [{"chunk_id": "deadbeef0000"}]
        if "LONGTITLE" in prompt and "rejected" not in prompt:
            card["title"] = "x" * 61
        if "UNSURE" in prompt:
            card["confidence"] = 0.3
        return "Here is the card:\n```json\n" + json.dumps(card, ensure_ascii=False) + "\n```"

    def on_generator(self, prompt):
        card = {"title": "Card", "description": "Text.", "characteristics": {"a": "1"}, "confidence": 0.9}
        if "UNSURE" in prompt:
            card["confidence"] = 0.1
        if "BROKEN" in prompt:
            return "no object here"
        return json.dumps(card)

    def on_extractor(self, prompt):
        if "NOFACTS" in prompt:
            return "nothing"
        return json.dumps({"product_name": prompt[:40], "characteristics": {"a": "1"}, "missing_fields": []})

    def on_critic(self, prompt):
        if "NEVER" in prompt or ("SECOND" in prompt and "mark me" not in prompt):
            return json.dumps({"verdict": "regenerate", "issues": ["mark me"]})
        if "MUMBLE" in prompt:
            return "hm"
        return json.dumps({"verdict": "approve", "issues": []})

    def on_injectiondetector(self, prompt):
        if "MODELDOWN" in prompt:
            raise ModelError("bad request", status=400)
        return json.dumps({"injection": "HARMLESS" not in prompt, "reason": "steers the model"})

    def on_judge(self, prompt):
        if "JUDGEDOWN" in prompt:
            raise ModelError("down", status=400)
        return json.dumps({"faithfulness": 0.75, "reasons": []})


def make_client(agent):
    return StubClient(agent.name)


class HashEmbedder:
    """Deterministic stand-in: signed word hashes. For tests and dry runs."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        vectors = []
        for index, text in enumerate(texts):
            vector = np.zeros(self.dim)
            for word in re.findall(r"\w+", text.lower()):
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vector[int.from_bytes(digest[:4], "big") % self.dim] += 1 if digest[4] & 1 else -1
            vectors.append((index, vector.tolist()))
        return vectors
