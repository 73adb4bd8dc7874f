"""Language models behind HTTP: one client a provider, chosen by settings.

Calls of a batch run on a few threads at a time; a call that fails comes back as its exception.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from docloom.config import ConfigError, Settings
from docloom.models import Request

Transport = Callable[[str, dict, dict, float], dict]
DEFAULTS: Mapping[str, float] = {"temperature": 0.2, "top_p": 0.5, "max_tokens": 1024, "repeat_penalty": 1.1}
#: Sampling by task: structured answers are drawn without chance, summaries with some freedom.
BY_TASK: Mapping[str, Mapping[str, float]] = {
    "SUMMARY": {"temperature": 0.5, "max_tokens": 1000}, "SUMMARY_PART": {"temperature": 0.5, "max_tokens": 1000},
    **{t: {"temperature": 0.0, "top_p": 1.0, "repeat_penalty": 1.0} for t in ("CATEGORY_SUBCATEGORY", "DEPARTMENT_ASSIGNMENT", "BASE_EXTRACTION", "CHECK_CONFIDENTIAL")}}


def post_json(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


@dataclass
class _Client:
    base_url: str
    model: str
    options: Mapping[str, float] = field(default_factory=dict)
    timeout: float = 120.0
    parallel: int = 4
    transport: Transport = post_json

    def sampling(self, task: str) -> dict[str, float]:
        return {**DEFAULTS, **BY_TASK.get(task, {}), **self.options}

    def call(self, request: Request) -> str:
        raise NotImplementedError

    def _tried(self, request: Request) -> str | Exception:
        try:
            return self.call(request)
        except Exception as e:
            return e

    def answers(self, requests: Sequence[Request]) -> list[str | Exception]:
        with ThreadPoolExecutor(max(1, self.parallel)) as pool:
            return list(pool.map(self._tried, requests))


class LocalClient(_Client):
    """A generate endpoint that holds the answer to a JSON schema by itself."""

    def call(self, request: Request) -> str:
        o = self.sampling(request.task)
        body = {"model": self.model, "prompt": request.prompt, "system": request.system, "stream": False,
                "options": {"temperature": o["temperature"], "top_p": o["top_p"], "num_predict": int(o["max_tokens"]), "repeat_penalty": o["repeat_penalty"]}}
        if request.schema:
            body["format"] = json.loads(request.schema)
        return str(self.transport(f"{self.base_url}/api/generate", body, {}, self.timeout).get("response", "")).strip()


@dataclass
class HostedClient(_Client):
    """A chat endpoint with a key; it promises JSON only, so the schema is told in words."""

    api_key: str = ""
    project: str = ""

    def call(self, request: Request) -> str:
        o = self.sampling(request.task)
        system = request.system
        if request.schema:
            system = f"{system}\n\nOdpowiedz samym obiektem JSON zgodnym ze schematem:\n{request.schema}".strip()
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": request.prompt}],
                "temperature": o["temperature"], "top_p": o["top_p"], "max_tokens": int(o["max_tokens"]), "repetition_penalty": o["repeat_penalty"]}
        if self.project:
            body["project_id"] = self.project
        if request.schema:
            body["response_format"] = {"type": "json_object"}
        reply = self.transport(f"{self.base_url}/chat/completions", body, {"Authorization": f"Bearer {self.api_key}"}, self.timeout)
        return str(reply["choices"][0]["message"]["content"]).strip()


def client(settings: Settings, *, base_url: str, api_key: str = "", project: str = "", transport: Transport = post_json) -> _Client:
    """The client of the provider the settings name."""
    if not base_url:
        raise ConfigError("no address for the language model")
    if settings.provider == "hosted":
        if not api_key:
            raise ConfigError("a hosted model needs a key")
        return HostedClient(base_url.rstrip("/"), settings.model, transport=transport, api_key=api_key, project=project)
    return LocalClient(base_url.rstrip("/"), settings.model, transport=transport)
