"""A language model behind an HTTP service that lists its models under /api/tags and answers under /api/generate."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How long the service may take to be found and to answer, and how many pieces of a reply it may make.
CONNECT_SECONDS, ANSWER_SECONDS, MOST_TOKENS, CONTEXT_TOKENS = 2.0, 180.0, 512, 4096
#: From a URL, a body or None, and seconds to the service's answer.
Fetch = Callable[[str, dict | None, float], dict]

PROMPT = """Name the personal data in the text below as one JSON object, and nothing else:
{{"entities": [{{"text": "...", "type": "..."}}]}}
type is one of PERSON, PHONE, EMAIL, IDCN, ADDRESS, DATE, HEALTH, TRACK, ACCOUNT, PASSWORD, URL, OTHER. text stands in
the text exactly so; each text is named once. Companies, schools, projects and subjects are no personal data.

{text}
"""


def fetch(url: str, body: dict | None, seconds: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=seconds) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class Probe:
    """Whether a service was found, the model it will be asked for (None: it has none like it), and the models it has."""

    reachable: bool
    model: str | None = None
    models: tuple[str, ...] = ()

    def problem(self, wanted: str, url: str) -> str | None:
        if not self.reachable:
            return f"no model service at {url}"
        if self.model is None:
            like = [m for m in self.models if m.split(":")[0][:4] == wanted[:4]][:3] or list(self.models[:5])
            return f"no model {wanted} at {url}; there are {', '.join(like) or 'none'}"
        return None


def probe(url: str, wanted: str, ask: Fetch = fetch) -> Probe:
    """What a service has. A model fits by its whole name, by a longer name that holds it, which is then asked for, or by the
    name before the version."""
    try:
        models = tuple(m.get("name", "") for m in ask(f"{url}/api/tags", None, CONNECT_SECONDS).get("models", []))
    except (OSError, ValueError):  # URLError is an OSError
        return Probe(False)
    for fits, name in ((lambda m: m == wanted, None), (lambda m: wanted in m, None), (lambda m: m.split(":")[0] == wanted.split(":")[0], wanted)):
        found = next((m for m in models if fits(m)), None)
        if found is not None:
            return Probe(True, name or found, models)
    return Probe(True, None, models)


def ensured(url: str, wanted: str, ask: Fetch = fetch) -> str:
    """The model to ask for; an error that says what is missing if there is none."""
    found = probe(url, wanted, ask)
    if problem := found.problem(wanted, url):
        raise RuntimeError(problem)
    return found.model or wanted


def asking(url: str, model: str, ask: Fetch = fetch) -> Callable[[Column], Column]:
    """A function from a column of pieces to the service's replies, for tokens.scanned(). Nulls and empty pieces aren't asked about."""

    @F.pandas_udf("string")
    def run(pieces: pd.Series) -> pd.Series:
        def one(piece):
            body = {"model": model, "prompt": PROMPT.format(text=piece), "stream": False, "options": {"temperature": 0.0, "num_ctx": CONTEXT_TOKENS, "num_predict": MOST_TOKENS}}
            return ask(f"{url}/api/generate", body, ANSWER_SECONDS).get("response", "")

        return pieces.map(lambda p: one(p) if p else None)

    return run
