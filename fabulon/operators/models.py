"""Models as plain objects: a scoring model that is fitted and kept as JSON, providers of answers, their accounting and repair."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The scored features, their weights and the bias from which fits begin.
WEIGHTS = {"surface_similarity": 1.2, "context_embedding_similarity": 2.0, "speech_partner_compatibility": 1.5, "temporal_validity": 1.0, "first_attested_soft_prior": 0.4}
BIAS = -4.0
#: Surfaces less similar than this score nothing.
FLOOR = 0.80


@dataclass
class ScoringModel:
    """Weights, bias and the Platt parameters of a probability."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bias: float = BIAS
    platt_a: float = 1.0
    platt_b: float = 0.0

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loads(text: str) -> ScoringModel:
        return ScoringModel(**json.loads(text))

    def without(self, *features: str) -> ScoringModel:
        """The model with the named weights at nought."""
        return ScoringModel({k: 0.0 if k in features else w for k, w in self.weights.items()}, self.bias, self.platt_a, self.platt_b)


def logistic_fit(examples: DataFrame, model: ScoringModel | None = None, correct: str = "correct", epochs: int = 200, rate: float = 0.1, l2: float = 0.01) -> ScoringModel:
    """A model fitted by full-batch gradient descent from the given weights: each step's gradient is one aggregate over all examples.

    Examples are read `epochs` times; they are cached by nobody but the caller. Without examples the model comes back as it was.
    """
    model = model or ScoringModel()
    names = list(model.weights)
    w, b = np.array([model.weights[n] for n in names]), model.bias
    n = examples.count()
    rows = examples.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], F.col(correct).cast("double").alias("_y"))
    for _ in range(epochs if n else 0):
        scored = lambda c: F.when(F.col(c) >= FLOOR, F.col(c)).otherwise(0.0) if c == "surface_similarity" else F.col(c)
        z = sum((scored(c) * float(x) for c, x in zip(names, w, strict=True)), F.lit(float(b)))
        e = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))) - F.col("_y")
        g = rows.agg(*[F.sum(e * F.col(c)).alias(c) for c in names], F.sum(e).alias("_b")).first()
        w = w - rate * (np.array([g[c] for c in names]) / n + l2 * w)
        b = b - rate * g["_b"] / n
    return ScoringModel(dict(zip(names, map(float, w), strict=True)), float(b), model.platt_a, model.platt_b)


# -- answers in JSON -----------------------------------------------------------------------------


def _balanced(text: str) -> str | None:
    """The first object of a text whose braces close, or null."""
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if inside:
            escaped, inside = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def closed_json(text: str) -> str | None:
    """A truncated object or array with what is open closed; the least is cut off at its end that makes it valid. Null if nothing does."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    text = text[start:]
    for end in range(len(text), max(0, len(text) - 200), -1):
        part, stack, inside, escaped = text[:end], [], False, False
        for c in part:
            if inside:
                escaped, inside = c == "\\" and not escaped, c != '"' or escaped
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        whole = (part[:-1] if escaped else part) + '"' * inside
        for tail in (whole, whole.rstrip().rstrip(",:")):
            if _valid(tail + "".join(reversed(stack))):
                return tail + "".join(reversed(stack))
    return None


def extract_json(text: str) -> str | None:
    """The JSON of a model's answer: the text itself, a fenced block, the first balanced object, else the closed rest; null if there is none."""
    bare = text.strip()
    if bare[:1] in ("{", "[") and _valid(bare):
        return bare
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    if fenced and _valid(fenced[1].strip()):
        return fenced[1].strip()
    found = _balanced(text)
    return found if found is not None and _valid(found) else closed_json(text)


def listed_json(text: str) -> str:
    """A list of `key: value` lines as JSON: keys in lower case, quoted values as they are, several as an array."""
    out: dict[str, object] = {}
    for line in text.splitlines():
        m = re.match(r"^\s*[-*•]?\s*[`*]*([\w ]+?)[`*]*\s*:\s*(.+)$", line)
        if m:
            raw, quoted = m[2].strip().rstrip(","), re.findall(r'"([^"]*)"', m[2])
            out[m[1].strip().lower().replace(" ", "_")] = quoted if raw.startswith("[") or len(quoted) > 1 else quoted[0] if quoted else raw.strip('"')
    return json.dumps(out)


# -- providers -----------------------------------------------------------------------------------

#: A provider answers a prompt with text, or fails.
Provider = Callable[[str], str]


def stub(fields: dict[str, object]) -> Provider:
    """A provider that gives every field its neutral value, whatever it is asked."""
    return lambda prompt: json.dumps(fields)


def default_confidence(answer: dict) -> float:
    """What an answer says of its confidence, between 0 and 1; 1 if it says nothing."""
    value = answer.get("confidence", 1.0)
    return min(1.0, max(0.0, float(value))) if isinstance(value, int | float) else 1.0


def routed(prompt: str, local: Provider | None, large: Provider | None, least: float = 0.75, most: int = 5000, used: int = 0, confidence: Callable[[dict], float] = default_confidence) -> tuple[dict | None, list[dict]]:
    """(answer, calls): the local provider's answer if it parses and is sure enough, else the large one's, while escalations are under `most`.

    Every attempt is a row of the calls: tier, ok, escalated, escalation_reason.
    """
    calls, reason, kept = [], "LOCAL_UNAVAILABLE", None
    if local is not None:
        try:
            text = extract_json(local(prompt))
        except Exception:  # a provider may fail in any way
            text = None
        kept = json.loads(text) if text else None
        reason = "LOCAL_PARSE_FAILURE" if kept is None else None if confidence(kept) >= least else "LOW_CONFIDENCE"
        calls.append({"tier": "LOCAL", "ok": kept is not None, "escalated": False, "escalation_reason": None})
        if reason is None:
            return kept, calls
    if large is None or used >= most:
        calls.append({"tier": "LARGE", "ok": False, "escalated": False, "escalation_reason": "BUDGET_EXHAUSTED" if used >= most else reason})
        return kept, calls
    try:
        text = extract_json(large(prompt))
    except Exception:
        text = None
    calls.append({"tier": "LARGE", "ok": text is not None, "escalated": True, "escalation_reason": reason})
    return (json.loads(text) if text else kept), calls


def adjudicated(cases: DataFrame, answers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cases (case, candidates array of ids) as a model decides: rows (case, decision, target_id); LINK counts only to one of the candidates, all else is NEW."""
    said = answers(cases).join(cases.select("case", "candidates"), "case")
    link = (F.col("decision") == "LINK") & F.array_contains("candidates", F.col("target_id"))
    return said.select("case", F.when(link, "LINK").otherwise("NEW").alias("decision"), F.when(link, F.col("target_id")).alias("target_id"))
