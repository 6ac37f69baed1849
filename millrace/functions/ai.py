"""Language-model functions.

Each calls ``model()``, a function from prompts to answers that the session sets: a client of an endpoint, run in
Arrow batches on executors. Without one a deterministic offline stand-in answers from words alone, so that
queries run and can be tested; it is no language model.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import batch_udf, ColumnOrName, col, function
from .vectors import vector_cosine_similarity

#: Words of the offline stand-in's sentiment.
GOOD = frozenset("good great excellent happy love best nice wonderful fast easy".split())
BAD = frozenset("bad terrible awful sad hate worst poor slow broken hard".split())
_WORD = re.compile(r"\w+")

Model = Callable[[list[dict]], list[str | None]]


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def offline(requests: list[dict]) -> list[str | None]:
    """Answers of the stand-in. A request has ``task``, ``text`` and options."""
    out: list[str | None] = []
    for r in requests:
        text, task = r["text"], r["task"]
        words = _words(text)
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
        score = sum(w in GOOD for w in words) - sum(w in BAD for w in words)
        if task == "sentiment":
            out.append(str(max(-1.0, min(1.0, score / 3))))
        elif task == "summarize":
            out.append(" ".join(sentences[:2]))
        elif task == "answer":
            asked = set(_words(r["question"]))
            best = max(sentences, key=lambda s: len(asked & set(_words(s))), default="")
            out.append(best)
        elif task == "classify":
            labels = r["labels"]
            out.append(max(labels, key=lambda x: (sum(w in words for w in _words(x)), -labels.index(x))) if labels else None)
        elif task == "filter":
            out.append(str(bool(set(_words(r["prompt"])) & set(words))).lower())
        else:
            out.append(text)
    return out


_model: list[Model] = [offline]


def set_model(model: Model) -> None:
    """The model that columns built from now on call; it must pickle."""
    _model[0] = model


def _ask(task: str, text: ColumnOrName, more: dict | None = None, type_: str = "string", read=lambda x: x, tolerant: bool = False) -> Column:
    model, options = _model[0], more or {}

    @batch_udf(type_)
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None]
        try:
            answers = model([{"task": task, "text": texts.iloc[i]} | options for i in at])
        except Exception:
            if not tolerant:
                raise
            answers = [None] * len(at)
        for i, a in zip(at, answers, strict=True):
            out[i] = None if a is None else read(a)
        return pd.Series(out, dtype=object)

    return run(col(text).cast("string"))


@function("COMPLETE", "AI_COMPLETE")
def complete(prompt: ColumnOrName, model: str = "default") -> Column:
    return _ask("complete", prompt, {"model": model})


@function("TRY_COMPLETE")
def try_complete(prompt: ColumnOrName, model: str = "default") -> Column:
    return _ask("complete", prompt, {"model": model}, tolerant=True)


@function()
def sentiment(text: ColumnOrName) -> Column:
    """-1 to 1."""
    return _ask("sentiment", text, type_="double", read=float)


def _mood(x: float) -> str:
    return "positive" if x > 0.2 else "negative" if x < -0.2 else "neutral"


@function()
def ai_sentiment(text: ColumnOrName) -> Column:
    return _ask("sentiment", text, read=lambda a: json.dumps({"categories": [{"name": "overall", "sentiment": _mood(float(a))}]}))


@function()
def entity_sentiment(text: ColumnOrName, entities: list[str]) -> Column:
    return _ask("sentiment", text, {"entities": entities}, read=lambda a: json.dumps({e: _mood(float(a)) for e in entities}))


@function("SUMMARIZE", "AI_SUMMARIZE")
def summarize(text: ColumnOrName) -> Column:
    return _ask("summarize", text)


@function("AI_TRANSLATE")
def ai_translate(text: ColumnOrName, source: str, target: str) -> Column:
    return _ask("translate", text, {"from": source, "to": target})


@function()
def extract_answer(text: ColumnOrName, question: str) -> Column:
    return _ask("answer", text, {"question": question})


@function("CLASSIFY_TEXT", "AI_CLASSIFY")
def classify_text(text: ColumnOrName, labels: list[str]) -> Column:
    return _ask("classify", text, {"labels": labels}, read=lambda a: json.dumps({"label": a}))


@function()
def ai_filter(text: ColumnOrName, prompt: str) -> Column:
    return _ask("filter", text, {"prompt": prompt}, type_="boolean", read=lambda a: a.strip().lower() == "true")


@function("COUNT_TOKENS", "AI_COUNT_TOKENS")
def count_tokens(text: ColumnOrName, model: str = "default") -> Column:
    """Words and single punctuation marks: an estimate that needs no vocabulary."""
    return F.regexp_count(col(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def embed(text: str, n: int) -> list[float]:
    """Signed feature hashing of words and word pairs, of unit length: the stand-in for an embedding model."""
    words = _words(text)
    v = [0.0] * n
    for t in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        v[h % n] += 1.0 if h >> 63 else -1.0
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


def _embed(n: int):
    @batch_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else embed(x, n) for x in s], dtype=object)

    def build(text: ColumnOrName, model: str = "default") -> Column:
        return run(col(text))

    return build


embed_text_768 = function("EMBED_TEXT_768")(_embed(768))
embed_text_1024 = function("EMBED_TEXT_1024", "AI_EMBED")(_embed(1024))


@function()
def ai_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return vector_cosine_similarity(embed_text_768(a), embed_text_768(b))


def fold(model: Model, request: dict, texts: list[str], most_chars: int) -> str | None:
    """One answer for all texts: bounded chunks of them are answered, then the answers, until one is left.

    A text longer than a chunk is several. Answers that aren't shorter than what they answer can't be folded any
    further: those of that round are joined.
    """
    while True:
        pieces = [t[i : i + most_chars] for t in texts for i in range(0, max(1, len(t)), most_chars)]
        chunks: list[str] = []
        for p in pieces:
            if chunks and len(chunks[-1]) + 1 + len(p) <= most_chars:
                chunks[-1] += "\n" + p
            else:
                chunks.append(p)
        answers = model([request | {"text": c} for c in chunks or [""]])
        if len(answers) == 1:
            return answers[0]
        said = [x for x in answers if x is not None]
        if sum(map(len, said)) >= sum(map(len, chunks)):
            return "\n".join(said)
        texts = said


def _ask_all(task: str, text: ColumnOrName, more: dict, most_chars: int) -> Column:
    model, request = _model[0], {"task": task} | more

    @batch_udf("string")
    def run(groups: pd.Series) -> pd.Series:
        return pd.Series([fold(model, request, list(g), most_chars) for g in groups], dtype=object)

    return run(F.array_sort(F.collect_list(col(text).cast("string"))))


@function("AI_AGG")
def ai_agg(text: ColumnOrName, prompt: str, most_chars: int = 200_000) -> Column:
    """One answer for a group, to which all its texts count, sorted; ``most_chars``: what one prompt may hold. A group's
    texts meet in one task."""
    return _ask_all("complete", text, {"prompt": prompt}, most_chars)


@function("AI_SUMMARIZE_AGG")
def ai_summarize_agg(text: ColumnOrName, most_chars: int = 200_000) -> Column:
    """A summary of a group's texts, as ``ai_agg``."""
    return _ask_all("summarize", text, {}, most_chars)


def split_recursive(text: str, size: int, overlap: int = 0, separators: list[str] | None = None) -> list[str]:
    """Chunks of at most ``size`` characters: parts by the first separator that the text has, merged again."""
    seps = ["\n\n", "\n", " ", ""] if separators is None else separators
    sep = next((s for s in seps if s == "" or s in text), "")
    later = seps[seps.index(sep) + 1 :] if sep in seps else []
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    held: list[str] = []
    width = lambda xs: sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)

    def close() -> None:
        if held and (chunk := sep.join(held).strip()):
            out.append(chunk)

    for p in parts:
        if len(p) > size:
            close()
            held.clear()
            out += split_recursive(p, size, overlap, later) if later else [p]
            continue
        if held and width([*held, p]) > size:
            close()
            while held and (width(held) > overlap or width([*held, p]) > size):
                held.pop(0)
        held.append(p)
    close()
    return out


@function()
def split_text_recursive_character(text: ColumnOrName, format: str = "none", size: int = 512, overlap: int = 0, separators: list[str] | None = None) -> Column:
    seps = ["\n# ", "\n## ", "\n### ", "\n\n", "\n", " ", ""] if separators is None and format == "markdown" else separators

    @batch_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split_recursive(x, size, overlap, seps) for x in s], dtype=object)

    return run(col(text))


def split_headers(text: str, headers: dict[str, str]) -> list[tuple[str, str]]:
    """(chunk, headers above it as JSON) of a Markdown text."""
    marks = sorted(headers, key=len, reverse=True)
    above: dict[str, str] = {}
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def close() -> None:
        if chunk := "\n".join(held).strip():
            out.append((chunk, json.dumps(above)))
        held.clear()

    for line in text.split("\n"):
        mark = next((m for m in marks if line.startswith(m + " ")), None)
        if mark is None:
            held.append(line)
            continue
        close()
        for m in list(above):
            if len(next(k for k, v in headers.items() if v == m)) >= len(mark):
                del above[m]
        above[headers[mark]] = line[len(mark) :].strip()
    close()
    return out


@function()
def split_text_markdown_header(text: ColumnOrName, headers: dict[str, str]) -> Column:
    @batch_udf("array<struct<chunk:string,headers:string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"chunk": c, "headers": h} for c, h in split_headers(x, headers)] for x in s], dtype=object)

    return run(col(text))


