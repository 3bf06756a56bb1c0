"""The sentence check for one answer, by the rules that ``evidence.sentence_support`` has for tables."""

from __future__ import annotations

import re

from lectern.functions.words import NEGATIONS, VERIFIER_STOPWORDS

END = re.compile(r"(?<!\bal\.)(?<=[.!?])\s+", re.I)
NUMBER = re.compile(r"(?<!\w)[+-]?\d[\d,]*(?:\.\d+)?%?(?!\w)")


def words(text: str) -> set[str]:
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1} - set(VERIFIER_STOPWORDS)


def sentences(text: str) -> list[str]:
    return [s.strip() for s in END.split(text.strip()) if s.strip()]


def _numbers(text: str) -> set[str]:
    return {n.replace(",", "") for n in NUMBER.findall(text)}


def supports(sentence: str, shown: str) -> tuple[bool, float]:
    said, given = words(sentence), words(shown)
    score = len(said & given) / len(said) if said else 0.0
    names = {w for name in re.findall(r"\b[A-Z][A-Za-z0-9-]+\b", sentence) for w in words(name)}
    denied = set(NEGATIONS)
    good = score >= 0.8 and _numbers(sentence) <= _numbers(shown) and said & denied == given & denied and names <= given
    return good, score


def check(answer: str, items: list[dict]) -> list[dict]:
    """Each sentence of an answer with the best support among the items' sentences, the first of equals."""
    shown = [(s, h["chunk_id"]) for h in items for s in sentences(h["text"])]
    out = []
    for sentence in sentences(answer):
        ranked = [(*supports(sentence, s), chunk) for s, chunk in shown]
        good, score, chunk = max(ranked, key=lambda r: r[:2], default=(False, 0.0, None))
        out.append({"sentence": sentence, "supported": good, "score": score, "chunk_id": chunk if good else None})
    return out
