"""What a deployment supplies: embeddings, recognition of images, generated text. Functions take any object that fits."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from lectern.operators import study as S
from lectern.operators.study import make_questions
from lectern.sources.ingest import fake_embedding


class EmbeddingProvider(Protocol):
    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]: ...


class OcrProvider(Protocol):
    def is_available(self) -> bool: ...

    def ocr_image(self, image: bytes, language: str) -> str:
        """Recognized words as tab-separated lines, empty if none could be read."""
        ...


class LlmProvider(Protocol):
    def summarize(self, context: str, mode: str) -> str: ...

    def generate_questions(self, context: str, count: int, mode: str) -> list[tuple[str, str]]: ...

    def evaluate_answer(self, question: str, expected: str, given: str) -> tuple[float, str]:
        """A score between 0 and 1, and what the writer is told."""
        ...


@dataclass(frozen=True)
class Settings:
    """Values that change results; a session's own settings stand apart."""

    max_upload_mb: int = 20
    embedding_dimension: int = 384
    ocr_language: str = "eng"
    ocr_dpi: int = 200
    ocr_pages: int = 25
    ocr_timeout: float = 20.0
    chunk_words: int = 900
    chunk_overlap: int = 120
    preview_dpi: int = 150


@dataclass(frozen=True)
class FakeEmbeddings:
    """Stable vectors without a model."""

    dimension: int = 384

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        return [fake_embedding(t, self.dimension) for t in texts]


@dataclass(frozen=True)
class CommandOcr:
    """A recognizer run as a command that reads an image and writes tab-separated words; a failure is an empty page."""

    command: str = "tesseract"
    arguments: tuple[str, ...] = ("stdin", "stdout", "-l", "{language}", "--psm", "6", "tsv")
    timeout: float = 20.0

    def is_available(self) -> bool:
        return shutil.which(self.command) is not None

    def ocr_image(self, image: bytes, language: str) -> str:
        if not self.is_available():
            return ""
        line = [self.command, *(a.format(language=language) for a in self.arguments)]
        try:
            done = subprocess.run(line, input=image, capture_output=True, timeout=self.timeout, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return ""
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


@dataclass(frozen=True)
class LocalText:
    """Summaries and questions from the sentences of a context alone."""

    def _said(self, context: str) -> list[str]:
        from lectern.operators.verify import sentences

        return sentences(" ".join(context.split()))

    def summarize(self, context: str, mode: str = "concise") -> str:
        return " ".join(self._said(context)[: 3 if mode == "detailed" else 2])

    def generate_questions(self, context: str, count: int, mode: str = "balanced") -> list[tuple[str, str]]:
        return make_questions(self._said(context), count, mode)

    def evaluate_answer(self, question: str, expected: str, given: str) -> tuple[float, str]:
        """As ``study.evaluate`` has it for columns."""
        words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if w not in S.STOPWORDS}
        wanted = words(expected) or words(question)
        if not wanted:
            return 0.0, S.NOTHING_EXPECTED
        missing = sorted(wanted - words(given))
        if not missing:
            return 1.0, S.ALL_SAID
        score = round(1 - len(missing) / len(wanted), 2)
        return score, (S.NONE_SAID if score == 0 else "") + S.MISSING + ", ".join(missing[:8]) + "."


@dataclass(frozen=True)
class Fallback:
    """A provider of text whose failures another one makes good."""

    first: LlmProvider
    other: LlmProvider = field(default_factory=LocalText)

    def summarize(self, context: str, mode: str = "concise") -> str:
        try:
            return self.first.summarize(context, mode) or self.other.summarize(context, mode)
        except Exception:  # whatever a hosted model fails with
            return self.other.summarize(context, mode)

    def generate_questions(self, context: str, count: int, mode: str = "balanced") -> list[tuple[str, str]]:
        try:
            return self.first.generate_questions(context, count, mode) or self.other.generate_questions(context, count, mode)
        except Exception:
            return self.other.generate_questions(context, count, mode)

    def evaluate_answer(self, question: str, expected: str, given: str) -> tuple[float, str]:
        try:
            return self.first.evaluate_answer(question, expected, given)
        except Exception:
            return self.other.evaluate_answer(question, expected, given)


#: Providers of text by name; a deployment adds its own.
TEXT: dict[str, Callable[[], LlmProvider]] = {"local": LocalText}


def text_provider(name: str = "local") -> LlmProvider:
    """The provider of that name behind the local one; an unknown name is the local one."""
    return LocalText() if name == "local" or name not in TEXT else Fallback(TEXT[name]())
