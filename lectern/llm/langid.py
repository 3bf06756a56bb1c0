"""Language identification by cross-parsing entropy.

A suffix automaton per language holds all substrings of some labelled text. A
document is cross-parsed against each: from where the last phrase ended, the
longest match is the next phrase. Text of the same language needs fewer, longer
phrases; the language with the fewest phrases per letter wins.

Only letters count: case is folded, everything else becomes one blank. The
automaton steps are deterministic, so the parse is a walk through a transition
table, and a batch of documents walks in step, one array operation per letter.
A table has a column per class of letters: one for each of a language's most
frequent letters, a few that its other letters share, and one for those it
lacks. All tables together stay within a number of bytes: the more labels and
the larger their alphabets, the fewer letters teach each; every label is taught.

Cases: a null text or one without a letter is ``und`` with score 0; documents of
any length are parsed whole; ties go to the language first in order; without
labelled rows every language is ``und``; rows without a label teach nothing;
repeated rows are predicted alike; extra columns pass through ``predict``
untouched unless they bear a name that it is told to give.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.resident import resident

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRules:
    """Bounds of the sample that teaches the languages.

    sample_documents: labelled documents read per language, chosen by a hash.
    sample_letters: letters kept per language, dealt over its documents.
    own, shared: classes of a language for single letters and for all others.
    table_bytes: of all tables together.
    walkers: documents that walk in step; letters: letters of a batch in memory.
    least: letters from which on a document may be told to be in no known language.
    """

    sample_documents: int = 200
    sample_letters: int = 40_000
    own: int = 128
    shared: int = 64
    table_bytes: int = 96_000_000
    walkers: int = 4096
    letters: int = 2_000_000
    least: int = 200


def letters(text: str) -> str:
    """Lower-case letters with single blanks between the words; empty without any letter."""
    folded = text.lower()
    return " ".join("".join(c if c.isalpha() else " " for c in folded).split())


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point its folded letter, or a blank; rare planes share one letter."""
    table = np.full(0x110000, 32, np.uint16)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = min(ord(low) if len(low) == 1 else code, 0xFFFF)
    return table


class Automaton:
    """The suffix automaton of a sequence of classes."""

    def __init__(self, sequence: list[int]):
        link, length, edges = [-1], [0], [{}]
        last = 0
        for c in sequence:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            at = last
            while at >= 0 and c not in edges[at]:
                edges[at][c] = new
                at = link[at]
            if at >= 0:
                to = edges[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    edges.append(dict(edges[to]))
                    while at >= 0 and edges[at].get(c) == to:
                        edges[at][c] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new
        self.edges = edges

    def steps(self, width: int, base: int, out: np.ndarray) -> None:
        """For each state and class: four times the place of the next state, plus the phrases that end."""
        first = np.zeros(width, np.int64)
        for c, to in self.edges[0].items():
            first[c] = to
        # A letter without an edge ends the phrase and begins the next one at the root;
        # one that the language lacks is a phrase of its own.
        out[:] = np.where(first > 0, (base + first * width) * 4 + 1, base * 4 + 2)
        out[0] = base * 4 + 1
        for state, edges in enumerate(self.edges):
            for c, to in edges.items():
                out[state, c] = (base + to * width) * 4


@dataclass(frozen=True)
class Model:
    """langs; all tables in one; where each one's root is; the number of each code, and its class per language.

    States are numbered by their first place in the table, so that a step is
    one addition and one lookup.
    """

    langs: tuple[str, ...]
    table: np.ndarray
    roots: np.ndarray
    codes: np.ndarray
    classes: np.ndarray


Sample = tuple[tuple[str, str], ...]


def model(sample: Sample, rules: LanguageRules = LanguageRules()):
    """The automata of a sample, built once in each Python worker, to be used in a ``with``."""
    return resident((Model, sample, rules), lambda: build(sample, rules))


def _classes(text: str, rules: LanguageRules) -> dict[str, int]:
    """The class of each letter of a language: the most frequent have their own, others share some by their code."""
    ranked = sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))
    found = {c: k for k, (c, _) in enumerate(ranked[: rules.own], 1)}
    return found | {c: rules.own + 1 + ord(c) * 40503 % 65521 % rules.shared for c, _ in ranked[rules.own :]}


def build(sample: Sample, rules: LanguageRules = LanguageRules()) -> Model:
    """All tables of a sample; texts give way at their ends where the tables would be too large."""
    room = rules.table_bytes // max(1, len(sample))
    bases, widths, automata, own = [0], [], [], []
    for _, text in sample:
        classes = _classes(text, rules)
        width = max(classes.values(), default=0) + 1
        # An automaton has less than two states to a letter.
        most = max(1, room // (8 * width))
        automaton = Automaton([classes[c] for c in text[:most]])
        own.append(classes)
        automata.append(automaton)
        widths.append(width)
        bases.append(bases[-1] + len(automaton.edges) * width)
    table = np.empty(bases[-1], np.int32 if bases[-1] * 4 < 2**31 else np.int64)
    for automaton, base, width in zip(automata, bases, widths):
        size = len(automaton.edges)
        automaton.steps(width, base, table[base : base + size * width].reshape(size, width))
        automaton.edges = []
    alphabet = sorted({min(ord(c), 0xFFFF) for classes in own for c in classes})
    codes = np.zeros(0x10000, np.uint16)
    codes[alphabet] = np.arange(1, len(alphabet) + 1)
    by_code = np.zeros((len(sample), len(alphabet) + 1), np.uint8)
    for i, classes in enumerate(own):
        for c, k in classes.items():
            by_code[i, codes[min(ord(c), 0xFFFF)]] = k
    return Model(tuple(x for x, _ in sample), table, np.array(bases[:-1], np.int64), codes, by_code)


def phrase_counts(texts: list[str | None], m: Model, rules: LanguageRules) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per text and language, and letters and blanks per text."""
    flat = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)) + 1)
    folded = _folding()[flat]
    # The joining line ends become marks, so blanks collapse within a text only.
    marks = ends[:-1] - 1
    folded[marks] = 0
    blank = folded == 32
    before = np.empty(len(folded), np.uint16)
    before[:1], before[1:] = 0, folded[:-1]
    after = np.zeros(len(folded), bool)
    after[:-1] = folded[1:] != 0
    # A blank stays where a letter is before it; one that ends up last in its text is cut below.
    keep = (folded != 0) & ~(blank & ((before == 32) | (before == 0)))
    kept = folded[keep]
    total = np.concatenate([[0], np.cumsum(keep)])
    starts = total[np.concatenate([[0], ends[:-1]])]
    stops = total[np.minimum(ends, len(folded) + 1) - 1] if len(folded) else np.zeros(len(texts), np.int64)
    sizes = stops - starts
    trailing = (sizes > 0) & (kept[np.maximum(stops - 1, 0)] == 32) if len(kept) else np.zeros(len(texts), bool)
    sizes = sizes - trailing
    counts = np.zeros((len(m.langs), len(texts)), np.int64)
    numbers = m.codes[kept]
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), rules.walkers):
        group = order[at : at + rules.walkers]
        counts[:, group] = _walk(m, numbers, starts[group], sizes[group])
    return counts, sizes


#: Texts that still walk from which on steps for all at once no longer pay.
FEW = 20


def _walk(m: Model, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases per language and text, the last, open one included: texts, longest first, walk through all tables in step."""
    n = len(sizes)
    found = np.zeros((len(m.roots), n), np.int64)
    states = np.repeat(m.roots[:, None], n, axis=1)
    together = int(sizes[FEW - 1]) if n >= FEW else 0
    # How many texts are still walking at each step.
    alive = np.searchsorted(-sizes, -np.arange(together), side="left")
    for step, k in enumerate(alive.tolist()):
        at = states[:, :k] + m.classes.take(numbers[starts[:k] + step], axis=1)
        value = m.table.take(at)
        found[:, :k] += value & 3
        states[:, :k] = value >> 2
    table = memoryview(m.table)
    for i in range(min(FEW, n)):
        rest = numbers[starts[i] + together : starts[i] + sizes[i]]
        for j in range(len(m.roots)):
            state, ends = int(states[j, i]), 0
            for c in m.classes[j][rest].tolist():
                value = table[state + c]
                ends += value & 3
                state = value >> 2
            found[j, i] += ends
            states[j, i] = state
    return found + (states != m.roots[:, None])


def learn(docs: DataFrame, rules: LanguageRules, teach: Column, text: str, lang: str, key: str) -> Sample:
    """A bounded sample of labelled text: ((language, folded text), ...), in order of language.

    Each of a language's documents, chosen by a hash, gives a stretch that
    begins at a place chosen by the hash, so that no text is known by its head.
    """
    rows = docs.where(teach & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    # One row per label, which the tables hold anyway.
    counts = [(r["l"], r["count"]) for r in rows.groupBy("l").count().collect()]
    if not counts:
        return ()
    # As many letters as the tables take of a language with a small alphabet.
    room = max(1, min(rules.sample_letters, rules.table_bytes // (len(counts) * 8 * 24)))
    share = [(x, -(-2 * room // min(n, rules.sample_documents))) for x, n in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "s_lang string, share int"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("t") - F.col("share") + 1, F.lit(1))).cast("int") + 1
    stretches = rows.join(shares, F.col("l") == F.col("s_lang")).select("l", "h", F.substring(F.col("t"), begin, F.col("share")).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    chosen = stretches.withColumn("r", rank).where(F.col("r") <= rules.sample_documents)
    taken: dict[str, list[str]] = {x: [] for x, _ in counts}
    left = dict.fromkeys(taken, room)
    for r in chosen.orderBy("l", "r").toLocalIterator():
        part = letters(r["t"])[: max(left[r["l"]], 0)]
        if part:
            taken[r["l"]].append(part)
            left[r["l"]] -= len(part) + 1
    return tuple((x, " ".join(parts)) for x in sorted(taken) if (parts := taken[x]))


def limits(sample: Sample, rules: LanguageRules = LanguageRules()) -> dict[str, float]:
    """Phrases per letter, for each language, beyond which a text is in no known language.

    A tenth of a language's letters is kept apart and parsed against the rest,
    as it is and shuffled; the limit lies midway between the two.
    """
    rng, out = random.Random(0), {}
    for lang, text in sample:
        begin = len(text) * 9 // 10
        rest, own = text[:begin], letters(text[begin:])
        if len(own) < 2 or not letters(rest):
            out[lang] = float("inf")
            continue
        order = list(own)
        rng.shuffle(order)
        counts, sizes = phrase_counts([own, "".join(order)], build(((lang, rest),), rules), rules)
        out[lang] = float((counts[0] / np.maximum(sizes, 1)).mean())
    return out


#: Names of what ``predict`` adds: the language, 1 less the winner's phrases over the runner-up's, and the winner's phrases to a letter.
NAMES = ("lang_pred", "score", "phrase_rate")


def predict(
    docs: DataFrame, sample: Sample, rules: LanguageRules = LanguageRules(), text: str = "text", names: tuple[str, str, str] = NAMES
) -> DataFrame:
    """``docs`` with the three columns of ``names``; the rate is null where a text has fewer letters than ``least``."""
    kept = [f for f in docs.schema if f.name not in names]

    def predicted(texts: list[str | None], taught: Model | None) -> tuple[list, list, list]:
        if taught is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        counts, sizes = phrase_counts(texts, taught, rules)
        ranked = np.sort(counts, axis=0)
        second = ranked[1] if len(counts) > 1 else sizes
        score = np.where(sizes > 0, 1 - ranked[0] / np.maximum(second, 1), 0.0).clip(0, 1)
        best = counts.argmin(axis=0)
        langs = [taught.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), sizes.tolist())]
        rates = [n / s if s >= rules.least else None for n, s in zip(ranked[0].tolist(), sizes.tolist())]
        return langs, score.tolist(), rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The classes of a batch are kept for every language.
        most = min(rules.letters, 16 * rules.letters // max(1, len(sample)))
        with model(sample, rules) as taught:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                langs, scores, rates, at = [], [], [], 0
                while at < len(texts):
                    # As many documents at once as their letters allow, one at least.
                    end, total = at, 0
                    while end < len(texts) and (end == at or total < most):
                        total += len(texts[end] or "")
                        end += 1
                    for whole, part in zip((langs, scores, rates), predicted(texts[at:end], taught if sample else None)):
                        whole += part
                    at = end
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *found], names=[*(f.name for f in kept), *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, f"{fields}`{names[0]}` string, `{names[1]}` double, `{names[2]}` double")


def identify(
    docs: DataFrame,
    rules: LanguageRules = LanguageRules(),
    teach: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
) -> DataFrame:
    """(key, lang_pred, score) per row; ``teach`` selects the rows that may be learned from."""
    sample = learn(docs, rules, F.lit(True) if teach is None else teach, text, lang, key)
    return predict(docs.select(key, text), sample, rules, text).drop(text, NAMES[2])
