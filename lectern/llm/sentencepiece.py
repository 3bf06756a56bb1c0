"""SentencePiece encoding and decoding, exact for BPE models, by a max-plus parallel scan.

A tokenization is a path through the lattice of pieces that match the text. In
a BPE model the right path is the only one whose every two neighbours stay as
they are when they alone are encoded together; a step is worth 0 if its two
pieces are such neighbours and minus infinity if not, and the path worth most
is the tokenization. (Adding piece scores, as for a unigram model, would give
other ids than the library does for these vocabularies.)

Giant documents are cut into chunks at arbitrary places. The states at a cut
are the pieces that may end there or reach across. For each chunk, a matrix
holds what the best path is worth from each state at its left cut to each at
its right one; entries of minus infinity are left out. Matrices combine by
max-plus products, which are associative: neighbours are multiplied in pairs,
the products again, up to one for a run of chunks and one for the document. On
the way down, the state between two factors is the one through which their
product is worth most; so the state at every cut is known, and then each chunk
traces its own part of the path back, alone. Runs of chunks are multiplied and
taken apart in tasks of their own.
Other documents are a single chunk. A unit that no piece can reach out of, such
as a word, has one state on either side; its path is found once and looked up.

Cases: a null or empty text has no ids; any length and any characters encode,
unknown ones as bytes; repeated rows and keys stay apart; an empty table gives
an empty result; extra columns are dropped. Decoding gives the text back but for
the mark U+2581, which reads as a blank.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.resident import resident
from lectern.llm.storage import cut
from lectern.llm.tokens import Uncut, Units, batches_of

MARK = "▁"
MEET = re.compile(f"[^{MARK}](?={MARK})")
#: Units, and twice as many pairs, that a worker knows at a time.
KEPT = 250_000
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Pieces:
    """giant: characters from which on a document is cut. chunk: characters of its chunks. run: chunks whose matrices one task multiplies."""

    path: str = ""
    giant: int = 65_536
    chunk: int = 16_384
    run: int = 64


#: A state is (end, piece): where the piece that reaches the cut ends, counted from there; at the
#: beginning of a text, and after characters that are no piece, the piece is -1.
State = tuple[int, int]
#: What the best path is worth from each state to each; what is left out is minus infinity.
Matrix = dict[State, dict[State, float]]


class Model:
    """A BPE piece model as a lattice of compatible neighbours."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i] and not sp.is_byte(i)}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {i: sp.get_score(i) for i in self.ids.values()}
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that reach over a blank are not supported")
        self.raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.raw |= {i: bytes([b]) for b, i in self.bytes_at.items()} | {i: b"" for i in range(size) if special[i]}
        #: For each piece that merging gives from its own text: its rank, none for a character, and its last merge.
        self.rank: dict[int, float] = {}
        self.split: dict[int, tuple[int, int]] = {}
        #: Pieces that can stand in a tokenization, by their text.
        self.live: dict[str, int] = {}
        for piece, i in self.ids.items():
            left = self.halves(piece)
            if left is not None:
                self.live[piece] = i
                self.rank[i] = -self.score[i] if left else -1.0
                if left:
                    self.split[i] = (self.ids[left], self.ids[piece[len(left) :]])
        #: The same as a tree by characters; a piece's number is kept under 0 where it ends.
        self.tree: dict = {}
        for piece, i in self.live.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[0] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Whether a line end always stands alone, so that lines are cut there too.
        self.lines = not any("\n" in p for p in self.ids)
        self.bare = Units(lambda u: self._known(u, ""), KEPT)
        self.spaced = Units(lambda u: self._known(u, MARK), KEPT)
        self.inner = Units(self.unit, KEPT)
        self.newline = self.unit("\n")

    def halves(self, text: str) -> str | None:
        """The left part of the last merge that makes a piece of its own text; "" for a character, None if it isn't made."""
        parts = list(text)
        if any(p not in self.ids for p in parts):
            return None
        left = ""
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if at < 0:
                return None
            left = parts[at]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return left

    def worth(self, left: int, right: int) -> bool:
        """Whether the step from left to right is worth 0: nothing merges across before both are made.

        Going back in time, the piece made later comes apart first, and what
        then faces the cut must not merge, at an earlier rank than that of the
        merge undone. Of equal ranks the one on the left merges first.
        """
        if left < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 2 * KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        text, rank, bound, closed = self.text, self.rank, float("inf"), False
        while True:
            across = self.ids.get(text[a] + text[b])
            if across is not None:
                own = -self.score[across]
                if own < bound or closed and own == bound:
                    return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, closed, a = ra, False, self.split[a][1]
            else:
                bound, closed, b = rb, True, self.split[b][0]

    def forward(self, text: str, begin: int, piece: int, end: int) -> list[tuple[int, int] | None]:
        """For each place up to end, (piece that ends there, where it begins) on the path from begin, if any."""
        root, longest, pairs = self.tree, self.longest, self.pairs
        back: list[tuple[int, int] | None] = [None] * (end + 1)
        back[begin] = (piece, -1)
        for start in range(begin, end):
            if back[start] is None:
                continue
            before, at, node = back[start][0], start, root
            for c in text[start : min(end, start + longest)]:
                node = node.get(c)
                if node is None:
                    break
                at += 1
                found = node.get(0)
                if found is None or back[at] is not None:
                    continue
                good = True if before < 0 else pairs.get((before, found))
                if good is None:
                    good = self.worth(before, found)
                if good:
                    back[at] = (found, start)
            if at == start and text[start] not in self.ids:
                # No piece has this character: the path goes through it from any piece.
                back[start + 1] = (-1, start)
        return back

    def trace(self, text: str, back: list, begin: int, at: int) -> list[int]:
        """Ids of the path from begin to at; a character without a piece gives its bytes."""
        out: list[int] = []
        while at > begin:
            piece, start = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes_at[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        return out[::-1]

    def unit(self, unit: str) -> bytes:
        """Ids, as bytes, of a text that nothing reaches into."""
        return array("I", self.trace(unit, self.forward(unit, 0, -1, len(unit)), 0, len(unit))).tobytes()

    def _known(self, unit: str, before: str) -> bytes:
        if not unit or MARK in unit:
            raise Uncut
        return self.unit(before + unit)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts that are one chunk each."""
        self.bare.age()
        self.spaced.age()
        bare, spaced, out = self.bare.__getitem__, self.spaced.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            try:
                if not self.lines:
                    raise Uncut
                head, *more = [line.split(" ") for line in text.split("\n")]
                done = [b"".join(map(spaced, head))]
                done += [bare(x[0]) + b"".join(map(spaced, x[1:])) for x in more]
                out.append(self.newline.join(done))
            except Uncut:  # runs of blanks, or marks
                out.append(b"".join(map(self.unit, UNITS.findall(normal(text)))))
        return out

    def states(self, text: str, at: int) -> list[State]:
        """All states at a cut of a text: pieces that begin before it and end there or beyond."""
        found = [
            (end - at, piece)
            for start in range(max(0, at - self.longest), at)
            for end in range(at, min(len(text), start + self.longest) + 1)
            if (piece := self.live.get(text[start:end])) is not None
        ]
        return found + ([(0, -1)] if at == 0 or text[at - 1] not in self.ids else [])

    def reach(self, text: str, back: list, at: int) -> list[State]:
        """The states at a cut that the path leads to."""
        found = [(0, -1)] if at and back[at] is not None and back[at][0] < 0 else []
        for start in range(max(0, at - self.longest), at):
            if back[start] is None:
                continue
            for end in range(at, min(len(text), start + self.longest) + 1):
                piece = self.live.get(text[start:end])
                if piece is not None and self.worth(back[start][0], piece):
                    found.append((end - at, piece))
        return found

    def matrix(self, text: str, left: int, right: int, first: bool) -> Matrix:
        """The matrix of the chunk from left to right of a text with context on both sides."""
        out: Matrix = {}
        for state, to in self.steps(text, left, right, first):
            out.setdefault(state, {})[to] = 0.0
        return out

    def steps(self, text: str, left: int, right: int, first: bool) -> list[tuple[State, State]]:
        """The entries of a chunk's matrix that are worth 0."""
        entries = [(0, -1)] if first else self.states(text, left)
        meeting = self.meeting(text, left, right)
        if meeting is None:
            # A piece that reaches to the chunk's end or over it is the state there too.
            over = [(s, (left + s[0] - right, s[1])) for s in entries if left + s[0] >= right]
            return over + [
                (state, to)
                for state in entries
                if left + state[0] < right
                for to in self.reach(text, self.forward(text, left + state[0], state[1], right), right)
            ]
        first_at, last_at = meeting
        rest = self.reach(text, self.forward(text, last_at, -1, right), right)
        alive = [s for s in entries if self.forward(text, left + s[0], s[1], first_at)[first_at] is not None]
        return [(state, to) for state in alive for to in rest]

    def meeting(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """The first and last place, out of reach of the cuts, where a blank follows something else: all paths meet there."""
        low, high = left + self.longest, max(right - self.longest, 0)
        first = MEET.search(text, low, high) if low < high else None
        if first is None:
            return None
        at = first.start() + 1
        last = text.rfind(MARK, at, high)
        while text[last - 1] == MARK:  # the first of a run of blanks
            last -= 1
        return at, max(at, last)

    def part(self, text: str, left: int, right: int, entry: State, to: State) -> list[int]:
        """Ids that the chunk emits between two states: those after the entry's piece, and the last."""
        begin, end = left + entry[0], right + to[0]
        if begin >= end:
            return []  # the entry's piece reaches as far
        out: list[int] = []
        meeting = self.meeting(text, left, right)
        piece = entry[1]
        if meeting is not None:
            first, last = meeting
            out += self.trace(text, self.forward(text, begin, piece, first), begin, first)
            for unit in UNITS.findall(text[first:last]):
                out += np.frombuffer(self.inner[unit], "<u4").tolist()
            begin, piece = last, -1
        back = self.forward(text, begin, piece, right)
        start = end - len(self.text[to[1]]) if to[1] >= 0 else end
        out += self.trace(text, back, begin, start)
        return [*out, to[1]] if to[1] >= 0 else out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a dummy blank at the beginning is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def normal(text: str | None) -> str:
    """The text as pieces see it: marked blanks, and one before the beginning."""
    return MARK + text.replace(" ", MARK) if text else ""


def times(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for state, row in a.items():
        best: dict[State, float] = {}
        for between, worth in row.items():
            for to, more in b.get(between, {}).items():
                if worth + more > best.get(to, -math.inf):
                    best[to] = worth + more
        if best:
            out[state] = best
    return out


def tree(matrices: list[Matrix]) -> list[list[Matrix]]:
    """The matrices, the products of their pairs, and so on up to the product of all."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        last = levels[-1]
        pairs = [times(a, b) for a, b in zip(last[::2], last[1::2])]
        levels.append(pairs + last[len(pairs) * 2 :])
    return levels


def scan(matrices: list[Matrix], entry: State = (0, -1), to: State | None = None) -> list[tuple[State, State]]:
    """The (entry, exit) of every matrix on the path worth most; without ``to``, it ends where the text does."""
    levels = tree(matrices)
    row = levels[-1][0][entry]
    if to is None:
        to = min((s for s in row if s[0] == 0), key=lambda s: (-row[s], s))
    ends = [(entry, to)]
    for factors in reversed(levels[:-1]):
        finer = []
        for k, (left, right) in enumerate(ends):
            if 2 * k + 1 == len(factors):
                finer.append((left, right))
                continue
            first, second = factors[2 * k], factors[2 * k + 1]
            through = [(w + second[s][right], s) for s, w in first[left].items() if right in second.get(s, {})]
            between = min(through, key=lambda x: (-x[0], x[1]))[1]
            finer += [(left, between), (between, right)]
        ends = finer
    return ends


def _pack(m: Matrix) -> str:
    return json.dumps([(s, to, w) for s, row in m.items() for to, w in row.items()])


def _unpack(packed: str) -> Matrix:
    out: Matrix = {}
    for s, to, w in json.loads(packed):
        out.setdefault(tuple(s), {})[tuple(to)] = w
    return out


def model(path: str):
    """One model, with its known units, for each Python worker, to be used in a ``with``."""
    return resident((Model, path), lambda: Model(path))


def encode(
    docs: DataFrame, config: Pieces, text: str = "text", key: str = "doc_id", decoded: bool = False
) -> DataFrame:
    """(key, ids, n_chunks): ids as little-endian unsigned 32-bit integers; with the text that they decode to, if asked for."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    long = F.length("t") > config.giant

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(config.path) as m:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in batches_of(texts):
                    ids = m.encode(texts[a:b])
                    found = [batch.column(0)[a:b], pa.array(ids, pa.binary())]
                    if decoded:
                        found.append(pa.array([m.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(found, names=["k", "ids", "decoded"][: len(found)])

    schema = f"k {kind}, ids binary" + (", decoded string" if decoded else "")
    small = rows.where(~long).mapInArrow(whole, schema).withColumn("n", F.lit(1))
    giants = _giants(rows.where(long), config, kind)
    if decoded:
        giants = decode(giants.withColumn("kept_ids", F.col("ids")), config.path).withColumnRenamed("kept_ids", "ids")
    last = ["decoded"] if decoded else []
    return small.unionByName(giants).select(F.col("k").alias(key), "ids", F.col("n").cast("int").alias("n_chunks"), *last)


def _giants(rows: DataFrame, config: Pieces, kind: str) -> DataFrame:
    """(k, ids, n) of giant documents, whose chunks are worked on apart."""
    chunks = f"k {kind}, row long, chunk int, last boolean, lead int, size int, t string"

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(config.path) as m:
            longest = m.longest
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                s = normal(t.as_py())
                for chunk, a in enumerate(range(0, len(s), config.chunk)):
                    b, low = min(len(s), a + config.chunk), max(0, a - longest)
                    found = [[k.as_py()], [row], [chunk], [b == len(s)], [a - low], [b - a], [s[low : b + longest]]]
                    kinds = [k.type, pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, x) for v, x in zip(found, kinds)], names=["k", "row", "chunk", "last", "lead", "size", "t"]
                    )
                row += 1

    # Kept, so that a row's number names the same document to all that follow, and spread out.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut(rows.mapInArrow(divide, chunks).repartition(parts, "row", "chunk"))

    kinds = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("matrix", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(config.path) as m:
            for batch in batches:
                for r in batch.to_pylist():
                    found = m.matrix(r["t"], r["lead"], r["lead"] + r["size"], r["chunk"] == 0)
                    row = {"row": r["row"], "chunk": r["chunk"], "matrix": _pack(found)}
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)

    def product(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("chunk")
        whole = tree([_unpack(x) for x in table["matrix"]])[-1][0]
        return pd.DataFrame({"row": table["row"].iloc[:1], "chunk": table["run"].iloc[:1], "matrix": [_pack(whole)]})

    def ends(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("chunk")
        found = [_unpack(x) for x in table["matrix"]]
        if "run_entry" in table:
            path = scan(found, tuple(table["run_entry"].iloc[0]), tuple(table["run_exit"].iloc[0]))
        else:
            path = scan(found)
        return pd.DataFrame(
            {"row": table["row"], "chunk": table["chunk"], "entry": [list(a) for a, _ in path], "exit": [list(b) for _, b in path]}
        )

    # Small, and read on the way up and on the way down.
    matrices = cut(cuts.select("row", "chunk", "lead", "size", "t").mapInArrow(measure, "row long, chunk int, matrix string"))
    runs = matrices.withColumn("run", F.call_function("div", F.col("chunk"), F.lit(config.run)).cast("int"))
    products = runs.groupBy("row", "run").applyInPandas(product, "row long, chunk int, matrix string")
    # A document has as many products as it has runs of a million letters: far less than its text, which is one row.
    outer = products.groupBy("row").applyInPandas(ends, "row long, chunk int, entry array<int>, exit array<int>")
    outer = outer.select("row", F.col("chunk").alias("run"), F.col("entry").alias("run_entry"), F.col("exit").alias("run_exit"))
    path = runs.join(outer, ["row", "run"]).groupBy("row", "run").applyInPandas(ends, "row long, chunk int, entry array<int>, exit array<int>")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(config.path) as m:
            for batch in batches:
                ids = [
                    np.array(m.part(r["t"], r["lead"], r["lead"] + r["size"], tuple(r["entry"]), tuple(r["exit"])), "<u4").tobytes()
                    for r in batch.to_pylist()
                ]
                kept = [batch.column(batch.schema.get_field_index(c)) for c in ("k", "row", "chunk")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], names=["k", "row", "chunk", "part"])

    traced = cuts.join(path, ["row", "chunk"]).mapInArrow(trace, f"k {kind}, row long, chunk int, part binary")
    gathered = traced.groupBy("row").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["part"]))
    return gathered.select("k", joined.alias("ids"), F.size("parts").alias("n"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded in place of the ids."""
    kept = [c for c in encoded.columns if c not in (ids, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(path) as m:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(ids))
                texts = [m.decode(np.frombuffer(x.as_py(), "<u4")) for x in column]
                others = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    fields = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in kept)
    return encoded.select(*kept, ids).mapInArrow(run, f"{fields}decoded string")
