"""SentencePiece encoding and decoding, with giant documents by a max-plus parallel scan.

A segmentation is a path over the places of the normalised text; a piece is a step with a score. A chunk's transfer matrix
has, for each state at its start and each at its end, the greatest sum of scores of the steps between: matrices multiply
in the max-plus semiring, which is associative, so chunks are computed side by side, matrices of neighbours are combined
level by level into one for the document, states are resolved down the same levels, and each chunk is traced back by
itself from its two resolved states. No task sees more than FAN matrices of a document at once.

* Unigram models: a step's score is the piece's, a state is where the piece that crosses the boundary ends.
* BPE models: merges are greedy, but a segmentation is the one that BPE gives if and only if BPE leaves each two
  neighbouring pieces as they are when it meets them alone. So a step scores 0 after a piece with which it is stable and
  minus infinity otherwise, and a state is the piece that crosses or meets the boundary.

Documents up to ``giant`` characters are one chunk and go to the library whole; the switch is one of time alone, as the
results of both ways equal the library's own. (Of unigram paths with equal scores, the library's may be another.)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

#: Characters beyond which a document is split, and of each chunk.
GIANT, CHUNK = 80_000, 8_000
#: Neighbouring matrices that are combined at once, and chunks that one task takes.
FAN, TASK_CHUNKS = 16, 16
#: Ids, or characters, that are decoded or encoded at once.
AT_ONCE = 200_000
NEVER = float("-inf")
#: A step over a character that no piece has, as the library scores it: below the worst piece.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
START = (-1, 0, 0)

State = tuple[int, int, int]  # piece (or -1), its start and its end


def model_type(path: str) -> int:
    """1 for unigram, 2 for BPE; from the trainer's settings in the model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type


class Scanner:
    """Transfer matrices and traces of chunks for a model."""

    def __init__(self, sp, bpe: bool) -> None:
        self.sp, self.bpe = sp, bpe
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in kept}
        self.score = {i: sp.get_score(i) for i in kept}
        self.longest = max(map(len, self.piece), default=1)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_id = {i: p for p, i in self.piece.items()}
        self.memory: dict[tuple[str, str], bool] = {}

    def unknown(self, char: str) -> list[int]:
        """Ids for a character that no piece has."""
        ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in char.encode()]
        return ids if all(map(self.sp.is_byte, ids)) else [self.sp.unk_id()]

    def _merged(self, symbols: list[str]) -> list[str]:
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = self.piece.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        """Whether BPE leaves a and b as they are."""
        if (a, b) not in self.memory:
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[a, b] = self._merged(list(a + b)) == [a, b]
        return self.memory[a, b]

    def steps(self, text: str, end: int, low: int) -> Iterator[tuple[int, int, float]]:
        """(piece, start, score) of the pieces that end at ``end`` and start at ``low`` or later; -1: a lone character."""
        for start in range(max(low, end - self.longest), end):
            k = self.piece.get(text[start:end])
            if k is not None:
                yield k, start, 0.0 if self.bpe else self.score[k]
            elif start == end - 1:
                yield -1, start, 0.0 if self.bpe else self.worst

    def state(self, k: int, start: int, end: int) -> State:
        return (k, start, end) if self.bpe and k >= 0 else (-1, 0, end)

    def states(self, text: str, at: int) -> list[State]:
        """What may cross or meet a boundary, in an order that depends on the text around it alone."""
        found = [self.state(k, start, end) for end in range(at, min(len(text), at + self.longest - 1) + 1) for k, start, _ in self.steps(text, end, 0) if start < at]
        return sorted(set(found))

    def run(self, text: str, begin: int, finish: int, before: list[State]) -> tuple[list[State], dict, dict]:
        """States at the end of text[begin:finish], and best scores and back pointers of all states from those at the start.

        text has ``longest`` more characters on either side, where there are any. What a state is reached with is one
        value for each start state: an array of scores, or for BPE, where all scores are 0, a bitmap in an integer.
        """
        best: dict[State, int | np.ndarray] = {}
        back: dict[State, list[tuple]] = {}
        at: dict[int, list[State]] = {}

        def reach(state: State, value: int | np.ndarray, step: tuple | None) -> None:
            old = best.get(state)
            if old is None:
                best[state], back[state] = value, [(value if self.bpe else value > NEVER, step)]
                at.setdefault(state[2], []).append(state)
            elif self.bpe:
                if new := value & ~old:
                    best[state] = old | new
                    back[state].append((new, step))
            elif (better := value > old).any():
                best[state] = np.where(better, value, old)
                back[state].append((better, step))

        for i, s in enumerate(before):
            one = np.full(len(before), NEVER)
            one[i] = 0.0
            reach((*s[:2], begin) if s == START else s, 1 << i if self.bpe else one, None)
        for end in range(begin + 1, min(len(text), finish + self.longest - 1) + 1):
            for k, start, score in self.steps(text, end, begin):
                if start < finish and start in at:
                    state = self.state(k, start, end)
                    for s in at[start]:
                        if not self.bpe:
                            reach(state, best[s] + score, (k, start, *s))
                        elif s[0] < 0 or k < 0 or self.stable(self.by_id[s[0]], self.by_id[k]):
                            reach(state, best[s], (k, start, *s))
        return [s for end in sorted(at) if end >= finish for s in at[end]], best, back

    def matrix(self, text: str, begin: int, finish: int, first: bool, offset: int) -> tuple[list[State], list[State], list[list[float]]]:
        """The transfer matrix, with places in the whole document."""
        before = [START] if first else self.states(text, begin)
        after, best, _ = self.run(text, begin, finish, before)
        score = (lambda s, i: 0.0 if best[s] >> i & 1 else NEVER) if self.bpe else (lambda s, i: float(best[s][i]))
        return [shift(s, offset) for s in before], [shift(s, offset) for s in after], [[score(s, i) for s in after] for i in range(len(before))]

    def trace(self, text: str, begin: int, finish: int, offset: int, into: State, out: State) -> list[int]:
        """Ids of the pieces between the two states: those that start after ``into`` ends, up to ``out`` itself."""
        _, _, back = self.run(text, begin, finish, [shift(into, -offset)])
        state, ids = shift(out, -offset), []
        while step := next(step for hit, step in reversed(back[state]) if (hit & 1 if self.bpe else hit[0])):
            k, start, *rest = step
            ids += [k] if k >= 0 else self.unknown(text[start])[::-1]
            state = tuple(rest)
        return ids[::-1]


def shift(state: State, by: int) -> State:
    return state if state == START else (state[0], state[1] + by if state[0] >= 0 else 0, state[2] + by)


def product(a: tuple, b: tuple) -> tuple:
    """Of two transfer matrices that follow one another: their max-plus product over the states they share."""
    place = {tuple(s): i for i, s in enumerate(b[0])}
    x = np.array(a[2], float).reshape(len(a[0]), len(a[1]))
    pick = [(i, place[tuple(s)]) for i, s in enumerate(a[1]) if tuple(s) in place]
    y = np.array(b[2], float).reshape(len(b[0]), len(b[1]))
    if not pick:
        return a[0], b[1], np.full((len(a[0]), len(b[1])), NEVER).tolist()
    left, right = x[:, [i for i, _ in pick]], y[[j for _, j in pick]]
    return a[0], b[1], (left[:, :, None] + right[None, :, :]).max(1).tolist()


def combined(matrices: list[tuple]) -> tuple:
    """The product of matrices that follow one another, as a tree of products of neighbours."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def best_end(whole_text: tuple) -> State:
    """The state at the end of the best path through a whole document."""
    _, after, score = whole_text
    stop = max(s[2] for s in after)
    return tuple(after[max((i for i, s in enumerate(after) if s[2] == stop), key=lambda i: score[0][i])])


def resolve(matrices: list[tuple], into: State, out: State) -> list[State]:
    """The states at the boundaries 0..n of the best path from one state to another through n matrices."""
    before = {tuple(s): i for i, s in enumerate(matrices[0][0])}
    reach = [{tuple(s): matrices[0][2][before[into]][i] for i, s in enumerate(matrices[0][1])}]
    for a, b, m in matrices[1:]:
        known = [(reach[-1][tuple(s)], row) for s, row in zip(a, m, strict=True) if tuple(s) in reach[-1]]
        reach.append({tuple(s): max((x + row[i] for x, row in known), default=NEVER) for i, s in enumerate(b)})
    states = [out]
    for came, (a, b, m) in zip(reach[-2::-1], matrices[:0:-1], strict=True):
        column = next(i for i, s in enumerate(b) if tuple(s) == states[-1])
        score = {tuple(s): m[i][column] for i, s in enumerate(a)}
        states.append(max(came, key=lambda s: came[s] + score.get(s, NEVER)))
    return [into, *states[::-1]]


def _packed(matrix: tuple) -> str:
    import json

    return json.dumps(matrix)


def _unpacked(text: str) -> tuple:
    import json

    before, after, score = json.loads(text)
    return [tuple(s) for s in before], [tuple(s) for s in after], score


def boundary_states(moves: DataFrame, last: int, fan: int = FAN) -> DataFrame:
    """key, n, into, out: the states in which the best path enters and leaves each chunk.

    moves: key, n (0 to ``last`` at most), matrix. Matrices go up a tree of ``fan`` children each, then states come down.
    """
    import json

    levels = [moves]
    while last > 0:
        last //= fan

        def up(table):
            import pyarrow as pa

            rows = sorted(table.to_pylist(), key=lambda r: r["n"])
            found = _packed(combined([_unpacked(r["matrix"]) for r in rows]))
            return pa.table([pa.array([rows[0]["key"]], pa.int64()), pa.array([rows[0]["n"] // fan], pa.int64()), pa.array([found])], ["key", "n", "matrix"])

        level = levels[-1].groupBy("key", F.floor(F.col("n") / fan).alias("above")).applyInArrow(up, "key long, n long, matrix string")
        levels.append(stored(level, "matrices"))

    @F.pandas_udf("string")
    def ends(matrices: pd.Series) -> pd.Series:
        return matrices.map(lambda m: json.dumps(best_end(_unpacked(m))))

    states = levels[-1].select("key", "n", F.lit(json.dumps(START)).alias("into"), ends("matrix").alias("out"))

    def down(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        into, out = (tuple(json.loads(rows[0][k])) for k in ("into", "out"))
        at = [json.dumps(s) for s in resolve([_unpacked(r["matrix"]) for r in rows], into, out)]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in ("key", "n")]
        return pa.table([*columns, pa.array(at[:-1]), pa.array(at[1:])], ["key", "n", "into", "out"])

    for level in levels[-2::-1]:
        above = states.withColumnRenamed("n", "above")
        met = level.withColumn("above", F.floor(F.col("n") / fan)).join(above.hint("merge"), ["key", "above"])
        states = stored(met.groupBy("key", "above").applyInArrow(down, "key long, n long, into string, out string"), "states")
    return states


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _parts(column, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Slices (start, rows) of an Arrow list or string column with about ``most`` entries or bytes each."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column) if str(column.type).startswith(("list", "large_list")) else pc.binary_length(column), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end - at
        at = end


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, ids (array<int>), as the model's own encoding without special ids.

    model: a model file that is there on each executor. Null text counts as empty and gives no ids; ``chunk`` must be
    longer than the longest piece. Texts of up to ``giant`` characters go to the library whole, longer ones are scanned in
    parallel; ids are the same either way. Only giant documents are shuffled: their matrices, then their chunks' ids.
    Repeated rows give a row each, other columns are ignored, an empty table gives an empty result.
    """
    text = whole(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))

    def direct(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp = _load(model)
        for batch in batches:
            for at, n in _parts(batch.column(1)):
                part = batch.slice(at, n)
                ids = [np.array(x, np.int32) for x in sp.encode(part.column(1).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    small = rows.where(F.length("text") <= giant).mapInArrow(direct, "doc_id long, ids array<int>")

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp = _load(model)
        scanner = Scanner(sp, model_type(model) == BPE)
        for batch in batches:
            for key, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = sp.normalize(text)
                for n, begin in enumerate(range(0, len(s), chunk) if s else [0]):
                    low = max(0, begin - scanner.longest)
                    piece = s[low : begin + chunk + scanner.longest]
                    columns = [[key], [doc], [n], [low], [begin - low], [min(chunk, len(s) - begin) + begin - low], [piece]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.string()], strict=True)], ["key", "doc_id", "n", "low", "begin", "finish", "text"])

    chunks = "key long, doc_id long, n long, low long, begin long, finish long, text string"
    large = rows.where(F.length("text") > giant).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    parts = stored(large.mapInArrow(split, chunks), "chunks")
    n_chunks, last = parts.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_chunks:
        return small
    tasks = -(-n_chunks // TASK_CHUNKS)
    parts = parts.repartition(tasks, "key", "n")  # with a number, so that it is kept as it is

    def matrices(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(_load(model), model_type(model) == BPE)
        for batch in batches:
            rows = batch.to_pylist()
            found = [_packed(scanner.matrix(r["text"], r["begin"], r["finish"], r["n"] == 0, r["low"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string())], ["key", "n", "matrix"])

    ends = boundary_states(stored(parts.mapInArrow(matrices, "key long, n long, matrix string"), "matrices"), last)

    def traced(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        scanner = Scanner(_load(model), model_type(model) == BPE)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [scanner.trace(r["text"], r["begin"], r["finish"], r["low"], tuple(json.loads(r["into"])), tuple(json.loads(r["out"]))) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["key", "doc_id", "n", "ids"])

    each = parts.join(ends.repartition(tasks, "key", "n").hint("merge"), ["key", "n"]).select("key", "doc_id", "n", "low", "begin", "finish", "text", "into", "out")
    ids = stored(each.mapInArrow(traced, "key long, doc_id long, n long, ids array<int>"), "traced")
    joined = ids.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("all"))
    return small.unionByName(joined.select("doc_id", F.flatten(F.col("all.ids")).alias("ids")))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text (what the model decodes ids to), ids_crc32 (of little-endian 32-bit ids) for each row of encoded.

    Null ids count as none and give the empty text; other columns are left out. An empty table gives an empty result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp = _load(model)
        for batch in batches:
            for at, n in _parts(batch.column(1)):
                part = batch.slice(at, n)
                lists = part.column(1)
                ends, values, none = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.is_null().to_numpy(zero_copy_only=False)
                ids = [values[a:a] if null else values[a:b] for a, b, null in zip(ends, ends[1:], none, strict=False)]
                text = sp.decode([x.tolist() for x in ids], num_threads=1)
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(text, pa.string()), pa.array(crc, pa.int64())], ["doc_id", "ids", "text", "ids_crc32"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string, ids_crc32 long")


def pieces_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, text_sha256 (of the decoded text) for each row of decode_documents()."""
    n_ids = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return decoded.select("doc_id", n_ids.alias("n_ids"), "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
