"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad; a line's features are its own and those of the
lines before and after it.  Marginals from forward-backward, weighted by the lines'
lengths, add up to a document's quality, which a logistic curve fitted on the
training documents turns into a probability.

Training takes a bounded sample: of the ``SAMPLE_DOCS`` eligible documents with the
lowest hash as many as have ``SAMPLE_LINES`` lines together; a document's label is
taken as the label of all its lines.  Scoring covers every document whole, in
double precision, and its digits do not depend on what a text is batched with.

Edge cases: a null or empty text is one empty line; repeated rows give repeated
results; documents with a null label are not trained on, and of repeated labels the
lowest counts; without any label every score is 0.5; columns beyond those
that are kept are ignored, and a kept column may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.durable import free_names
from tessera.llm.graph import every, map_in_arrow

SAMPLE_DOCS = 4_000
#: Lines of all training documents together, which bounds the driver's share; a document of more than a sixteenth of them is not trained on.
SAMPLE_LINES = 400_000
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
STEPS = 150
#: Bytes of text that are turned into features at a time.
CHUNK = 1 << 20

NAMES = ["upper", "digit", "stop", "symbol", "wide", "space", "word", "length", "words", "again", "again2", "same", "edge", "symbols_per_word", "caps"]


def _tables() -> np.ndarray:
    """For each byte, its class: upper, lower, digit, stop, symbol, wide, space, newline."""
    t = np.full(256, 4, np.uint8)
    t[ord("A") : ord("Z") + 1] = 0
    t[ord("a") : ord("z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[[ord(c) for c in ".,;:!?'\"()-"]] = 3
    t[128:] = 5
    t[[9, 11, 12, 13, 32]] = 6
    t[10] = 7
    return t


TABLE = _tables()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the number of lines of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    body = buf[:-8]
    kinds = TABLE[body]
    ends = np.flatnonzero(kinds == 7)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    one = np.maximum(length, 1).astype(np.float32)

    def share(k):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        return (total[ends] - total[starts]).astype(np.float32)

    upper, digit, stop, symbol, wide, space = (share(k) for k in (0, 2, 3, 4, 5, 6))
    ink = kinds < 6
    prev = np.concatenate([[False], ink[:-1]])
    first = np.flatnonzero(ink & ~prev)
    last = np.flatnonzero(prev & ~ink)  # the text ends with a newline
    line = np.searchsorted(ends, first)
    words = np.bincount(line, minlength=len(ends)).astype(np.float32)
    some = np.maximum(words, 1)
    # a word's mark: its length and first eight bytes
    head = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (len(body), 8), (1, 1))[first].copy().view("<u8").reshape(-1) if len(first) else np.zeros(0, "<u8")
    size = (last - first).astype(np.uint64)
    mask = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(size, np.uint64(7)) * np.uint64(8))) - np.uint64(1))
    mark = (head & mask) * np.uint64(0x9E3779B97F4A7C15) + size
    again = np.zeros(len(first), bool)
    again[1:] = (mark[1:] == mark[:-1]) & (line[1:] == line[:-1])
    again2 = np.zeros(len(first), bool)
    again2[2:] = (mark[2:] == mark[:-2]) & (line[2:] == line[:-2])
    count = lambda flags: np.bincount(line[flags], minlength=len(ends)).astype(np.float32)
    odd_end = (kinds[last - 1] == 4) if len(last) else np.zeros(0, bool)
    caps = (kinds[first] == 0) & (kinds[np.minimum(first + 1, len(kinds) - 1)] == 0) if len(first) else np.zeros(0, bool)
    total = np.zeros(len(ends), np.uint64)
    np.add.at(total, line, mark) if len(first) else None
    same = np.zeros(len(ends), np.float32)
    same[1:] = (total[1:] == total[:-1]) & (length[1:] == length[:-1]) & (length[1:] > 0)
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    same[np.cumsum(lines) - lines] = 0  # a text's first line has none before it
    letters = np.bincount(line, weights=(last - first).astype(np.float64), minlength=len(ends)).astype(np.float32)
    x = np.stack([upper / one, digit / one, stop / one, symbol / one, wide / one, space / one, np.minimum(letters / some, 30) / 10, np.log1p(length).astype(np.float32), np.log1p(words), count(again) / some, count(again2) / some, same, count(odd_end) / some, symbol / some, count(caps) / some], 1)
    return x.astype(np.float32), length, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those before and after within a document, and a constant."""
    begin = np.cumsum(lines) - lines
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begin] = 0
    after[begin + lines - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], 1)


def line_scores(x: np.ndarray, lines: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``with_neighbours(x, lines) @ w`` in double, one feature at a time: a line's digits depend on no other line of the batch."""
    begin, d = np.cumsum(lines) - lines, x.shape[1]
    own, before, after = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(d):
        col = x[:, k].astype(np.float64)
        own += col * w[k]
        before[1:] += col[:-1] * w[d + k]
        after[:-1] += col[1:] * w[2 * d + k]
    before[begin] = 0
    after[begin + lines - 1] = 0
    return own + before + after + w[3 * d]


class Chains:
    """Chains of unequal length side by side: documents by falling length, one step for all at a time."""

    def __init__(self, lines: np.ndarray):
        order = np.argsort(-lines, kind="stable")
        self.lines = lines[order]
        begin = (np.cumsum(lines) - lines)[order]
        n = np.searchsorted(-self.lines, -np.arange(lines.max(initial=0)), side="left")
        self.rows = [begin[:k] + t for t, k in enumerate(n)]

    def marginals(self, score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, the expected moves (2, 2), and the log partition function's sum."""
        n = len(score)
        unary = np.stack([np.zeros(n), score], 1)
        m, shift = np.exp(move - move.max()), move.max()
        top = unary.max(1, keepdims=True)
        e = np.exp(unary - top)
        fwd, bwd, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
        for t, r in enumerate(self.rows):
            q = fwd[self.rows[t - 1][: len(r)]] if t else None
            a = e[r] if t == 0 else (q[:, :1] * m[0] + q[:, 1:] * m[1]) * e[r]
            s = a.sum(1)
            fwd[r], scale[r] = a / s[:, None], s
        pair = np.zeros((2, 2))
        for t in range(len(self.rows) - 1, 0, -1):
            r = self.rows[t]
            q = self.rows[t - 1][: len(r)]
            b = e[r] * bwd[r] / scale[r][:, None]
            pair += (fwd[q].T @ b) * m
            bwd[q] = b[:, :1] * m[:, 0] + b[:, 1:] * m[:, 1]
        p = fwd * bwd
        moves = n - (len(self.rows[0]) if self.rows else 0)
        return p[:, 1] / p.sum(1), pair, float(np.log(scale).sum() + top.sum() + shift * moves)


class Model:
    """weights of the standardised features, moves between labels, and the final logistic curve."""

    def __init__(self, mean, std, w, move, curve):
        self.mean, self.std, self.w, self.move, self.curve = mean, std, w, move, curve

    def document_quality(self, x, length, lines) -> np.ndarray:
        """Length-weighted marginals; an empty line counts as one byte."""
        p, _, _ = Chains(lines).marginals(line_scores((x - self.mean) / self.std, lines, self.w), self.move)
        weight, begin = np.maximum(length, 1).astype(np.float64), np.cumsum(lines) - lines
        return np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        q = np.clip(self.document_quality(*line_features(texts)), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def adam(grad, x, steps, rate):
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (1 - (k - 1) / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def fit(x: np.ndarray, length: np.ndarray, lines: np.ndarray, label: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood of the lines' labels, a document's for each of its lines."""
    mean, std = x.mean(0), x.std(0) + 1e-3
    full = with_neighbours((x - mean) / std, lines).astype(np.float64)
    y, chains, d, n = np.repeat(label, lines).astype(np.float64), Chains(lines), full.shape[1], len(x)

    stay = np.array([[(lines - 1)[label == 0].sum(), 0], [0, (lines - 1)[label == 1].sum()]], np.float64)

    def grad(theta):
        move = theta[d:].reshape(2, 2)
        p, pair, _ = chains.marginals(full @ theta[:d], move)
        return np.concatenate([full.T @ (p - y) / n, ((pair - stay) / n).reshape(-1)]) + ridge * theta * np.concatenate([np.ones(d), np.full(4, 50.0)])

    theta = adam(grad, np.zeros(d + 4), steps, 0.1)
    model = Model(mean, std, theta[:d], theta[d:].reshape(2, 2), (1.0, 0.0))
    q = np.clip(model.document_quality(x, length, lines), 1e-9, 1 - 1e-9)
    z = np.log(q / (1 - q))

    def curve_grad(c):
        p = 1 / (1 + np.exp(-(c[0] * z + c[1])))
        return np.array([((p - label) * z).mean(), (p - label).mean()]) + 1e-4 * c

    model.curve = tuple(float(c) for c in adam(curve_grad, np.array([1.0, 0.0]), 400, 0.05))
    return model


def sample(docs: DataFrame, labels: DataFrame, docs_bound: int, lines_bound: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, label and line features of the training documents: in the order of a hash, as many as have ``lines_bound`` lines together."""
    good = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("doc_id is not null and label is not null")
    good = good.filter(fold(F.col("doc_id")) != HELD).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_bound)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # texts stay where they are until at most docs_bound of them are chosen by id and hash; both tables sent have at most as many rows
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sized = text.join(F.broadcast(good), "doc_id").select("doc_id", "hash", "label", n_lines.cast("long").alias("n")).distinct()
    place = [F.xxhash64("doc_id"), "doc_id", "hash"]
    sized = sized.filter(F.col("n") <= lines_bound // 16).orderBy(*place).limit(docs_bound)
    upto = F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    keys = sized.withColumn("upto", upto).filter(F.col("upto") <= lines_bound).select("doc_id", "hash", "label")
    chosen = text.join(F.broadcast(keys), ["doc_id", "hash"])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, mark, label, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, length, _ = line_features([text.encode()])
                rows.append((doc, mark, label, x.tobytes(), length.astype("<i8").tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "hash", "label", "x", "length"])

    found = chosen.select(F.col("doc_id").cast("long"), "hash", "label", "text").mapInArrow(run, "doc_id long, hash long, label int, x binary, length binary")
    return found.groupBy("doc_id", "hash", "label").agg(F.first("x").alias("x"), F.first("length").alias("length"))


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS


def train(docs: DataFrame, labels: DataFrame, docs_bound: int = SAMPLE_DOCS, lines_bound: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    rows = sorted(sample(docs, labels, docs_bound, lines_bound, id_col, text_col, label_col).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if len({r.label for r in rows}) < 2:
        return None
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, len(NAMES)) for r in rows]
    return fit(np.concatenate(xs), np.concatenate([np.frombuffer(r.length, "<i8") for r in rows]), np.array([len(x) for x in xs]), np.array([r.label for r in rows]))


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id), then score and predicted, with underscores added where a kept column has that name."""
    kept = docs.select(*every(docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in (keep or [id_col])])))
    names = free_names(kept, "score", "predicted", "_text")
    given = docs.select(*every(kept), F.col(text_col).cast("string").alias(names[2]))
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            done, texts, size, got = 0, [], 0, []
            for t in batch.column(batch.num_columns - 1):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1]) + 1
                if size >= CHUNK:
                    got.append(model.scores(texts) if model else np.full(len(texts), 0.5))
                    done, texts, size = done + len(texts), [], 0
            if texts:
                got.append(model.scores(texts) if model else np.full(len(texts), 0.5))
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [f"c{i}" for i in range(len(schema))])

    return map_in_arrow(given, run, schema)


def op2_crf_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole document; a fifth of the ids is held out of training."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "score", "predicted")
