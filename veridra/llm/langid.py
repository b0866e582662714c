"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.llm.common import release, slices, text_bytes

PAD = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdConfig:
    """The network is fitted on a bounded sample: about `per_lang` texts of each language, and of each text one window of `window`
    characters at a place that a hash picks. All languages are learned; more than `max_langs` of them are an error, as the column then
    does not hold languages. Prediction reads whole texts, in stretches of at most `span` bytes, `batch` stretches at a time."""

    hidden: int = 6
    per_lang: int = 400
    max_langs: int = 2000
    window: int = 160
    span: int = 128
    batch: int = 1024
    steps: int = 400
    rate: float = 0.02
    seed: int = 7


class BiGRU:
    """Two gated recurrent layers, one forward and one backward, and a softmax over languages at every byte.

    Arrays lie as (time, unit, row), rows last, so that every numpy call runs over long stretches of memory. The gates
    are tanh of half the input, moved to 0..1: the logistic function."""

    def __init__(self, hidden: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (3 * h, PAD + 1)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["W" + d] = rng.normal(0, 0.3, (classes, h)).astype(np.float32)
        self.p["c"] = np.zeros((classes, 1), np.float32)

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (time, unit, row) over byte columns `x` (time, row). A padding byte keeps the state as it is."""
        h, n = self.h, x.shape[1]
        E, U = self.p["E" + d], self.p["U" + d]
        out = np.empty((len(x), h, n), np.float32)
        s = np.zeros((h, n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            e = E.take(x[t], axis=1)
            a = U @ s
            g = a[: 2 * h] + e[: 2 * h]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r, c = g[:h], g[h:], a[2 * h :]
            m = r * c
            m += e[2 * h :]
            np.tanh(m, out=m)
            if tape is not None:
                live = x[t] != PAD
                tape.append((t, s, z, r, c, m, live))
                s = np.where(live, m + z * (s - m), s)
                out[t] = s
            else:
                s = np.subtract(s, m, out=out[t])
                s *= z
                s += m
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, language, row) for byte columns `x`; rows' ends may be padded."""
        logits = self.p["Wf"] @ self.states(x, "f")
        logits += self.p["Wb"] @ self.states(x, "b")
        logits += self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def freeze(self) -> None:
        """Let padding close the update gate, so that prediction needs no mask."""
        for d in "fb":
            self.p["E" + d][:, PAD] = 0
            self.p["E" + d][: self.h, PAD] = 60

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all bytes; `y` is one language per row."""
        h, grads = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        tapes = {"f": [], "b": []}
        states = {d: self.states(x, d, tapes[d]) for d in "fb"}
        p = self.p["Wf"] @ states["f"] + self.p["Wb"] @ states["b"] + self.p["c"]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        live = x != PAD
        p[:, y, np.arange(x.shape[1])] -= 1
        p *= (live / max(1, live.sum()))[:, None, :].astype(np.float32)
        grads["c"] += p.sum(axis=(0, 2))[:, None]
        for d in "fb":
            grads["W" + d] += np.einsum("tcn,thn->ch", p, states[d], optimize=True)
            back = self.p["W" + d].T @ p
            U, ds = self.p["U" + d], np.zeros((h, x.shape[1]), np.float32)
            inputs = np.empty((len(x), 3 * h, x.shape[1]), np.float32)
            for t, s, z, r, c, m, on in reversed(tapes[d]):
                ds = ds + back[t]
                dn = ds * on
                dz = dn * (s - m) * z * (1 - z)
                dm = dn * (1 - z) * (1 - m * m)
                dr = dm * c * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dm])
                da = np.concatenate([dz, dr, dm * r])
                grads["U" + d] += da @ s.T
                ds = ds * ~on + dn * z + U.T @ da
            for j in range(3 * h):
                grads["E" + d][j] = np.bincount(x.ravel(), weights=inputs[:, j].ravel(), minlength=PAD + 1)
        return grads


def columns(stretches: list[np.ndarray], span: int) -> np.ndarray:
    """(time, row) array of byte values, padded behind."""
    out = np.full((span, len(stretches)), PAD, np.int16)
    for i, s in enumerate(stretches):
        out[: len(s), i] = s
    return out


def train(texts: list[str], labels: list[int], classes: int, cfg: LangIdConfig) -> BiGRU:
    """Fit the network by Adam on balanced batches of the texts' windows."""
    net, rng = BiGRU(cfg.hidden, classes, cfg.seed), np.random.default_rng(cfg.seed)
    data = [np.frombuffer(text_bytes(t)[: cfg.span], np.uint8).astype(np.int16) for t in texts]
    by = [np.flatnonzero(np.array(labels) == c) for c in range(classes)]
    by = [(c, rows) for c, rows in enumerate(by) if len(rows)]
    each = max(1, 96 // len(by))
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, cfg.steps + 1):
        picks = [(i, c) for c, rows in by for i in rng.choice(rows, each)]
        grads = net.gradients(columns([data[i] for i, _ in picks], cfg.span), np.array([c for _, c in picks]))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = cfg.rate * min(1.0, 2 * (1 - step / (cfg.steps + 1)))
        for k, g in grads.items():
            g *= min(1.0, 1 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    net.freeze()
    return net


def held_out(id_col: str) -> Column:
    """One document in three never takes part in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, cfg: LangIdConfig) -> tuple[list[str], list[int], list[str]]:
    """Windows, labels and the languages in order. Two passes: counts per language, then the rows whose hash falls under
    per_lang / count, so what reaches the driver is bounded whatever the table's size or skew."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    counts = known.groupBy(lang_col).agg(F.count("*").alias("c")).limit(cfg.max_langs + 1).collect()
    if len(counts) > cfg.max_langs:
        raise ValueError(f"more than {cfg.max_langs} languages in {lang_col}")
    langs = sorted(r[0] for r in counts)
    if not langs:
        return [], [], []
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(cfg.per_lang / r[1]))])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(cfg.seed)), F.lit(1_000_003)) / 1_000_003
    room = F.greatest(F.length(text_col) - cfg.window, F.lit(0))
    start = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(cfg.seed + 1)), room + 1).cast("int")
    rows = known.filter(drawn < F.element_at(share, F.col(lang_col))).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.substring(F.col(text_col), start, F.lit(cfg.window)).alias("t"))
    rows = sorted((r.i, r.l, r.t) for r in rows.limit(4 * cfg.per_lang * len(langs)).collect())
    at = {lang: i for i, lang in enumerate(langs)}
    return [t for *_, t in rows], [at[lang] for _, lang, _ in rows], langs


class Reader:
    """Pools a network's byte labels over whole texts."""

    def __init__(self, net: BiGRU, langs: list[str], cfg: LangIdConfig):
        self.net, self.langs, self.cfg = net, langs, cfg

    def read(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and mean probability of every text."""
        cfg, total = self.cfg, np.zeros((len(texts), len(self.langs)))
        stretches: list[np.ndarray] = []
        owners: list[int] = []
        has_letter = [any(map(str.isalpha, t)) if t else False for t in texts]

        def flush() -> None:
            width = max(map(len, stretches))
            x = columns(stretches, width)
            p = self.net.probabilities(x)
            p *= (x != PAD)[:, None, :]
            np.add.at(total, owners, p.sum(axis=0).T)
            stretches.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if has_letter[i]:
                data = np.frombuffer(text_bytes(text), np.uint8)
                for s in np.array_split(data, -(-len(data) // cfg.span)):
                    stretches.append(s)
                    owners.append(i)
                    if len(stretches) == cfg.batch:
                        flush()
        if stretches:
            flush()
        best = total.argmax(axis=1)
        sums = total.sum(axis=1)
        return [self.langs[b] if s > 0 else UNKNOWN for b, s in zip(best, sums)], [float(min(1.0, total[i, b] / s)) if s > 0 else 0.0 for i, (b, s) in enumerate(zip(best, sums))]


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Every row with `held_out`, `lang_pred` and `score`, replacing columns of these names; see `identify`."""
    texts, labels, langs = sample(docs, text_col, lang_col, id_col, cfg)
    reader = Reader(train(texts, labels, len(langs), cfg), langs, cfg) if langs else None
    kept = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out(id_col))
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 512, at):
                rows = piece.column(at).to_pylist()
                found, scores = reader.read(rows) if reader else ([UNKNOWN] * len(rows), [0.0] * len(rows))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        release()

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Predict every whole text's language, one row per row: (doc_id, held_out, lang_pred, score).

    `score` is the predicted language's mean probability over the text's bytes. Null, blank or letterless text is `und` with
    score 0, and so is every text if no labelled text is there to learn from. Null ids are never learned from and not held
    out. Equal texts get equal results up to rounding. Very long texts are read whole, in stretches. An empty table gives no rows.
    Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return with_language(rows, cfg=cfg).select("doc_id", "held_out", "lang_pred", "score")
