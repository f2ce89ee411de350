"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a run of letters forwards and backwards, and a
softmax over both states labels every byte position with a language; its state
starts anew at each run, and in a run of over ``LONGEST`` bytes at each piece of
whole characters.  A document's probabilities pool all positions of all its
runs: the prediction has the largest mean log probability, and its score is the
mean probability.  As a run's labels depend on the run alone, each distinct run
is read once per batch of work and kept in a bounded cache.

Training is backpropagation through time in numpy on the driver, on every run
of at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of
their id.  Languages weigh the same.

Defined results: ``und`` with score 0 for a null text, one without letters, or
where nothing was learnt (as from an empty table); null languages are not
learnt from; of equally likely languages (ties) the first by name; very long
texts are read whole; a null id is held out or not like the text '' and
repeated rows are judged alike; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``predict`` and kept by
``keep_identified``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, map_batches

SAMPLE_DOCS = 3000
HIDDEN, BATCH, STEPS, RATE, SEED = 16, 512, 900, 0.01, 17
LONGEST, CACHED, POSITIONS = 64, 400_000, 65_536
RUN = re.compile(r"[^\W\d_]+")


def pieces_of(run: str) -> list[bytes]:
    """The bytes of a run, in pieces of whole characters and at most LONGEST bytes."""
    b = run.encode()
    if len(b) <= LONGEST:
        return [b]
    out, at = [], 0
    while at < len(b):
        stop = min(len(b), at + LONGEST)
        while stop < len(b) and b[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(b[at:stop])
        at = stop
    return out


@dataclass
class Network:
    """Weights of both directions (w: byte x 3H, u: H x 3H, b: 3H; gates z, r, n) and of the softmax."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        weights = {}
        for d in "fb":
            weights |= {f"w{d}": r.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"b{d}": np.zeros(3 * hidden)}
        weights |= {"o": r.normal(0, 0.1, (2 * hidden, len(langs))), "c": np.zeros(len(langs))}
        return cls(langs, {k: v.astype(np.float32) for k, v in weights.items()})

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [time, rows, H] over bytes x [time, rows]; ``keep`` gets what the way back needs."""
        w, u, b = (self.weights[k + d] for k in "wub")
        n = u.shape[0]
        h = np.zeros((x.shape[1], n), dtype=u.dtype)
        out = np.empty((x.shape[0], x.shape[1], n), dtype=u.dtype)
        for t in range(x.shape[0]):
            a, g = w[x[t]] + b, h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * n] + g[:, : 2 * n])))
            z, r, gn = zr[:, :n], zr[:, n:], g[:, 2 * n :]
            new = np.tanh(a[:, 2 * n :] + r * gn)
            if keep is not None:
                keep.append((h, z, r, gn, new))
            h = new + z * (h - new)
            out[t] = h
        return out

    def log_probs(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log probabilities [time, rows, languages] of every position."""
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self.states(x, "f", kf), self.states(x[::-1], "b", kb)[::-1]], axis=2)
        y = both @ self.weights["o"] + self.weights["c"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        if keep is not None:
            keep |= {"f": kf, "b": kb, "both": both}
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted loss over all positions and its gradients, through time."""
        keep: dict = {}
        y = self.log_probs(x, keep)
        rows = np.arange(x.shape[1])
        loss = -float((y[:, rows, label] * weight).sum())
        dy = np.exp(y)
        dy[:, rows, label] -= 1
        dy *= weight[None, :, None]
        n, both = self.weights["uf"].shape[0], keep["both"]
        grad = {"o": np.einsum("trh,trl->hl", both, dy), "c": dy.sum(axis=(0, 1))}
        dboth = dy @ self.weights["o"].T
        for d, dh_all, xs in (("f", dboth[:, :, :n], x), ("b", dboth[::-1, :, n:], x[::-1])):
            w, u = np.zeros_like(self.weights["w" + d]), self.weights["u" + d]
            du, db = np.zeros_like(u), np.zeros_like(self.weights["b" + d])
            dh = np.zeros_like(dh_all[0])
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, gn, new = keep[d][t]
                dh = dh + dh_all[t]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(w, xs[t], da)
                db += da.sum(axis=0)
                du += h.T @ dg
                dh = dh * z + dg @ u.T
            grad |= {"w" + d: w, "u" + d: du, "b" + d: db}
        return loss, grad


def _matrix(runs: list[bytes]) -> np.ndarray:
    """Bytes [time, rows] of runs of one length."""
    return np.frombuffer(b"".join(runs), dtype=np.uint8).reshape(len(runs), -1).T.astype(np.intp)


def train(examples: list[tuple[bytes, str, int]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """A network from (run, language, count) examples, by Adam over batches of runs of one length."""
    langs = sorted({x[1] for x in examples})
    net = Network.fresh(langs, hidden, seed)
    if not langs:
        return net
    r = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(langs)}
    mass = np.zeros(len(langs))
    for run, lang, n in examples:
        mass[code[lang]] += n * len(run)
    groups: dict[int, list] = {}
    for run, lang, n in sorted(examples):
        groups.setdefault(len(run), []).append((run, code[lang], n / mass[code[lang]]))
    lengths, share, data = [], [], []
    for k, g in sorted(groups.items()):
        p = np.array([x[2] for x in g])
        lengths.append(k)
        share.append(p.sum())
        data.append((g, p / p.sum()))
    share = np.array(share) / np.sum(share)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        g, p = data[r.choice(len(lengths), p=share)]
        picked = [g[i] for i in r.choice(len(g), size=BATCH, p=p)]
        x = _matrix([q[0] for q in picked])
        weight = np.full(len(picked), 1 / (x.shape[0] * len(picked)), dtype=np.float32)
        _, grad = net.gradients(x, np.array([q[1] for q in picked]), weight)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in grad.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Pools the labels of all positions; distinct runs are read once while they stay cached."""

    def __init__(self, net: Network):
        self.net, self.k = net, len(net.langs)
        self.row: dict[str, int] = {}
        self.sums = np.zeros((0, 2 * self.k + 1), dtype=np.float64)

    def read(self, runs: list[str]) -> np.ndarray:
        """For each run the sums over its positions of log probabilities, of probabilities and of 1."""
        out = np.zeros((len(runs), 2 * self.k + 1), dtype=np.float64)
        groups: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, run in enumerate(runs):
            for piece in pieces_of(run):
                places, pieces = groups.setdefault(len(piece), ([], []))
                places.append(i)
                pieces.append(piece)
        for n, (places, pieces) in groups.items():
            # by positions: the states of long pieces take as much memory as those of short ones
            step = max(1, POSITIONS // n)
            for at in range(0, len(pieces), step):
                y = self.net.log_probs(_matrix(pieces[at : at + step]))
                got = np.concatenate([y.sum(axis=0), np.exp(y).sum(axis=0), np.full((y.shape[1], 1), n)], axis=1)
                np.add.at(out, places[at : at + step], got)
        return out

    def pool(self, texts: list[str]) -> np.ndarray:
        """For each text the pooled sums."""
        lists = [RUN.findall(t.lower()) for t in texts]
        new = list({w for runs in lists for w in runs if w not in self.row})
        if len(self.row) + len(new) > CACHED:
            self.row, self.sums = {}, self.sums[:0]
            new = list({w for runs in lists for w in runs})
        if new:
            new.sort()
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.read(new)])
        out = np.zeros((len(texts), 2 * self.k + 1))
        for i, runs in enumerate(lists):
            if runs:
                out[i] = self.sums[np.fromiter(map(self.row.__getitem__, runs), dtype=np.int64, count=len(runs))].sum(axis=0)
        return out

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The predicted language and its score of each text."""
        if not self.k:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = self.pool([t or "" for t in texts])
        best, n = sums[:, : self.k].argmax(axis=1), sums[:, -1]
        score = np.where(n > 0, sums[np.arange(len(texts)), self.k + best] / np.maximum(n, 1), 0.0)
        return [self.net.langs[b] if m else "und" for b, m in zip(best, n, strict=True)], np.clip(score, 0, 1)


def held_out(of: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of ``of``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == 0


def _labelled(df: DataFrame, folds: int, held: bool) -> DataFrame:
    out = held_out(folds)
    return df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (out if held else ~out))


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, lang) of at most ``limit`` rows of different id or text, those with the smallest hash of the id; repeated rows count once, by their first language."""
    keyed = rows.select("doc_id", "text", "lang", F.xxhash64("text").alias("_text"))
    keys = keyed.select("doc_id", "_text").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(limit).toDF("_id", "_hash")
    taken = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return taken.groupBy("doc_id", "_text").agg(F.min("lang").alias("lang"), F.first("text").alias("text")).select("doc_id", "text", "lang")


def fit(df: DataFrame, folds: int = 5, sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network from the labelled rows (doc_id, text, lang) that are not held out."""

    def runs(batches):
        for b in batches:
            count: dict[tuple[bytes, str], int] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for run in RUN.findall(text.lower()):
                    for piece in pieces_of(run):
                        count[piece, lang] = count.get((piece, lang), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.binary()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["run", "lang", "n"])

    taken = _sample(_labelled(df, folds, False), sample_docs).select("text", "lang")
    rows = map_batches(taken, runs, "run binary, lang string, n long").groupBy("run", "lang").agg(F.sum("n").alias("n")).toArrow()
    return train(list(zip(*[rows.column(k).to_pylist() for k in range(3)], strict=True)))


def least_score(df: DataFrame, net: Network, folds: int = 5) -> float:
    """The score below which a text is in no known language.

    Halfway between a guess among the languages and the score that all but one
    in two hundred of all held-out labelled documents reach (rows that repeat id
    and text count once); a guess where none is held out.
    """
    guess = 1 / max(1, len(net.langs))
    rows = _labelled(df, folds, True).select("doc_id", "text", F.xxhash64("text").alias("_text"))
    scored = predict(rows, net, keep=("_text",)).filter("lang_pred <> 'und'")
    got = scored.groupBy("doc_id", "_text").agg(F.min("score").alias("score")).agg(F.percentile_approx("score", 0.005, 10_000)).first()[0]
    return guess if got is None else max(guess, (guess + got) / 2)


def predict(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the columns named in ``keep``."""
    model = df.sparkSession.sparkContext.broadcast(net)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(1).alias("_"), *[F.col(c) for c in keep]).alias("own"))
    id_kind, own_kind = (t for _, t in rows.select("doc_id", "own").dtypes)

    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                langs, scores = reader.label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "own", "lang_pred", "score"])

    out = map_batches(rows, run, f"doc_id {id_kind}, own {own_kind}, lang_pred string, score double")
    return out.select("doc_id", "lang_pred", "score", *[F.col("own")[c].alias(c) for c in keep])


def keep_identified(df: DataFrame, net: Network, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` in a language that the network knows, with all their columns.

    Rejected are texts without letters and those that score below ``least``,
    by default ``least_score`` of the rows, which then need doc_id and lang.
    """
    least = least_score(df, net) if least is None else least
    model, at = df.sparkSession.sparkContext.broadcast(net), df.columns.index(text_col)

    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                langs, scores = reader.label(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    # by number: a name with a dot in it could not be resolved
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return map_batches(plain, run, plain.schema).toDF(*df.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    net = fit(docs)
    return predict(docs, net).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
