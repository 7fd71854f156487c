"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns name three kinds (assign, access, hex); their spans always stay. A candidate is a
run of 16 or more characters of ``A-Za-z0-9+/_=-``. The network (numpy) reads it in views of 40
characters, each with 24 before it and what follows; views of a longer candidate overlap by
half, up to its end, and the highest score counts. The calibrated score adds spans of kind
``model`` where no other span lies.

It is trained on labelled findings: all different candidates of all documents, labelled by the
patterns, and generated ones for secrets that have no keyword beside them and for strings that
only look alike. A third of the labelled findings calibrate the scores (Platt) and set the
threshold: the highest one that still finds ``RECALL`` of the labelled secrets of every kind there.

* Findings are dealt by hash into parts of some ``PART``. A network that has learned from one of them goes
  on learning in all of them at once, ``ROUNDS`` times, and what they have made of it is averaged by their
  numbers of findings. Scores that calibrate are counted in steps of 1 / ``STEPS``; the driver holds networks and counts alone.
* A null text counts as empty: no spans. Offsets are code points, ends exclusive. Repeated
  rows are repeated; an empty table gives no rows and a network of generated findings only.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import drop_path, shared_path, sliced, texts_of

KINDS = ("assign", "access", "hex", "model")
RECALL, PART, ROUNDS, STEPS = 0.98, 20_000, 3, 256
BEFORE, WITHIN, AFTER = 24, 40, 8
WIDTH, FILTERS, EMBEDDED = 5, 24, 8

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUNS = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, in bytes. Texts without a keyword or a long enough run are passed over."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.translate(_HEX_RUNS):
        # runs are maximal either way, so asking for 32 finds those that a plain run of 32 or more is
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that are scored: all of it, or overlapping ones of ``WITHIN`` characters that cover it."""
    return [(at, at + WITHIN) for at in [*range(start, end - WITHIN, WITHIN // 2), end - WITHIN]] if end - start > WITHIN else [(start, end)]


#: Classes of bytes that the network tells apart: 26 letters in lower and upper case, digits, and signs.
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 1 + _c - 97 if 97 <= _c <= 122 else 27 + _c - 65 if 65 <= _c <= 90 else 53 + _c - 48 if 48 <= _c <= 57 else 63 + b"+/_=-.:\"' @\n".find(_c) + 1 if _c in b"+/_=-.:\"' @\n" else 76
CLASSES = 77


def view(text: bytes, start: int, end: int) -> np.ndarray:
    """Class numbers of a part of a candidate and its context; 0 where the text has ended or the part has."""
    out = np.zeros(BEFORE + WITHIN + AFTER, np.int64)
    before = text[max(0, start - BEFORE) : start]
    own = text[start:end]
    after = text[end : end + AFTER]
    for at, part in ((BEFORE - len(before), before), (BEFORE, own), (BEFORE + WITHIN, after)):
        out[at : at + len(part)] = _CLASS[np.frombuffer(part, np.uint8)]
    return out


class Network:
    """Embedding, one convolution, its maximum over all places and its mean over the candidate's, logistic output."""

    #: Places of the convolution that lie within the candidate.
    INSIDE = slice(BEFORE, BEFORE + WITHIN - WIDTH + 1)

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 0.3, (CLASSES, EMBEDDED)), r.normal(0, 0.15, (WIDTH * EMBEDDED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, FILTERS), np.zeros(1), r.normal(0, 0.2, FILTERS)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        e = self.w[0][x]
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(WIDTH)], axis=2)
        conv = cols @ self.w[1] + self.w[2]
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None], 1)[:, 0]
        # the share that each place of the candidate has in the mean; places behind its end have none
        share = (x[:, self.INSIDE] > 0)[:, :, None] * 1.0
        share /= np.maximum(share.sum(1, keepdims=True), 1)
        active = conv[:, self.INSIDE] > 0
        mean = (conv[:, self.INSIDE] * active * share).sum(1)
        return np.maximum(top, 0) @ self.w[3] + mean @ self.w[5] + self.w[4][0], cols, best, top, mean, active * share

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> None:
        order = np.random.default_rng(5)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            own_rate = rate if epoch < epochs * 2 // 3 else 0.3 * rate
            for rows in np.array_split(order.permutation(len(x)), max(1, len(x) // batch)):
                z, cols, best, top, mean, share = self.forward(x[rows])
                dz = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
                dtop = dz[:, None] * self.w[3] * (top > 0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)
                dcols = dtop[:, :, None] * self.w[1].T[None]
                # letters are told apart by the maximum alone: the mean teaches the filters, not the embedding
                demb = np.zeros_like(self.w[0])
                for i in range(WIDTH):
                    np.add.at(demb, np.take_along_axis(x[rows], best + i, 1), dcols[:, :, i * EMBEDDED : (i + 1) * EMBEDDED])
                dmean = (dz[:, None] * self.w[5])[:, None] * share
                dfilters = np.einsum("bfc,bf->cf", picked, dtop) + np.einsum("bnc,bnf->cf", cols[:, self.INSIDE], dmean, optimize=True)
                grads = [demb, dfilters, dtop.sum(0) + dmean.sum((0, 1)), np.maximum(top, 0).T @ dz, np.array([dz.sum()]), mean.T @ dz]
                step += 1
                for w, g, a, b in zip(self.w, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= own_rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, kind: np.ndarray | None = None) -> None:
        """Platt's parameters, and the highest threshold that finds ``recall`` of the secrets of every ``kind``."""
        self.settle(self.places(x), y, np.ones(len(x)), np.zeros(len(x), np.int64) if kind is None else kind, recall)

    def settle(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, kind: np.ndarray, recall: float) -> None:
        """The same from the network's outputs ``z``, each of which stands for ``n`` findings."""
        for _ in range(300):  # Platt's two parameters, by plain gradient steps
            d = n * (1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))) - y)
            self.scale -= 0.05 * float((d * z).sum() / n.sum())
            self.shift -= 0.05 * float(d.sum() / n.sum())
        scores, least = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))), []
        for k in np.unique(kind[y == 1]):
            own = np.nonzero((y == 1) & (kind == k))[0]
            own = own[np.argsort(scores[own], kind="stable")]
            upto = np.cumsum(n[own])
            least.append(float(scores[own[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]]))
        self.threshold = min(least, default=1.0)

    def places(self, x: np.ndarray) -> np.ndarray:
        out = [self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.places(x) + self.shift, -30, 30)))


def generated(n: int = 8000, seed: int = 11) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Labelled findings from rules: keys of several alphabets, and strings that only look like keys; and which rule made each."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    parts_of_words = ["th", "er", "on", "an", "re", "ing", "de", "la", "tion", "en", "os", "mi"]
    spoken = lambda: r.choice(["", "b", "c", "ch", "d", "f", "g", "h", "k", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "th", "v", "w"]) + r.choice(["a", "e", "i", "o", "u", "ea", "oo", "ou"]) + r.choice(["", "", "n", "ng", "r", "s", "t", "l", "m", "ck", "ct", "th"])
    word = lambda: "".join(r.choice(parts_of_words) if r.randrange(2) else spoken() for _ in range(r.randint(1, 4)))
    path = lambda n: "/" + "/".join(word() for _ in range(n)) + "/"
    secret = [
        lambda: some(lower + upper + digits, 24, 44),
        lambda: r.choice(["sk_live_", "sk-", "ghp_", "xoxb-", "pk_"]) + some(lower + upper + digits, 20, 40),
        lambda: some(lower + upper + digits + "+/", 30, 60) + r.choice(["", "=", "=="]),
        lambda: some("0123456789abcdef", 24, 64),
        lambda: some("0123456789ABCDEF", 32, 64),
        lambda: some(upper + digits, 20, 32),
        lambda: some(lower + upper + digits, 16, 24),
        lambda: some(lower + upper, 16, 40),
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: some(lower + upper + digits, 16, 18),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + some(digits, 1, 4),
        lambda: "/" + "/".join(word() for _ in range(r.randint(2, 5))) + "/" + some(digits, 1, 6),
        lambda: "_".join(word() for _ in range(r.randint(3, 5))) + some(digits, 1, 3),
        lambda: word() + word() + word() + some(digits, 1, 4) + word() + word(),
        lambda: some(digits, 4, 4) + "-" + some(digits, 2, 2) + "-" + some(digits, 2, 2) + "T" + some(digits, 6, 8),
        lambda: some(digits, 16, 24),
        lambda: "+" + some(digits, 2, 3) + "-" + "-".join(some(digits, 3, 4) for _ in range(3)),
        lambda: "-" * r.randint(12, 30) + some(digits, 1, 3) + "-" * r.randint(1, 9),
        lambda: "=" * r.randint(16, 40) + some(digits, 1, 2),
        lambda: word() + "/" + word() + "/" + some(digits, 1, 4) + "=" + word() + word() + word(),
        lambda: path(r.randint(5, 12)),
        lambda: r.choice("-_/").join(word() for _ in range(r.randint(3, 12))),
        lambda: "".join(word() for _ in range(r.randint(3, 8))),
        lambda: r.choice("-=_") * r.randint(16, 90),
    ]
    lead = lambda: r.choice(["", r.choice(["key ", "Authorization: Bearer ", "credential=", "auth: "]), *[" ".join(word() for _ in range(4)) + r.choice([" ", ": ", "\n", ' "'])] * 3])
    x, y, kind = [], [], []
    for i in range(n):
        rule = r.randrange(len(secret if i % 2 else plain))
        own = (secret if i % 2 else plain)[rule]().encode()
        # one key in six comes after a path or a long name
        ahead = r.choice([path(r.randint(2, 9)), "_".join(word() for _ in range(r.randint(3, 9))) + "="]).encode() if i % 2 and not r.randrange(6) else b""
        before = (lead() if i % 2 else " ".join(word() for _ in range(4)) + r.choice([" ", ": ", "\n", "("])).encode()
        text = before + ahead + own + r.choice([" ", '"', ".", "\n", ", "]).encode() + word().encode()
        key = len(before) + len(ahead)
        for start, end in parts(len(before), key + len(own)):
            seen = min(end, key + len(own)) - max(start, key)
            if not ahead or seen <= 0 or seen >= min(16, len(own)):  # what holds a bit of a key is neither
                x.append(view(text, start, end))
                y.append(i % 2 if seen > 0 else 0)
                kind.append(rule)
    return x, y, kind


def _aside(x: np.ndarray) -> np.ndarray:
    """Which findings calibrate: a third, by what they are."""
    return np.array([hashlib.md5(row.tobytes()).digest()[0] % 3 == 0 for row in x], bool)


def _views(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int64)


def findings(docs: DataFrame) -> DataFrame:
    """(view, label): the different parts of all candidates of all documents, labelled by the patterns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda views, labels: pa.RecordBatch.from_arrays([pa.array(views, pa.binary()), pa.array(labels, pa.int32())], ["view", "label"])
        for b in sliced(batches, 0):
            views, labels = [], []
            for text in texts_of(b.column(0)):
                found = candidates(text)
                spans = base_spans(text) if found else []
                for start, end in found:
                    own = [(s, e) for s, _, e in spans if s < end and start < e]
                    for a, z in parts(start, end):
                        # a part without the secret is no example against it where the candidate holds one
                        if (label := any(s < z and a < e for s, e in own)) or not own:
                            views.append(view(text, a, z).astype(np.uint8).tobytes())
                            labels.append(int(label))
                    if len(views) >= 8192:
                        yield batch(views, labels)
                        views, labels = [], []
            yield batch(views, labels)

    return docs.select(F.col("text").cast("string")).mapInArrow(of, "view binary, label int").distinct()


def learned(rows: DataFrame, network: Network, given: tuple[np.ndarray, np.ndarray], epochs: int) -> Network:
    """``network`` after ``epochs`` over the findings of each part and the ``given`` ones, averaged over the parts by their findings."""
    shared = rows.sparkSession.sparkContext.broadcast((network, given[0].astype(np.uint8), given[1]))

    def of(part: pa.Table) -> pa.Table:
        own, x, y = shared.value
        part = part.sort_by([("view", "ascending"), ("label", "ascending")])
        views = _views(part.column("view"))
        kept = ~_aside(views)
        made = pickle.loads(pickle.dumps(own))
        made.fit(np.concatenate([x.astype(np.int64), views[kept]]), np.concatenate([y, part.column("label").to_numpy()[kept].astype(np.float64)]), epochs)
        return pa.table({"part": part.column("part")[:1], "n": pa.array([len(views)], pa.int64()), "w": pa.array([np.concatenate([w.ravel() for w in made.w])], pa.list_(pa.float64()))})

    made = sorted((r["part"], r["n"], np.array(r["w"])) for r in rows.groupBy("part").applyInArrow(of, "part int, n long, w array<double>").collect())
    flat, at = sum(n * w for _, n, w in made) / sum(n for _, n, _ in made), 0
    out = Network()
    for k, w in enumerate(out.w):
        out.w[k] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return out


def counted(rows: DataFrame, network: Network) -> list[tuple[int, int, int]]:
    """(step, label, n): how many findings that calibrate have an output of the network in each step."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _views(b.column(0))
                kept = _aside(x)
                steps = np.floor(np.clip(shared.value.places(x[kept]), -32, 32) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(steps), b.column(1).filter(pa.array(kept))], ["step", "label"])

    return [tuple(r) for r in rows.select("view", "label").mapInArrow(of, "step long, label int").groupBy("step", "label").count().orderBy("step", "label").collect()]


def train(docs: DataFrame, recall: float = RECALL, size: int = PART) -> Network:
    """A network from generated findings and those of all ``docs``, labelled by the patterns."""
    x, y, kind = (np.array(a) for a in generated())
    y, aside, spark = y.astype(np.float64), _aside(x), docs.sparkSession
    made, given, path = Network(), (x[~aside], y[~aside]), shared_path(spark, "findings")
    findings(docs).write.parquet(path)
    rows = spark.read.parquet(path)
    n = -(-rows.count() // size)
    steps = []
    if n:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("view"), F.lit(n)).cast("int"))
        made = learned(rows.where("part = 0"), made, given, 12)
        for _ in range(ROUNDS if n > 1 else 0):
            made = learned(rows, made, given, 1)
        steps = counted(rows, made)
    else:
        made.fit(*given)
    drop_path(spark, path)
    at, label, many = np.array(steps, np.float64).reshape(-1, 3).T
    z = np.concatenate([made.places(x[aside]), at / STEPS])
    made.settle(z, np.concatenate([y[aside], label]), np.concatenate([np.ones(int(aside.sum())), many]), np.concatenate([kind[aside], np.full(len(many), -1)]), recall)
    return made


def spans_of(texts: list[bytes], network: Network) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind, end) for each text, in code points, in order of start and kind."""
    found = [base_spans(t) for t in texts]
    asked = [(k, start, end) for k, t in enumerate(texts) for start, end in candidates(t)]
    pieces = [(n, a, z) for n, (_, start, end) in enumerate(asked) for a, z in parts(start, end)]
    if asked:
        best = np.zeros(len(asked))
        for i in range(0, len(pieces), 8192):
            part = pieces[i : i + 8192]
            np.maximum.at(best, [n for n, _, _ in part], network.scores(np.stack([view(texts[asked[n][0]], a, z) for n, a, z in part])))
        for (k, start, end), score in zip(asked, best, strict=True):
            if score >= network.threshold and not any(s < end and start < e for s, kind, e in found[k] if kind < 3):
                found[k].append((start, 3, end))
    for text, spans in zip(texts, found, strict=True):
        if spans and not text.isascii():
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            spans = [(int(chars[s]), k, int(chars[e])) for s, k, e in spans]
        yield sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with the array ``secrets`` of (kind, start, end)."""
    names = [*docs.columns, "secrets"]
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in spans_of(list(texts_of(b.column(at))), shared.value)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names)

    return docs.mapInArrow(of, docs.select("*", F.expr("cast(null as array<struct<kind: string, start: bigint, end: bigint>>)").alias("secrets")).schema)


def report(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), network).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.filter("secrets", lambda s: s["kind"] != "model")), 256).alias("base_sha256"), text("secrets").alias("spans")
    )


def redact(docs: DataFrame, network: Network, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, and n_chars, if there is one, counted anew."""
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            values = b.column(at).to_pylist()
            for k, spans in enumerate(spans_of(list(texts_of(b.column(at))), shared.value)):
                upto, parts = 0, []
                for start, _, end in spans:
                    if start >= upto:
                        parts += [values[k][upto:start], mark]
                    upto = max(upto, end)
                if spans:
                    values[k] = "".join([*parts, values[k][upto:]])
            columns = b.columns
            columns[at] = pa.array(values, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(of, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
