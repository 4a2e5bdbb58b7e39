"""Secret scans: rules, and a character convolutional network in numpy over every candidate."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import extended, release, stored, texts

# The rules' patterns, least lengths and kinds in order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "model")

#: What the network looks at: runs of so many such characters with a letter and a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}")
#: Characters before, of and after the candidate that are read.
BEFORE, INSIDE, AFTER = 20, 44, 8
#: Longer candidates are read by windows of INSIDE characters that start so far apart.
STEP = 22
#: Runs that may be keys which the rules don't know: no examples of what is none.
_RUN, _CHANGE, LEAST_CHANGES = re.compile(r"[A-Za-z0-9]{16,}"), re.compile(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), 3
#: Findings, about, that a task learns from at a time, and the recall that the threshold keeps.
BLOCK, RECALL = 6_000, 0.98
#: Rounds over all findings; parts of one in which changes of weights are summed up, as whole numbers, so that their order
#: does not matter; and the steps and bounds by which scores before calibration are counted.
EPOCHS, PARTS, BINS, FAR = 12, float(1 << 32), 64, 64
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: Of so many shares of the findings, by a hash of what is found, one calibrates and one measures.
SPLITS = 6
_WORD = re.compile(r"(?<!\S)[A-Za-z]{3,9}(?!\S)")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Matches of the rules, leftmost and without overlap for each kind, in order of start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of 24 or more is the same whether shorter runs are matched and dropped, or not matched
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def view(text: str, start: int, end: int) -> bytes:
    """The fixed-width window that the network reads; other characters than ASCII become one code."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    right = text[end : end + AFTER].ljust(AFTER, "\0")
    return (left + inside + right).encode("ascii", "replace").replace(b"\n", b" ")


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping spans of INSIDE characters at most that cover a candidate; a short one is its own."""
    last = max(start, end - INSIDE)
    return [(s, min(end, s + INSIDE)) for s in (*range(start, last, STEP), last)]


def merged(spans: list[Span]) -> list[list[int]]:
    """Spans in order of start as runs (start, end) that neither touch nor overlap."""
    out: list[list[int]] = []
    for start, _, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def uncovered(text: str, found: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """The candidates of ``found``, and of those that rules match in part, the parts left that are candidates by themselves."""
    out, runs, k = [], merged(base), 0
    for s, e in found:
        while k < len(runs) and runs[k][1] <= s:
            k += 1
        at, j = s, k
        while at < e:
            a, b = runs[j] if j < len(runs) and runs[j][0] < e else (e, e)
            if a > at and ((at, a) == (s, e) or CANDIDATE.fullmatch(text[at:a])):
                out.append((at, a))
            at, j = b, j + 1
    return out


def key_like(text: str) -> bool:
    return any(len(_CHANGE.findall(x)) >= LEAST_CHANGES for x in _RUN.findall(text))


@dataclass
class Network:
    """Embedding, one convolution, greatest value over the place, and a logistic output.

    ``held_out`` says how it does on findings that neither trained nor calibrated it.
    """

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    held_out: dict[str, float] = field(default_factory=dict)

    def forward(self, x: np.ndarray) -> tuple:
        e = self.emb[x]
        width = self.conv.shape[0] // self.emb.shape[1]
        cols = np.lib.stride_tricks.sliding_window_view(e, width, axis=1)  # n, places, dim, width
        cols = cols.transpose(0, 1, 3, 2).reshape(len(x), e.shape[1] - width + 1, -1)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        top = h.argmax(axis=1)
        pooled = np.take_along_axis(h, top[:, None, :], axis=1)[:, 0, :]
        return cols, top, pooled, pooled @ self.out[:-1] + self.out[-1]

    def probability(self, views: list[bytes], batch: int = 512) -> np.ndarray:
        """Calibrated probabilities that the candidates are secrets."""
        if not views:
            return np.empty(0)
        x = np.frombuffer(b"".join(views), dtype=np.uint8).reshape(len(views), -1) & 127
        z = np.concatenate([self.forward(x[i : i + batch])[3] for i in range(0, len(x), batch)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


Finding = tuple[bytes, int, int]  # what the network reads, label, hash of what is found


def _finding(text: str, start: int, end: int, label: int) -> Finding:
    return view(text, start, end), label, zlib.crc32(text[start:end].encode())


def _made_up(rng: np.random.Generator) -> list[Finding]:
    """Labelled findings by rule: keys of random characters, and identifiers with structure."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick(lower, int(rng.integers(3, 9)))
    out = []
    for _ in range(400):
        chars = (upper + lower + digits, upper + digits, lower + digits, digits + "ABCDEF", upper + lower + digits + "+/")[int(rng.integers(5))]
        key = pick(chars, int(rng.integers(20, 44)))
        prefix = str(rng.choice(["", "sk-", "ghp_", "xoxb-", "key_", ""]))
        before = str(rng.choice([f"{word()} {word()} ", f"{word()}: ", f'{word()}="', "Authorization: Bearer "]))
        text = before + prefix + key + str(rng.choice([" ", '"', "\n", ""])) + word()
        out.append(_finding(text, len(before), len(before) + len(prefix + key), 1))
        route = "/".join(word() for _ in range(int(rng.integers(1, 9)))) + str(rng.choice(["/", "-", "/v1/", "="]))
        text = f"{word()} {route}{prefix}{key} {word()}"
        start = text.index(" ") + 1
        for w in windows(start, start + len(route + prefix + key)):
            held = w[1] - max(w[0], start + len(route))  # characters of the key that the window shows
            if held >= 16 or held < 1:
                out.append((view(text, *w), int(held >= 16), zlib.crc32(key.encode())))
        plain = str(
            rng.choice(
                [
                    f"{word()}-{word()}-{word()}-{rng.integers(1, 2030)}",
                    f"{word()}_{word()}_{word()}_v{rng.integers(1, 20)}",
                    f"{word()}/{word()}/{word()}{rng.integers(1, 99)}/{word()}",
                    f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}",
                    f"{word()}{word()}{word()}{rng.integers(0, 10)}",
                ]
            )
        )
        text = f"{word()} {plain} {word()}"
        at = text.index(plain)
        out.append(_finding(text, at, at + len(plain), 0))
    return out


def _bare(findings: list[Finding]) -> list[Finding]:
    """The secrets among the findings without what stands around them."""
    return [(b" " * BEFORE + v[BEFORE:-AFTER] + b" " * AFTER, 1, g) for v, label, g in findings if label]


def _columns(rows: list[Finding]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the network reads, labels and shares."""
    x = np.frombuffer(b"".join(v for v, _, _ in rows), dtype=np.uint8).reshape(len(rows), -1) & 127
    return x, np.array([label for _, label, _ in rows], dtype=float), np.array([g % SPLITS for _, _, g in rows])


def _new(rng: np.random.Generator, dim: int = 8, filters: int = 16, width: int = 5) -> Network:
    return Network(rng.normal(0, 0.3, (128, dim)), rng.normal(0, 0.2, (width * dim, filters)), np.zeros(filters), rng.normal(0, 0.2, filters + 1))


def _learn(net: Network, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Rounds of gradient steps over the rows, in place."""
    values = [net.emb, net.conv, net.bias, net.out]
    dim, width = net.emb.shape[1], net.conv.shape[0] // net.emb.shape[1]
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step, learn = 0, np.arange(len(x))
    positive = min(max(y.mean(), 0.05), 0.95)
    for _ in range(epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), 64):
            part = learn[k : k + 64]
            cols, top, pooled, z = net.forward(x[part])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * np.where(y[part] > 0, 0.5 / positive, 0.5 / (1 - positive)) / len(part)
            d_out = np.append(pooled.T @ g, g.sum())
            d_pool = g[:, None] * net.out[:-1][None, :] * (pooled > 0)
            at = np.take_along_axis(cols, top[:, :, None], axis=1)  # n, filters, width * dim
            d_conv = np.einsum("nfc,nf->cf", at, d_pool)
            d_cols = d_pool[:, :, None] * net.conv.T[None, :, :]
            places = top[:, :, None] + np.arange(width)[None, None, :]
            chars = x[part][np.arange(len(part))[:, None, None], places]
            d_emb = np.zeros_like(net.emb)
            np.add.at(d_emb, chars.ravel(), d_cols.reshape(-1, dim))
            step += 1
            for v, grad, (m, s) in zip(values, (d_emb, d_conv, d_pool.sum(axis=0), d_out), state):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


def _calibrate(net: Network, z: np.ndarray, t: np.ndarray, n: np.ndarray, measured: np.ndarray) -> None:
    """Calibration, threshold and measures from scores ``z`` before calibration, labels, how often each comes, and its share."""
    far, near = {}, {}
    for out, of in ((near, ~measured), (far, measured)):
        out["z"], out["t"], out["n"] = z[of], t[of], n[of].astype(float)
    scale = max(float(np.abs(near["z"]).max()), 1e-9)
    u, t, a, b = near["z"] / scale, near["t"], 1.0, 0.0
    mean = lambda x: float(np.average(x, weights=near["n"]))
    for _ in range(100):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-3)
        hess = np.array([[mean(h * u * u) + 1e-3, mean(h * u)], [mean(h * u), mean(h) + 1e-3]])
        da, db = np.linalg.solve(hess, [mean((p - t) * u) + 1e-3 * a, mean(p - t)])
        a, b = a - np.clip(da, -3, 3), b - np.clip(db, -3, 3)
    net.slope, net.offset = float(a / scale), float(b)
    of = lambda x: 1 / (1 + np.exp(-np.clip(net.slope * x + net.offset, -30, 30)))
    p = of(near["z"])
    order = np.argsort(p)
    order = order[t[order] > 0]
    if len(order):
        upto = near["n"][order].cumsum()
        net.threshold = float(p[order][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")])
    told, true, n = of(far["z"]) >= net.threshold, far["t"] > 0, far["n"]
    net.held_out = {
        "findings": int(n.sum()),
        "secrets": int(n[true].sum()),
        "recall": float(n[told & true].sum() / n[true].sum()) if true.any() else 0.0,
        "precision": float(n[told & true].sum() / n[told].sum()) if told.any() else 0.0,
    }


def fit(findings: list[Finding], epochs: int = EPOCHS, dim: int = 8, filters: int = 16, width: int = 5, seed: int = 11) -> Network:
    """Train on findings, calibrate on a share of them, set the threshold there, and measure on another share.

    Findings by rule are added. Shares go by a hash of what is found, and secrets of the training
    share are shown again without what stands around them, so that the network cannot rest on a
    key word alone; no copy of a finding is in two shares. The threshold is the highest that
    keeps RECALL of the secrets of the calibrating share.
    """
    rng = np.random.default_rng(seed)
    rows = [*findings, *_made_up(rng)]
    rows += _bare(findings)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    x, y, share = _columns(rows)
    net = _new(rng, dim, filters, width)
    _learn(net, x[share > 1], y[share > 1], epochs, rng)
    x, y, share = x[share < 2], y[share < 2], share[share < 2]
    _calibrate(net, net.forward(x)[3], y, np.ones(len(x)), share == 1)
    return net


def _blocks(found: DataFrame, n: int) -> DataFrame:
    """(block, view, label, found): the findings as rows of about BLOCK each, dealt by a hash and sorted within, as bytes."""
    blocks = -(-n // BLOCK)

    def packed(rows: pa.Table) -> pa.Table:
        got = sorted(zip(*(rows.column(c).to_pylist() for c in ("view", "label", "found"))))
        views, labels, hashes = zip(*got)
        values = [rows.column("block").slice(0, 1).to_pylist(), [b"".join(views)], [bytes(labels)], [np.array(hashes, "<i8").tobytes()]]
        return pa.table(dict(zip(("block", "view", "label", "found"), values)), pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("view", "label", "found"))]))

    keyed = found.withColumn("block", F.pmod(F.xxhash64("view", "label"), F.lit(blocks)).cast("long"))
    spread = keyed.repartition(min(blocks, 4 * found.sparkSession.sparkContext.defaultParallelism), "block")
    return stored(spread.groupBy("block").applyInArrow(packed, "block long, view binary, label binary, found binary"), "finding blocks")


def _of_block(view: bytes, label: bytes, found: bytes) -> list[Finding]:
    size = BEFORE + INSIDE + AFTER
    rows = zip((view[i : i + size] for i in range(0, len(view), size)), label, np.frombuffer(found, "<i8").tolist())
    return [*(rows := list(rows)), *_bare(rows)]


def _together(blocks: DataFrame, seed: int = 11) -> Network:
    """A network from all blocks: in each round every block takes the network of the round before further, and changes are averaged.

    Tasks hand on sums of changes, one number for each weight. Calibration, threshold and measures come from the
    scores of all findings of their shares, counted in steps of 1 / BINS.
    """
    spark = blocks.sparkSession
    rng = np.random.default_rng(seed)
    extra = _made_up(rng)
    net = _new(rng)
    rows = lambda batch: zip(*(x.to_pylist() for x in batch.columns))
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(net)

        def work(batches: Iterator[pa.RecordBatch], epoch: int = epoch, shared=shared) -> Iterator[pa.RecordBatch]:
            before, n = shared.value, 0
            old = np.concatenate([v.ravel() for v in (before.emb, before.conv, before.bias, before.out)])
            total = np.zeros(len(old), dtype=np.int64)
            for batch in batches:
                for block, *of in rows(batch):
                    own = Network(*(v.copy() for v in (before.emb, before.conv, before.bias, before.out)))
                    x, y, share = _columns([*_of_block(*of), *extra])
                    _learn(own, x[share > 1], y[share > 1], 1, np.random.default_rng([seed, epoch, block]))
                    new = np.concatenate([v.ravel() for v in (own.emb, own.conv, own.bias, own.out)])
                    total, n = total + np.rint((new - old) * PARTS).astype(np.int64), n + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(old) + 1)), pa.array(np.append(total, n))], ["place", "change"])

        got = blocks.mapInArrow(work, "place long, change long").groupBy("place").agg(F.sum("change").alias("change")).orderBy("place").collect()
        change = np.array([r["change"] for r in got[:-1]]) / PARTS / got[-1]["change"]
        at = 0
        for v in (net.emb, net.conv, net.bias, net.out):
            v += change[at : at + v.size].reshape(v.shape)
            at += v.size
        shared.unpersist()

    shared = spark.sparkContext.broadcast(net)

    def binned(of: list[Finding]) -> tuple[np.ndarray, ...]:
        x, y, share = _columns(of)
        x, y, share = x[share < 2], y[share < 2], share[share < 2]
        z = np.concatenate([np.empty(0), *(shared.value.forward(x[i : i + 512])[3] for i in range(0, len(x), 512))])
        return np.floor(np.clip(z, -FAR, FAR) * BINS).astype(np.int64), y.astype(np.int64), share

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *of in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in binned(_of_block(*of))], ["bin", "label", "share"])

    counted = blocks.mapInArrow(scored, "bin long, label long, share long").groupBy("bin", "label", "share").count().orderBy("bin", "label", "share").collect()
    bins, labels, share = (np.concatenate(c) for c in zip(np.array([r[:3] for r in counted], dtype=np.int64).reshape(-1, 3).T, binned(extra)))
    n = np.concatenate([np.array([r["count"] for r in counted], dtype=np.int64), np.ones(len(bins) - len(counted), np.int64)])
    _calibrate(net, bins / BINS, labels.astype(float), n, share == 1)
    shared.unpersist()
    return net


def slug(text: str) -> list[Finding]:
    """One finding that is no secret: words of the text itself, joined with a number as in file names or routes.

    Which words and what form follow from a checksum of the text. None for a text of few words.
    """
    pick = zlib.crc32(text.encode())
    found = [m[0] for m in islice(_WORD.finditer(text, pick % max(1, len(text) - 200)), 6)]
    if len(found) < 4:
        return []
    mark = "-_/"[pick % 3]
    name = mark.join(found[1 : 3 + pick % 2]) + (mark if pick & 8 else "") + str(pick >> 8 & 1023)
    whole = f"{found[0]} {name} {found[-1]}"
    return [_finding(whole, len(found[0]) + 1, len(found[0]) + 1 + len(name), 0)]


def findings(text: str) -> list[Finding]:
    """Views of all candidates of a text: 1 where a rule matches there too, 0 for what is not like a key, and a slug."""
    runs, out, k = merged(base_spans(text)), slug(text), 0
    for c in candidates(text):
        while k < len(runs) and runs[k][1] <= c[0]:
            k += 1
        for s, e in windows(*c):
            j = k
            while j < len(runs) and runs[j][1] <= s:
                j += 1
            known = j < len(runs) and runs[j][0] < e
            if known or not key_like(text[s:e]):
                out.append(_finding(text, s, e, int(known)))
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Network:
    """Fit on the findings of all documents; equal findings count once. ``key`` bears on nothing and may be any column.

    Secrets are what the rules match; what is none are other candidates that are not like a key, and a slug of each
    text's own words. Up to BLOCK findings are learned from at once; more by blocks that tasks take one at a time.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for t in texts(batch.column("text")) for x in findings(t)]
            columns = [pa.array([x[i] for x in got], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["view", "label", "found"])

    found = stored(rows.mapInArrow(work, "view binary, label int, found long").distinct(), "findings")
    n = found.count()
    if n <= BLOCK:
        net = fit(sorted((bytes(r["view"]), r["label"], r["found"]) for r in found.collect()))
    else:
        blocks = _blocks(found, n)
        net = _together(blocks)
        release(blocks)
    release(found)
    return net


def scan(docs: DataFrame, network: Network, text: str = "text", scores: bool = False) -> DataFrame:
    """All columns of ``docs``, and ``secret_spans``: structs (kind, start, end, score) in code points, end exclusive.

    The network scores every candidate, by its highest window, and every match of a rule that is none. Matches
    of the rules always stay; their score is the highest of the candidates they overlap, or their own. Candidates,
    or their parts, that overlap no rule and reach the network's threshold are added as kind
    ``model``. In order of start, then kind as in KINDS. A null or empty text has none. With ``scores``, a column
    ``secret_scores`` has the calibrated score of all that was scored, taken or not. Columns of these names are replaced.
    """
    made = ["secret_spans", *(["secret_scores"] if scores else [])]
    names = [c for c in docs.columns if c not in made]
    kept = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found = [_scored(net, t) for t in texts(batch.column(text))]
            columns = [pa.array([x[0] for x in found], pa.list_(struct)), pa.array([x[1] for x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns[: len(made)]], [*names, *made])

    kinds = {"kind": T.StringType(), "start": T.IntegerType(), "end": T.IntegerType(), "score": T.DoubleType()}
    spans = T.ArrayType(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    return kept.mapInArrow(work, extended(kept, secret_spans=spans, **({"secret_scores": T.ArrayType(T.DoubleType())} if scores else {})))


def _scores(net: Network, text: str, found: list[tuple[int, int]]) -> list[float]:
    """The highest probability of the windows of each candidate, so many candidates at a time."""
    out: list[float] = []
    for k in range(0, len(found), 1024):
        cut = [windows(*c) for c in found[k : k + 1024]]
        p = net.probability([view(text, *w) for row in cut for w in row])
        out += np.maximum.reduceat(p, np.cumsum([0, *map(len, cut[:-1])])).tolist()
    return out


def _spans(net: Network, text: str) -> list[dict]:
    return _scored(net, text)[0]


def _scored(net: Network, text: str) -> tuple[list[dict], list[float]]:
    """The spans of a text, and the scores of all that was scored in it."""
    base, found = base_spans(text), candidates(text)
    if not base and not found:
        return [], []
    known = dict(zip(found, _scores(net, text, found)))
    scored = list(known.items())
    rows, k = [], 0
    for s, kind, e in base:
        while k < len(scored) and scored[k][0][1] <= s:
            k += 1
        best, j = None, k
        while j < len(scored) and scored[j][0][0] < e:
            best, j = max(scored[j][1], best or 0.0), j + 1
        rows.append((s, kind, e, best))
    left = uncovered(text, found, base)
    more = list(dict.fromkeys([*(x for x in left if x not in known), *((s, e) for s, _, e, best in rows if best is None and (s, e) not in known)]))
    known.update(zip(more, _scores(net, text, more)))
    rows = [(s, kind, e, known[s, e] if best is None else best) for s, kind, e, best in rows]
    rows += [(s, len(KINDS) - 1, e, known[s, e]) for s, e in left if known[s, e] >= net.threshold]
    return [{"kind": KINDS[kind], "start": s, "end": e, "score": p} for s, kind, e, p in sorted(rows, key=lambda r: r[:3])], list(known.values())


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``scanned`` with each run of touching or overlapping spans replaced by ``mark``.

    Texts without spans, null among them, stay as they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column("secret_spans").to_pylist()):
                if spans:
                    runs = merged(sorted((x["start"], 0, x["end"]) for x in spans))
                    ends = [0, *(e for _, e in runs)]
                    t = mark.join(t[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(t)]))
                out.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return scanned.mapInArrow(work, scanned.schema)
