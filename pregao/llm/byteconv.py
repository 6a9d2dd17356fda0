"""Document quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are cut into overlapping chunks. Learned filters slide
over the bytes of a chunk, and each filter's largest response in the chunk is its
feature. A hidden layer reads the features; its units are combined over all chunks
of the text (their mean and their largest value) into one logit and so one probability.

Training takes a bounded sample of labelled rows with class weights that restore the shares of
all labelled rows. Each class gives at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES / 2`` bytes, by
hash of the id, so reruns and row order do not matter, and neither class can use up the other's share;
of a text of more than ``EXCERPT`` characters so many are trained on, from a place that the hash
says. Scoring covers every byte of every text, a bounded number of chunks at a time.

Defined results: a null text counts as empty and gets the score of a text without any
filter response; equal texts have equal scores; an empty table gives no rows; without
labelled rows of both classes every score is that of the one class, or 1 without labels.
"""

from __future__ import annotations

import dataclasses
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 12_000_000
EXCERPT = 1 << 15  # characters, of a training text
EPOCHS = 8
LEAST_STEPS = 400  # a small sample is gone through more often
BATCH_DOCS = 32
RATE = 4e-3

EMBED = 8  # numbers per byte
STRIDE = 4  # bytes between filter positions; a filter spans two strides
FILTERS = 32
HIDDEN = 16
CHUNK = 64  # filter positions per chunk; neighbouring chunks overlap by half
HALF = CHUNK // 2
BLOCK_BYTES = 1 << 18  # scored at a time


@dataclasses.dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED; row 256 stands for bytes past the end
    filters: np.ndarray  # (2 * STRIDE * EMBED) x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN: weights of the mean and of the largest value
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in dataclasses.fields(self)]


def new_network(share_good: float, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    share = min(max(share_good, 1e-3), 1 - 1e-3)
    return Network(
        normal(257, EMBED, scale=0.5),
        normal(2 * STRIDE * EMBED, FILTERS, scale=(2 * STRIDE * EMBED) ** -0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        np.zeros(HIDDEN, np.float32),
        normal(2 * HIDDEN, scale=0.1),
        np.array([np.log(share / (1 - share))], np.float32),
    )


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each filled up to whole half-chunks and a stride more, and half-chunks per text.

    A text of n half-chunks has max(n - 1, 1) chunks; an empty one has none.
    """
    width = HALF * STRIDE
    halves = np.array([-(-len(t) // width) for t in texts], np.int64)
    halves[halves == 1] = 2
    codes = np.full(int(halves.sum()) * width + len(texts) * STRIDE, 256, np.int16)
    at = 0
    for t, n in zip(texts, halves.tolist(), strict=True):
        codes[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * width + STRIDE
    return codes, halves


def _positions(halves: np.ndarray) -> np.ndarray:
    """Stride at which each filter position starts; the last stride of a text starts none."""
    return np.arange(int(halves.sum()) * HALF) + np.repeat(np.arange(len(halves)), halves * HALF)


def _responses(net: Network, codes: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded strides, and the rectified response of every filter at every position."""
    strides = net.embed[codes].reshape(-1, STRIDE * EMBED)
    cut = STRIDE * EMBED
    first = strides[:-1] @ net.filters[:cut]
    first += strides[1:] @ net.filters[cut:]
    if len(halves) > 1:
        first = first[_positions(halves)]
    first += net.filter_bias
    return strides, np.maximum(first, 0, out=first)


def _spans(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half of every chunk, and the text of every chunk."""
    chunks = np.maximum(halves - 1, 0)
    text = np.repeat(np.arange(len(halves)), chunks)
    # Each text before has one chunk fewer than half-chunks, but none if it is empty.
    return np.arange(len(text)) + (np.cumsum(halves - chunks) - (halves - chunks))[text], text


def _units(net: Network, codes: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Hidden units of every chunk."""
    _, response = _responses(net, codes, halves)
    top = response.reshape(-1, HALF, FILTERS).max(axis=1)
    first, _ = _spans(halves)
    feature = np.maximum(top[first], top[first + 1])
    return np.maximum(feature @ net.hidden + net.hidden_bias, 0)


def score(net: Network, texts: list[bytes] | pa.Array) -> np.ndarray:
    """Probability of label 1 per text. A long text is scored in overlapping blocks of chunks.

    Of an Arrow array one text at a time is copied.
    """
    width = HALF * STRIDE
    result = np.empty(len(texts))

    def finish(index: int, total: np.ndarray, peak: np.ndarray, chunks: int) -> None:
        logit = net.out_bias[0] + (total / max(chunks, 1)) @ net.out[:HIDDEN] + peak @ net.out[HIDDEN:]
        result[index] = 1 / (1 + np.exp(-float(logit)))

    for index, text in enumerate(texts):
        text = text if isinstance(text, bytes) else text.as_py() or b""
        total, peak, chunks = np.zeros(HIDDEN), np.zeros(HIDDEN, np.float32), 0
        at = 0
        while at < len(text):
            # The next block starts one half-chunk before this one's end, so no chunk is lost or doubled.
            part = text[at : at + BLOCK_BYTES + STRIDE]
            last = at + BLOCK_BYTES >= len(text)
            codes, halves = pack([part[:BLOCK_BYTES]])
            if not last:
                tail = np.frombuffer(part[BLOCK_BYTES:], np.uint8)
                codes[BLOCK_BYTES : BLOCK_BYTES + len(tail)] = tail
            units = _units(net, codes, halves)
            total += units.sum(axis=0, dtype=np.float64)
            peak, chunks = np.maximum(peak, units.max(axis=0)), chunks + len(units)
            at += BLOCK_BYTES if last else BLOCK_BYTES - width
        finish(index, total, peak, chunks)
    return result


def gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradient of the weighted mean log loss, in the order of ``parameters``."""
    codes, halves = pack(texts)
    strides, response = _responses(net, codes, halves)
    by_half = response.reshape(-1, HALF, FILTERS)
    top_at = by_half.argmax(axis=1)
    top = np.take_along_axis(by_half, top_at[:, None, :], axis=1)[:, 0]
    first, text = _spans(halves)
    left = top[first] >= top[first + 1]
    feature = np.where(left, top[first], top[first + 1])
    units = np.maximum(feature @ net.hidden + net.hidden_bias, 0)

    docs, chunks = len(texts), np.maximum(halves - 1, 0)
    mean, peak = np.zeros((docs, HIDDEN), units.dtype), np.zeros((docs, HIDDEN), units.dtype)
    peak_at = np.zeros((docs, HIDDEN), np.int64)
    ends = np.cumsum(chunks)
    for d in range(docs):
        if chunks[d]:
            own = units[ends[d] - chunks[d] : ends[d]]
            mean[d], peak_at[d] = own.mean(axis=0), own.argmax(axis=0) + ends[d] - chunks[d]
            peak[d] = own.max(axis=0)
    logit = net.out_bias[0] + mean @ net.out[:HIDDEN] + peak @ net.out[HIDDEN:]
    slope = ((1 / (1 + np.exp(-logit)) - labels) * weights / weights.sum()).astype(net.out.dtype)

    d_out = np.concatenate([slope @ mean, slope @ peak])
    d_units = (slope / np.maximum(chunks, 1))[text, None] * net.out[:HIDDEN]
    some = chunks > 0
    np.add.at(d_units, (peak_at[some], np.arange(HIDDEN)), slope[some, None] * net.out[HIDDEN:])
    d_units *= units > 0
    d_feature = d_units @ net.hidden.T
    d_top = np.zeros_like(top)
    np.add.at(d_top, first, np.where(left, d_feature, 0))
    np.add.at(d_top, first + 1, np.where(left, 0, d_feature))
    d_top *= top > 0
    # Only the position of each half-chunk's largest response passes a gradient on.
    half, filter_ = np.nonzero(d_top)
    position, flow = _positions(halves)[half * HALF + top_at[half, filter_]], d_top[half, filter_]
    window = np.concatenate([strides[position], strides[position + 1]], axis=1)
    d_filters = np.zeros_like(net.filters)
    d_window = flow[:, None] * net.filters.T[filter_]
    for f in range(FILTERS):
        d_filters[:, f] = flow[filter_ == f] @ window[filter_ == f]
    byte = codes[(position[:, None] * STRIDE + np.arange(2 * STRIDE)).ravel()]
    d_embed = np.zeros_like(net.embed)
    d_bytes = d_window.reshape(-1, EMBED)
    for e in range(EMBED):
        d_embed[:, e] = np.bincount(byte, d_bytes[:, e], minlength=257)
    bias = np.bincount(filter_, flow, minlength=FILTERS).astype(np.float32)
    return [d_embed, d_filters, bias, feature.T @ d_units, d_units.sum(axis=0), d_out, slope.sum()[None]]


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, share_good: float, epochs: int = EPOCHS) -> Network:
    """Adam over shuffled batches; fixed seeds, so equal input gives an equal network."""
    net, rng = new_network(share_good), np.random.default_rng(11)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    batches = -(-len(texts) // BATCH_DOCS)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH_DOCS):
            pick, step = order[at : at + BATCH_DOCS], step + 1
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            found = gradients(net, [texts[i] for i in pick], labels[pick], weights[pick])
            for p, g, m, v in zip(net.parameters(), found, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def constant(good: bool) -> Network:
    """A network that gives every text the same score, near 1 or near 0."""
    net = new_network(0.5)
    net.out[:], net.out_bias[:] = 0, 30.0 if good else -30.0
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", epochs: int = EPOCHS) -> Network:
    """Train on a bounded sample of the rows of ``labels`` (doc_id, 0 or 1) that have a document.

    Class shares are counted over all of those rows. The sample is chosen by id, so only the
    texts of chosen rows travel.
    """
    usable = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("_label"))
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_hash", F.xxhash64("doc_id"))
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return constant(bool(good) or not bad)
    each = [usable.filter(F.col("_label") == v).orderBy("_hash", "doc_id").limit(SAMPLE_ROWS) for v in (0, 1)]
    chosen = each[0].unionByName(each[1])
    # At most 2 * SAMPLE_ROWS rows are broadcast, and as many kept even if documents repeat an id.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    start = F.pmod(F.xxhash64("_hash"), F.greatest(F.length("_text") - EXCERPT, F.lit(0)) + 1) + 1
    texts = texts.withColumn("_text", F.substring("_text", start.cast("int"), F.lit(EXCERPT)))
    texts = texts.withColumn("_bytes", F.octet_length("_text"))
    texts = texts.orderBy("_hash", "doc_id", "_label", "_bytes").limit(2 * SAMPLE_ROWS)
    before = Window.partitionBy("_label").orderBy("_hash", "doc_id", "_bytes").rowsBetween(Window.unboundedPreceding, 0)
    # An excerpt is far smaller than a class's share, so each class has rows.
    taken = texts.withColumn("_sum", F.sum("_bytes").over(before)).filter(F.col("_sum") <= SAMPLE_BYTES // 2)
    taken = taken.orderBy("_hash", "doc_id", "_label", "_bytes").collect()
    found = {v: sum(r["_label"] == v for r in taken) for v in (0, 1)}
    values = np.array([r["_label"] for r in taken], np.float32)
    weights = np.where(values == 1, good / found[1], bad / found[0]).astype(np.float32)
    return train([r["_text"].encode() for r in taken], values, weights / weights.mean(), good / (good + bad), epochs)


def scored(docs: DataFrame, net: Network, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``score`` of every row; an old column of that name is replaced.

    Only texts go to Python, and only scores come back.
    """

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(score(net, texts.cast(pa.binary())))

    return docs.select(*[F.col(c) for c in carry if c != "score"], quality(F.col("text")).alias("score"))
