"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter
keeps its maximum, and a dense softmax layer scores the languages. A text is cut into windows
from end to end; its score is the mean of the windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import bytes_of, refuse_clashes

WINDOW = 256
DIM = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 16  # of each width
EPOCHS = 4  # or as many as make STEPS steps
STEPS = 800
BATCH = 64
AT_ONCE = 32  # windows scored at a time, to stay in cache
PAD = 256
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: Bound of the training sample: windows of a language, drawn by hash from all windows of all its labelled texts.
SAMPLE_WINDOWS = 2400
SURPLUS = 1.2  # of windows drawn, so that chance leaves no fewer than the bound
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int16)
LETTER_BYTES = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for a in range(0, len(windows), AT_ONCE):
            pooled = (_columns(self.embed[windows[a : a + AT_ONCE]]) @ self.filters).max(axis=1)
            out[a : a + AT_ONCE] = _softmax(np.maximum(pooled + self.bias, 0) @ self.dense + self.offset)
        return out


def _columns(embedded: np.ndarray) -> np.ndarray:
    """Each position's next ``max(WIDTHS)`` embeddings side by side."""
    most = max(WIDTHS)
    n = embedded.shape[1] - most + 1
    return np.concatenate([embedded[:, j : j + n] for j in range(most)], axis=2)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(text: np.ndarray) -> np.ndarray:
    """A text's bytes in rows of ``WINDOW``, A-Z as a-z, the last row padded."""
    rows = max(1, -(-len(text) // WINDOW))
    out = np.full(rows * WINDOW, PAD, np.int16)
    out[: len(text)] = FOLD[text]
    return out.reshape(rows, WINDOW)


def train(windows: np.ndarray, langs: list[str], seed: int = 0) -> Model:
    """Fit the network to labelled windows by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    x, y = windows, np.array([names.index(lang) for lang in langs])
    keep = LETTER_BYTES[x].sum(axis=1) >= WINDOW // 8  # a window of few letters tells nothing
    if keep.any():
        x, y = x[keep], y[keep]
    p = _begin(rng, len(names))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    weight = 1 / np.bincount(y, minlength=len(names)).clip(1)
    weight = (weight * len(y) / len(names)).astype(np.float32)
    for _ in range(max(EPOCHS, STEPS // max(1, len(x) // BATCH))):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            _, g = loss_and_gradient(p, x[at], y[at], weight[y[at]] / len(at))
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(names, *(p[k].astype(np.float32) for k in ("embed", "filters", "bias", "dense", "offset")))


def _mask() -> np.ndarray:
    """Which weights of the widest filter shape each filter has."""
    mask = np.zeros((max(WIDTHS) * DIM, FILTERS * len(WIDTHS)), np.float32)
    for n, w in enumerate(WIDTHS):
        mask[: w * DIM, n * FILTERS : (n + 1) * FILTERS] = 1
    return mask


def _begin(rng, langs: int) -> dict[str, np.ndarray]:
    count = FILTERS * len(WIDTHS)
    scale = np.sqrt(2 / (np.repeat(WIDTHS, FILTERS) * DIM))
    p = {
        "embed": rng.normal(0, 1, (PAD + 1, DIM)),
        "filters": rng.normal(0, 1, (max(WIDTHS) * DIM, count)) * _mask() * scale,
        "bias": np.zeros(count),
        "dense": rng.normal(0, 0.1, (count, langs)),
        "offset": np.zeros(langs),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][PAD] = 0
    return p


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross-entropy of windows ``x`` with classes ``y``, and its gradient by each parameter."""
    most, rows = max(WIDTHS), np.arange(len(x))[:, None]
    columns = _columns(p["embed"][x])
    maps = columns @ p["filters"]
    where = maps.argmax(axis=1)
    raw = np.take_along_axis(maps, where[:, None], 1)[:, 0] + p["bias"]
    pooled = np.maximum(raw, 0)
    delta = _softmax(pooled @ p["dense"] + p["offset"])
    loss = float(-(weight * np.log(delta[rows[:, 0], y] + 1e-30)).sum())
    delta[rows[:, 0], y] -= 1
    delta *= weight[:, None]
    back = (delta @ p["dense"].T) * (raw > 0)
    g = {"dense": pooled.T @ delta, "offset": delta.sum(axis=0), "bias": back.sum(axis=0)}
    g["filters"] = np.einsum("bfc,bf->cf", columns[rows, where], back) * _mask()
    spread = (back[:, :, None] * p["filters"].T).reshape(len(x), -1, most, DIM)
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], x[rows[:, :, None], where[:, :, None] + np.arange(most)], spread)
    g["embed"][PAD] = 0
    return loss, g


def held_out(id_col):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _draw(shares: dict[str, int]):
    """Windows of ``(id, label, body)`` whose hash is under their label's share of 2 ** 64."""

    def run(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(2))
            seeds = [xxhash.xxh64_intdigest(str(i).encode(), 9) for i in batch.column(0).to_pylist()]
            labels, ranks, parts = [], [], []
            for n, label in enumerate(batch.column(1).to_pylist()):
                text = data[offsets[n] : offsets[n + 1]]
                count = max(1, -(-len(text) // WINDOW))
                rank = (np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seeds[n])
                rank ^= rank >> np.uint64(31)
                rank *= np.uint64(0xBF58476D1CE4E5B9)
                rank ^= rank >> np.uint64(29)
                for k in np.flatnonzero(rank <= np.uint64(shares.get(label, 0))).tolist():
                    labels.append(label)
                    ranks.append(int(rank[k]) >> 1)
                    parts.append(text[k * WINDOW : (k + 1) * WINDOW].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(ranks, pa.int64()), pa.array(parts, pa.binary())], ["label", "rank", "part"])

    return run


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", windows: int = SAMPLE_WINDOWS
) -> Model | None:
    """Train on rows not held out that have a label, an id and a letter; None if there are none.

    The sample is bounded: of each language at most ``windows`` windows, those of the smallest hash among all windows of
    all its texts. A share of them is drawn by hash first, so few rows leave a task, whatever the table's size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("body"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id") & F.col("body").rlike(r"\p{L}"))
    totals = rows.groupBy("label").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("body") / WINDOW))).alias("n")).collect()
    shares = {r.label: min((1 << 64) - 1, int((SURPLUS * windows + 64) / int(r.n) * (1 << 64))) for r in totals}
    drawn = rows.mapInArrow(_draw(shares), "label string, rank long, part binary")
    order = Window.partitionBy("label").orderBy("rank", "part")
    sample = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= windows).select("label", "part").collect()
    sample = sorted((r.label, bytes(r.part)) for r in sample)
    if not sample:
        return None
    return train(np.concatenate([windows_of(np.frombuffer(part, np.uint8)) for _, part in sample]), [lang for lang, _ in sample])


def _predict(model: Model | None):
    def run(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            sure = [x.is_valid and LETTER.search(x.as_py()) is not None for x in batch.column(1)]
            lang, score = [UNDETERMINED] * len(sure), [0.0] * len(sure)
            todo = [n for n, s in enumerate(sure) if s and model is not None]
            while todo:
                part, size = [], 0
                while todo and size < 1 << 21:
                    part.append(todo.pop(0))
                    size += int(offsets[part[-1] + 1] - offsets[part[-1]])
                blocks = [windows_of(data[offsets[n] : offsets[n + 1]]) for n in part]
                x = np.concatenate(blocks)
                weight = LETTER_BYTES[x].sum(axis=1).astype(np.float64)
                begins = np.cumsum([0, *map(len, blocks)])[:-1]
                total = np.add.reduceat(model.probabilities(x) * weight[:, None], begins, axis=0)
                mean = total / np.add.reduceat(weight, begins)[:, None]
                for n, best, m in zip(part, mean.argmax(axis=1).tolist(), mean):
                    lang[n], score[n] = model.langs[best], float(min(max(m[best], 0.0), 1.0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, *range(2, batch.num_columns))), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*(batch.schema.names[i] for i in (0, *range(2, batch.num_columns))), "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The language of each whole text.

    Returns ``id_col``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1), and the columns of ``keep``. The
    prediction is ``und`` with score 0 if the text is null or has no letter, or nothing could be
    learned; a null id counts as the empty text in ``held_out``; long texts are scored whole; ties go to the
    first language by name; repeated rows repeat; other columns are not looked at; a column of ``keep``
    named as one of the result's is refused with a ValueError.
    """
    keep = keep or []
    refuse_clashes([id_col, "held_out", "lang_pred", "score", *keep])
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), *[docs[c].alias(f"keep_{n}") for n, c in enumerate(keep)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "body")
    out = rows.mapInArrow(_predict(model), f"{kinds}, lang_pred string, score double")
    return out.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", *[F.col(f"keep_{n}").alias(c) for n, c in enumerate(keep)]
    )
