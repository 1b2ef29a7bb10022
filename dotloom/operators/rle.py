"""The compressed column-major run-length code of published mask files, to and from row runs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_text(counts: list[int]) -> str:
    """Run lengths as text: differences to the run two before, in groups of five bits, least first, plus 48."""
    out = []
    for k, c in enumerate(counts):
        x = c - counts[k - 2] if k > 2 else c
        more = True
        while more:
            low, x = x & 31, x >> 5
            more = x != (-1 if low & 16 else 0)
            out.append(chr(48 + (low | 32 if more else low)))
    return "".join(out)


def text_counts(text: str) -> list[int]:
    """Run lengths of ``counts_text``. Raises ValueError where the text ends within a number or a length is negative."""
    counts: list[int] = []
    x = shift = 0
    for c in text:
        v = ord(c) - 48
        x |= (v & 31) << shift
        shift += 5
        if v & 32:
            continue
        if v & 16:
            x -= 1 << shift
        counts.append(x + counts[-2] if len(counts) > 2 else x)
        if counts[-1] < 0:
            raise ValueError("negative run length")
        x = shift = 0
    if shift:
        raise ValueError("text ends within a number")
    return counts


def row_runs(counts: list[int], height: int, width: int) -> list[tuple[int, int, int]]:
    """Half-open row runs (y, xs, xe) of column-major run lengths. Raises ValueError if they don't fill the mask."""
    if sum(counts) != height * width:
        raise ValueError("run lengths don't fill the mask")
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(np.int8)
    edge = np.zeros((height, width + 2), np.int8)
    edge[:, 1:-1] = flat.reshape(width, height).T
    step = np.diff(edge, axis=1)
    (y, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
    return list(zip(y.tolist(), a.tolist(), b.tolist(), strict=True))


def column_counts(runs: list[tuple[int, int, int]], height: int, width: int) -> list[int]:
    """Column-major run lengths of row runs, the first for unset pixels; runs outside the mask are cut."""
    mask = np.zeros((height, width), bool)
    for y, a, b in runs:
        if 0 <= y < height:
            mask[y, max(a, 0) : max(b, 0)] = True
    flat = mask.T.ravel()
    cut = np.flatnonzero(np.diff(flat)) + 1
    sizes = np.diff(np.concatenate([[0], cut, [flat.size]])).tolist()
    return [0, *sizes] if flat.size and flat[0] else sizes


def encode(runs: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Masks (keys, size, counts) of row runs; ``sizes`` has (image_id, height, width). A mask is one row's work."""
    per = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "xs", "xe"))).alias("runs")).join(sizes, "image_id")
    names = [*keys, "size", "counts"]

    def run(batches):
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("runs", "height", "width")]
            text = [counts_text(column_counts([(r["y"], r["xs"], r["xe"]) for r in m], h, w)) for m, h, w in zip(*rows, strict=True)]
            size = pa.array([[h, w] for h, w in zip(*rows[1:], strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], size, pa.array(text, pa.string())], names)

    return per.mapInArrow(run, ", ".join([*[f"{k} long" for k in keys], "size array<int>", "counts string"]))


def decode(masks: DataFrame, *keys: str) -> DataFrame:
    """Row runs (keys, y, xs, xe) of masks (keys, size, counts, height, width); masks of another size than their image's go, as do unreadable ones."""
    fit = masks.where("size[0] = height AND size[1] = width")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    got = row_runs(text_counts(batch.column("counts")[k].as_py() or ""), *batch.column("size")[k].as_py())
                except ValueError:
                    continue
                if got:
                    who = [pa.array([batch.column(c)[k].as_py()] * len(got), pa.int64()) for c in keys]
                    yield pa.RecordBatch.from_arrays([*who, *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)]], [*keys, "y", "xs", "xe"])

    return fit.select(*keys, "size", "counts").mapInArrow(run, ", ".join([*[f"{k} long" for k in keys], "y long, xs long, xe long"]))
