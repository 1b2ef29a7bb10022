"""Large JSON documents read by byte ranges.

Spark's text source splits a file at every opening brace, wherever its ranges begin, so each range is a chunk of the
document that starts behind a brace. Whether that brace stands in a string, and how deep, follows from the chunks before:
a first pass sums up what each chunk does to both for either start, and these sums, a row a range, are composed in the
order of the ranges. A second pass cuts each chunk into the elements at the wanted depth. An element that runs over a
border comes in pieces, at most two a range, which are put together by its place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _BACK, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Marks bytes outside strings, quotes excluded, for text that starts inside a string or not; and how it ends."""
    back = data == _BACK
    # A quote behind an odd number of backslashes is no end.
    last_other = np.maximum.accumulate(np.where(~back, np.arange(len(data)), -1))
    odd = np.zeros(len(data), bool)
    odd[1:] = (np.arange(len(data) - 1) - last_other[:-1]) % 2 == 1
    quote = (data == _QUOTE) & ~odd
    seen = np.cumsum(quote) + int(inside)
    return (seen % 2 == 0) & ~quote, bool((seen[-1] if len(seen) else int(inside)) % 2)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(path, start of the range, whether it is the range's first part, bytes) of consecutive records of a range."""
    last = None
    for batch in batches:
        path, start, value = (batch.column(c).to_pylist() for c in ("path", "start", "value"))
        at = 0
        while at < len(value):
            end = at
            while end < len(value) and (path[end], start[end]) == (path[at], start[at]):
                end += 1
            new = (path[at], start[at]) != last
            # The file's first record has no brace ahead.
            head = "" if new and start[at] == 0 else "{"
            yield path[at], start[at], new, (head + "{".join(value[at:end])).encode()
            last, at = (path[at], start[at]), end


def _array_key(raw: bytes, at: int) -> str:
    """The key of the array that opens at a place, empty for an object or without one. No brace comes between both, so a range has them both."""
    if raw[at] != ord("["):
        return ""
    end = at - 1
    while end >= 0 and raw[end] in b" \t\r\n:":
        end -= 1
    begin = raw.rfind(b'"', 0, max(end, 0))
    return raw[begin + 1 : end].decode("utf-8", "replace") if end > 0 and raw[end] == _QUOTE and begin >= 0 else ""


def _summary(batches):
    """What each range does: for a start outside and inside a string, its end, its change of depth, and the last key of an array opened at each depth."""
    state = None

    def out():
        (path, start), sides = state
        for side, s in enumerate(sides):
            yield {"path": path, "start": start, "side": side, "inside": s["inside"], "depth": s["depth"], "keys": [(k, v) for k, v in s["keys"].items()]}

    def give():
        return pa.RecordBatch.from_pylist(list(out()), pa.schema([("path", pa.string()), ("start", pa.int64()), ("side", pa.int32()), ("inside", pa.bool_()), ("depth", pa.int64()), ("keys", pa.map_(pa.int64(), pa.string()))]))

    for path, start, new, raw in _chunks(batches):
        if new:
            if state:
                yield give()
            state = ((path, start), [{"inside": bool(k), "depth": 0, "keys": {}} for k in (0, 1)])
        data = np.frombuffer(raw, np.uint8)
        for s in state[1]:
            free, s["inside"] = _outside(data, s["inside"])
            depth = s["depth"] + np.cumsum(np.where(free, _STEP[data], 0))
            for at in np.flatnonzero(free & (_STEP[data] == 1)).tolist():
                key = _array_key(raw, at)
                s["keys"][int(depth[at]) - 1] = key
            s["depth"] = int(depth[-1]) if len(depth) else s["depth"]
    if state:
        yield give()


def _starts(rows) -> dict:
    """(inside a string, depth, key of the open array of the document) at the start of each range."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.path, {}).setdefault(r.start, {})[r.side] = r
    out = {}
    for path, ranges in by.items():
        inside, depth, key = False, 0, ""
        for start in sorted(ranges):
            out[path, start] = (inside, depth, key)
            r = ranges[start][int(inside)]
            key = r["keys"].get(1 - depth, key)
            inside, depth = r.inside, depth + r.depth
    return out


ELEMENTS = "path string, start long, kind int, key string, value string"


def elements(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """(key, value): the JSON text of each element ``depth`` brackets deep in the documents of a file or folder.

    Depth 2 gives the elements of the arrays of a top-level object, ``key`` being the array's (empty for what is in no array); depth 1 the members of the
    object, as ``"name": value``. Documents may follow each other in a file. Texts are cut by their brackets and
    quotes alone; what is no JSON is for the parser of the elements to find.
    """
    text = spark.read.option("lineSep", "{").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    summary = text.mapInArrow(_summary, "path string, start long, side int, inside boolean, depth long, keys map<long,string>")
    starts = spark.sparkContext.broadcast(_starts(summary.collect()))  # two rows a range

    def cut(batches):
        rows: list[tuple] = []
        here, inside, at_depth, key, pending, whole = None, False, 0, "", [], True

        def tail():
            # What is open at a range's end goes on in the next one.
            if here and (at_depth >= depth or not whole):
                rows.append((*here, 0 if not whole else 1, key, b"".join(pending).decode("utf-8", "surrogateescape")))

        for path, start, new, raw in _chunks(batches):
            if new:
                tail()
                here = (path, start)
                inside, at_depth, key = starts.value[here]
                pending, whole = [], at_depth < depth  # not whole: the first piece began in an earlier range
            data = np.frombuffer(raw, np.uint8)
            free, inside = _outside(data, inside)
            level = at_depth + np.cumsum(np.where(free, _STEP[data], 0))
            step = np.where(free, _STEP[data], 0)
            edge = np.flatnonzero(free & (((data == _COMMA) & (level == depth)) | ((step == 1) & (level == depth)) | ((step == -1) & (level == depth - 1))))
            last = 0
            for at in edge.tolist():
                if step[at] != 1:
                    pending.append(raw[last:at])
                    value = b"".join(pending).decode()
                    if not whole or value.strip():
                        rows.append((*here, 2 if whole else 0, key, value))
                elif depth == 2:
                    key = _array_key(raw, at)
                pending, whole, last = [], True, at + 1
            if len(level):
                at_depth = int(level[-1])
            if at_depth >= depth or not whole:
                pending.append(raw[last:])
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
                rows = []
        tail()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    every = text.mapInArrow(cut, ELEMENTS)
    # Kind 0 goes on from an earlier range, kind 1 starts at a range's end: each of these begins an element.
    w = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pieces = every.where("kind < 2").withColumn("n", F.sum("kind").over(w))
    joined = pieces.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value", "key"))).alias("p"))
    joined = joined.select(F.col("p")[0]["key"].alias("key"), F.concat_ws("", F.transform("p", lambda x: x["value"])).alias("value")).where(F.trim("value") != "")
    return every.where("kind = 2").select("key", "value").union(joined)


_NAMES, _TYPES = ["path", "start", "kind", "key", "value"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
