"""Labelled corpora in CSV files, read by many tasks whatever their texts hold.

A class may be one file, a folder of part files or a glob.  Files are read as lines of
bytes, in splits.  A line break inside quotes does not end a record, and whether a
split starts inside quotes depends on all splits before it; so every split is first
told as a step, from outside and from inside quotes, together with whether its bytes
are valid UTF-8.  Following the steps of a file gives the state at each split's start;
with it, tasks put lines together to records and decode them.  Only records that cross
the end of a split are shuffled.  Fields are then parsed from text.

Fields are quoted as in RFC 4180: a quote opens only at the start of a field, and two
quotes inside stand for one.
"""

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from fraudwatch import schemas
from fraudwatch.functions.text import missing_to_null
from fraudwatch.operators.keyed import concat
from fraudwatch.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UTF8 = "UTF-8"
GB18030 = "GB18030"

#: How fields are read from a record's text: an absent field is null, an empty one empty.
FIELDS = {
    "escape": '"', "multiLine": "true", "nullValue": "\u0001", "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _exists(spark, path):
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def load_corpus(spark: SparkSession, class_paths: dict[str, int], multi_line: bool = True) -> DataFrame:
    """``(msg_key, content, label, class_id)`` from every class path that exists.

    ``msg_key`` ascends within a file, over its splits too.  It depends on the file
    listing, so write the result before ranking if files may be added meanwhile.
    """
    there = {path: class_id for path, class_id in class_paths.items() if _exists(spark, path)}
    if not there:
        raise ValueError("none of the corpus paths exists")
    rows = _read(spark, there, schemas.CORPUS, multi_line).withColumns(
        {"content": missing_to_null(F.col("content")), "label": missing_to_null(F.col("label"))}
    )
    return rows.select(F.col("key").alias("msg_key"), "content", "label", "class_id")


def route_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding)``: UTF-8 if every line is strictly valid, else GB18030.

    GB18030 contains GBK.  Files are checked line by line, in splits, so size does
    not matter; neither encoding uses the line-break byte inside a character.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    valid = F.bool_and(F.is_valid_utf8("value"))
    return lines.groupBy("path").agg(F.when(valid, UTF8).otherwise(GB18030).alias("encoding"))


def read_any_encoding(
    spark: SparkSession, path: str, multi_line: bool = True, schema: T.StructType = schemas.CORPUS
) -> DataFrame:
    """Read each file in its own encoding; the first record of a file is its header."""
    return _read(spark, {path: 0}, schema, multi_line).select(*schema.names)


def load_dir(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Every ``.csv`` of a folder as text; rows with too many fields are skipped."""
    schema = T.StructType(schemas.CORPUS.fields + [T.StructField("_extra", T.StringType())])
    rows = read_any_encoding(spark, f"{folder}/*.csv", multi_line, schema)
    return rows.filter(F.col("_extra").isNull()).select("content", "label").na.fill("")


# --- lines to records --------------------------------------------------------------------------------------

_QUOTED = re.compile(rb'(?:[^"]|"")*')


def quotes_after(line: bytes, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, if its start does or not."""
    if b'"' not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if inside or line[at : at + 1] == b'"':
            at = _QUOTED.match(line, at if inside else at + 1).end()
            if at == size:
                return True
            inside = False
        at = line.find(b",", at) + 1
        if not at:
            return False


def _file(class_id: int):
    return F.xxhash64(F.lit(class_id), F.col("_metadata.file_path")).alias("file")


def _lines(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """Every line as bytes, with its file and the start of its split; rows keep their order within a split."""
    told = lambda path, class_id: spark.read.option("lineSep", "\n").text(path).select(
        _file(class_id), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))
    return concat(*(told(path, class_id) for path, class_id in paths.items()))


def _files(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """class_id, file, and the bytes of the files before it in order of class and path: one row per file, no file is opened."""
    told = lambda path, class_id: spark.read.format("binaryFile").load(path).select(
        F.lit(class_id).alias("class_id"), _file(class_id), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    every = concat(*(told(path, class_id) for path, class_id in paths.items()))
    before = F.sum("size").over(Window.orderBy("class_id", "path").rowsBetween(Window.unboundedPreceding, -1))
    return every.select("class_id", "file", F.coalesce(before, F.lit(0)).alias("base"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of batches that belong to one split, in order; the key is (file, split)."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()))
        start = 0
        for row in range(1, len(keys) + 1):
            if row == len(keys) or keys[row] != keys[start]:
                yield keys[start], batch.slice(start, row - start)
                start = row


STEPS = "file bigint, split bigint, from_outside boolean, from_inside boolean, valid boolean"


def _steps(batches: Iterator[pa.RecordBatch], multi_line: bool) -> Iterator[pa.RecordBatch]:
    """One row per split: where it leads from outside and from inside quotes, and whether it is valid UTF-8."""
    held: dict[tuple, list] = {}
    for key, piece in _runs(batches):
        state = held.setdefault(key, [False, multi_line, True])
        lines = piece.column("line").to_pylist()
        whole = b"\n".join(lines)
        if state[2] and not whole.isascii():
            try:
                whole.decode()
            except UnicodeDecodeError:
                state[2] = False
        if multi_line and b'"' in whole:
            for line in lines:
                state[0], state[1] = quotes_after(line, state[0]), quotes_after(line, state[1])
    if held:
        columns = [[k[0] for k in held], [k[1] for k in held], *zip(*held.values())]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in STEPS.split(", ")])


STARTS = "file bigint, split bigint, inside boolean, crosses boolean, utf8 boolean"


def _follow(steps: pa.Table) -> pa.Table:
    """A file's steps, one per split, followed from its start."""
    rows = steps.sort_by("split").to_pylist()
    inside, starts, crosses = False, [], []
    for row in rows:
        starts.append(inside)
        leaves = row["from_inside"] if inside else row["from_outside"]
        crosses.append(inside or leaves)
        inside = leaves
    utf8 = [all(r["valid"] for r in rows)] * len(rows)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    columns = [[r["file"] for r in rows], [r["split"] for r in rows], starts, crosses, utf8]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in STARTS.split(", ")])


RECORDS = (
    "class_id int, file bigint, split bigint, place bigint, key bigint, text string, starts boolean, ends boolean, header boolean"
)


def _records(batches: Iterator[pa.RecordBatch], whole: bool, multi_line: bool) -> Iterator[pa.RecordBatch]:
    """Records of each split: those that lie in it, or the parts of those that cross its ends."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
    now, out = None, []

    def told(ends: bool) -> None:
        key, place, lines, starts = now["key"], now["first"], now["open"], now["starts"]
        data = b"\n".join(lines)
        if ends:
            data = data.removesuffix(b"\r")
        now["open"], now["starts"] = [], True
        header = starts and key[1] == 0 and not now["met"]
        now["met"] = True
        if (starts and ends) == whole and not (whole and header):
            text = data.decode("utf-8" if now["utf8"] else "gb18030", "replace")
            out.append((now["class_id"], *key, place, now["base"] + key[1] + place + (key[1] > 0), text, starts, ends, header))

    def flushed():
        rows = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return rows

    for key, piece in _runs(batches):
        if now is None or now["key"] != key:
            if now and now["open"]:
                told(False)
            first = {n: piece.column(n)[0].as_py() for n in ("class_id", "inside", "utf8", "base")}
            now = first | {"key": key, "place": 0, "first": 0, "open": [], "starts": not first["inside"], "met": first["inside"]}
        for line in piece.column("line").to_pylist():
            if not now["open"]:
                now["first"] = now["place"]
            now["place"] += 1
            if not now["inside"] and not line.strip(b"\r"):
                continue
            now["open"].append(line)
            now["inside"] = multi_line and quotes_after(line, now["inside"])
            if not now["inside"]:
                told(True)
        if len(out) >= 5000:
            yield flushed()
    if now and now["open"]:
        told(False)
    if out:
        yield flushed()


def _read(spark: SparkSession, paths: dict[str, int], schema: T.StructType, multi_line: bool) -> DataFrame:
    """class_id, key and the schema's fields of every record but the headers."""
    lines = _lines(spark, paths)
    steps = lines.mapInArrow(lambda b: _steps(b, multi_line), STEPS)
    starts = steps.groupBy("file").applyInArrow(_follow, STARTS)
    # One row of some 40 bytes per split of the files, a few millionths of them; the join must keep the order of the lines.
    known = settle(starts.join(_files(spark, paths), "file"))

    def records(whole: bool) -> DataFrame:
        met = F.broadcast(known if whole else known.where("crosses"))
        placed = lines.join(met, ["file", "split"]).select("class_id", "file", "split", "line", "inside", "utf8", "base")
        return placed.mapInArrow(lambda b: _records(b, whole, multi_line), RECORDS)

    # At most two parts a split: the end of one record and the start of another.
    number = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("class_id", "file").orderBy("split", "place"))
    part = F.struct("split", "place", "text")
    stitched = records(False).withColumn("number", number).groupBy("class_id", "file", "number").agg(
        F.array_join(F.sort_array(F.collect_list(part))["text"], "\n").alias("text"), F.min("key").alias("key"), F.max("header").alias("header"))
    stitched = stitched.where(~F.col("header")).withColumn("text", F.rtrim(F.col("text"), F.lit("\r")))
    told = records(True).select("class_id", "key", "text").unionByName(stitched.select("class_id", "key", "text"))
    fields = F.from_csv("text", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), FIELDS)
    return told.select("class_id", "key", fields.alias("fields")).select("class_id", "key", "fields.*")
