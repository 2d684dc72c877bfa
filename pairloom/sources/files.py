"""Readers and writers of the file formats that pair tables, vectors and features come in."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS_TRAIN = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int"
PAIRS_TEST = "test_id long, question1 string, question2 string"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", malformed: str = "null") -> DataFrame:
    """A CSV table with a header, quoted line breaks and doubled quotes; the schema is given, never guessed.

    ``malformed`` says what becomes of a row that doesn't fit: 'null' (its bad fields are null), 'drop' or 'fail'.
    """
    mode = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[malformed]
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, encoding=encoding, mode=mode)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV table with a header; white space at the ends of values stays."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_submission(df: DataFrame, path: str, ident: str = "test_id", p: str = "is_duplicate") -> None:
    """(id, prediction) rows as CSV."""
    write_csv(df, path, [ident, p])


def read_glove(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(word, vec) of a text file of vectors; the last ``dims`` fields are the vector, so that a word may have blanks."""
    f = F.split("value", " ")
    n = F.size(f)
    word, vec = F.array_join(F.slice(f, 1, n - dims), " "), F.transform(F.slice(f, -dims, dims), lambda x: x.cast("float"))
    return spark.read.text(path).filter(n > dims).select(word.alias("word"), vec.alias("vec"))


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a file in the binary format of word2vec. The format has no marks to split at, so a file is one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                view = memoryview(data)
                head = bytes(view[:100]).split(b"\n", 1)[0]
                count, dims = map(int, head.split())
                at, words, vecs = len(head) + 1, [], []
                for _ in range(count):
                    end = at
                    while view[end] != 32:
                        end += 1
                    words.append(bytes(view[at:end]).lstrip(b"\n").decode("utf-8", "replace"))
                    vecs.append(list(struct.unpack_from(f"<{dims}f", view, end + 1)))
                    at = end + 1 + 4 * dims
                    if len(words) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(vecs, pa.list_(pa.float32()))], ["word", "vec"])
                        words, vecs = [], []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(vecs, pa.list_(pa.float32()))], ["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "word string, vec array<float>")


def word2vec_to_parquet(source: str, folder: str, rows: int = 50_000) -> int:
    """Write the vectors of a binary word2vec file of any size as Parquet files (word, vec) of ``rows`` rows; returns their number.

    The file is read once from begin to end with a buffer of a few megabytes; paths may be local or of any file system that
    pyarrow knows. Files above 2 GB must go this way, as Spark reads no larger ones whole.
    """
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    def place(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    (a, src), (b, dst) = place(source), place(folder)
    b.create_dir(dst)
    done = 0
    with a.open_input_stream(src, buffer_size=4 << 20) as f:
        head = b""
        while not head.endswith(b"\n"):
            head += f.read(1)
        count, dims = map(int, head.split())
        while done < count:
            words, vecs = [], []
            for _ in range(min(rows, count - done)):
                word = b""
                while (c := f.read(1)) not in (b" ", b""):
                    word += c
                words.append(word.lstrip(b"\n").decode("utf-8", "replace"))
                vecs.append(f.read(4 * dims))
            flat = pa.Array.from_buffers(pa.float32(), dims * len(words), [None, pa.py_buffer(b"".join(vecs))])
            ends = pa.array(range(0, dims * len(words) + 1, dims), pa.int32())
            pq.write_table(pa.table({"word": pa.array(words, pa.string()), "vec": pa.ListArray.from_arrays(ends, flat)}), f"{dst}/part-{done:012d}.parquet", filesystem=b)
            done += len(words)
    return done


def write_npy(df: DataFrame, path: str, column: str) -> None:
    """The vectors of ``column`` as numpy arrays below ``path``, a file for each partition; ``path`` is a folder all executors share."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np
        import pyarrow.fs as fs
        from pyspark import TaskContext

        parts = [np.array(b.column(0).to_pylist(), dtype="float64") for b in batches if b.num_rows]
        if parts:
            out = io.BytesIO()
            np.save(out, np.concatenate(parts))
            to, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            to.create_dir(at)
            with to.open_output_stream(f"{at}/part-{TaskContext.get().partitionId():06d}.npy") as f:
                f.write(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, parts))], pa.int64())], ["rows"])

    df.select(column).mapInArrow(save, "rows long").agg(F.sum("rows")).collect()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, vec) of two-dimensional arrays saved by numpy; a file is one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                x = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                x = x.reshape(len(x), -1).astype("float64")
                for lo in range(0, len(x), 10_000):
                    part = x[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["file", "row", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, row long, vec array<double>")


def sparse_line(features: Column, label: Column | None = None) -> Column:
    """A row in sparse text form: the label, then index:value with six decimals, indices from 0.

    A missing or NaN value is written as -1; values of at most 1e-6 in size are left out.
    """
    value = lambda v: F.when(v.isNull() | F.isnan(v), -1.0).otherwise(v)
    cells = F.filter(F.transform(features, lambda v, i: F.when(F.abs(value(v)) > 1e-6, F.concat(i.cast("string"), F.lit(":"), F.format_string("%.6f", value(v))))), lambda x: x.isNotNull())
    line = F.array_join(cells, " ")
    return line if label is None else F.concat_ws(" ", label.cast("string"), line)


def write_sparse(df: DataFrame, path: str, columns: list[str], label: str | None = None) -> None:
    """``df`` as text files of :func:`sparse_line`."""
    line = sparse_line(F.array(*[F.col(c).cast("double") for c in columns]), F.col(label) if label else None)
    df.select(line.alias("value")).write.mode("overwrite").text(path)
