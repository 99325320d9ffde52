"""Clouds read by byte ranges: headers by themselves, then record-aligned ranges of PCD, PLY and NPY files in as many tasks as their sizes ask for."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.scratch import materialize

#: Bytes of a file that are read to find its header, and bytes of a range.
HEAD, RANGE = 4096, 1 << 25
#: Headers may be as long as this; they are read HEAD bytes at a time.
LONGEST_HEAD = 1 << 16
# Type letters and sizes of PCD fields, and type names of PLY properties.
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", **{("I", n): f"<i{n}" for n in (1, 2, 4, 8)}, **{("U", n): f"<u{n}" for n in (1, 2, 4, 8)}}
PLY_TYPES = {
    "char": "<i1", "uchar": "<u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8",
    "int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8",
}
HEADS = "path string, length long, text boolean, columnwise boolean, offset long, n long, names array<string>, types array<string>, error string"
POINTS = "path string, pt long, x double, y double, z double, extra map<string,double>, error string"


def _local(path: str) -> str | None:
    """The name of a plain path or a file: one on this machine; None for other stores."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") or "://" not in path else None


def read_bytes(path: str, start: int, size: int) -> bytes:
    """``size`` bytes of a file from ``start``; a plain path or file: by the machine's files, other stores by Arrow's."""
    if _local(path):
        with open(_local(path), "rb") as f:
            f.seek(start)
            return f.read(size)
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(min(size, max(0, f.size() - start)), start)


def parse_pcd(head: bytes) -> tuple[dict[str, list[str]], int]:
    """PCD header fields and where the body starts; an IndexError if the header goes on."""
    fields, at = {}, 0
    while True:
        end = head.find(b"\n", at)
        if end < 0:
            raise IndexError("header")
        line = head[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            name, *rest = line.split()
            fields[name.upper()] = rest
            if name.upper() == "DATA":
                return fields, at


def declared_count(fields: dict[str, list[str]]) -> int:
    """POINTS, else WIDTH x HEIGHT."""
    return int(fields["POINTS"][0]) if "POINTS" in fields else int(fields["WIDTH"][0]) * int(fields["HEIGHT"][0])


def _pcd(head: bytes) -> dict:
    fields, at = parse_pcd(head)
    counts = [int(c) for c in fields.get("COUNT", ["1"] * len(fields["FIELDS"]))]
    names = [n if c == 1 else f"{n}_{i}" for n, c in zip(fields["FIELDS"], counts) for i in range(c)]
    text = fields["DATA"][0] == "ascii"
    if not text and fields["DATA"][0] != "binary":
        raise ValueError(f"unsupported DATA {fields['DATA'][0]}")
    types = [""] * len(names) if text else [PCD_TYPES[t, int(s)] for t, s, c in zip(fields["TYPE"], fields["SIZE"], counts) for _ in range(c)]
    return {"text": text, "offset": at, "n": declared_count(fields), "names": names, "types": types}


def _ply(head: bytes) -> dict:
    mark = b"end_header"
    at = head.find(mark)
    if at < 0 or head.find(b"\n", at) < 0:
        raise IndexError("header")
    lines = [x.split() for x in head[:at].decode("ascii", "replace").splitlines()]
    form = next((x[1] for x in lines if x[:1] == ["format"]), "")
    if form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unsupported format {form}")
    elements = [x[1] for x in lines if x[:1] == ["element"]]
    if not elements or elements[0] != "vertex":
        raise ValueError("the vertices must come first")
    n = next(int(x[2]) for x in lines if x[:2] == ["element", "vertex"])
    own, names, types = "", [], []
    for x in lines:
        own = x[1] if x[:1] == ["element"] else own
        if own == "vertex" and x[:1] == ["property"]:
            names.append(x[-1])
            types.append("" if form == "ascii" else PLY_TYPES[x[1]])
    return {"text": form == "ascii", "offset": head.find(b"\n", at) + 1, "n": n, "names": names, "types": types}


def _npy(head: bytes) -> dict:
    f = io.BytesIO(head)
    version = npy.read_magic(f)
    try:
        shape, columnwise, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
    except ValueError as e:
        raise (IndexError("header") if "EOF" in str(e) else e) from e
    if len(shape) != 2 or shape[1] < 3 or kind.kind not in "fiub":
        raise ValueError("N x 3 or wider is needed")
    names = ["x", "y", "z", *(f"f{i}" for i in range(3, shape[1]))]
    return {"text": False, "columnwise": columnwise, "offset": f.tell(), "n": shape[0], "names": names, "types": [kind.str] * len(names)}


def read_head(path: str, length: int, kind: str) -> dict:
    """What the header of a cloud says; at most HEAD bytes of it are read, more only where the header goes on."""
    size = HEAD
    while True:
        head = read_bytes(path, 0, min(size, length))
        try:
            found = {"pcd": _pcd, "ply": _ply, "npy": _npy}[kind](head)
        except IndexError as e:
            if len(head) >= min(length, LONGEST_HEAD):
                raise ValueError("no end of the header") from e
            size *= 2
            continue
        if not {"x", "y", "z"} <= set(found["names"]) or not found["n"]:
            raise ValueError("empty cloud")
        width = 0 if found["text"] else np.dtype(list(zip(map(str, range(len(found["types"]))), found["types"]))).itemsize
        if not found["text"] and found["offset"] + found["n"] * width > length:
            raise ValueError("truncated body")
        return found


def _data_lines(row: dict, range_bytes: int) -> list[bytes]:
    """The data lines that begin in the range from ``start``: not those that are blank or comments."""
    path, offset, start, length = row["path"], row["offset"], row["start"], row["length"]
    end = min(start + range_bytes, length)
    data = read_bytes(path, max(offset, start - 1), end - max(offset, start - 1))
    if start > offset:  # the line that begins before belongs to the range before
        cut = data.find(b"\n")
        data = data[cut + 1 :] if cut >= 0 else b""
    at = end
    while data and not data.endswith(b"\n") and at < length:  # the last line goes on
        more = read_bytes(path, at, min(HEAD, length - at))
        cut = more.find(b"\n")
        data, at = data + (more[: cut + 1] if cut >= 0 else more), at + len(more)
    return [x for x in data.splitlines() if x.strip() and not x.lstrip().startswith(b"#")]


def _table(row: dict, range_bytes: int) -> np.ndarray:
    """The numbers of a text range, as far as its lines are points."""
    lines, width = _data_lines(row, range_bytes)[: max(0, row["n"] - row["before"])], len(row["names"])
    table = np.loadtxt(io.BytesIO(b"\n".join(lines)), ndmin=2) if lines else np.empty((0, width))
    if table.shape[1] != width:
        raise ValueError("lines of another width")
    return table


def _columns(row: dict, range_bytes: int) -> tuple[int, dict[str, np.ndarray]]:
    """(number of the first point, columns) of a range."""
    names, types = row["names"], row["types"]
    if row["text"]:
        table = _table(row, range_bytes)
        return row["before"], {c: table[:, i] for i, c in enumerate(names)}
    start, n = row["start"], min(row["per"], row["n"] - row["start"])
    if row["columnwise"]:
        size = np.dtype(types[0]).itemsize
        at = [row["offset"] + (i * row["n"] + start) * size for i in range(len(names))]
        return start, {c: np.frombuffer(read_bytes(row["path"], a, n * size), t).astype(float) for c, a, t in zip(names, at, types)}
    kind = np.dtype(list(zip(map(str, range(len(names))), types)))
    rows = np.frombuffer(read_bytes(row["path"], row["offset"] + start * kind.itemsize, n * kind.itemsize), kind, n)
    return start, {c: rows[str(i)].astype(float) for i, c in enumerate(names)}


def _points(row: dict, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(columns["x"])
    more = [c for c in columns if c not in ("x", "y", "z")]
    items = np.column_stack([columns[c] for c in more]).ravel() if more else np.empty(0)
    keys = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(more), dtype=np.int32), n), pa.array(more, pa.string())).cast(pa.string())
    extra = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(more)), keys, pa.array(items))
    axes = [pa.array(columns[c], from_pandas=True) for c in ("x", "y", "z")]  # NaN becomes null
    path = pa.array([row["path"]]).take(pa.array(np.zeros(n, np.int32)))
    return pa.RecordBatch.from_arrays([path, pa.array(np.arange(first, first + n)), *axes, extra, pa.nulls(n, pa.string())], names=["path", "pt", "x", "y", "z", "extra", "error"])


def heads(files: DataFrame, kind: str | None = None) -> DataFrame:
    """HEADS of (path, length): what each header says, or why it cannot be read. ``kind`` is the format of files whose names don't end with it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                row = {"path": path, "length": length, "text": None, "columnwise": False, "offset": None, "n": None, "names": None, "types": None, "error": None}
                try:
                    row |= read_head(path, length, kind or path.rsplit(".", 1)[-1].lower())
                except Exception as e:  # a bad file must not fail the job
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_HEADS)

    return files.select("path", "length").mapInArrow(read, HEADS)


_LIST = pa.list_(pa.string())
_HEADS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("text", pa.bool_()), ("columnwise", pa.bool_()), ("offset", pa.int64()), ("n", pa.int64()), ("names", _LIST), ("types", _LIST), ("error", pa.string())])


def _spread(ranges: DataFrame, heads: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges dealt to one task for each ``range_bytes`` of all files or so."""
    total = heads.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(heads.sparkSession.sparkContext.defaultParallelism, min(100_000, total // range_bytes + 1))
    return ranges.repartition(int(tasks), "path", "start")


def read_ranges(files: DataFrame, kind: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """POINTS of the clouds (path, length): pt counts from 0 in each file; fields beside the coordinates stand in ``extra``.

    Binary bodies are read in ranges of whole records of about ``range_bytes``, text bodies in ranges of bytes, of which each reads the lines that begin in it; text ranges are
    read three times: their lines are counted, then checked, then given. So one large file is read by many tasks, and no task holds more than a range. A bad or empty file gives one
    row with its error and no point; NaN coordinates arrive as nulls.
    """
    found = materialize(heads(files, kind), "heads")
    good = found.filter("error IS NULL")
    errors = found.filter("error IS NOT NULL").select("path", "error")
    width = F.aggregate("types", F.lit(0), lambda a, t: a + F.substring(t, -1, 1).cast("int"))  # the last letter of a type is its size
    binary = good.filter("NOT text").withColumn("per", F.greatest(F.floor(F.lit(range_bytes) / width), F.lit(1)).cast("long"))
    binary = binary.withColumn("start", F.explode(F.expr("sequence(0L, n - 1, per)"))).withColumn("before", F.lit(0).cast("long"))
    pieces = good.filter("text").withColumn("start", F.explode(F.sequence("offset", F.greatest(F.col("length") - 1, F.col("offset")), F.lit(range_bytes).cast("long"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "start": row["start"], "rows": len(_data_lines(row, range_bytes))}], schema=_COUNTS)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    _table(row, range_bytes)
                except Exception as e:  # a bad file must not fail the job
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([f"{type(e).__name__}: {e}"[:200]])], names=["path", "error"])

    w = W.partitionBy("path")  # ranges of a file, not lines
    counted = _spread(pieces.select("path", "length", "offset", "start"), found, range_bytes).mapInArrow(count, "path string, start long, rows long")
    counted = counted.withColumns({"before": F.sum("rows").over(w.orderBy("start")) - F.col("rows"), "all": F.sum("rows").over(w)})
    pieces = materialize(pieces.join(counted, ["path", "start"]).withColumn("per", F.lit(0).cast("long")), "pieces")
    columns = ["path", "length", "text", "columnwise", "offset", "n", "names", "types", "start", "per", "before"]
    short = pieces.filter(F.col("all") < F.col("n")).select("path", F.lit("ValueError: truncated body").alias("error")).distinct()
    text = pieces.filter((F.col("all") >= F.col("n")) & (F.col("before") < F.col("n"))).select(*columns)
    unread = _spread(text, found, range_bytes).mapInArrow(check, "path string, error string").groupBy("path").agg(F.min("error").alias("error"))
    bad = materialize(short.unionByName(unread), "bad")
    errors = errors.unionByName(bad)
    text = text.join(bad.select("path"), "path", "left_anti")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _points(row, *_columns(row, range_bytes))

    points = _spread(binary.select(*columns).unionByName(text.select(*columns)), found, range_bytes).mapInArrow(read, POINTS)
    none = {c: F.lit(None).cast(t) for c, t in (("pt", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("extra", "map<string,double>"))}
    return points.unionByName(errors.withColumns(none))


_COUNTS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("rows", pa.int64())])


def read_clouds(spark: SparkSession, folder: str, glob: str = "*.{pcd,ply,npy}", kind: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The points of every PCD, PLY and NPY file below ``folder``, see :func:`read_ranges`."""
    return read_ranges(list_files(spark, folder, glob), kind, range_bytes)


def header_counts(spark: SparkSession, folder: str, glob: str = "*.pcd") -> DataFrame:
    """(path, n_points) from the headers of PCD files, of which no more than HEAD bytes are read; null where a header can't be read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [points_declared(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(counts, pa.int64())], names=["path", "n_points"])

    return list_files(spark, folder, glob).mapInArrow(count, "path string, n_points long")


def points_declared(path: str, length: int) -> int | None:
    try:
        return declared_count(parse_pcd(read_bytes(path, 0, min(HEAD, length)))[0])
    except (IndexError, KeyError, ValueError, OSError):
        return None


#: Files of a task that reads them, and folders of one that lists them, about.
FILES, FOLDERS = 1000, 64
_ENTRIES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether it is a folder) of what lies in a folder, without names that Spark's sources pass over."""
    top = folder.rstrip("/") + "/"
    if _local(folder):
        with os.scandir(_local(folder)) as found:
            entries = [(e.name, e.stat().st_size, e.is_dir()) for e in found if e.is_dir() or e.is_file()]
    else:
        store, name = fs.FileSystem.from_uri(folder)
        entries = [(i.base_name, i.size or 0, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(name))]
    for name, length, inner in entries:
        if not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")):
            yield top + name, length, inner


def _globs(glob: str) -> list[str]:
    """The patterns that a glob with {a,b} stands for."""
    found = re.search(r"\{([^{}]*)\}", glob)
    return [x for part in found[1].split(",") for x in _globs(glob[: found.start()] + part + glob[found.end() :])] if found else [glob.replace("[^", "[!")]


def _is_folder(folder: str) -> bool:
    try:
        if _local(folder):
            return folder.startswith(("/", "file:")) and os.path.isdir(_local(folder))
        store, name = fs.FileSystem.from_uri(folder)
        return store.get_file_info(name).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; contents are never read.

    Tasks list the folders of each level, and no name is sent to the driver. What is no folder that Python sees (a file, a pattern, a store that only Hadoop knows) is left to
    Spark's own listing, which the driver keeps.
    """
    if not _is_folder(folder):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
    patterns = _globs(glob)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column("path").to_pylist():
                rows = [r for r in _entries(top) if r[2] or any(fnmatchcase(r[0].rsplit("/", 1)[1], g) for g in patterns)]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), _ENTRIES.types)], schema=_ENTRIES)

    levels = []
    folders, n, total = spark.createDataFrame([("file:" + _local(folder) if _local(folder) else folder,)], "path string"), 1, 0
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // FOLDERS)))
        level = materialize(folders.repartition(tasks, "path").mapInArrow(entries, "path string, length long, folder boolean"), "listed")
        levels.append(level.filter("NOT folder").select("path", "length"))
        folders, (n, files) = level.filter("folder").select("path"), level.agg(F.count_if("folder"), F.count_if(~F.col("folder"))).first()
        total += files
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.repartition(max(spark.sparkContext.defaultParallelism, -(-total // FILES)), "path")


def write_texts(files: DataFrame, folder: str) -> None:
    """Write each text of (name, text) as the file ``name`` below ``folder``, by the tasks; a file gets its name once it is whole, and the driver hears of none."""

    def write(rows) -> None:
        for row in rows:
            path, data = f"{folder}/{row['name']}", row["text"].encode()
            part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
            if _local(path):
                os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
                with open(_local(part), "wb") as f:
                    f.write(data)
                os.replace(_local(part), _local(path))
            else:
                store, name = fs.FileSystem.from_uri(path)
                hidden = fs.FileSystem.from_uri(part)[1]
                store.create_dir(name.rsplit("/", 1)[0])
                with store.open_output_stream(hidden) as f:
                    f.write(data)
                store.move(hidden, name)

    files.select("name", "text").foreachPartition(write)
