"""OIFITS as a Spark data source: a partition a piece of a file, filters pushed into the reader, files written by their tasks.

    register(spark)
    rows = spark.read.format("oifits").option("pushdown", "true").load("/data/night").where("target = 'HD 1' and kind = 'v2'")
    write(rows, "/data/copy")

Filters are pushed only with the option, for frames that one query filters in one way: Spark 4.1 keeps a single set of
pushed filters for a loaded frame, and a query that filters such a frame in two ways would read the rows of one twice.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..plans.work import Table
from . import fits, oifits

ROW = oifits.ROW + ", target string"
NAMES = [x.split()[0] for x in ROW.split(", ")]
#: Columns whose filters by value the reader answers itself.
PUSHED = ("target", "insname", "kind")
#: Days within which rows count as one exposure where a file gives no exposure times.
TOLERANCE = 1e-4
#: Rows times channels that a task reads, or writes at a time.
VALUES = 50_000
OBSERVED = {v[0] for v in oifits.KINDS.values()}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path on it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[str]:
    """The OIFITS files of a path: itself, or those in its folder, by name."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".fits", ".oifits")))
    head = path[: len(path.rstrip("/")) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    return [head + n for n in names]


class Piece(InputPartition):
    """Rows of the tables of a file: (place of the table among its tables, first row, last row)."""

    def __init__(self, path: str, spans: list[tuple[int, int, int]]):
        self.path, self.spans = path, spans


def pieces(path: str, values: int = 0) -> list[Piece]:
    """A file in pieces of `values` numbers of rows and channels, by its headers alone; small tables share a piece."""
    values = values or VALUES
    system, at = _open(path)
    with system.open_input_file(at) as f:
        parts = fits.parts(f)
    channels = {_ins(p.header): p.rows for p in parts if p.name == "OI_WAVELENGTH"}
    out, room = [], 0
    for i, p in enumerate(parts):
        if p.name not in OBSERVED:
            continue
        first, each = 0, max(1, channels.get(_ins(p.header), 1))
        while first < p.rows:
            if room < each:
                out.append(Piece(path, []))
                room = max(values, each)
            last = min(p.rows, first + room // each)
            out[-1].spans.append((i, first, last))
            room -= (last - first) * each
            first = last
    return out


def _ins(header: dict) -> str:
    return str(header.get("INSNAME", "")).strip()


class OifitsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set[str]] = {}

    def partitions(self) -> list[InputPartition]:
        return [x for p in _files(self.path) for x in pieces(p)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where there are no partitions
            return
        for pdf in rows_of(partition, self.wanted):
            for start in range(0, len(pdf), 10_000):
                yield pa.RecordBatch.from_pandas(pdf.iloc[start : start + 10_000], schema=_SCHEMA, preserve_index=False)


class PushingReader(OifitsReader):
    """Takes filters by value on PUSHED, and leaves the others to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ROW.split(", ")])


class OifitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oifits"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> OifitsReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else OifitsReader)(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format `oifits` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OifitsSource)


def rows_of(piece: Piece, wanted: dict[str, set[str]]) -> Iterator[pd.DataFrame]:
    """The wanted rows and channels of a piece; a table of another kind or instrument is not read. Absent numbers become null."""
    system, at = _open(piece.path)
    keep = lambda kind, value: kind not in wanted or value in wanted[kind]
    kinds = {k: v for k, v in oifits.KINDS.items() if keep("kind", k)}
    with system.open_input_file(at) as f:
        parts = fits.parts(f)
        small = [fits.rows_of(f, p) for p in parts if p.name in ("OI_TARGET", "OI_WAVELENGTH")]
        targets = {int(i): str(n).strip() for t in small if t.name == "OI_TARGET" for i, n in zip(t.columns["TARGET_ID"], t.columns["TARGET"])}
        waves = [t for t in small if t.name == "OI_WAVELENGTH"]
        for i, first, last in piece.spans:
            own = [k for k, v in kinds.items() if v[0] == parts[i].name]
            if not own or not keep("insname", _ins(parts[i].header)):
                continue
            t = fits.rows_of(f, parts[i], first, last)
            ids = np.array([targets.get(int(i)) for i in t.columns["TARGET_ID"]], object)
            chosen = np.array([keep("target", x) for x in ids], bool)
            for kind in own:
                if not chosen.any() or kinds[kind][1] not in t.columns:
                    continue
                part = fits.Table(t.name, t.header, {c: np.asarray(x)[chosen] for c, x in t.columns.items()})
                pdf = oifits.long_rows(piece.path, kind, part, waves)
                # rows keep the numbers they have in the file's table
                pdf["row"] = first + np.flatnonzero(chosen)[pdf["row"].to_numpy()]
                yield pdf.assign(target=np.repeat(ids[chosen], len(pdf) // len(ids[chosen])))[NAMES]


def exposures(long: DataFrame) -> DataFrame:
    """(file, insname, tolerance): days within which rows are one exposure, twice the longest integration of the tables."""
    longest = F.max(F.when(F.col("exposure") > 0, F.col("exposure"))) * (2.0 / 86400.0)
    return long.groupBy("file", "insname").agg(F.coalesce(longest, F.lit(TOLERANCE)).alias("tolerance"))


def same_exposure(left: DataFrame, right: DataFrame, keys: list[str], id: str, tolerance: DataFrame) -> DataFrame:
    """`left` (file, insname, keys, mjd, time, left_id) with the `id` of the nearest row of `right` in one exposure, or null.

    Days and the TIME column must both agree to the tolerance of the file's instrument: rows of one day can interleave
    in TIME. Ties go to the smaller id. Candidates meet by buckets of the tolerance, so that a join is on equal keys.
    """
    both = ["file", "insname"]
    at = F.floor(F.col("mjd") / F.col("tolerance"))
    wide = left.join(tolerance, both).withColumn("__bucket", F.explode(F.array(at - 1, at, at + 1)))
    near = right.join(tolerance, both).select(*both, *keys, F.col("mjd").alias("__mjd"), F.col("time").alias("__time"), F.col(id).alias("__id"), at.alias("__bucket"))
    apart, late = F.abs(F.col("mjd") - F.col("__mjd")), F.abs(F.col("time") - F.col("__time")) / 86400.0
    found = wide.join(near, [*both, *keys, "__bucket"]).where((apart <= F.col("tolerance")) & (late <= F.col("tolerance")))
    best = found.groupBy("left_id").agg(F.min(F.struct((apart + late).alias("d"), F.col("__id").alias("id"))).alias("best"))
    return left.join(best.select("left_id", F.col("best.id").alias(id)), "left_id", "left")


def sample_ids(long: DataFrame) -> DataFrame:
    """The squared visibilities with their sample_id and station pair in order (a, b)."""
    pair = [F.least("sta1", "sta2").alias("a"), F.greatest("sta1", "sta2").alias("b")]
    return long.where("kind = 'v2'").select("*", *pair, F.xxhash64("file", "insname", "row", "channel", F.lit("vis")).alias("sample_id"))


def aligned_extras(long: DataFrame, kind: str) -> DataFrame:
    """Amplitudes (`amp`) or phases (`phi`) of the long rows on the samples of the squared visibilities of their exposure.

    (file, sample_id, value, error, flag): the sign of a phase turns where its stations are the other way round. Rows
    without a squared visibility keep a null sample_id, so that none is lost.
    """
    vis = sample_ids(long)
    order = F.col("sta1") > F.col("sta2")
    extra = long.where(F.col("kind") == kind).withColumns({"a": F.least("sta1", "sta2"), "b": F.greatest("sta1", "sta2"), "left_id": F.xxhash64("file", "insname", "row", "channel", "kind")})
    extra = extra.withColumn("turned", order)
    keys = ["target", "channel", "a", "b"]
    found = same_exposure(extra, vis, keys, "sample_id", exposures(long))
    way = vis.select("sample_id", F.col("sta1").alias("__s1"))
    both = found.join(way, "sample_id", "left")
    sign = F.when((F.lit(kind) == "phi") & F.col("__s1").isNotNull() & (F.col("sta1") != F.col("__s1")), -1.0).otherwise(1.0)
    return both.select("file", "sample_id", (F.col("value") * sign).alias("value"), "error", "flag")


def frame_means(long: DataFrame) -> DataFrame:
    """`long` with frame_mjd, the mean day of the rows of a file, target and instrument that are one exposure after another."""
    from pyspark.sql import Window

    w = Window.partitionBy("file", "target", "insname").orderBy("mjd")
    held = long.join(exposures(long), ["file", "insname"])
    new = F.coalesce((F.col("mjd") - F.lag("mjd").over(w) > F.col("tolerance")).cast("int"), F.lit(0))
    framed = held.withColumn("__new", new).withColumn("frame", F.sum("__new").over(w))
    return framed.withColumn("frame_mjd", F.avg("mjd").over(Window.partitionBy("file", "target", "insname", "frame"))).drop("__new", "tolerance")


#: What the channels of a row of a file share; the row comes first, as sorts tell most rows apart by it.
SHARED = ["row", "mjd", "time", "exposure", "sta1", "sta2", "sta3", "u", "v", "u2", "v2", "target"]
#: Kinds that stand second in a table that they may share.
SECOND = ("phi", "t3amp")


def _copies(cells: str) -> Column:
    """Rows that the cells of one row fill: more than one if a channel is there again."""
    channels = F.transform(cells, lambda c: c["channel"])
    each = F.transform(F.array_distinct(channels), lambda c: F.size(F.filter(channels, lambda x: x == c)))
    return F.when(F.size(cells) == 0, 0).when(F.size(F.array_distinct(channels)) == F.size(cells), 1).otherwise(F.array_max(each)).cast("long")


class _Written:
    """A file that is written as its rows come in: tables by instrument, kind and row, whose lengths are known before."""

    def __init__(self, path: str, name: str, head: dict):
        self.name = name if name.endswith((".fits", ".oifits")) else f"{name}.fits"
        self.system, self.at = _open(path)
        self.system.create_dir(self.at, recursive=True)
        self.part = f"{self.at}/.{self.name}.{np.random.default_rng().integers(1 << 62):x}"
        self.f = self.system.open_output_stream(self.part)
        self.number = {n: i + 1 for i, n in enumerate(head["targets"])}
        self.channels = {w["insname"]: [c["channel"] for c in w["waves"]] for w in head["instruments"]}
        self.lengths = {(t["insname"], t["name"], k): t["lengths"][k] for t in head["tables"] for k in (0, 1)}
        self.now, self.size, self.rows = None, 0, 0
        targets = {"TARGET_ID": np.arange(1, len(self.number) + 1, dtype=np.int16), "TARGET": np.array(head["targets"], object)}
        tables = [fits.Table("OI_TARGET", {"OI_REVN": 2}, targets)]
        for w in head["instruments"]:
            waves = {c: np.array([x.get(k) for x in w["waves"]], float) for c, k in (("EFF_WAVE", "wavel"), ("EFF_BAND", "bandwidth"))}
            tables.append(fits.Table("OI_WAVELENGTH", self.header(w["insname"]), waves))
        self.f.write(fits.write(tables))

    def header(self, ins: str) -> dict:
        return {"OI_REVN": 2, "ARRNAME": "ARRAY", "INSNAME": ins, "DATE-OBS": "2024-01-01"}

    def add(self, b: pa.RecordBatch, ins: str, name: str, second: int) -> None:
        kinds = [k for k, v in oifits.KINDS.items() if v[0] == name]
        cells = [b.column(c) for c in ("one", "two")]
        held = [(k, c) for k, c in zip(kinds, cells) if pc.sum(pc.list_value_length(c)).as_py()]
        channels, times = self.channels[ins], b.column("copies").to_numpy()
        n, first = int(times.sum()), np.cumsum(times) - times
        wide = lambda c: np.repeat(b.column(c).to_numpy(zero_copy_only=False), times)
        get = lambda c: wide(c).astype(float)
        c = {"TARGET_ID": np.array([self.number[x] for x in wide("target")], np.int16), "TIME": get("time"), "MJD": get("mjd"), "INT_TIME": get("exposure")}
        flag = np.ones((n, len(channels)), bool)
        for kind, x in held:
            _, value, error, scale = oifits.KINDS[kind]
            row = np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy())
            channel, values, errors, flags = (y.to_numpy(zero_copy_only=False) for y in x.flatten().flatten())
            place = np.searchsorted(channels, channel)
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
            again = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
            at = first[row] + again, place
            for column, y in ((value, values), (error, errors)):
                c[column] = np.full(flag.shape, np.nan)
                c[column][at] = y / scale
            if kind == held[0][0]:
                flag[at] = flags
            self.rows += len(row)
        if name == "OI_T3":
            c |= {"U1COORD": get("u"), "V1COORD": get("v"), "U2COORD": get("u2"), "V2COORD": get("v2")}
        elif name != "OI_FLUX":
            c |= {"UCOORD": get("u"), "VCOORD": get("v")}
        stations = np.stack([wide(f"sta{i + 1}").astype(np.int16) for i in range({"OI_T3": 3, "OI_FLUX": 1}.get(name, 2))], axis=1)
        c |= {"STA_INDEX": stations[:, 0] if name == "OI_FLUX" else stations, "FLAG": flag}
        table = fits.Table(name, self.header(ins), c)
        if self.now != (ins, name, second):
            self.end()
            self.now = ins, name, second
            self.f.write(fits.start(table, self.lengths[self.now]))
        body = fits.rows(table)
        self.size += len(body)
        self.f.write(body)

    def end(self) -> None:
        self.f.write(fits.padding(self.size))
        self.size = 0

    def close(self) -> pa.RecordBatch:
        self.end()
        self.f.close()
        self.system.move(self.part, f"{self.at}/{self.name}")
        return pa.RecordBatch.from_pydict({"file": [self.name], "rows": [self.rows]})


def write(long: DataFrame, path: str) -> DataFrame:
    """(file, rows): long rows written as one OIFITS file for each value of `file`, in the folder `path`; written when it returns.

    `file` names are taken without their folders, with `.fits` put on where it is missing. A file is written under
    another name and moved when it is whole, so that a task that is run again leaves one file. Tables are one for each
    kind and instrument; VIS and T3 tables hold amplitudes and phases together where all rows have both, with equal
    flags. Spark gathers the channels of a row, counts and sorts the rows; a file's task writes them as they come, some
    thousands at a time. A channel that a row lacks is flagged, without a value.
    """
    names = F.create_map(*(F.lit(x) for k, v in oifits.KINDS.items() for x in (k, v[0])))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c)
    long = long.withColumns({c: text(c) for c in ("file", "insname", "target")})
    cell = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("channel", "int"), ("value", "double"), ("error", "double"))), F.coalesce("flag", F.lit(False)).alias("flag"))
    cells = lambda which: F.array_sort(F.collect_list(F.when(which, cell)))
    by, second = ["file", "insname", "name"], F.col("kind").isin(*SECOND)
    rows = long.withColumn("name", names[F.col("kind")]).where("name is not null").groupBy(*SHARED, *by).agg(cells(~second).alias("one"), cells(second).alias("two"))
    rows = Table(rows.withColumns({"n1": _copies("one"), "n2": _copies("two")}), "oifits-rows")
    keyed = lambda c: F.transform(c, lambda x: F.struct(x["channel"], x["flag"]))
    both = rows.df.groupBy(*by).agg(F.bool_and(keyed("one") == keyed("two")).alias("both"), F.array(F.sum("n1"), F.sum("n2")).alias("lengths"))
    both = Table(both, "oifits-tables")
    waves = long.groupBy("file", "insname", "channel").agg(F.min(F.struct("wavel", "bandwidth")).alias("w"))
    waves = waves.groupBy("file", "insname").agg(F.array_sort(F.collect_list(F.struct(F.col("channel").cast("int").alias("channel"), "w.wavel", "w.bandwidth"))).alias("waves"))
    heads = waves.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("insname", "waves"))).alias("instruments"))
    heads = heads.join(both.df.groupBy("file").agg(F.collect_list(F.struct("insname", "name", "lengths")).alias("tables")), "file")
    heads = heads.join(rows.df.groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("targets")), "file")
    # no null among nested columns: for each row that Spark hands to Python it would go through a batch's nulls before it
    void = F.array().cast(rows.df.schema["one"].dataType)
    table = lambda second, copies, one, two: F.struct(F.lit(second).alias("second"), F.col(copies).alias("copies"), one.alias("one"), two.alias("two"))
    alone = F.filter(F.array(table(0, "n1", F.col("one"), void), table(1, "n2", void, F.col("two"))), lambda x: x["copies"] > 0)
    split = F.when(F.col("both"), F.array(table(0, "n1", F.col("one"), F.col("two")))).otherwise(alone)
    body = rows.df.join(both.df.drop("lengths"), by).select(*by, *SHARED, F.explode(split).alias("x")).select(*by, *SHARED, "x.*")
    head = heads.select("file", F.to_json(F.struct("targets", "instruments", "tables")).alias("head"))
    nothing = {"starts": F.lit(0), "insname": F.lit(""), "name": F.lit(""), "second": F.lit(0), "one": void, "two": void}
    stream = body.withColumns({"starts": F.lit(1), "head": F.lit("")}).unionByName(head.withColumns(nothing), allowMissingColumns=True)
    stream = stream.repartition("file").sortWithinPartitions("file", "starts", "insname", "name", "second", "row", "mjd", "time")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            keys = b.select(["file", "starts", "insname", "name", "second"]).to_pandas()
            edges = np.flatnonzero((keys != keys.shift()).any(axis=1)).tolist()
            for first, last in zip(edges, [*edges[1:], len(keys)]):
                file, starts, ins, name, second = keys.iloc[first]
                if not starts:
                    if now:
                        yield now.close()
                    now = _Written(path, posixpath.basename(file), json.loads(b.column("head")[first].as_py()))
                    continue
                for at in range(first, last, step := max(1, VALUES // len(now.channels[ins]))):
                    now.add(b.slice(at, min(step, last - at)), ins, name, second)
        if now:
            yield now.close()

    done = Table(stream.mapInArrow(task, "file string, rows long"), "oifits-written")
    rows.drop()
    both.drop()
    return done.df
