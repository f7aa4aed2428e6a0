"""Records of CSV files with quoted line breaks, read by byte ranges.

Spark splits text files at line ends, and a line end inside quotes does not end a record. Whether
a range starts inside quotes depends on all ranges before it, so the files are read twice:

1. each range is scanned for what it does to the two states that a line may start in (outside or
   inside quotes): the state at its end, and whether a record ends in it. These maps, one row a
   range, are composed in file order on the driver, which gives every range its true start state
   and, if it starts inside a record, the range in which that record began;
2. with its start state each range cuts its lines into whole records. Records that cross a range
   end are put together from their parts by a group-by over nothing but those parts, which a
   further pass picks out if there are any.

The states are those of a CSV parser, not mere quote parity: a quote opens a quoted field only at
the start of a field, so ``5" disk`` stays one line, and a doubled quote does not end a field.

Ranges follow ``spark.sql.files.*``. Where ``spark.sql.files.minPartitionNum`` is unset, it is set
to the present parallelism, so that ranges stay as they are when executors come or go. A result
that is computed after these settings were changed raises an error (read again) rather than use
states of other ranges.

Line ends are ``\\n`` or, if the first line of a file ends so, ``\\r\\n``, which then counts as
``\\n`` everywhere in that file; a bare ``\\r`` in a header raises an error. Empty lines between
records are skipped; a byte-order mark is dropped. An unclosed quote takes the rest of its file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
_QUOTED = re.compile(r'"[^"]*+(?:""[^"]*+)*+"')
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


def _from_field(line: str, at: int, sep: str) -> bool:
    """Whether a line ends inside quotes if a field starts at ``at``."""
    while True:
        if line.startswith('"', at):
            field = _QUOTED.match(line, at)
            if field is None:
                return True
            at = line.find(sep, field.end())
        else:  # the next field that starts with a quote
            at = line.find(f'{sep}"', at)
        if at < 0:
            return False
        at += 1


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a line that starts inside or outside quotes ends inside them."""
    if not inside:
        return _from_field(line, 0, sep)
    rest = _REST.match(line)
    if rest is None:
        return True
    at = line.find(sep, rest.end())
    return at >= 0 and _from_field(line, at + 1, sep)


@dataclass
class Ranges:
    """What is known of the byte ranges of a set of files."""

    inside: dict[tuple[str, int], bool]
    #: start of the range in which the record that a range starts in began
    began: dict[tuple[str, int], int]
    #: files of which some record crosses a range end
    crossed: set[str]
    crlf: set[str]
    header: str | None


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines of one range at a time, in order."""
    for batch in batches:
        file, start = batch.column(0), batch.column(1)
        at = 0
        while at < batch.num_rows:
            key = file[at].as_py(), start[at].as_py()
            same = pc.and_(pc.equal(file.slice(at), key[0]), pc.equal(start.slice(at), key[1]))
            end = pc.index(same, False).as_py()
            n = batch.num_rows - at if end < 0 else end
            yield key, batch.column(2).slice(at, n)
            at += n


def _scan(lines: DataFrame, sep: str) -> DataFrame:
    """One row a range: end states by start state, whether a record ends in it if it starts
    inside quotes, and the first record of a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, ins, ended, head, closed, open_head = None, False, True, False, [], False, False

        def row() -> pa.RecordBatch:
            if key[1] == 0 and not closed:
                raise ValueError(f"{key[0]}: the first byte range does not hold the header")
            first = "\n".join(head) if key[1] == 0 else None
            return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out_to": out, "in_to": ins, "ended": ended, "head": first}])

        for now, values in _runs(batches):
            if now != key:
                if key is not None:
                    yield row()
                key, out, ins, ended, head, closed, open_head = now, False, True, False, [], False, False
            if now[1] == 0 and not closed:
                for line in values:
                    head.append(line.as_py())
                    open_head = ends_inside(head[-1], open_head, sep)
                    if not open_head:
                        closed = True
                        break
            quoted = pc.match_substring(values, '"')
            some = values.filter(quoted)
            if not ins and len(values):
                ended = True
            for line in some.to_pylist():
                out, ins = ends_inside(line, out, sep), ends_inside(line, ins, sep)
                ended = ended or not ins
        if key is not None:
            yield row()

    return lines.mapInArrow(run, "file string, start bigint, out_to boolean, in_to boolean, ended boolean, head string")


def scan_ranges(spark: SparkSession, path: str | list[str], sep: str = ",") -> Ranges:
    """Scan the files once and compose the ranges' maps (one row a range reaches the driver)."""
    rows = sorted(_scan(_lines(spark, path), sep).collect(), key=lambda r: (r["file"], r["start"]))
    found = Ranges({}, {}, set(), set(), None)
    file, inside, began = None, False, 0
    for r in rows:
        key = r["file"], r["start"]
        if r["file"] != file:
            file, inside, began = r["file"], False, r["start"]
            head = (r["head"] or "").removeprefix(BOM)
            if head.endswith("\r"):
                found.crlf.add(file)
                head = head.replace("\r\n", "\n").removesuffix("\r")
            if "\r" in head.replace("\r\n", ""):
                raise ValueError(f"{file}: a bare carriage return in the header")
            if found.header is not None and head != found.header:
                raise ValueError(f"{file}: its header differs from that of the other files")
            found.header = head
        found.inside[key] = inside
        if inside:
            found.began[key] = began
            found.crossed.add(file)
        if not inside or r["ended"]:
            began = r["start"]
        inside = r["in_to"] if inside else r["out_to"]
        if inside:
            found.crossed.add(file)
    return found


def _cut(lines: DataFrame, ranges: Ranges, sep: str, parts: bool) -> DataFrame:
    """Whole records (``record``), or the parts of those that cross a range end (``file, began,
    start, record``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, first, open_lines = None, False, False, []

        def part(began: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "began": began, "start": key[1], "record": "\n".join(open_lines)}])

        def last() -> Iterator[pa.RecordBatch]:
            if open_lines and parts:
                yield part(ranges.began[key] if first else key[1])

        for now, values in _runs(batches):
            if parts and now[0] not in ranges.crossed:
                continue  # here and not by a filter: one that prunes files would change the ranges
            if now != key:
                if key is not None:
                    yield from last()
                if now not in ranges.inside:
                    raise RuntimeError("the byte ranges have changed since the files were scanned; read them again")
                key, inside, open_lines = now, ranges.inside[now], []
                first = inside  # the lines up to the next record belong to one that began before
                header = now[1] == 0
            whole = pa.array([], pa.string())
            quoted = pc.match_substring(values, '"')
            if not inside and not pc.any(quoted).as_py():
                whole = values
            else:
                done = []
                for line, some in zip(values.to_pylist(), quoted.to_pylist()):
                    if some:
                        inside = ends_inside(line, inside, sep)
                    open_lines.append(line)
                    if not inside:
                        if first:
                            if parts:
                                yield part(ranges.began[key])
                            first = False
                        else:
                            done.append("\n".join(open_lines))
                        open_lines = []
                whole = pa.array(done, pa.string())
            if header and len(whole):
                whole, header = whole.slice(1), False
            if not parts and len(whole):
                if key[0] in ranges.crlf:
                    whole = pc.replace_substring(whole, "\r\n", "\n")
                    whole = pc.replace_substring_regex(whole, r"\r\z", "")
                whole = whole.filter(pc.greater(pc.binary_length(whole), 0))
                yield pa.RecordBatch.from_arrays([whole.cast(pa.string())], ["record"])
        if key is not None:
            yield from last()

    return lines.mapInArrow(run, "file string, began bigint, start bigint, record string" if parts else "record string")


def _joined_parts(lines: DataFrame, ranges: Ranges, sep: str) -> DataFrame:
    """Records that cross range ends, put together."""
    records = (_cut(lines, ranges, sep, True).groupBy("file", "began")
               .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
               .select("file", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    crlf = F.col("file").isin(sorted(ranges.crlf))
    return records.select(F.when(crlf, F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), r"\r\z", ""))
                          .otherwise(F.col("record")).alias("record"))


def column_names(header: str, sep: str = ",") -> list[str]:
    """Names in a header record; unnamed columns are called by their place."""
    names = next(csv.reader([header], delimiter=sep), []) if "\n" not in header else next(csv.reader(header.splitlines(True), delimiter=sep))
    names = [name or f"_c{i}" for i, name in enumerate(names)]
    lower = [n.lower() for n in names]
    return [f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv_ranges(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """All columns of the CSV files at ``path`` (header, RFC 4180 quoting) as strings."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    ranges = scan_ranges(spark, path, sep)
    if not ranges.header:
        raise ValueError(f"{path}: no header")
    names = column_names(ranges.header, sep)
    lines = _lines(spark, path)
    records = _cut(lines, ranges, sep, False)
    if ranges.crossed:
        records = records.unionByName(_joined_parts(lines, ranges, sep))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"})
    return records.select(fields.alias("f")).select(*[F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)])
