"""Raw feed records as typed valid rows, or unchanged among the rejects with a reason (problem 1).

Blank records, records that start with `#` and the end mark `//` are neither. Structure is judged by pyarrow's CSV
reader over each batch: it is given every other record, with its number in the batch put in front, and reports rows of
a wrong number of fields to a callback. Fields are read as strings; whole columns are then cast, and cells that fail
give the record its reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed forms of the two feeds
BARE, QUOTED = r'[^",\r\n]*', r'"(?:[^"]|"")*"'
REGION_SHAPE = rf"(?s)^(?:{BARE}|{QUOTED})(?:,(?:{BARE}|{QUOTED}))*$"
ALIGNMENT_SHAPE = r'^(?:"[^" \t]*"[ \t]+[^"]*|[^"]*)$'
FAMILY = r"^PF[0-9]{5,}$"
WHOLE = r"^[0-9]+$"
GREATEST = str(2**63 - 1)  # what a bigint holds
E_VALUE = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
FULL_ID = r"^(?P<acc>[A-Z0-9]{6}|[A-Z0-9]{10})\.(?P<version>[0-9]+)/(?P<first>[0-9]+)-(?P<last>[0-9]+)$"
ALIGNED = r"^[A-Za-z.\-]+$"

REGION_FIELDS = "id string, family string, seq_start bigint, seq_end bigint, evalue double, description string"
ALIGNMENT_FIELDS = "accession string, version bigint, seq_start bigint, seq_end bigint, aligned string"


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(values, pattern), False).to_numpy(zero_copy_only=False)


def _cast(values: pa.Array, ok: np.ndarray, to: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """The cells of ok as numbers (others 0), and where the number can be held."""
    cells = pc.if_else(pa.array(ok), values, pa.scalar("0", values.type))
    if to == pa.int64():
        digits = pc.utf8_ltrim(cells, characters="0")
        size = pc.utf8_length(digits)
        fits = pc.or_(pc.less(size, len(GREATEST)), pc.and_(pc.equal(size, len(GREATEST)), pc.less_equal(digits, GREATEST))).to_numpy(zero_copy_only=False)
        cells = pc.if_else(pa.array(fits), pc.utf8_lpad(digits, 1, "0"), pa.scalar("0", values.type))
        return cells.cast(to).to_numpy(), ok & fits
    numbers = cells.cast(to).to_numpy()
    return numbers, ok & np.isfinite(numbers)


def _mark(raw: pa.Array) -> str:
    """A character that no record of the batch holds."""
    return next(c for c in map(chr, range(0xE000, 0x110000)) if not pc.any(pc.match_substring(raw, c)).as_py())


class _Reasons:
    """The first reason found for each record."""

    def __init__(self, n: int):
        self.of = np.full(n, None, object)

    def give(self, where: np.ndarray, reason: str) -> None:
        self.of[where & np.equal(self.of, None)] = reason


def _read(records: pa.Array, at: np.ndarray, fields: int, delimiter: str, reasons: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Numbers and string columns of the records that have so many fields; others get a reason."""
    if not len(at):
        return at, [pa.array([], pa.string())] * fields
    lines = pc.binary_join_element_wise(pa.array(at).cast(pa.string()), records.take(pa.array(at)), delimiter)
    data = pa.py_buffer("\n".join(lines.to_pylist()).encode() + b"\n")
    wrong: list[csv.InvalidRow] = []

    def note(row: csv.InvalidRow) -> str:
        wrong.append(row)
        return "skip"

    names = ["number", *map(str, range(fields))]
    table = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(use_threads=False, column_names=names, block_size=max(1 << 16, data.size + 1)),
        parse_options=csv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=note),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
    ).combine_chunks()
    for row in wrong:
        found = row.actual_columns - 1
        reasons[int(row.text.split(delimiter, 1)[0].strip('"'))] = f"{found} field{'s' * (found != 1)} instead of {fields}"
    columns = [c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns]
    return columns[0].cast(pa.int64()).to_numpy(), columns[1:]


def _region(raw: pa.Array, live: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    n = len(raw)
    reasons = _Reasons(n)
    broken = live & ~_matches(raw, REGION_SHAPE)
    reasons.give(broken, "broken quoting")
    mark = _mark(raw)  # guards blanks inside double quotes while blanks around bare fields are cut
    kept = pc.replace_substring_regex(raw, r'(^|,)"([ \t])', rf'\1"{mark}\2')
    kept = pc.replace_substring_regex(kept, r'([ \t])"(,|$)', rf'\1{mark}"\2')
    at, cells = _read(kept, np.flatnonzero(live & ~broken), 6, ",", reasons.of)
    cells = [pc.utf8_trim(c, characters=" \t") for c in cells]
    bad = _Reasons(len(at))
    bad.give(pc.equal(pc.utf8_length(cells[0]), 0).to_numpy(zero_copy_only=False), "empty id")
    bad.give(~_matches(cells[1], FAMILY), "family isn't an accession")
    (start, s_ok), (end, e_ok) = (_cast(c, _matches(c, WHOLE), pa.int64()) for c in cells[2:4])
    bad.give(~s_ok, "start isn't a whole number")
    bad.give(~e_ok, "end isn't a whole number")
    bad.give(start < 1, "start under 1")
    bad.give(start > end, "start behind end")
    evalue, v_ok = _cast(cells[4], _matches(cells[4], E_VALUE), pa.float64())
    bad.give(~v_ok, "E-value isn't a finite unsigned number")
    reasons.of[at] = bad.of
    text = [pc.replace_substring(c, mark, "") for c in (cells[0], cells[5])]
    return reasons.of, _placed(n, at, [text[0], cells[1], pa.array(start), pa.array(end), pa.array(evalue), text[1]], REGION_FIELDS)


def _alignment(raw: pa.Array, live: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    n = len(raw)
    reasons = _Reasons(n)
    broken = live & ~_matches(raw, ALIGNMENT_SHAPE)
    reasons.give(broken, "broken quoting")
    lines = pc.replace_substring_regex(pc.utf8_trim(raw, characters=" \t"), r"[ \t]+", "\t")
    lines = pc.replace_substring_regex(lines, r"[\r\n]", _mark(raw))  # a line break within a record is no end of record
    at, (full_id, aligned) = _read(lines, np.flatnonzero(live & ~broken), 2, "\t", reasons.of)
    bad = _Reasons(len(at))
    ok = _matches(full_id, FULL_ID)
    parts = pc.extract_regex(pc.if_else(pa.array(ok), full_id, pa.scalar("AAAAAA.1/1-1")), FULL_ID)
    bad.give(~ok, "full id isn't accession.version/start-end")
    (version, v_ok), (start, s_ok), (end, e_ok) = (_cast(pc.struct_field(parts, k), ok, pa.int64()) for k in ("version", "first", "last"))
    bad.give(~v_ok | (version < 1), "version under 1")
    bad.give(~s_ok | (start < 1), "start under 1")
    bad.give(~e_ok | (start > end), "start behind end")
    bad.give(~_matches(aligned, ALIGNED), "sequence holds more than letters, - and .")
    letters = pc.utf8_length(pc.replace_substring_regex(aligned, r"[^A-Za-z]", "")).to_numpy(zero_copy_only=False)
    bad.give(letters != end - start + 1, "letters don't fill start to end")
    reasons.of[at] = bad.of
    return reasons.of, _placed(n, at, [pc.struct_field(parts, "acc"), pa.array(version), pa.array(start), pa.array(end), aligned], ALIGNMENT_FIELDS)


def _placed(n: int, at: np.ndarray, columns: list[pa.Array], fields: str) -> dict[str, pa.Array]:
    """The columns with the value of record at[k] in row at[k] and null elsewhere."""
    where = np.full(n, -1)
    where[at] = np.arange(len(at))
    take = pa.array(where, mask=where < 0)
    return {f.split()[0]: c.take(take) for f, c in zip(fields.split(", "), columns, strict=True)}


def _reader(judge: Callable, fields: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw_line").cast(pa.string())
            text = pc.replace_substring_regex(pc.fill_null(raw, ""), r"\r$", "")
            mark = pc.utf8_trim(text, characters=" \t\r\n")
            skipped = _matches(mark, r"^$") | _matches(mark, r"^//$") | _matches(text, r"^#")
            reasons, columns = judge(text, ~skipped)
            state = np.where(skipped, "skipped", np.where(np.equal(reasons, None), "valid", "rejected"))
            valid = pa.array(state == "valid")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("line_id"),
                    raw,
                    pa.array(state, pa.string()),
                    pa.array(reasons, pa.string()),
                    *[pc.if_else(valid, columns[c], pa.scalar(None, columns[c].type)) for c in names],
                ],
                names=["line_id", "raw_line", "state", "reason", *names],
            )

    return run


def _records(df: DataFrame, line_id: str, raw: str, judge: Callable, fields: str) -> DataFrame:
    rows = df.select(F.col(line_id).cast("bigint").alias("line_id"), F.col(raw).cast("string").alias("raw_line"))
    out = rows.mapInArrow(_reader(judge, fields), f"line_id bigint, raw_line string, state string, reason string, {fields}")
    return out.where("state <> 'skipped'")


def region_records(df: DataFrame, line_id: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """Records of the comma-separated search feed: line_id, raw_line, state ('valid' or 'rejected'), reason and the
    typed fields (null in rejects). Null and blank records are skipped like comments; repeated records each give a
    row; an empty table gives no rows; other columns are ignored."""
    return _records(df, line_id, raw, _region, REGION_FIELDS)


def alignment_records(df: DataFrame, line_id: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """Records of alignment files, in the form of region_records."""
    return _records(df, line_id, raw, _alignment, ALIGNMENT_FIELDS)
