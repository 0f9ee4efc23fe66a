"""Several values packed in one field, one row for each (problem 4).

A dictionary of whole values is matched by an Aho-Corasick automaton; dynamic programming then picks the cheapest cover of
the field by known values, delimiters and leftovers. So a delimiter inside a known value separates nothing, whatever
separates the values of that field. The dictionary is given as a table, fitted to the column (`fit_dictionary`), or made by
rule: residue ranges are known by their form, in which a digit run is reduced to its kind, so that the comma inside
`2,576-2,683`, the slash inside `N/A` and the dash inside `C-term` are protected.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[;,|\t\r\n]"  # of values in general; blanks around them don't count
BLANKS = " \u00a0"
MAX_DICTIONARY = 64 << 20  # bytes of known values up to which they are broadcast
# costs of a cover: leftovers stay only where nothing better covers them, and a longer known value beats its parts
VALUE, LEFTOVER = 1, 40

# fixed forms: how writers write a range, what they write instead of one, what separates and what encloses values
RANGE_MARKS = ("-", "–", "−", "‐", "‑", "—", "..", "...", ":", "~", "→", "->", " - ", " – ", " − ", " — ", " → ", " -> ", " ~ ", " to ", "to", " .. ", " ... ", " : ", " bis ", "bis", " à ", " a ")
HALF_MARKS = ("-", "–", "−", "..", ":")
UNREADABLE = ("NA", "N/A", "n/a", "na", "none", "None", "null", "unk", "unknown", "?", "-", "C-term", "N-term", "c-term", "n-term")
DELIMITER = re.compile(r"_|,|;|\||/|&|\+| and |\s")
ENCLOSING = frozenset("\"'()[]{}<>“”‘’`")

# kinds of digit runs: one or two digits, three, more; and a letter that names a chain in front of a range
SHORT, THREE, LONG, CHAIN = "\x01", "\x02", "\x03", "\x04"
NUMBERS = (SHORT, THREE, LONG, *(f"{a}{f',{THREE}' * k}" for a in (SHORT, THREE) for k in (1, 2)))
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"
RANGE = re.compile(rf"(?:[A-Za-z]:)?({NUMBER})[^0-9]+({NUMBER})")
SYMBOL = re.compile(r"[0-9]+|[A-WYZa-wyz](?=:[0-9])|[^0-9]")
# costs of covers by ranges: an ascending one is free
GROUPING, KNOWN_UNREADABLE, DESCENDING = 1, 8, 30


def automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Of known whole values with what is known of each."""
    known = ahocorasick.Automaton()
    for word, payload in words:
        known.add_word(word, (len(word), payload))
    known.make_automaton()
    return known


def boundaries(text: str, delimiter: re.Pattern) -> tuple[list[int], list[bool], list[bool]]:
    """Of each place the end of a delimiter that begins there, with the blanks around it (or 0); where a value may begin
    and where one may end."""
    n = len(text)
    after, may_begin, may_end = [0] * n, [False] * (n + 1), [False] * (n + 1)
    may_begin[0] = may_end[n] = True
    last = 0
    for m in delimiter.finditer(text):
        begin, end = m.span()
        if begin == end:
            continue
        while begin > last and text[begin - 1] in BLANKS:
            begin -= 1
        while end < n and text[end] in BLANKS:
            end += 1
        after[begin], may_end[begin], may_begin[end], last = end, True, True, end
    return after, may_begin, may_end


def best_cover(n: int, after: list[int], values: dict[int, list[tuple[int, float, object]]]) -> list[tuple[int, int, object]]:
    """The cheapest cover of n characters by values (by begin: end, cost, result), delimiters and leftovers: begin, end and
    result of each value and leftover in order (the result of a leftover is None)."""
    far = float("inf")
    best: list[tuple[float, int, object]] = [(0, -1, None)] + [(far, -1, None)] * n
    gap = object()
    ends = [n] * (n + 1)  # where a leftover that begins here must end
    for i in range(n - 1, -1, -1):
        ends[i] = i if after[i] else ends[i + 1]
    for i in range(n):
        cost = best[i][0]
        if cost == far:
            continue
        steps = values.get(i, [])
        steps = [*steps, (after[i], 0, gap) if after[i] else (ends[i], LEFTOVER, None)]
        for end, more, result in steps:
            if cost + more < best[end][0]:
                best[end] = (cost + more, i, result)
    found, end = [], n
    while end > 0:
        _, begin, result = best[end]
        if result is not gap:
            found.append((begin, end, result))
        end = begin
    return found[::-1]


QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def values_of(text: str | None, known: ahocorasick.Automaton | None, delimiter: re.Pattern, spans: Iterable[tuple[int, int]] = ()) -> list[tuple[str, bool]]:
    """The values packed in text, in order, and whether each is known as a whole or quoted. Known ones are found by the
    automaton or given as spans."""
    if not text:
        return []
    after, may_begin, may_end = boundaries(text, delimiter)
    values: dict[int, list[tuple[int, float, object]]] = {}
    for a, b in spans:
        values.setdefault(a, []).append((b, VALUE, text[a:b]))
    for last, (length, _) in known.iter(text) if known else ():
        a, b = last - length + 1, last + 1
        if may_begin[a] and may_end[b]:
            values.setdefault(a, []).append((b, VALUE, text[a:b]))
    for m in QUOTED.finditer(text):
        if may_begin[m.start()] and may_end[m.end()]:
            values.setdefault(m.start(), []).append((m.end(), 0, m[1].replace('""', '"')))
    cover = best_cover(len(text), after, values)
    return [(text[a:b] if x is None else x, x is not None) for a, b, x in cover]


def fit_dictionary(df: DataFrame, packed: str, delimiter: str = SEPARATORS, least: int = 2) -> DataFrame:
    """value: whole fields of the column that hold a delimiter and yet are one value.

    Such a field stands in at least `least` rows, and one of its parts is never seen without the others: neither alone in a
    field nor among the parts of another field. So `red, blue` is a list where red stands elsewhere too, and `Smith, John`
    a value where neither Smith nor John does.
    """
    fields = df.select(F.btrim(F.col(packed).cast("string")).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    parts = fields.select("value", "n", F.explode(F.array_distinct(F.transform(F.split("value", delimiter), lambda x: F.btrim(x)))).alias("part")).where("part <> ''")
    seen = parts.groupBy("part").agg(F.count("*").alias("fields"))  # of different fields
    several = parts.where(F.col("value") != F.col("part")).where(F.col("n") >= least)
    lone = several.join(seen, "part").groupBy("value").agg(F.min("fields").alias("least"))
    return lone.where("least = 1").select("value")


def unpack(df: DataFrame, row_id: str, packed: str, dictionary: DataFrame, delimiter: str = SEPARATORS, max_dictionary: int = MAX_DICTIONARY) -> DataFrame:
    """One row for each value packed in a field: row_id, place (from 1), value, known.

    dictionary is a table of known whole values (column `value`); only those that hold a delimiter matter. A value is
    known if it is among them or wholly in double quotes, which are undone. The dictionary is broadcast up to
    max_dictionary bytes; beyond, the stretches of each field that could be such values are looked up in it by a join.

    Null, empty and blank fields give no rows; empty places between delimiters aren't counted; rows that repeat each give
    theirs; an empty dictionary leaves a plain split, an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.btrim(F.col(packed).cast("string"), F.lit(BLANKS)).alias("packed")).where("packed <> ''")
    words = dictionary.select(F.btrim(F.col("value").cast("string")).alias("value")).where("value <> ''").where(F.col("value").rlike(delimiter)).distinct()
    size, longest = words.agg(F.sum(F.octet_length("value") + 8), F.max(F.length("value"))).first()
    pattern, kind = re.compile(delimiter), rows.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, place bigint, value string, known boolean"
    if (size or 0) <= max_dictionary:
        shared = df.sparkSession.sparkContext.broadcast([r["value"] for r in words.collect()])  # at most max_dictionary bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = automaton((w, True) for w in shared.value) if shared.value else None
            for batch in batches:
                yield _rows(batch.column("row_id"), [values_of(t, known, pattern) for t in batch.column("packed").to_pylist()])

        return rows.mapInArrow(run, schema)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every stretch of a field between two boundaries that is no longer than the longest known value."""
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                _, may_begin, may_end = boundaries(text, pattern)
                begins, ends = [k for k, x in enumerate(may_begin) if x], [k for k, x in enumerate(may_end) if x]
                for a in begins:
                    within = ends[bisect_right(ends, a) : bisect_right(ends, a + longest)]
                    out += [(row, a, b, text[a:b]) for b in within]
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "a", "b", "value"])

    met = numbered.select("row", "packed").mapInArrow(stretches, "row bigint, a bigint, b bigint, value string").join(words, "value", "left_semi")
    spans = met.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[(x["a"], x["b"]) for x in s or ()] for s in batch.column("spans").to_pylist()]
            texts = batch.column("packed").to_pylist()
            yield _rows(batch.column("row_id"), [values_of(t, None, pattern, s) for t, s in zip(texts, pairs, strict=True)])

    return numbered.join(spans, "row", "left").select("row_id", "packed", "spans").mapInArrow(choose, schema)


def _rows(ids: pa.Array, found: list[list[tuple[str, bool]]]) -> pa.RecordBatch:
    flat = [(k, place, value, known) for k, values in enumerate(found) for place, (value, known) in enumerate(values, 1)]
    row, place, value, known = (list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [], [])
    arrays = [ids.take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(value, pa.string()), pa.array(known, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["row_id", "place", "value", "known"])


@lru_cache(1)
def _ranges() -> ahocorasick.Automaton:
    """The forms of ranges, and of what is written instead of one."""
    words: dict[str, bool] = {}
    for a, mark, b in product(NUMBERS, RANGE_MARKS, NUMBERS):
        words[a + mark + b] = words[f"{CHAIN}:{a}{mark}{b}"] = True
    for word in UNREADABLE:
        words[word] = False
    for mark, a in product(HALF_MARKS, NUMBERS):
        words |= dict.fromkeys((mark + a, a + mark, f"x{mark}{a}", f"{a}{mark}x", f"?{mark}{a}", f"{a}{mark}?"), False)
    return automaton(words.items())


def segments(text: str | None) -> list[tuple[int, int, int]]:
    """(place, start, end) of each readable range of one field; places count all values written in it from 1."""
    if not text:
        return []
    form, at = [], []  # the form, and where each of its characters stands in text
    for m in SYMBOL.finditer(text):
        first, size = m[0][0], m.end() - m.start()
        if "0" <= first <= "9":
            form.append(SHORT if size < 3 else THREE if size == 3 else LONG)
        else:
            form.append(CHAIN if first.isascii() and first.isalpha() and text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].isdigit() and first not in "xX" else first)
        at.append(m.start())
    at.append(len(text))
    n = len(text)
    after, may_begin, may_end = [0] * n, [False] * (n + 1), [False] * (n + 1)
    may_begin[0] = may_end[n] = True
    for i in range(n):
        end = i + 1 if text[i] in ENCLOSING else m.end() if (m := DELIMITER.match(text, i)) else 0
        if end:
            after[i], may_end[i], may_begin[end] = end, True, True
    values: dict[int, list[tuple[int, float, object]]] = {}
    for last, (length, is_range) in _ranges().iter("".join(form)):
        a, b = at[last - length + 1], at[last + 1]
        if not (may_begin[a] and may_end[b]):
            continue
        cost, numbers = KNOWN_UNREADABLE, ()
        if is_range and (m := RANGE.fullmatch(text, a, b)) and max(both := (int(m[1].replace(",", "")), int(m[2].replace(",", "")))) < 1 << 63:
            numbers = both
            cost = DESCENDING * (numbers[0] > numbers[1]) + GROUPING * text.count(",", a, b)
        values.setdefault(a, []).append((b, cost, numbers))
    cover = best_cover(n, after, values)
    return [(place, *numbers) for place, (_, _, numbers) in enumerate(cover, 1) if numbers]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parse: Callable = lru_cache(1 << 14)(segments)
    for batch in batches:
        row, place, start, end = [], [], [], []
        for k, text in enumerate(batch.column("packed").to_pylist()):
            for p, s, e in parse(text):
                row.append(k)
                place.append(p)
                start.append(s)
                end.append(e)
        out = [pa.array(x, pa.int64()) for x in (row, place, start, end)]
        yield pa.RecordBatch.from_arrays([batch.column("row_id").take(out[0]), *out[1:]], names=["row_id", "seg_no", "seg_start", "seg_end"])


def unpack_ranges(df: DataFrame, row_id: str, packed: str) -> DataFrame:
    """One row for each readable range in the field packed: row_id, seg_no, seg_start, seg_end.

    seg_no counts all values written in the field, unreadable ones too, from the left. Null, empty and blank fields
    and those that say nothing ('none', 'NA', '-') give no rows; rows that repeat each give theirs; numbers beyond
    a bigint count as unreadable; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(packed).cast("string").alias("packed"))
    return rows.where("packed rlike '[0-9]'").mapInArrow(_split, "row_id bigint, seg_no bigint, seg_start bigint, seg_end bigint")
