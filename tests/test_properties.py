import re

from hypothesis import given, settings
from hypothesis import strategies as st

from foldloom.operators.packed_fields import DELIMITER, RANGE_MARKS, UNREADABLE, segments

RANGES = st.tuples(st.integers(1, 5000), st.integers(0, 400)).map(lambda x: (x[0], x[0] + x[1]))
PLAIN_MARKS = st.sampled_from([m for m in RANGE_MARKS if " " not in m])
PLAIN_DELIMITERS = st.sampled_from(["_", "; ", ";", "|", " | ", "/", "&", " + ", "\t", " ", " and ", "__"])
WORDS = st.sampled_from([w for w in UNREADABLE if w != "-" and not DELIMITER.search(w)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(RANGES, WORDS), min_size=1, max_size=8), PLAIN_MARKS, PLAIN_DELIMITERS, st.sampled_from(["", '"', "'"]), st.sampled_from(["", "()", "[]", "{}"]))
def test_written_values_come_back(values, mark, delimiter, quote, bracket):
    written = [quote + (f"{v[0]}{mark}{v[1]}" if isinstance(v, tuple) else v) + quote for v in values]
    text = (bracket[:1] or "") + delimiter.join(written) + (bracket[1:] or "")
    assert segments(text) == [(k, *v) for k, v in enumerate(values, 1) if isinstance(v, tuple)]


@settings(max_examples=200, deadline=None)
@given(st.lists(RANGES, min_size=1, max_size=6), st.sampled_from([", ", ",", "_", ";"]))
def test_grouped_thousands_come_back(values, delimiter):
    text = delimiter.join(f'"{a:,}-{b:,}"' for a, b in values)
    assert segments(text) == [(k, *v) for k, v in enumerate(values, 1)]


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789-–_,;. \"'()[]xNA?toC/|&+\t", max_size=60))
def test_any_text_is_read(text):
    found = segments(text)
    places = [k for k, _, _ in found]
    assert places == sorted(set(places))
    runs = {int(x) for x in re.findall(r"[0-9]+", text)} | {int(x.replace(",", "")) for x in re.findall(r"[0-9]{1,3}(?:,[0-9]{3})+", text)}
    assert all(x < 10**18 for _, s, e in found for x in (s, e)) and (not found or runs)
