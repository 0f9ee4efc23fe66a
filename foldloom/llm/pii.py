"""Personal information in free text: found, and replaced by typed placeholders (problem 9).

E-mail addresses, phone numbers, identity numbers and street addresses are found by their forms; names by a gazetteer of
given and family names, fitted to the header lines (`Author: Given Family <mail>`) of all documents.

Every span found gets its placeholder in the same pass, and placeholders keep equal values linked over documents: a phone
or identity number is read, and counts only if it is valid; its free parts are permuted by a keyed Feistel network within
its own format (see numbers; the date of a personal number becomes another date). Other values get a keyed tag of their
plain form. Without the key nobody can undo either, so it must come from the caller and stay secret.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.numbers import numbers, pseudonym, read

GIVEN_FAMILIES = 2  # family names with which a word must stand to count as a given name

LETTER = "A-Za-zÀ-ÖØ-öø-žẞ"
# fixed forms: particles of names, street words, words that join an obfuscated address
PARTICLES = "de la|de los|de|del|della|di|da|do|dos|das|du|van der|van den|van de|van|von der|von dem|von|zu|zur|ter|ten|bin|ibn|abu|le|la"
EN_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Boulevard|Blvd|Terrace|Crescent|Square|Place|Gardens|Grove|Mews|Parkway|Highway"
FR_STREETS = "rue|avenue|quai|boulevard|place|chemin|allée|impasse|cours|route|passage|sentier"
ES_STREETS = "Calle|Avenida|Plaza|Paseo|Carrera|Camino|Ronda|Travesía|Via|Viale|Piazza|Rua|Praça"
JOINED_STREETS = "straße|strasse|str\\.|weg|allee|gasse|platz|damm|gatan|vägen|gränd|torget|straat|laan|plein|gade|vej"
UNITS = "Apt|Apartment|Unit|Flat|Suite|Ste|Room|Floor"

HEADER_NAME = r"(?m)^[ \t]*(?:Author|From|Cc|Committer|[A-Z][a-z]+(?:-[a-z]+)*-by): ([^<>\n\r\d@:]{3,60}?) ?(?:<[^\n]*)?\r?$"

EMAIL_AFTER = re.compile(r"@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![\w@-])")
EMAIL_BEFORE = re.compile(rf"[{LETTER}0-9](?:[{LETTER}0-9._%+-]*[{LETTER}0-9_+-])?$")
EMAIL_CHARACTERS = frozenset(re.findall(rf"[{LETTER}0-9._%+-]", "".join(map(chr, range(0x2000)))))
TOKEN_END = re.compile(r"[\s\"'<>(),;]")
REMOTE_COMMAND = re.compile(r"\b(?:ssh|scp|sftp|rsync|telnet|mosh|ssh-copy-id)\s")
_AT = r"(?: ?[\[({<] ?(?:at|AT|At|a) ?[\])}>] ?| (?:at|AT|@) |_at_|＠)"
_DOT = r"(?: ?[\[({<] ?(?:dot|DOT|Dot) ?[\])}>] ?| (?:dot|DOT) |\.)"
HIDDEN_EMAIL = re.compile(rf"(?<![\w.+-])([{LETTER}0-9](?:[\w.+-]*[{LETTER}0-9])?)({_AT})((?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,}})(?![\w-])")
HIDDEN_SIGN = re.compile(r"[\[({<] ?(?:at|AT|At|a) ?[\])}>]| AT | @ | at [\w-]+ dot |_at_|＠")

_CAP = rf"[A-ZÀ-ÖØ-Þ][{LETTER}]*(?:['’-][{LETTER}]+)*"
ADDRESS = re.compile(
    rf"""(?<![\w./])(?<!\w-)(?:
    \d{{1,5}}[A-Za-z]?[ ](?:(?:[NSEW]\.?|{_CAP})[ ]){{1,4}}(?:{EN_STREETS})\b(?:\.?,?[ ](?:{UNITS})\.?[ ][\w-]{{1,6}})?
  | \d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:{FR_STREETS})(?:[ ](?:de|du|des|la|le|les))*[ ](?:[dl]['’])?{_CAP}(?:[ ]{_CAP}){{0,2}}
  | (?:{ES_STREETS})(?:[ ](?:de|del|la|los|las|el|da|do))*(?:[ ]{_CAP}){{1,3}},?[ ]\d{{1,5}}[a-z]?
  | {_CAP}(?:[ -]{_CAP})?(?:{JOINED_STREETS})[ ]\d{{1,4}}(?:[ ]?[a-h])?
  )(?!\w)""",
    re.X,
)
STREET_WORDS = frozenset(f"{EN_STREETS}|{FR_STREETS}|{ES_STREETS}".split("|"))  # an address holds one, or a word that ends so:
STREET_ENDS = tuple(JOINED_STREETS.replace("str\\.|", "").split("|"))
WORD = re.compile(rf"[{LETTER}]+(?:-[{LETTER}]+)*")
_FAMILY = rf"(?:(?:{PARTICLES}) )?(?:(?:al|el)-)?[{LETTER}]+(?:['’-][{LETTER}]+)*"
REST_OF_NAME = re.compile(rf"((?: [A-Z]\.)*) ({_FAMILY})", re.I)
FAMILY_BEFORE = re.compile(rf"(?<![\w'’-])((?:(?:{PARTICLES}) )?(?:(?:al|el)-)?[{LETTER}]+(?:['’-][{LETTER}]+)*), $", re.I)
INITIAL = re.compile(rf"[A-ZÀ-ÖØ-Þ](?<![\w.@].)\.(?: [A-Z]\.)* ({_FAMILY})(?![\w@])")
INITIAL_BEHIND = re.compile(r", [A-ZÀ-ÖØ-Þ]\.(?!\w)")
BEFORE_MAIL = re.compile(rf"(?<![\w.'’-])(?:{_CAP}|[A-ZÀ-ÖØ-Þ]\.)(?: [A-Z]\.)* (?:(?:{PARTICLES}) )?(?:(?:al|el)-)?{_CAP}$")
NAME_WORD_BEFORE = re.compile(rf"(?:^|[^\w])({_CAP}|[A-ZÀ-ÖØ-Þ]\.) $")
LOOSE_PARTICLE = re.compile(r"(?:von|van|de|du|da|do|zu|le|la) (?!(?:der|den|de|dem|la|los) )")
FIELD_END = re.compile(r'"?(?:[,;\t]\S| ?\| |[,;\t]*\r?\n)')
PARTICLE = re.compile(rf"^(?:(?:{PARTICLES}) )?(?:(?:al|el)-)?(?:[oO]['’]|[mM][aA]?[cC](?=[A-Z]))?", re.I)
# fixed form of a binary hunk: its mark, then the size of each part and lines of data
BINARY = re.compile(r"^GIT binary patch\r?\n(?:(?:literal|delta) \d+\r?\n(?:[A-Za-z][0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]{5,}(?:\r?\n|\Z))*(?:\r?\n)?)+", re.M)


FOUND = pa.list_(pa.struct([("pii_type", pa.string()), ("pii_text", pa.string()), ("placeholder", pa.string())]))


@dataclass(frozen=True)
class Gazetteer:
    given: frozenset[str]  # in lower case, like family
    family: frozenset[str]


def _stems(family: str) -> list[str]:
    """Lower-case parts of a family name, without particle and prefix."""
    bare = PARTICLE.sub("", family)
    return [p.lower() for p in re.split("-", bare) if len(p) > 2]


def fit_gazetteer(df: DataFrame, doc_id: str, text: str, sample: None = None, families: int = GIVEN_FAMILIES) -> Gazetteer:
    """Given and family names of the header lines of all documents; former calls name sample, which can only be None.

    A word counts as a given name if it stands first with at least `families` family names; then the rest of the name
    is a family name. What comes to the driver, and is broadcast, is each given and each family name once, so it grows with
    the different names and not with the documents.
    """
    if sample is not None:
        raise ValueError("the gazetteer is fitted to all documents")
    names = df.select(F.explode(F.regexp_extract_all(text, F.lit(HEADER_NAME), 1)).alias("name")).where("name like '% %'")
    name = F.when(F.col("name").contains(", "), F.concat_ws(" ", F.split_part("name", F.lit(", "), F.lit(2)), F.split_part("name", F.lit(", "), F.lit(1)))).otherwise(F.col("name"))
    parts = names.select(F.lower(F.btrim(name)).alias("name")).distinct()
    parts = parts.select(F.substring_index("name", " ", 1).alias("given"), F.regexp_replace("name", r"^\S+ (?:\p{L}\. )*", "").alias("family"))
    parts = parts.where(r"given rlike '^[\\p{L}-]{3,}$'").distinct()
    counted = parts.withColumn("n", F.count("*").over(Window.partitionBy("given"))).where(F.col("n") >= families)
    words = counted.select(F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("given").alias("word")), F.struct(F.lit(False).alias("first"), F.col("family").alias("word")))).alias("x"))
    found = words.select("x.*").distinct().toArrow()
    given, family = (found.filter(keep)["word"].to_pylist() for keep in (found["first"], pc.invert(found["first"])))
    return Gazetteer(frozenset(given), frozenset(s for f in family for s in _stems(f)))


def _cased(text: str) -> int:
    return 0 if text.islower() else 2 if text.isupper() else 1


class _Behind:
    """What stands in front of ascending places of a text; each character is looked at a fixed number of times."""

    def __init__(self, text: str):
        self.text = text
        self.run = 0  # where characters of an address begin, of those up to run_at
        self.token, self.token_at, self.url = 0, 0, False
        self.line, self.line_at, self.command = 0, 0, -1
        self.run_at = 0

    def run_start(self, at: int) -> int:
        """Where the characters in front of at begin that may belong to an address."""
        start = at
        while start > self.run_at and self.text[start - 1] in EMAIL_CHARACTERS:
            start -= 1
        if start > self.run_at:
            self.run = start
        self.run_at = at
        return self.run

    def in_url(self, at: int) -> bool:
        """Whether the token that at belongs to holds '://' in front of it."""
        for m in TOKEN_END.finditer(self.text, self.token_at, at):
            self.token, self.url = m.end(), False
        self.url = self.url or self.text.find("://", max(self.token, self.token_at - 2), at) >= 0
        self.token_at = at
        return self.url

    def in_remote_command(self, at: int) -> bool:
        """Whether a command that takes logins stands in front of at in its line."""
        start = self.text.rfind("\n", self.line_at, at) + 1
        if start or self.line_at == 0:
            self.line = start
            end = self.text.find("\n", start)
            m = REMOTE_COMMAND.search(self.text, start, end if end >= 0 else len(self.text))
            self.command = m.end() if m else -1
        self.line_at = at
        return 0 <= self.command <= at


def _words_back(text: str, at: int, words: int) -> int:
    """Where the last so many words begin that end at `at`, with single blanks between them."""
    for k in range(words):
        if k:
            if text[at - 1 : at] != " ":
                break
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _name_start(text: str, at: int) -> int:
    """Where a name that ends at `at` may begin: a family name with two particles, any initials, a given name."""
    start = _words_back(text, at, 3)
    while text[start - 1 : start] == " " and re.fullmatch(r"[A-Z]\.", text[(before := _words_back(text, start - 1, 1)) : start - 1]):
        start = before
    return _words_back(text, start - 1, 1) if text[start - 1 : start] == " " else start


def _word_before(text: str, at: int) -> re.Match | None:
    """The name word in front of the blank in front of at."""
    return NAME_WORD_BEFORE.search(text, max(0, _words_back(text, at - 1, 1) - 1), at)


class Finder:
    """The spans of personal information in a text, for a gazetteer."""

    def __init__(self, gazetteer: Gazetteer):
        self.given, self.family = gazetteer.given, gazetteer.family

    def find(self, text: str) -> list[tuple[int, int, str]]:
        if "GIT binary patch" in text:  # its data may look like anything
            text = BINARY.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        found: list[tuple[int, int, str]] = []  # in order of place; spans don't overlap
        starts: list[int] = []

        def add(start: int, end: int, kind: str) -> None:
            while end > start and text[end - 1] in ".,":
                end -= 1
            at = bisect_left(starts, end)
            if not at or found[at - 1][1] <= start:
                found.insert(at, (start, end, kind))
                starts.insert(at, start)

        self._emails(text, add)
        for m in numbers(text):
            number = read(m)
            if number:
                add(m.start(), m.end(), number.kind)
        words = set(WORD.findall(text))
        if _has_street(text, words):
            for m in ADDRESS.finditer(text):
                add(m.start(), m.end(), "address")
        self._names(text, words, add)
        return found

    def _emails(self, text: str, add) -> None:
        at, line = text.find("@"), _Behind(text)
        while at >= 0:
            after = EMAIL_AFTER.match(text, at)
            before = EMAIL_BEFORE.search(text, line.run_start(at), at) if after else None
            if before:
                start, end = before.start(), after.end()
                remote = text[end : end + 1] in (":", "/") and text[end + 1 : end + 2].strip() != ""
                if not remote and not line.in_url(start) and not line.in_remote_command(start):
                    add(start, end, "email")
                    if text[start - 2 : start] in (" <", " ("):
                        name = BEFORE_MAIL.search(text, _name_start(text, start - 2), start - 2)
                        if name:
                            add(name.start(), name.end(), "name")
            at = text.find("@", at + 1)
        if HIDDEN_SIGN.search(text):
            for m in HIDDEN_EMAIL.finditer(text):
                if m[2].strip() != "at" or re.search(r"\bdot\b", m[3]):
                    add(m.start(), m.end(), "email")

    def _names(self, text: str, words: set[str], add) -> None:
        hits = [w for w in words if w.lower() in self.given]
        for word in hits:
            at, size, case = text.find(word), len(word), _cased(word)
            while at >= 0:
                end = at + size
                if _begins(text, at) and text[end : end + 1] not in ("-", "@", "_", "'", "’"):
                    self._name_at(text, at, end, case, add)
                at = text.find(word, end)
        for m in INITIAL.finditer(text):
            if _begins(text, m.start()) and (self._known_family(m[1]) or _is_field(text, m.start(), m.end())):
                add(m.start(), _without_possessive(m), "name")
        for m in INITIAL_BEHIND.finditer(text):
            before = FAMILY_BEFORE.search(text, _words_back(text, m.start(), 3), m.start() + 2)
            if before and self._known_family(before[1]):
                add(before.start(), m.end(), "name")

    def _name_at(self, text: str, at: int, end: int, case: int, add) -> None:
        rest = REST_OF_NAME.match(text, end)
        if rest and text[rest.end() : rest.end() + 1] not in ("@", "_"):
            family = PARTICLE.sub("", rest[2]) or rest[2]
            fits = (
                family[:1].isupper() and _cased(family) < 2 or (case == 1 and len(family) > 2 and self._known_family(rest[2]) and family[:1].isupper())
                if case == 1
                else _cased(family) == case and (case == 2 or self._known_family(rest[2]) or _is_field(text, at, rest.end()))
            )
            if fits:
                add(at, _without_possessive(rest), "name")
                return
        before = FAMILY_BEFORE.search(text, _words_back(text, at - 2, 3), at) if text[at - 2 : at] == ", " else None
        if before:
            start = before.start()
            if LOOSE_PARTICLE.match(text, start) and _word_before(text, start):
                start = text.index(" ", start) + 1  # 'Gemeldet von Berg, Ida': a preposition
            family = text[start : before.end(1)]
            if (_cased(family) == case or case == 1) and self._may_lead(text, start, family, case):
                initial = re.match(r"(?: [A-Z]\.)*", text[end : end + 12])[0]
                add(start, end + len(initial), "name")

    def _may_lead(self, text: str, start: int, family: str, case: int) -> bool:
        """Whether the word in front of ', Given' is a family name, and not the end of another name."""
        if text[start - 1 : start] == '"':
            return True
        word = _word_before(text, start)
        if self._known_family(family):
            return not word or word[1][-1] != "." and word[1].lower() not in self.given
        bare = PARTICLE.sub("", family) or family
        return not word and len(bare) > 3 and _cased(bare) == case > 0 and bare[0].isupper()

    def _known_family(self, family: str) -> bool:
        return any(s in self.family for s in _stems(family))


def _has_street(text: str, words: set[str]) -> bool:
    """Whether a word of an address may stand in a text of these words."""
    parts = words.union(*[w.split("-") for w in words if "-" in w])
    return not STREET_WORDS.isdisjoint(parts) or any(w.endswith(STREET_ENDS) for w in parts) or "str. " in text


def _is_field(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] fills a field: from the beginning of a line, behind a diff's mark, to a delimiter."""
    line = text[max(0, start - 3) : start].rpartition("\n")[2]  # of a longer one three characters tell enough
    return line in ("", "+", "-", " ", '+"', '-"', ' "') and FIELD_END.match(text, end) is not None


def _begins(text: str, at: int) -> bool:
    """Whether a word may begin here; the first character of a line may be a diff's mark."""
    before = text[at - 1 : at]
    if before in ("+", "-", "'", "’"):
        return at < 2 or not text[at - 2].isalnum() if before in "'’" else at < 2 or text[at - 2] == "\n"
    return not (before.isalnum() or before in ("_", "@", ".", "/"))


def _without_possessive(m: re.Match) -> int:
    return m.end() - 2 if m[0][-2:] in ("'s", "’s") else m.end()


def _plain(kind: str, text: str) -> str:
    """One form for all ways to write a value."""
    if kind == "email":
        text = re.sub(_DOT, ".", re.sub(_AT, "@", text, count=1)).replace(" ", "")
    elif kind == "name" and ", " in text:
        text = " ".join(reversed(text.split(", ", 1)))
    return " ".join(text.lower().split())


@lru_cache(1 << 14)
def placeholder(kind: str, text: str, key: bytes) -> str:
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()}:{pseudonym(text, key)}]"
    return f"[{kind.upper()}:{hashlib.blake2b(_plain(kind, text).encode(), digest_size=8, key=key).hexdigest()}]"


def mask_pii(df: DataFrame, doc_id: str, text: str, key: bytes, gazetteer: Gazetteer | None = None) -> DataFrame:
    """doc_id, masked (the whole text with a placeholder in each place) and found, an array of pii_type, pii_text and
    placeholder in order of place. The gazetteer is fitted to df unless given. key holds 16 to 64 secret bytes.

    Null texts stay null with an empty array, empty ones empty; repeated rows each give a row; an empty table gives no
    rows; other columns are ignored.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must hold 16 to 64 bytes")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fitted = gazetteer if gazetteer is not None else fit_gazetteer(rows, "doc_id", "text")
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # different names, not documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            masked, found = [], []
            for t in batch.column("text").to_pylist():
                cases = [(a, b, k, placeholder(k, t[a:b], key)) for a, b, k in finder.find(t)] if t else []
                out, at = [], 0
                for start, end, _, new in cases:
                    out += [t[at:start], new]
                    at = end
                masked.append("".join([*out, t[at:]]) if cases else t)
                found.append([{"pii_type": k, "pii_text": t[a:b], "placeholder": new} for a, b, k, new in cases])
            arrays = [batch.column("doc_id"), pa.array(masked, pa.string()), pa.array(found, FOUND)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "masked", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, masked string, found array<struct<pii_type: string, pii_text: string, placeholder: string>>")
