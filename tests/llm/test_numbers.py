import random

import pytest

from foldloom.llm.numbers import CARD_LETTERS, EXTENSION, NUMBER, _by_elevens, _by_tens, permute, pseudonym, read

# the notations of each kind of number
FORMS = [
    "+1 415 555 0156", "+1-415-555-0156 ext. 38", "+1 (415) 555-0156", "+14155550156", "(202) 555-0130", "312.555.0189", "312-555-0189 x5", "001 212 555 1234",
    "+44 20 7946 0958", "+44 (0) 20 7946 0958", "0044 1632 960599", "020 7946 0988", "01632 960599", "0163 296 0599", "+33 1 99 00 14 42", "01 99 00 14 42", "01.99.00.14.42", "0612345678",
    "+49 30 23125 617", "+353 1 234 5678", "+353-1-234-5678", "+46812345678", "+7 495 123 45 67",
    "123-45-6789", "928-25-4702", "994 00 5396", "665-01-0001", "667-01-0001", "441016-9924", "000229-1230", "811218-9876", "811218+9876",
    "08 764 084 864", "86 095 742 719", "QQ 68 82 99 B", "AB123456C", "12345678Z", "12345678-Z", "X1234567L", "Z-1234567-R", "Z89531253", "A00000001",
]


def kind(text):
    m = NUMBER.fullmatch(text)
    r = m and read(m)
    return r and (r.stays, next(k for k in ("phone", "ssn", "personal", "tax", "insurance", "card", "passport") if m[k]))


@pytest.mark.parametrize("text", FORMS)
def test_pseudonyms_keep_the_format(text):
    """For 1,000 keys: accepted by the same pattern as the same kind, in the same notation, right if the original was."""
    assert kind(text)
    seen = set()
    for k in range(1000):
        new = pseudonym(text, b"key %d" % k)
        assert kind(new) == kind(text)
        assert [c if not c.isalnum() else "" for c in EXTENSION.sub("", new)] == [c if not c.isalnum() else "" for c in EXTENSION.sub("", text)]
        digits = "".join(c for c in new if c.isdigit())
        if kind(text)[1] == "card":
            assert CARD_LETTERS[int(new.replace("-", "").replace("X", "0").replace("Y", "1").replace("Z", "2", 1 if new[0] == "Z" else 0)[:-1]) % 23] == new[-1]
        if kind(text)[0] == "personal:right":
            assert _by_tens(digits[:9]) == int(digits[9])
        if kind(text)[0] == "tax:right":
            assert _by_elevens(digits[:10]) == int(digits[10])
        seen.add(new)
    assert len(seen) > 900


SAME = [
    ["212-555-1234", "212-555-1234 x5", "(212) 555-1234", "212.555.1234", "+1 212 555 1234", "+12125551234", "+1-212-555-1234 ext. 9", "001 212 555 1234"],
    ["020 7946 0958", "+44 20 7946 0958", "+44 (0) 20 7946 0958", "0044 20 7946 0958", "+442079460958"],
    ["01 99 00 14 42", "01.99.00.14.42", "+33 1 99 00 14 42", "0033 1 99 00 14 42"],
    ["QQ 68 82 99 B", "QQ688299B"],
    ["12345678Z", "12345678-Z"],
    ["123-45-6789", "123 45 6789"],
]


@pytest.mark.parametrize("texts", SAME, ids=[t[0] for t in SAME])
def test_notations_are_linked(texts):
    def own(text):
        """The number without extension, country or trunk zero."""
        digits = "".join(c for c in EXTENSION.sub("", text).replace("(0)", "") if c.isalnum())
        return digits[-9:]

    for k in range(50):
        key = b"key %d" % k
        assert len({own(pseudonym(t, key)) for t in texts}) == 1
    assert pseudonym(texts[0], b"one key") != pseudonym(texts[0], b"another")


def test_different_numbers_stay_different():
    r = random.Random(5)
    for make in (lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(0, 9999):04d}", lambda: f"{r.randint(0, 99):02d}{r.randint(1, 12):02d}{r.randint(1, 28):02d}-{r.randint(0, 9999):04d}", lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"):
        texts = {make() for _ in range(3000)}
        assert len({pseudonym(t, b"key") for t in texts}) == len(texts)


def test_permutations():
    for n in (1, 2, 10, 999, 1000):
        assert sorted(permute(k, n, b"k") for k in range(n)) == list(range(n))


@pytest.mark.parametrize("text", ["000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000", "441316-9924", "12345678A", "B00000000", "hello"])
def test_invalid_numbers(text):
    assert kind(text) is None
    with pytest.raises(ValueError):
        pseudonym(text, b"k")
