import random
import re

import pytest
from pyspark.sql import functions as F

from foldloom.llm.packing import pack_corpus, pack_sizes
from foldloom.llm.pii import Finder, Gazetteer, fit_gazetteer, mask_pii
from foldloom.llm.tokens import TOKENIZERS, VOCABULARY, Encoder, count_tokens, encode_corpus

TEXTS = ["", None, "Hello world", "  two  blanks\n\n\tx ", "naïve café 中文 😀 ½²", "<|endoftext|> it's I'LL", "=" * 3000, " " * 2000, "a\r\nb\x1c\x85c​d", "x" * 50_000]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder(reference):
    r = random.Random(1)
    odd = "ab \t\n'sé中1½² \x1c\x85​<|endoftext|>'ll've٣ⅷ　😀_-."
    texts = TEXTS + ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    e = Encoder(f"{TOKENIZERS}/{VOCABULARY}", known_words=500)
    assert [e.ids([t])[0] for t in texts] == [reference(t) for t in texts]


def test_encode_corpus(spark, data, reference):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(1, "again", "clash"), (None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    key = lambda x: str(tuple(x))
    got = sorted(((x["doc_id"], x["ids"]) for x in encode_corpus(df, "doc_id", "text").collect()), key=key)
    assert got == sorted(((k, reference(t)) for k, t, _ in rows), key=key)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = {x["doc_id"]: x["n_tokens"] for x in count_tokens(docs, "doc_id", "text").collect()}
    for x in encode_corpus(docs, "doc_id", "text").join(docs.select("doc_id", "text"), "doc_id").collect():
        assert x["ids"] == reference(x["text"]) and n[x["doc_id"]] == len(x["ids"])


@pytest.mark.parametrize("open_bins", [1, 4, 64])
def test_packing(spark, open_bins):
    r = random.Random(open_bins)
    sizes = [(k, r.choice([None, 0, 1, 99, 100, 101, 250, 300, r.randint(1, 60)])) for k in range(700)] + [(5, 7), (None, 3)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n bigint").repartition(5)
    rows = pack_sizes(df, "doc_id", "n", 100, open_bins).collect()
    bins = {}
    for x in rows:
        bins.setdefault(x["container"], []).append((x["place"], x["token_offset"], x["n_tokens"]))
    for items in bins.values():
        at = 0
        for k, (place, offset, n) in enumerate(sorted(items), 1):
            assert (place, offset) == (k, at)
            at += n
        assert at <= 100
    pieces = sorted((str(x["doc_id"]), x["n_tokens"]) for x in rows)
    want = sorted((str(k), p) for k, n in sizes for p in [100] * (max(0, (n or 0) - 1) // 100) + [(n or 0) - 100 * (max(0, (n or 0) - 1) // 100)])
    assert pieces == want
    assert pack_sizes(df.limit(0), "doc_id", "n", 100).count() == 0


def test_packing_is_tight(spark, data):
    rows = pack_corpus(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").toPandas()
    assert rows.n_tokens.sum() / (2048 * rows.container.nunique()) > 0.9


KEY = b"a key of the tests"
GAZETTEER = Gazetteer(frozenset(["hana", "anne-lise", "søren"]), frozenset(["nørracott", "kastani", "falsmark"]))
CASES = [
    ("Author: Hana Nørracott <hana-n@seqlab.test>", [("name", "Hana Nørracott"), ("email", "hana-n@seqlab.test")]),
    ("+// owner: Kastani, Søren", [("name", "Kastani, Søren")]),
    ("Thanks to S. Kastani and ANNE-LISE DE LA FALSMARK.", [("name", "S. Kastani"), ("name", "ANNE-LISE DE LA FALSMARK")]),
    ("+'Søren O'Kastani', x", [("name", "Søren O'Kastani")]),
    ("+hana nørracott,1", [("name", "hana nørracott")]),
    ("+F. Unknown;1\n+hana unknown\t2\nsee F. Unknown, or hana unknown", [("name", "F. Unknown"), ("name", "hana unknown")]),
    ("Gemeldet von Kastani, Søren <x>, with de la Falsmark, Hana or von Falsmark, Hana", [("name", "Kastani, Søren"), ("name", "de la Falsmark, Hana"), ("name", "von Falsmark, Hana")]),
    ("Agreed with Unknown, Hana.", [("name", "Unknown, Hana")]),
    ("Søren Kastani, Hana and others", [("name", "Søren Kastani")]),
    ("ask Hana about Release Notes", []),
    ("Reported by Build Robot <b@ci.example>", [("name", "Build Robot"), ("email", "b@ci.example")]),
    ("cc a.b+git (at) mail (dot) example (dot) com; tel +1-415-555-0156 ext. 38.", [("email", "a.b+git (at) mail (dot) example (dot) com"), ("phone", "+1-415-555-0156 ext. 38")]),
    ("cc n.z at seqlab dot test or k AT x.test or a_b @ x.example.", [("email", "n.z at seqlab dot test"), ("email", "k AT x.test"), ("email", "a_b @ x.example")]),
    ("git@git.x.example:core/a.git https://ci:x@forge.example/1 ssh ci@h.example pip install a@1.2.3", []),
    ("call (202) 555-0130, 020 7946 0988, 0044 1632 960599, 312.555.0189", [("phone", x) for x in ("(202) 555-0130", "020 7946 0988", "0044 1632 960599", "312.555.0189")]),
    ("range 120-145-1900, ts 2020-00-15 05:18:23, epoch = 17436868332", []),
    ("SSN=962-76-9616, pnr 441016-9924, QQ 68 82 99 B, Z89531253; 08 764 084 864", [("id_number", x) for x in ("962-76-9616", "441016-9924", "QQ 68 82 99 B", "Z89531253", "08 764 084 864")]),
    ("441316-9924 and 12345678A", []),
    ("lives at 363 Pinebrook Lane, Apt 4B.", [("address", "363 Pinebrook Lane, Apt 4B")]),
    ("(86 bis avenue du Nørrières, Ashby Holt 12818) Calle Junre 123, Ashworthweg 52a", [("address", "86 bis avenue du Nørrières"), ("address", "Calle Junre 123"), ("address", "Ashworthweg 52a")]),
    ("a" * 300 + ".b@x.test", [("email", "a" * 300 + ".b@x.test")]),
    ("https://h.example/" + "p/" * 200 + "ci@x.test", []),
    ("ssh -v " + "-o A=b " * 40 + "ci@h.example\nci@h.example", [("email", "ci@h.example")]),
    ("lit K" + "k" * 90 + ", Hana", [("name", "K" + "k" * 90 + ", Hana")]),
    ("06.12.34.56.78 or 0612345678 rang", [("phone", "06.12.34.56.78"), ("phone", "0612345678")]),
    ("000-12-3456 666-12-3456 123-00-4567 B00000000 123-45-6789", [("id_number", "123-45-6789")]),
    ("GIT binary patch\nliteral 9\nzx@123-45-6789\n\n987-65-4321", [("id_number", "987-65-4321")]),
    ("of a GIT binary patch\nliteralcall+1-415-555-0156x\n+1-415-555-0156", [("phone", "+1-415-555-0156")]),
    ("Needs a 3 Way Merge on the release branch.", []),
]


@pytest.mark.parametrize("text, want", CASES, ids=[c[0][:30] for c in CASES])
def test_find(text, want):
    assert [(k, text[a:b]) for a, b, k in Finder(GAZETTEER).find(text)] == want


def test_find_in_a_long_line():
    part = "Hana Kastani <h@x.test>, 020 7946 0988, S. Unknown, 8 Elm Road; "
    one = Finder(GAZETTEER).find(part)
    want = [(a + k * len(part), b + k * len(part), kind) for k in range(20_000) for a, b, kind in one]
    assert len(one) == 4 and Finder(GAZETTEER).find(part * 20_000) == want


def test_mask(spark):
    long = "word " * 100_000
    rows = [(1, "Signed-off-by: Ida Berg <i@x.test>\nIda Berg rang 020 7946 0988", 0), (2, "Acked-by: Ida Holm <j@x.test>\n020 7946 0988 " + long, 0), (3, None, 0), (4, "", 0), (4, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found int")
    got = sorted(mask_pii(df, "doc_id", "text", KEY).collect(), key=lambda x: x["doc_id"])
    assert [x["masked"] for x in got[2:]] == [None, "", ""]
    assert [x["pii_text"] for x in got[0]["found"]] == ["Ida Berg", "i@x.test", "Ida Berg", "020 7946 0988"]
    tag = re.search(r"\[PHONE:[0-9 ]+\]", got[0]["masked"])[0]
    assert got[0]["found"][3]["placeholder"] == tag and re.search(r"\[NAME:[0-9a-f]{16}\]", got[0]["masked"])
    assert "Berg" not in got[0]["masked"] and tag in got[1]["masked"]
    assert got[1]["masked"].endswith(long)
    assert mask_pii(df.limit(0), "doc_id", "text", KEY).count() == 0
    assert fit_gazetteer(df, "doc_id", "text").given == {"ida"}
    for key in (b"", b"short", b"x" * 65):
        with pytest.raises(ValueError):
            mask_pii(df, "doc_id", "text", key)
    with pytest.raises(TypeError):
        mask_pii(df, "doc_id", "text")
    assert fit_gazetteer(df, "doc_id", "text", sample=None).given == {"ida"}


def test_gazetteer_of_all_documents(spark):
    named = F.when(F.col("id") < 40, F.concat(F.lit("Author: Ida Berg"), F.translate("id", "0123456789", "abcdefghij"), F.lit(" <i@x.test>")))
    df = spark.range(1_000_001).select(F.col("id").alias("doc_id"), named.alias("text"))
    fitted = fit_gazetteer(df, "doc_id", "text")
    assert fitted.given == {"ida"} and len(fitted.family) == 40
    with pytest.raises(ValueError):
        fit_gazetteer(df, "doc_id", "text", sample=100)
