import hashlib
import random

import public_tokenizers as P

from shelfspark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, _extra int, _row string, _text int"


def cases():
    r = random.Random(5)
    soup = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = [None, "", " ", "\n\n  x", "It's 12,5 €", soup(900, "ab c\n\n  12'!é"), soup(4000, "ab c.\n\t  日本語éß9'"), "a" * 3000, " " * 2500 + "x", "\n" * 700 + " y" + "!" * 900]
    rows = [(i, t, None, i, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[7], (None, soup(2000, "xy z"), "clash", None, None, None)]


def expected(text):
    ids = bpe.encoding(PATH, P.PATTERN).encode_ordinary(text or "")
    return " ".join(map(str, ids)), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_give_the_ids_of_the_whole_text(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    for step, overlap in ((200, 64), (64, 16), (1000, 100)):
        rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN, step=step, overlap=overlap), PATH).collect()
        got = sorted((str(x.doc_id), " ".join(map(str, x.ids)), hashlib.sha256(bytes(x.decoded)).hexdigest()) for x in rows)
        assert got == sorted((str(i), *expected(t)) for i, t, *_ in cases())


def test_a_long_text_with_the_usual_chunks(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdeféß") for _ in range(r.randint(1, 9))) for _ in range(2000)]
    text = " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "'s", " 12"]) for _ in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "y" * 40_000), (3, text + "!")], "doc_id long, text string")
    coded = bpe.encode(df, PATH, P.PATTERN)
    # pieces are rows when they are encoded: the encoder stands below the aggregate that puts ids together
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and len(text) > 20 * bpe.CHUNK
    got = {x.doc_id: x for x in bpe.decode(coded, PATH).collect()}
    for i, t in ((1, text), (2, "y" * 40_000), (3, text + "!")):
        assert (" ".join(map(str, got[i].ids)), hashlib.sha256(bytes(got[i].decoded)).hexdigest()) == expected(t)


def test_empty_table(spark):
    out = bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN), PATH)
    assert out.collect() == [] and {"ids", "decoded", "doc_id", "_extra"} <= set(out.columns)
