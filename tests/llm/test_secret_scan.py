import base64
import math
import random
import re
import time
from collections import Counter

from shelfspark.llm import secret_scan as ss

from . import nasty


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 1, m.end(), "assign"))
    out += [(m.start(), 2, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 3, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(out)
    for m in re.finditer(ss.CANDIDATE, text):
        if any(re.search(must, m[0]) and not (no and re.search(no, m[0])) for must, no in ss.ALLOWED):
            continue
        least = next(bits for p, bits in ss.CLASSES.values() if re.search(p, m[0]))
        fit = []
        for i in range(len(m[0]) - ss.WINDOW + 1):
            n = Counter(m[0][i : i + ss.WINDOW]).values()
            if -sum(c / ss.WINDOW * math.log2(c / ss.WINDOW) for c in n) >= least - 1e-12:
                fit.append(i)
        if fit:
            out.append((m.start() + fit[0], 4, m.start() + fit[-1] + ss.WINDOW, "entropy"))
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return say(base), say(out)


MORE = ["secret:token: abcdefgh", "api_key='aaaaaa' API_KEY==bbbbbb", "éé token = 日 token = \"abc.def-gh\"", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "!", "f" * 23 + " " + "e" * 24, "deadbeef" * 4, "Q7x9Lk2Pz8Vt3Rw5Ym1Nc6Bj4Hd0Gs", "well-known-hyphenated-words-only", "550e8400-e29b-41d4-a716-446655440000", "/usr/local/lib/python/site/packages", "a1" * 12, "k3j4h5g6f7d8s9a0q1w2e3r4", "MFRGGZDFMZTWQ2LKNNWG23TP", "Zm9vYmFyMTIz/NDU2Nzg5MGFi/Y2RlZkdISUpL", "Chapter12-section3-of-the-book9", "/opt/Lib64/python3/Site-packages/x"]
#: Long candidates: random base-64, paths and words of thousands of parts, many matches in one text.
LONG = [base64.b64encode(random.Random(1).randbytes(22_500)).decode(), "ab/" * 5_000 + "+", "-aa" * 4_000, "A-" * 4_000, "x1y/" * 5_000, " ".join("0123456789abcdef" * 2 for _ in range(700))]


def test_spans(spark):
    data = [x[:2] for x in nasty.rows()] + [(100 + i, t) for i, t in enumerate(MORE)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "doc_id long, text string, spans string, m int")
    rows = ss.scan(df).select("doc_id", "text", ss.spans_text(ss.F.col("base_spans")).alias("b"), ss.spans_text(ss.F.col("spans")).alias("s")).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert (r.b, r.s) == brute(r.text), r.text


def test_long_candidates(spark):
    assert brute("ab/" * 100)[1] == "" and brute(MORE[-3])[1] and not brute(MORE[-2])[1] and not brute(MORE[-1])[1]
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    began = time.perf_counter()
    rows = ss.scan(df).select("text", ss.spans_text(ss.F.col("base_spans")).alias("b"), ss.spans_text(ss.F.col("spans")).alias("s")).collect()
    assert time.perf_counter() - began < 30 and len(rows) == len(LONG)
    for r in rows:
        assert (r.b, r.s) == brute(r.text)


def test_classes_have_limits_of_their_own():
    r = random.Random(4)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ss.ALPHABET[:62]):
        found = sum("entropy" in brute(draw(letters, 24))[1] for _ in range(300))
        assert found >= 280, letters


def test_redaction_takes_overlaps_as_one(spark):
    df = spark.createDataFrame([(1, "x token = " + "0123456789abcdef" * 2 + " y"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ss.redact(ss.scan(df)).collect()}
    assert got == {1: "x [SECRET] y", 2: None, 3: "plain"}


def test_empty_table_and_native_plan(spark):
    assert ss.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    plan = ss.scan(nasty.table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
