import random
import re
from collections import Counter

from shelfspark.llm import quality_rules as q

from . import nasty


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    r = random.Random(1)
    more = [(500 + i, "".join(r.choice("ab #\n\t\x0b") for _ in range(r.randint(0, 300))), "en", "a", 0, *nasty.EXTRA) for i in range(150)]
    rows = q.counts(nasty.table(spark, nasty.rows() + more)).collect()
    assert len(rows) == len(nasty.rows()) + 150
    for x in rows:
        assert tuple(x[c] for c in q.COUNTS) == brute(x.text), x.text


def test_junk_goes_and_clean_documents_stay(spark):
    r = random.Random(2)
    clean = [(i, nasty.prose(r, r.randint(50, 400)), "en", f"s{i % 4}", 0, *nasty.EXTRA) for i in range(1200)]
    junk = [(5000 + i, " ".join(w + "###" for w in nasty.prose(r, 120).split()), "en", "s1", 0, *nasty.EXTRA) for i in range(90)]
    counted = q.counts(nasty.table(spark, clean + junk)).cache()
    kept = {x.doc_id: x.kept for x in q.judge(counted, q.thresholds(counted)).collect()}
    assert sum(kept[x[0]] for x in clean) == len(clean)
    assert not any(kept[x[0]] for x in junk)


def test_nulls_and_empty_table(spark):
    counted = q.counts(nasty.table(spark)).cache()
    rows = q.judge(counted, q.thresholds(counted)).collect()
    assert len(rows) == len(nasty.rows()) and all(x.kept is not None for x in rows)
    none = q.counts(nasty.table(spark, []))
    assert q.judge(none, q.thresholds(none)).collect() == []


def test_sources_with_other_habits_get_other_thresholds(spark):
    r = random.Random(7)
    mark = lambda text, many: " ".join(w + "#" * (r.random() < many) for w in text.split())
    code = [(i, mark(nasty.prose(r, 200), r.uniform(0.5, 0.7)), "en", "code", 0, *nasty.EXTRA) for i in range(500)]
    prose = [(1000 + i, nasty.prose(r, 200), "en", "prose", 0, *nasty.EXTRA) for i in range(500)]
    marked = [(2000 + i, mark(nasty.prose(r, 200), 0.4), "en", "prose", 0, *nasty.EXTRA) for i in range(20)]
    dense = [(3000 + i, mark(nasty.prose(r, 200), 1.0) + " #" * 500, "en", "code", 0, *nasty.EXTRA) for i in range(20)]
    counted = q.counts(nasty.table(spark, code + prose + marked + dense)).cache()
    limits = {x.source: x.most_symbol_rate for x in q.thresholds(counted).collect()}
    assert limits["prose"] < 200 < 700 < limits["code"]
    kept = {x.doc_id: x.kept for x in q.judge(counted, q.thresholds(counted)).collect()}
    # no one cut-off does this: 40 % of marks are too many for prose, 70 % are not for code
    assert all(kept[x[0]] for x in code + prose) and not any(kept[x[0]] for x in marked + dense)


def test_sketches_merge_and_tell_quantiles_within_a_32nd(spark):
    r = random.Random(9)
    values = [int(r.paretovariate(0.7) * 50) for _ in range(3000)] + [0, 1, 63, 64, 65, 2**40, 2**62 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    edge = {x.v: x.bin for x in df.select("v", q.bin_of(q.F.col("v")).alias("bin")).collect()}
    assert all(e <= v and v - e <= e / 32 for v, e in edge.items())
    assert len({q_ for v, q_ in edge.items()}) < 1900 and all(edge[v] == v for v in edge if v < 64)
    parts = [spark.createDataFrame([(s, "symbol_rate", edge[v], 1) for v in values[k::3]], "source string, feature string, bin long, n long") for k, s in enumerate("abc")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("feature", "bin").agg(q.F.sum("n").alias("n"))
    got = q.quantiles(merged).collect()[0]
    ordered = sorted(values)
    for p, v in ((25, got.lo), (75, got.hi)):
        true = ordered[-(-len(values) * p // 100) - 1]
        assert v <= true and true - v <= v / 32 + 1
