"""Spans of personal data against plain regular expressions and hand-made cases."""

import hashlib
import random
import re

from auditflow.llm.private_data import ADDED, BASE, find_private, luhn, mod97, summary
from auditflow.llm.queries import QUERIES
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and passes_luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = summary(find_private(df)).orderBy("doc_id").collect()
    return [r.asDict() for r in rows]


def check(spark, texts):
    for text, row in zip(texts, found(spark, texts), strict=True):
        base = plain_base(text)
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest(), text
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in base) for k in PLAIN]
        kept = [s for s in row["spans"].split(",") if s and s.split(":")[0] in PLAIN]
        assert kept == [f"{k}:{a}:{b}" for a, _, b, k in base]


def test_base_matches_plain_patterns(spark):
    pick = random.Random(3)
    alphabets = ["ab1.@-_", "12.@+a ", "0123456789 -", "+12() .-9", "é😀a@b.1-+ ", "A9 4-"]
    texts = ["".join(pick.choice(pick.choice(alphabets)) for _ in range(pick.randrange(80))) for _ in range(400)]
    texts += ["".join(pick.choice(a) for _ in range(pick.randrange(120))) for a in alphabets for _ in range(60)]
    check(spark, texts)


def test_whole_table(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, texts)
    assert sum(r["n_email"] + r["n_card"] + r["n_ip"] + r["n_phone"] for r in found(spark, texts)) > 5


def test_long_runs_and_many_matches(spark):
    many = " ".join(f"user{i}@mail.example.com 10.0.{i % 300}.1 é" for i in range(3_000))
    runs = ["{}@", "1" * 3, "x@{}z", "1.2.", "+1{}"]
    fills = ["a.b", "1", "y.", "1.2.", " ("]
    short = [run.format(fill * 500) if "{" in run else fill * 500 for run, fill in zip(runs, fills, strict=True)]
    check(spark, [*short, many])
    long = [run.format(fill * 100_000) if "{" in run else fill * 100_000 for run, fill in zip(runs, fills, strict=True)]
    # A plain pattern takes time with the square of these runs.
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found(spark, long)] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 50_000, 0, 0), (0, 0, 0, 0)]


def test_checksums(spark):
    digits = ["4111111111111111", "4111111111111112", "0", "5", "79927398713", ""]
    rows = spark.createDataFrame([(d,) for d in digits], "d string").select(luhn(F.col("d")).alias("x")).collect()
    assert [r["x"] for r in rows] == [passes_luhn(d) and bool(d) for d in digits]
    accounts = ["GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "NO9386011117947"]
    rows = spark.createDataFrame([(a,) for a in accounts], "a string").select(mod97(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in rows] == [True, True, False, True]


def test_added_kinds_need_a_checksum_free_ends_or_a_word(spark):
    texts = [
        "IBAN: DE89 3704 0044 0532 0130 00.", "xDE89370400440532013000", "DE89370400440532013001", "GB82WEST12345698765432 é",
        "4111111111111111 4111111111111111", "41111111111111114111111111111111", "4111 1111-1111 1111",
        "my visa is 4222222222222", "4222222222222 is a number", "SSN 123-45-6789", "part 123-45-6789", "ssn 000-12-3456", "tax id 123-45-6789-1",
    ]
    spans = [(r["spans"], r["scores"]) for r in found(spark, texts)]
    assert spans == [
        ("iban:6:33", "100"), ("", ""), ("", ""), ("iban:0:22", "90"),
        ("card_group:0:16,card_group:17:33", "70,70"), ("", ""), ("card:0:19", "80"),
        ("card_short:11:24", "60"), ("", ""), ("ssn:4:15", "90"), ("", ""), ("", ""), ("", ""),
    ]


def test_context_raises_the_score_of_base_kinds(spark):
    rows = found(spark, ["call +1 (555) 010-0000 now", "+1 (555) 010-0000", "server 10.0.0.1 or mail a@b.cd"])
    assert [r["scores"] for r in rows] == ["100", "70", "90,100"]


def test_order_by_start_then_kind(spark):
    (row,) = found(spark, ["1.2.3.4@x.yz"])
    assert row["spans"] == "email:0:12,ip:0:7"


def test_awkward_rows(spark, awkward, no_rows):
    df = awkward.withColumn("spans", F.lit("clash")).withColumn("matches", F.lit("clash"))
    got = find_private(df)
    assert got.columns == df.columns
    assert got.count() == awkward.count()
    check(spark, [r["text"] for r in awkward.collect()])
    assert find_private(no_rows).count() == 0


def test_no_python_on_executors(spark, sf_dir):
    plan = QUERIES["op13_private_data"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_ranks_are_places(spark):
    kinds = [k.name for k in BASE + ADDED]
    rows = spark.createDataFrame([(1, "a@b.cd, 10.0.0.1, GB82WEST12345698765432")], "doc_id long, text string")
    assert [(s["kind"], s["rank"]) for s in find_private(rows).first()["spans"]] == [(k, kinds.index(k)) for k in ("email", "ip", "iban")]
