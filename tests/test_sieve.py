"""Required literals: never a match lost, and no detector run without need."""

import random
import re

from pyspark.sql import functions as F

from lorekeep.functions import redaction, sieve
from lorekeep.operators import ops


def test_literals_of_patterns():
    need = lambda p: (sorted(sieve.required(p)[0]), sieve.required(p)[1])
    assert need(r"abc\d+def?g") == (["abc"], False) and need(r"(ab|cde)x*") == (["ab", "cde"], False) and need(r"a?b*") == ([], False)
    assert need(r"(?:foo)+|x") == ([], False) and need(r"(?i)TOMATO\s") == (["tomato"], True) and need(r"(?i)spring") == ([], True)
    assert need(r"[ab]cd(?!ef)") == (["cd"], False) and need(r"(?:hello)?") == ([], False)
    assert {n: len(x[0]) for n, x in redaction.NEEDS.items()}["connection_string"] == 1


def test_no_match_is_lost():
    r = random.Random(4)
    parts = ["-----BEGIN RSA PRIVATE KEY-----", "x", "-----END RSA PRIVATE KEY-----", "AKIA" + "A" * 16, "LTAI" + "b" * 14, "eyJab.cd.ef", "Bearer ", "beaReR", "abcdefghijklmn", "db://u:p@h/x", "13812345678", "a@b.co", "h.corp", "10.0.0.1", "192.168.1.1", "172.16.0.3", " ", "\n", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        for name, pattern, _ in redaction.DETECTORS:
            if re.search(pattern, text):
                assert sieve.may_match(text, redaction.NEEDS[name]), (name, text)


def test_texts_without_literals_run_no_detector(monkeypatch):
    ran = []
    find = re.finditer
    monkeypatch.setattr(redaction.re, "finditer", lambda p, t: ran.append(p) or find(p, t))
    redaction.find("plain words without anything that tells of a secret", False)
    told = {p for n, p, _ in redaction.DETECTORS if not redaction.NEEDS[n][0]}
    assert set(ran) == told and len(told) < len(redaction.DETECTORS) / 2


def test_files_by_many_patterns(spark):
    r = random.Random(9)
    words = ["RedisTemplate", "spring.redis", "springxredis", "kafka", "KafkaTemplate", "apisix", "x", "Redisson", "redisson", None]
    rows = [("r", f"a{i}.md", " ".join(filter(None, r.choices(words, k=3))) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, file_path string, text string")
    for own, others in ops.COMPONENTS.values():
        for ps in (own, others, own + ["x?"]):
            assert ops.scan(df, ps).count() == df.where(F.col("text").rlike("|".join(f"({p})" for p in ps))).count()
