"""Secrets beside ordinary words, and the battery against a plain computation of its statistics."""

import math
import random
import string
from collections import Counter

from pyspark.sql import functions as F

from estatelake.llm import secrets

WORDS = """account settings profile notifications callback users orders products images static assets public private archive
    download upload report summary details history invoice payment shipping address customer support article comment""".split()
SIGNS = string.ascii_letters + string.digits


def test_secrets_behind_paths_are_found(spark):
    rng = random.Random(5)
    paths = ["/".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9))) for _ in range(2000)]
    keys = ["".join(rng.choice(SIGNS) for _ in range(24)) for _ in range(200)]
    rows = [(i, f"see {p} for more") for i, p in enumerate(paths)]
    rows += [(5000 + i, f"see account/settings/profile/notifications/callback/{k} for more") for i, k in enumerate(keys)]
    rows += [(6000 + i, f"see {rng.choice(WORDS)}_{k}-{rng.choice(WORDS)}/{rng.choice(WORDS)} for more") for i, k in enumerate(keys)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    texts = dict(rows)
    held = lambda i, k: any(k in texts[i][s.start : s.end] for s in got[i])
    assert sum(held(5000 + i, k) for i, k in enumerate(keys)) >= 190 <= sum(held(6000 + i, k) for i, k in enumerate(keys))
    assert sum(bool(got[i]) for i in range(2000)) <= 10
    for spans in got.values():
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_a_token_or_its_pieces_stand(spark):
    rows = [
        ("a", 0, 60, True, 1e-9), ("a", 10, 40, False, 1e-8), ("b", 0, 60, True, 1e-4), ("b", 5, 30, False, 1e-9), ("b", 35, 60, False, 1e-3),
        ("c", 5, 30, False, 1e-5), ("c", 40, 70, True, 0.0), ("c", 40, 60, False, 0.0), ("d", 0, 30, True, 1e-5), ("d", 40, 70, True, 1e-5),
    ]
    found = spark.createDataFrame(rows, "k string, start int, end int, whole boolean, p double")
    got = sorted((r.k, r.start, r.end) for r in secrets.strongest(found, ["k"]).collect())
    assert got == [("a", 0, 60), ("b", 5, 30), ("b", 35, 60), ("c", 5, 30), ("c", 40, 70), ("d", 0, 30), ("d", 40, 70)]


def plain(token, size):
    n, counts = len(token), Counter(token)
    squares = sum(o * o for o in counts.values())
    s2 = max(secrets.TEXT_COINCIDENCE, secrets.TEXT_OVER_UNIFORM / size)
    s3 = secrets.TEXT_CUBES * s2 * s2
    spread = math.sqrt(2 / (n * (n - 1)) * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2)))
    uniform = (s2 - (squares - n) / (n * (n - 1))) / spread
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" for c in token if c.isalnum()]
    pairs = max(len(kinds) - 1, 1)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    q = secrets.TEXT_CHANGES
    runs = (changes - pairs * q) / math.sqrt(pairs * q * (1 - q))
    marks = [c in "aeiouAEIOU" for c in token]
    share = sum(marks) / n
    turns = sum(a != b for a, b in zip(marks, marks[1:]))
    serial = 1 - turns / ((n - 1) * 2 * share * (1 - share)) if 0 < share < 1 else secrets.TEXT_SERIAL
    z = (uniform + runs + min((serial - secrets.TEXT_SERIAL) * math.sqrt(n), 3.0)) / math.sqrt(3)
    return size / n * squares - n, math.erfc(z / math.sqrt(2)) / 2


def test_battery_equals_plain_computation(spark):
    rng = random.Random(6)
    tokens = ["".join(rng.choice(SIGNS + "+/") for _ in range(rng.randint(20, 90))) for _ in range(150)]
    tokens += ["/".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9))) for _ in range(150)]
    tokens += ["".join(rng.choice("0123456789abcdef") for _ in range(30)) for _ in range(50)] + ["a" * 30, "eb" * 20, "ABC2" * 8]
    frame = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    for r in secrets.battery(frame).select("token", "encoding", "size", F.col("chi_squared"), "p").collect():
        chi, p = plain(r.token, r.size)
        assert abs(r.chi_squared - chi) < 1e-6 and abs(r.p - p) < 1e-6, r
