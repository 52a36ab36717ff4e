"""The randomness battery and its false-discovery control against a plain version, and on names from sources it wasn't made from."""

import math
import os
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from sabaki.llm import secrets


def upper(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token):
    return next((i for i, (_, p, _) in enumerate(secrets.ENCODINGS) if re.match(p, token)), None)


def score(token, alphabet):
    """Fisher's combination of the three tests, written out."""
    v = [alphabet.index(c) for c in token if c in alphabet]
    n, size = len(v), len(alphabet)
    bins = 3
    counts = [sum(x * bins // size == b for x in v) for b in range(bins)]
    df = bins - 1
    x = max(0.0, sum(c * c for c in counts) * bins / n - n)
    chi = upper((math.cbrt(x / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in token]
    m, each = len(kind), [kind.count(k) for k in "luds"]
    two, three = sum(k**2 for k in each), sum(k**3 for k in each)
    variance = (two * (two + m * (m + 1)) - 2 * m * three - m**3) / (m * m * (m - 1))
    turns = 1 + sum(a != b for a, b in zip(kind, kind[1:]))
    runs = min(1.0, 2 * upper(abs(turns - (m + 1 - two / m)) / math.sqrt(variance))) if variance > 1e-9 else 0.0
    centred = [a - sum(v) / n for a in v]
    spread = sum(c * c for c in centred)
    lagged = sum(a * b for a, b in zip(centred, centred[1:]))
    serial = min(1.0, 2 * upper(abs((lagged / spread + 1 / n) * math.sqrt(n)))) if spread else 0.0
    logs = -sum(math.log(max(p, 1e-300)) for p in (chi, runs, serial))
    return min(1.0, math.exp(-logs) * (1 + logs + logs * logs / 2))


def discovered(text, null):
    tried = []
    for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text):
        i = encoding(m[0])
        if i is not None:
            alphabet = secrets.ENCODINGS[i][2]
            s, others = score(m[0], alphabet), null[i, sum(len(m[0]) >= n for n in secrets.LENGTHS)]
            p = min(q for q in secrets.LEVELS if (1 + sum(o >= s for o in others)) / (1 + len(others)) <= q + 1e-12)
            tried.append((p, sum(c in alphabet for c in m[0]), m.start(), m.end()))
    mean = sum(n for _, n, _, _ in tried) / max(1, len(tried))
    ranked = sorted((p * mean / n, a, b) for p, n, a, b in tried)
    last = max((k for k, (w, _, _) in enumerate(ranked, 1) if w <= k * secrets.FDR / len(ranked) + 1e-12), default=0)
    return sorted((a, b) for _, a, b in ranked[:last])


def random_token(draw, i, n):
    while True:
        token = "".join(draw.choice(secrets.ENCODINGS[i][2]) for _ in range(n))
        if encoding(token) == i:
            return token


def test_battery_is_the_plain_one(spark):
    names = secrets.natural_tokens()
    assert len(names) == secrets.NATURAL * len(secrets.ENCODINGS) * len(secrets.LENGTHS) and names == secrets.natural_tokens()
    null = {}
    for t in names:
        i = encoding(t)
        null.setdefault((i, sum(len(t) >= n for n in secrets.LENGTHS)), []).append(score(t, secrets.ENCODINGS[i][2]))
    assert {len(v) for v in null.values()} == {secrets.NATURAL}
    draw = random.Random(12)
    texts = ["", "no tokens", "a1" * 40, "A" * 30 + "2" * 30, "a" * 25 + "1"]
    for _ in range(120):
        tokens = draw.sample(names, draw.randrange(0, 6)) + [random_token(draw, draw.randrange(len(secrets.ENCODINGS)), draw.randrange(20, 70)) for _ in range(draw.randrange(0, 4))]
        draw.shuffle(tokens)
        texts.append(" ; ".join(tokens))
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.sort_array("random").alias("r"))
    got = {r.doc_id: [(s.start, s.end) for s in r.r] for r in found.collect()}
    assert got == {i: discovered(t, null) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 50


def shares(spark, tokens):
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    return found.select(F.avg((F.size("random") > 0).cast("int"))).first()[0]


def test_names_stay_and_random_tokens_go(spark):
    """Names are identifiers in the standard library's sources, from which the null distribution wasn't made (its UUIDs and numbers are no names)."""
    names = set()
    for path in sorted(Path(os.__file__).parent.rglob("*.py")):
        for t in re.findall("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", path.read_text(encoding="utf-8", errors="ignore")):
            if encoding(t) is not None and t.isidentifier() and not re.search("[0-9a-f]{24,}", t):
                names.add(t)
    share = shares(spark, sorted(names))
    print(len(names), "names, reported:", share)
    assert len(names) > 20 and share <= 0.15
    draw = random.Random(3)
    for n, least in ((20, 0.7), (28, 0.93), (40, 0.97), (60, 0.99)):
        for i in range(len(secrets.ENCODINGS)):
            share = shares(spark, [random_token(draw, i, n) for _ in range(150)])
            print(secrets.ENCODINGS[i][0], n, "reported:", share)
            assert share >= least
