"""Random runs longer than all but a few natural words."""

import random

from pyspark.sql import functions as F

from motionloom.llm import secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SHORT = "the of and with from into about people water house garden little between morning".split()
LONG = "understanding international communication approximately representative organisation circumstances nevertheless responsibility characteristic".split()


def spans(spark, rows):
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written(F.concat("base", "found")).alias("spans"))
    return {r["doc_id"]: r["spans"] for r in found.collect()}


def key(rng, n):
    """A random key that does not happen to look uneven (a share of real keys does and is not to be found)."""
    while True:
        text = "".join(rng.choice(ALNUM) for _ in range(n))
        data = secrets.np.frombuffer(text.encode(), secrets.np.uint8)
        if any(c.isdigit() for c in text) and secrets.randomness(secrets._B64[data], secrets.np.array([0]), secrets.np.array([n]), 64)[0] > -1:
            return text


def test_keys_beyond_the_natural_words(spark):
    rng = random.Random(12)
    prose = [" ".join(rng.choice(LONG if rng.random() < 0.3 else SHORT) for _ in range(100)) for _ in range(60)]
    rows = [(i, t + (" counterrevolutionaries electroencephalographically" if i < 3 else "")) for i, t in enumerate(prose)]
    keys = {100 + 10 * n + i: key(rng, n) for n in (24, 32, 40, 64) for i in range(3)}
    got = spans(spark, rows + [(d, f"see {k} there") for d, k in keys.items()] + [(90, "draft-of-version-2-of-the-report-by-all")])
    assert {d: got[d] for d in keys} == {d: f"random:4:{4 + len(k)}" for d, k in keys.items()}
    assert all(s == "" for d, s in got.items() if d not in keys)


def test_few_long_words_are_pooled_with_shorter_ones():
    cell = lambda length, score: int(secrets.cells(2, secrets.np.array([length]), secrets.np.array([score]))[0])
    natural, maybe = {cell(24, -9.0): 5, cell(20, -8.0): 10, cell(16, -6.0): 500}, {cell(32, -0.3): 4, cell(32, -7.0): 1}
    assert secrets.accepted(natural, maybe) == [cell(32, -0.3)]
    assert secrets.accepted({}, maybe) == [] and secrets.accepted({cell(24, -9.0): 5}, maybe) == []


def test_runs_without_digits_or_beyond_a_base_span(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(LONG if rng.random() < 0.3 else SHORT) for _ in range(100))) for i in range(60)]
    letters = "".join(rng.choice(ALNUM[:52]) for _ in range(40))
    mixed = "Zk9QwXv7TgLm2RsB" + "3f8a1c94e07b5d62a9c41e7f"  # the hex rule matches its end alone
    digits = "31415926535897932384"  # under the 24 of the hex rule
    got = spans(spark, [*rows, (100, letters), (102, "password=abcdef1 x"), (103, mixed[16:]), (104, "abc-" * 12)])
    assert (got[100], got[102], got[103], got[104]) == ("random:0:40", "assign:0:16", "hex:0:24", "")
    scanned = next(secrets._scan(iter([secrets.pa.record_batch({"doc_id": [1, 2, 3], "text": [digits, mixed, mixed[16:]]})])))
    assert [[(x["start"], x["end"]) for x in m] for m in scanned["maybe"].to_pylist()] == [[(0, 20)], [(0, 40)], []]
