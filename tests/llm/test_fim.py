import hashlib
import re

import pytest

from loomgraph.llm import fim


def brute(doc_id, text, plan=fim.Plan()):
    text = text or ""
    units = re.findall(plan.unit, text)
    h = hashlib.sha256(f"{plan.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h3 % 100 >= plan.changed:
        return n, "plain", text, None, None
    if h4 % 100 < plan.suffix_first:
        return n, "spm", plan.suffix + c + plan.prefix + a + plan.middle + b, len(a), len(b)
    return n, "psm", plan.prefix + a + plan.suffix + c + plan.middle + b, len(a), len(b)


TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb\n", "ünï\n日本\n🙂🙂\n" * 3, "x <P> y\nz", "<S>", "a\n<M>", "<P", "a<\n<S\nb<", "line\n" * 5000, "x" * 200_000 + "\ny"]
SCHEMA = "doc_id long, text string, form string, row long, k1 string, nth int"


def run(spark, rows, plan=fim.Plan()):
    df = spark.createDataFrame([(*r, "f", 1, "k", 2) for r in rows], SCHEMA)
    out, new = fim.fill_in_middle(df, plan=plan)
    assert out.columns == [*df.columns, *new.values()] and len({c.lower() for c in out.columns}) == len(out.columns)
    out = out.withColumn("back", fim.restored(out[new["form"]], out[new["output"]], plan))
    return [(r["doc_id"], r["text"], (r[new["n"]], r[new["form"]], r[new["output"]], r[new["prefix_chars"]], r[new["middle_chars"]]), r["back"]) for r in out.collect()]


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(unit=r"\S+\s*|\s+", seed="x", changed=60, suffix_first=20, prefix="[|", suffix="|]", middle="||")])
def test_brute_force(spark, plan):
    rows = [(i * 10 + j, t) for i, t in enumerate(TEXTS) for j in range(6)] + [(None, t) for t in TEXTS] + [(7, "same\nrow\n")] * 9 + [(None, "twice\n")] * 2 + [(-3, "a\nb\n")]
    got = run(spark, rows, plan)
    assert sorted((str(i), str(t)) for i, t, *_ in got) == sorted((str(i), str(t)) for i, t in rows)
    for doc_id, text, made, back in got:
        assert made == brute(doc_id, text, plan), (doc_id, text)
        assert back == (text or "")
    assert {m[1] for *_, m, _ in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_texts_are_exchanged_once(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    out, _ = fim.fill_in_middle(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
