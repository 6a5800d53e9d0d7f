"""Quality rules, mixing, secrets and chat formatting on odd inputs and against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quadrat.llm import chat, mixing, quality, secrets

from .helpers import DOCS, WORD, docs_of, odd_docs


# quality


def brute_stats(text):
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + i for k, x in enumerate(windows) if windows.count(x) > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", "a b c a b c", "ß x  y", "a a a a", "x\n\nx\n x\ny|#", "a b c d a b c", "\x0bq\x0cq q"])
def test_quality_stats(text):
    assert quality._stats(quality.Text(text)) == brute_stats(text)


def test_quality_cascade_is_the_conjunction(spark):
    good = " ".join(f"w{k}" for k in range(80))
    df = docs_of(spark, [(1, good), (2, "few words"), (3, "a b c " * 40), (4, "# " * 80 + good), (5, None), (6, ""), (1, good)]).withColumn("kept", F.lit("old"))
    kept = sorted(r.doc_id for r in quality.cascade(df).where("kept").collect())
    assert kept == [1, 1]
    for order in (quality.RULES, quality.RULES[::-1]):
        got = quality.cascade(df, order=list(order)).where("kept").count()
        assert got == 2
    assert set(quality.estimate(df)) <= {r.name for r in quality.RULES}
    assert quality.cascade(odd_docs(spark)).count() == 11
    assert quality.cascade(odd_docs(spark).limit(0)).count() == 0


def test_quality_order_is_rejection_per_cost():
    r = quality.RULES[:3]
    m = {r[0].name: (1.0, 0.1), r[1].name: (10.0, 0.2), r[2].name: (0.1, 0.1)}
    assert [x.name for x in quality.ordered(r, m)] == [r[2].name, r[0].name, r[1].name]


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]] if total else []
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def mixed_docs(spark):
    rows = [(k, "w " * (1 + k * k % 37), ["b", "a", "c", None, "d"][k % 5]) for k in range(400)]
    rows += [(k, "w " * 3, "hot") for k in range(1000, 2000)] + [(3000, None, "void"), (None, "w w", "a")]
    return docs_of(spark, rows)


def test_mixing_targets_and_taken(spark):
    df = mixed_docs(spark)
    r = mixing.repetitions(df).select("row.source", "size", "target", "source_size", "reps").collect()
    sizes = {}
    for x in r:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    want = brute_targets(sizes)
    for s, n in sizes.items():
        own = [x for x in r if x.source == s]
        assert own[0].source_size == n and own[0].target == pytest.approx(want[s])
        taken = sum(x["size"] * x.reps for x in own)
        assert abs(taken - want[s]) <= max(x["size"] for x in own)
        assert all(0 <= x.reps <= 2 for x in own)
    again = mixing.repetitions(df.repartition(7)).select("row.doc_id", "reps")
    assert again.exceptAll(mixing.repetitions(df).select("row.doc_id", "reps")).count() == 0


def test_mix_keeps_columns_and_odd_rows(spark):
    df = mixed_docs(spark).withColumn("size", F.lit("x")).withColumn("reps", F.lit(9)).withColumn("d", F.lit(1)).withColumn("key", F.lit(2))
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert mixing.repetitions(odd_docs(spark)).count() == 11
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


# secrets


def test_secret_rules_and_positions(spark):
    key = "AKIA" + "ABCDEFGH" * 2
    texts = {1: f'é PASSWORD = "hunter2hunter2" {key}', 2: "deadbeefdeadbeef0 deadbeef", 3: None, 4: "", 5: "token:short api-key='abcdefabcdefabcdef'", 6: "secret: password=abcdefghijkl"}
    df = docs_of(spark, list(texts.items()))
    ledger = secrets.update(df)
    got = {r.row.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.report(df, ledger).collect()}
    for k, t in texts.items():
        want = []
        for n, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, t or "", re.A):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    want.append((m.start(), n, m.end(), rule.kind))
        assert got[k] == [(kind, a, b) for a, _, b, kind in sorted(want)]
    assert got[1][0] == ("assign", 2, 28) and ("access", 30, 50) in got[1]


def test_ledger_scans_only_what_is_unseen(spark):
    first = docs_of(spark, [(1, "token=abcdefabcdef1"), (2, "token=abcdefabcdef1"), (3, None)])
    ledger = secrets.update(first)
    n = len(secrets.RULES)
    assert ledger.count() == 2 * n  # two blobs
    ledger.write.format("noop").mode("overwrite").save()
    ledger = spark.createDataFrame(ledger.collect(), secrets.LEDGER)
    second = first.union(docs_of(spark, [(4, "AKIA" + "A" * 20)]))
    assert secrets.update(second, ledger).count() == n
    newer = (secrets.Rule("hex", 2, r"[0-9a-f]+", 0, 8), *secrets.RULES[:2])
    fresh = secrets.update(second, ledger, rules=newer).collect()
    assert sorted((r.kind, r.version) for r in fresh).count(("hex", 2)) == 3 and len(fresh) == 3 + 2
    found = secrets.report(second, ledger.union(secrets.update(second, ledger)))
    assert {r.row.doc_id: len(r.findings) for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    both = ledger.union(spark.createDataFrame(fresh, secrets.LEDGER))
    assert {f.kind for r in secrets.report(second, both, rules=newer).collect() for f in r.findings} >= {"access"}


def test_secrets_on_odd_rows(spark):
    df = odd_docs(spark).withColumn("blob", F.lit("x")).withColumn("findings", F.lit(1))
    assert secrets.report(df, secrets.update(df)).count() == 11
    empty = df.limit(0)
    assert secrets.update(empty).count() == 0 and secrets.report(empty, secrets.update(empty)).count() == 0


# chat


def test_chat_round_trip_and_examples(spark):
    nasty = ["</turn>", "\\b\\l\\g <turn user>", "\\### Assistant: </turn> ok", "", None, "é<>\\\\l", "a\nb"]
    rows = [(1, k, "assistant" if k % 2 else "us<er>\\", t) for k, t in enumerate(nasty)] + [(2, 0, "user", "only"), (None, 5, None, "x"), (3, None, "assistant", "n"), (3, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("k", F.lit(1))
    f = chat.format_chats(df)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.t] for r in f.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert parsed[1] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert parsed[None] == [("", "x")] and len(parsed[3]) == 2
    ex = chat.examples(f).orderBy("conv_id", "example").collect()
    own = [e for e in ex if e.conv_id == 1]
    plain = lambda s: s.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")
    assert [plain(e.target) for e in own] == [nasty[1], nasty[3], nasty[5]]
    whole = {r.conv_id: r.formatted for r in f.collect()}
    for e in own:
        assert whole[1].startswith(e.prompt + e.target + "</turn>") and len(e.prompt) == e.loss_start and len(e.target) == e.loss_n
        assert e.prompt.endswith("<turn assistant>")
    assert [e.prompt.count("</turn>") for e in own] == [1, 3, 5]
    assert not [e for e in ex if e.conv_id in (2, None)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query_reads_back(spark, tmp_path):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 2, "assistant", None), (4, 0, "user", "long " * 20_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 4, -7} and got[1].n_turns == 3
    assert got[1].turns_sha256 == sha("user\none\nassistant\ntwo\nassistant\n\n") and got[1].loss_sha256 == sha("two")
    assert got[-7].loss_sha256 == sha(chat.PROBE) and got[-7].loss_chars == len(chat.PROBE)


def test_chat_plan_is_native(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = chat.op5_chat(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


assert DOCS
