import hashlib
import random
import re

import pytest

from gleaner.llm import repair
from tests import oracle

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired role:text) by trying all edits, best first; rows of (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] if r[2] is not None else " "))
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    stack = [(0, "", (), 0)]
    while stack:
        cost, audit, said, i = stack.pop()
        if best and cost > best[0]:
            continue
        if i == len(rows) and LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in said)):
            best = min(best or (cost, audit, said), (cost, audit, said))
        if not (audit.endswith("II") and audit[-3:-2] in ("", "I")) and cost + 2 <= 3 * len(rows):
            stack += [(cost + 2, audit + "I", (*said, (role, "")), i) for role in ("user", "assistant") if _prefix([*said, (role, "")])]
        if i < len(rows):
            _, role, text = rows[i]
            stack.append((cost + 3, audit + "D", said, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                options = [("K", 0, role)] + [("R", 2, r) for r in ("user", "assistant")]
                stack += [(cost + more + c, audit + e, (*said, (r, text)), i + 1) for e, c, r in options if _prefix([*said, (r, text)])]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, best[0], best[1], hashlib.sha256("\n".join(f"{r}:{x}" for r, x in best[2]).encode()).hexdigest()


def _prefix(said):
    return re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] or "-" for r, _ in said)) is not None


def conversations(n, most, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t, None, t + 2])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""])
            rows.append((c, turn, role, rng.choice(["Yes.", "No!", "and", "a b ", "", " \n", None, "Why?\n", f"Text {t}.", f"open {t}"])))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def of(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_all_edits_tried(spark):
    rows = conversations(60, 5)
    got = of(repair.audited(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    for c in {r[0] for r in rows}:
        assert got[c] == brute([r[1:] for r in rows if r[0] == c]), [r[1:] for r in rows if r[0] == c]


def test_segments_change_nothing(spark):
    """Conversations far over the bound, some of one role only, cut into many segments."""
    rng = random.Random(9)
    rows = conversations(12, 60, 4) + [(100, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no"]) + f" {t % 37}." * (t % 3)) for t in range(900)]
    rows += [(101, None, "user", "same") for _ in range(90)] + [(102, t, "assistant", f"x{t}") for t in range(90)] + [(103, t, "system", f"x{t}.") for t in range(90)] + [(None, 0, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert of(repair.audited(df, segment_rows=20)) == of(repair.audited(df))


def test_edits_hold_every_row_once_and_give_a_legal_conversation(spark):
    rows = conversations(40, 12, 8)
    edits = repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "segment", "step").collect()
    for c in range(40):
        own = [e for e in edits if e.conv_id == c]
        assert sorted(str((e.turn, e.was_role)) for e in own if e.edit != "I") == sorted(str((t, r if r is not None else " ")) for k, t, r, _ in rows if k == c)
        assert LEGAL.fullmatch("".join(e.role[:1] for e in own if e.edit != "D"))


def test_memory_is_of_undecided_rows_only():
    given = []
    walk = repair.Survivors(lambda *e: given.append(e))
    rng = random.Random(2)
    most = 0
    for k in range(20_000):
        walk.step((k,), rng.choice("uuaas"), rng.choice([None, None, "truncated", "duplicate"]))
        most = max(most, walk.undecided())
    assert most < 200 and len(given) > 19_000
    walk.finish()
    assert [e[1][0] for e in given if e[0] != "I"] == list(range(20_000))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_the_sqls(spark, sf):
    d = f"/root/testdata/{sf}"
    oracle.same(repair.op12_repair(spark, d), repair.REPAIR_SQL, oracle.connect(d))


def test_awkward_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audited(empty).collect() == repair.repaired(empty).collect() == []
    rows = [(1, 0, "user", "x" * 300_000), (None, None, None, None), (2, 1, "", "a."), (2, 1, "", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = of(repair.audited(df))
    assert got[1][5:7] == (3, "D") and got[None][:7] == (0, 1, 0, 0, 0, 3, "D") and got[2][2] == 1
    clash = df.withColumns({"segment": df["turn"], "again": df["text"], "entry": df["text"], "a.b": df["text"], "_conv_id": df["text"]})
    assert of(repair.audited(clash)) == got
    # A conversation all of whose rows the damage drops still has its row.
    gone = next(k for k in range(999) if spark.sql(f"SELECT crc32(CAST('{k}:0' AS binary)) % 20 = 0").first()[0])
    spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    r = repair.op12_repair(spark, str(tmp_path)).first()
    assert (r.conv_id, r.cost, r.audit, r.repaired_sha256) == (gone, 0, "", hashlib.sha256(b"").hexdigest())
