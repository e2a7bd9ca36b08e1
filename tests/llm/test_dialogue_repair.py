"""Repaired conversations against a search over all edits, conversations that are cut by partitions, and the odd
cases of the docstring."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import duckdb
import pytest

from rankweave.llm import dialogue_repair as dr
from rankweave.llm import queries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, seg int, copies string, fault string, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Cost and audit by trying every edit, insertions included, up to the best cost so far."""
    best = (4 * len(rows), "D" * len(rows))

    def walk(i, made, cost, audit):
        nonlocal best
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", made):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            best = min(best, (cost, audit))
        if cost + 3 <= best[0]:
            for letter in "ua":
                walk(i, made + letter, cost + 3, audit + "I")
        if i < len(rows):
            walk(i + 1, made, cost + 4, audit + "D")
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] == "truncated" else 0
                walk(i + 1, made + (rows[i][2][:1] or "?"), cost + late, audit + "K")
                for letter in "ua":
                    walk(i + 1, made + letter, cost + 3 + late, audit + "R")

    walk(0, "", 0, "")
    return best


def plain(rows):
    out = {}
    changed = damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in changed if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            stripped = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(own, faults)
        pairs = [own[k][2][:1] + own[k + 1][2][:1] for k in range(len(own) - 1)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made(own, audit)).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in dr.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def made(rows, audit):
    """Rows by an audit: whatever isn't kept takes the role that must come next."""
    out, i = [], 0
    for letter in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((due, ""))
            continue
        if letter != "D":
            out.append((rows[i][2] if letter == "K" else due, rows[i][3]))
        i += 1
    return out


def found(verdicts):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in verdicts.collect()}


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "umbrella"], ["Yes.", "no", " ", None, "Why?\n ", "ok!", ""]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.5 else rng.choice(roles)
            rows.append((c if c else None, rng.choice([None, t, t, t, t + 2]), role, rng.choice([f"Text {rng.randint(0, 9)}.", *texts])))
    return rows


@pytest.mark.parametrize("partitions", [2, 23])
def test_repairs_are_the_cheapest(spark, partitions):
    """With many partitions most conversations are cut."""
    rows = random_rows(partitions, 40, 6)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", partitions == 2)
    try:
        verdicts, faulty = dr.repair(dr.damaged(frame(spark, rows)))
        assert found(verdicts) == plain(rows)
        lines: dict = {}
        for r in sorted(dr.repaired_rows(faulty, verdicts).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["place"])):
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        shas = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}
        empty = hashlib.sha256(b"").hexdigest()
        assert {r["conv_id"]: r["repaired_sha256"] for r in verdicts.collect()} == {c: shas.get(c, empty) for c in plain(rows)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_one_conversation_over_all_partitions(spark):
    """Most rows in one conversation: its segments are parsed apart, and equal its parse as a whole."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"Line {rng.randint(0, 500)}{rng.choice(['.', '', '!'])}") for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in range(3, 12) if c != 7]
    verdicts, _ = dr.repair(dr.damaged(frame(spark, rows)))
    got = found(verdicts)[7]
    own = sorted((r for r in damage(rows) if r[0] == 7), key=lambda r: (r[1], r[2], r[3]))
    stack, seen = dr.Stack(dr.START, True), set()
    for _, _, role, text in own:
        stack.read(role, text, "blank" if not text.strip() else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add((role, text))
    assert got[-3:] == stack.ends()
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made(own, got[-2])).encode()).hexdigest() == got[-1]


def test_rows_repeated_many_times(spark):
    rows = [(1, 5, "user", "Same.")] * 400 + [(1, 6, "assistant", "Fine.")]
    verdicts, _ = dr.repair(dr.damaged(frame(spark, rows)))
    got, copies = found(verdicts)[1], len([r for r in damage(rows) if r[1] == 5])
    assert got[2] == copies - 1 and got[4] == copies - 1 and got[5] == 4 * (copies - 1) and got[6] == "K" + "D" * (copies - 1) + "K"


def test_empty_table_long_text_and_dropped_conversations(spark):
    assert found(dr.repair(dr.damaged(frame(spark, [])))[0]) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (1, 1, "user", "word " * 300_000 + "."), (1, 2, "assistant", "x" * 1_000_000 + ".")]
    assert found(dr.repair(dr.damaged(frame(spark, rows)))[0]) == plain(rows)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op13_dialogue_repair"]).fetchall()
    assert sorted(map(tuple, queries.op13_dialogue_repair(spark, SF).collect())) == sorted(want)
    assert len(list(groupby(sorted(w[0] for w in want)))) == len(want)
