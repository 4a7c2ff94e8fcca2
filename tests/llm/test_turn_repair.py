"""Conversation repair against a search over all edits, on odd rows and on conversations that lie in many partitions."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from twinspark.llm import queries, turn_repair

COLUMNS = "conv_id long, turn long, role string, text string, part string, n int, symbol string"


def plainly(rows):
    """{conv_id: report} by a search in order of cost, then of the edits so far."""
    as_text = lambda x: " " if x is None else x
    of = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept = of[conv]
        code = zlib.crc32(f"{as_text(conv)}:{as_text(turn)}".encode()) % 20
        role, text = "user" if code == 4 else as_text(role), as_text(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {conv: repaired(kept) for conv, kept in of.items()}


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        for r in (r for r in ("user", "assistant") if r[0] in follows[last]):
            heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], (*lines, r + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, role + ":" + text)))
                for r in (r for r in ("user", "assistant") if r[0] in follows[last]):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r[0], (*lines, r + ":" + text)))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd():
    rng = random.Random(1)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.choice([0, 1, 2, 5, 30])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["A.", "B!", "c", "d?", " ", None, "", "e. \n", "f"])))
    for k in range(1500):  # a conversation with over half of all rows
        rows.append((7, k, rng.choice(["user", "assistant", "assistant", "system"]), f"t{k if k % 7 else 3}" + rng.choice([".", "", " x" * 2000 if k % 500 == 0 else ""])))
    rows += [(7, 5, "user", "same.")] * 300
    # No row of these is left after damage.
    rows += [(conv, turn, "user", "x.") for conv in range(1000, 1400) for turn in (0,) if zlib.crc32(f"{conv}:{turn}".encode()) % 20 == 0]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 3, None) for r in rows], COLUMNS)


def by_id(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 4, 33])
def test_same_as_search(spark, partitions):
    rows, before = odd(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_id(turn_repair.repair_conversations(turn_repair.damaged(frame(spark, rows).repartition(5))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plainly(rows)
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, v in got.items() if (k or 0) >= 1000)


def test_costs_of_runs_compose():
    """Wherever a row of turns is cut, the products of the parts give the costs of the whole."""
    rng = random.Random(3)
    unit = [tuple(0.0 if s == t else turn_repair.INFINITE for s in range(4)) for t in range(4)]
    for _ in range(50):
        symbols = [rng.randrange(-1, 9) for _ in range(rng.randrange(1, 40))]
        whole = turn_repair.costs_to_go(symbols, turn_repair.AT_END)
        k = rng.randrange(len(symbols) + 1)
        after = turn_repair.costs_to_go(symbols[k:], turn_repair.AT_END)
        assert turn_repair.costs_to_go(symbols[:k], after) == whole
        product = [turn_repair.costs_to_go(symbols[:k], u) for u in unit]
        assert tuple(min(product[t][s] + after[t] for t in range(4)) for s in range(4)) == whole


def test_no_rows_and_ids_that_are_strings(spark):
    empty = turn_repair.damaged(frame(spark, odd()).where("false"))
    assert turn_repair.repair_conversations(empty).count() == 0
    rows = [(f"c{c}", t, "user", "Yes.") for c in range(5) for t in range(4)]
    got = by_id(turn_repair.repair_conversations(turn_repair.damaged(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))))
    assert got == plainly(rows)


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert by_id(queries.QUERIES["op11_turn_repair"](spark, folder)) == plainly(map(tuple, rows))
